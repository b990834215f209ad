"""SQL twins of the queries that SQL can express."""

from tablewright.llm import chat, quality, vantage, variants, warc

_STOP = ", ".join(f"'{w}', '{w.capitalize()}'" for w in quality.STOP_WORDS)
_TESTS = " AND ".join(
    f"(CASE WHEN {r.per} > 0 THEN {r.counted}::DOUBLE / {r.per} ELSE 0 END) {'>=' if bound == r.low else '<='} {bound}"
    for r in quality.RULES
    for bound in (r.low, r.high)
    if bound is not None
)

QUALITY_RULES = rf"""
WITH w AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), places AS (
  SELECT row, unnest(words) AS a, unnest(range(1, len(words) + 1)) AS i FROM w
), followed AS (
  SELECT row, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM places WINDOW o AS (PARTITION BY row ORDER BY i)
), windows AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, a, b, c) AS found FROM followed WHERE c IS NOT NULL
), covered AS (
  SELECT row, count(DISTINCT i + k) AS n FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE found > 1 GROUP BY row
), counted AS (
  SELECT doc_id, len(words) AS n_words, length(list_aggregate(words, 'string_agg', '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    len(lines) AS n_lines, length(text) - length(replace(text, '!', '')) AS n_exclamations,
    len(list_filter(words, lambda x: x IN ({_STOP}))) AS n_stop_words,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullet_lines
  FROM w LEFT JOIN covered USING (row)
), base AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_TESTS} AS kept
FROM base
"""

WARC_REVISITS = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= {warc.MIN_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

_ESCAPES = " + ".join(f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in chat.CONTROLS)
_AROUND = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in chat.AROUND.items())

REPLY_TREES = f"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, CASE role {_AROUND} END + length(text) + length(text) - length(replace(text, '\\', '')) + {_ESCAPES} AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  ({len(chat.START)} + sum(chars))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def _crc_table() -> list[int]:
    """CRC-32 of every byte, by its polynomial."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in SQL."""
    digits = f"hex(encode({text}))"
    values = f"list_transform(range(length({digits}) // 2), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT)"
    step = f"lambda s, b: xor(s >> 8, list_extract({_crc_table()}::BIGINT[], (xor(s, b) & 255) + 1))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {values}), {step}), 4294967295)"


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


_FIELDS = ["doc_id", "source", "lang", "n_chars"]
_LEAF = "sha256(" + " || ".join(_field(f) for f in _FIELDS) + " || {text})"

MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT *, {_crc32("doc_id::VARCHAR")} % 5 = 0 AS tampered FROM documents
), hashed AS (
  SELECT doc_id, source, {_LEAF.format(text=_field("text"))} AS leaf,
    CASE WHEN tampered THEN {_LEAF.format(text=_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))} END AS changed
  FROM d
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM hashed
), low AS (
  SELECT 0 AS level, tree, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT level + 1, tree, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY level, tree, pos // 16, n
), subroots AS (
  SELECT tree, level AS height, digest FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM subroots) AS n, digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 16, n
), every AS (
  SELECT level, tree, pos, n, digest FROM low WHERE n > 1
  UNION ALL
  SELECT level + 1000, -1, pos, n, digest FROM high WHERE n > 1
), fold AS (
  SELECT row_number() OVER (ORDER BY tree, pos) AS row, CASE WHEN n > 1 THEN 0 ELSE 1000 END AS level, CASE WHEN n > 1 THEN tree ELSE -1 END AS inside, CASE WHEN n > 1 THEN pos ELSE tree END AS pos,
    tree, height, coalesce(changed, leaf) AS digest, ''::VARCHAR AS beside
  FROM placed JOIN subroots USING (tree)
  UNION ALL
  SELECT row, CASE WHEN inside >= 0 AND level + 1 = height THEN 1000 ELSE level + 1 END, CASE WHEN level + 1 = height THEN -1 ELSE inside END,
    CASE WHEN inside >= 0 AND level + 1 = height THEN tree ELSE pos // 16 END, tree, height, sha256(string_agg(value, '' ORDER BY place)),
    beside || coalesce(string_agg(value, '' ORDER BY place) FILTER (place <> pos), '')
  FROM (
    SELECT f.row, f.level, f.inside, f.pos, f.tree, f.height, f.beside, e.pos AS place, CASE WHEN e.pos = f.pos THEN f.digest ELSE e.digest END AS value
    FROM fold f JOIN every e ON e.level = f.level AND e.tree = f.inside AND e.pos // 16 = f.pos // 16
  )
  GROUP BY row, level, inside, pos, tree, height, beside
), ended AS (
  SELECT row, arg_max(digest, level) AS folded_root, arg_max(beside, level) AS beside FROM fold GROUP BY row
), numbered AS (
  SELECT row_number() OVER (ORDER BY tree, pos) AS row, doc_id, leaf, tree FROM placed JOIN subroots USING (tree)
), root AS (
  SELECT digest AS root FROM high WHERE n = 1
)
SELECT doc_id, leaf, digest AS subroot, root, sha256(beside) AS proof_sha256, folded_root, folded_root = root AS verified
FROM numbered JOIN ended USING (row) JOIN subroots USING (tree), root
"""

VANTAGE_POINTS = f"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), p AS (
  SELECT q.row, q.vec_id AS query_id, c.row AS other, c.vec_id, list_inner_product(q.x, c.x) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.row <> c.row AND len(q.x) = len(c.x)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id, other)::INTEGER AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {vantage.NEIGHBOURS}
"""

SPELLING_VARIANTS = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {variants.MIN_CHARS} GROUP BY doc_id, run
), marked AS (
  SELECT run, n, {_crc32("doc_id || ':' || run")} AS h FROM counted
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM marked GROUP BY 1 HAVING length(word) >= {variants.MIN_CHARS} AND sum(n) >= {variants.MIN_COUNT}
), cut AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
  UNION
  SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word
), near AS (
  SELECT p.word, count(*) AS n_near, arg_min(p.other, {{'less': -o.n, 'other': p.other}}) AS best, max(o.n) AS best_n
  FROM pairs p JOIN words o ON o.word = p.other GROUP BY p.word
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {variants.DOMINANCE} * n THEN best END AS form,
    CASE WHEN best_n >= {variants.DOMINANCE} * n THEN best_n END AS form_n
  FROM words LEFT JOIN near USING (word)
), chain AS (
  SELECT word, word AS last, 0 AS depth FROM words
  UNION ALL
  SELECT c.word, f.form, depth + 1 FROM chain c JOIN formed f ON f.word = c.last WHERE f.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(last, depth) AS root FROM chain GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
