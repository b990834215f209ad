import random

import corpus_pipeline
from tablewright.llm import jaccard
from tablewright.llm.simhash import fingerprint


def plain_kept(rows):
    """Ids that stay, by all pairs."""
    sets = [jaccard.shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if not a | b or 5 * len(a & b) >= 4 * len(a | b):
                parent[root(i)] = root(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), key), key)
    return sorted(low.values())


def changed(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return words


def test_similar_texts_have_a_common_prefix_hash():
    rng = random.Random(1)
    met = 0
    for _ in range(600):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(3, 150))]
        a, b = (jaccard.shingles(" ".join(w)) for w in (words, changed(rng, words, rng.randint(0, 5))))
        if jaccard.similar(a, b):
            met += 1
            x, y = jaccard.hashed(a), jaccard.hashed(b)
            assert set(jaccard.prefix(x)) & set(jaccard.prefix(y))
            apart = jaccard.most_apart(len(a), len(b))
            assert len(a ^ b) <= apart and jaccard.may_be_similar(jaccard.sketch(x).tobytes(), jaccard.sketch(y).tobytes(), apart)
            assert abs(jaccard.histogram(a) - jaccard.histogram(b)).sum() <= len(a ^ b)
        assert jaccard.similar(a, b) == (5 * len(a & b) >= 4 * len(a | b))
    assert met > 100


def test_stage_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HELD", 3)
    monkeypatch.setattr(jaccard, "PASSING", 4)
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(30)]
    rows = [(0, None), (1, ""), (2, "two words"), (3, "Two  words")]
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(20, 120))] + passage * (i % 3 > 0)
        for _ in range(rng.choice([1, 1, 2, 6])):
            rows.append((len(rows), " ".join(words)))
            words = changed(rng, words, rng.randint(0, 3))
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert got == plain_kept(rows)
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").count() == 0


def test_stage_links_copies_far_apart_in_bits(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    other = list(words)
    for at in (20, 80, 140):
        other[at] = "changed"
    a, b = " ".join(words), " ".join(other)
    assert jaccard.similar(jaccard.shingles(a), jaccard.shingles(b))
    assert bin((fingerprint(a, 5) ^ fingerprint(b, 5)) % (1 << 64)).count("1") > 4
    df = spark.createDataFrame([(1, a, "en", "s", 0), (2, b, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()] == [1]


def test_sketches_differ_by_no_more_than_the_sets():
    rng = random.Random(4)
    for _ in range(200):
        sets = []
        for n in (rng.randint(1, 3000), rng.randint(1, 3000)):
            sets.append({str(rng.randrange(4000)).encode() for _ in range(n)})
        x, y = (jaccard.sketch(jaccard.hashed(s)) for s in sets)
        size = min(len(x), len(y))
        apart = sum(bin(int(i) ^ int(j)).count("1") for i, j in zip(jaccard.folded(x, size), jaccard.folded(y, size)))
        assert apart <= len(sets[0] ^ sets[1])
        assert jaccard.may_be_similar(x.tobytes(), y.tobytes(), apart) and not jaccard.may_be_similar(x.tobytes(), y.tobytes(), apart - 1)


def test_fine_sketches_differ_by_no_more_than_the_sets():
    rng = random.Random(5)
    for n in (1, 40, 300, 3000):
        a = {str(rng.randrange(10**9)).encode() for _ in range(n)}
        b = set(list(a)[n // 4 :]) | {str(rng.randrange(10**9)).encode() for _ in range(n // 4)}
        x, y = (jaccard.fine_sketch(jaccard.hashed(v)) for v in (a, b))
        assert len(x) * 8 >= jaccard.FINE_LEAST
        assert jaccard.may_be_similar(x.tobytes(), y.tobytes(), len(a ^ b))
        # Nearly as far apart as the sets are, so a quarter of other shingles is told from a tenth.
        assert n < 40 or not jaccard.may_be_similar(x.tobytes(), y.tobytes(), jaccard.most_apart(len(a), len(b)))


def test_chains_beyond_the_pivots(spark, monkeypatch):
    """Texts each similar to the next alone, so that no pivot reaches them all, under many common keys."""
    for name, value in {"PIVOTS": 2, "HELD": 2, "PASSING": 3, "SKETCHES_HELD": 3, "SKETCHES_PASSING": 4, "FINE_HELD": 3, "FINE_PASSING": 4, "SMALL_ROWS": 5}.items():
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(6)
    words, rows = [f"w{i}" for i in range(100)], []
    for i in range(40):
        rows.append((i, " ".join(words)))
        at = 7 * i % 90
        words = words[:at] + [f"n{rng.randrange(10**6)}" for _ in range(6)] + words[at + 6 :]
    for i in range(20):  # a common passage, and too much of their own
        rows.append((100 + i, " ".join([f"w{j}" for j in range(40)] + [f"o{rng.randrange(10**6)}" for _ in range(40)])))
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert got == plain_kept(rows)
    assert len(got) < 30
