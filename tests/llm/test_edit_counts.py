import random

import public_tokenizers

from tablewright.llm import bpe, edit_counts, queries

ENCODER = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def plain_count(text):
    return len(ENCODER._encoding.encode_ordinary(text))


def random_edits(rng, text):
    places = sorted(rng.randint(0, len(text)) for _ in range(2 * rng.randint(0, 4)))
    return [(a, b, rng.choice(["", " ", "x", "'s", "\n\n", " new words here", "a b c d " * 20])) for a, b in zip(places[::2], places[1::2])]


def replaced(text, edits):
    for a, b, new in sorted(edits, reverse=True):
        text = text[:a] + new + text[b:]
    return text


def test_random_edits_count_like_whole_texts(odd_texts):
    rng = random.Random(1)
    texts = [t or "" for t in odd_texts] + [" ".join(rng.choice(["the", "of", "don't", "x1", "é"]) for _ in range(400))] * 40
    for text in texts:
        doc = edit_counts.Counted(text, ENCODER, leaf=16)
        assert doc.tokens == plain_count(text) and sum(doc.chars) == len(text)
        for _ in range(4):
            edits = random_edits(rng, doc.text)
            want = replaced(doc.text, edits)
            doc.edit(edits)
            assert doc.text == want and doc.tokens == plain_count(want) and sum(doc.chars) == len(want)
            assert doc.tree == edit_counts.grow(doc.tree[len(doc.tree) // 2 :][: len(doc.chars)])


def test_small_edits_encode_little():
    text = "one two three four " * 5000
    doc = edit_counts.Counted(text, ENCODER)
    doc.encoded = 0
    doc.edit([(50_000, 50_003, "five")])
    assert doc.tokens == plain_count(doc.text) and doc.encoded < 4 * edit_counts.LEAF


def test_tables(spark, odd_texts):
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(odd_texts)], "doc_id long, text string, n_edits string")
    edits = spark.createDataFrame([(3, 0, 1, "b c"), (3, 1, 1, None), (999, 0, 0, "x")], "doc_id long, start long, end long, text string")
    got = {r.doc_id: r for r in edit_counts.apply(edit_counts.attach(edit_counts.count(docs), edits)).collect()}
    assert len(got) == len(odd_texts)
    for i, t in enumerate(odd_texts):
        assert got[i].tokens_before == plain_count(t or "")
        assert (got[i].n_edits, got[i].text) == ((2, "b c") if i == 3 else (0, t))
    assert got[3].tokens_after == plain_count("b c")
    assert edit_counts.apply(edit_counts.attach(edit_counts.count(docs.limit(0)), edits)).count() == 0


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op7_edit_counts(spark, sf_dir).collect()
    assert len(got) == len(texts) and any(r.n_edits for r in got)
    for r in got:
        edits, end = [], 0
        for a, b, new in sorted((m.start(), m.end(), new) for p, new in edit_counts.REDACTIONS for m in p.finditer(texts[r.doc_id])):
            if a >= end:
                edits.append((a, b, new))
                end = b
        assert r.n_edits == len(edits) and r.tokens_before == plain_count(texts[r.doc_id])
        assert r.tokens_after == plain_count(replaced(texts[r.doc_id], edits))
