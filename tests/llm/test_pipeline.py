import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tablewright.llm import line_dedup
from test_line_dedup import brute
from test_jaccard import plain_kept

WORDS = "the of and to in is that it for on was be stone river garden window letter market winter silver candle forest".split()


def documents(rng):
    rows = []
    for i in range(40):
        lines = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(8, 20))) for _ in range(6)]
        if i % 8 == 5:
            lines = rows[-1][1].split("\n")[:3] + lines
        if i % 8 == 7:
            lines = rows[-1][1].split("\n")
        rows.append((i, "\n".join(lines)))
    junk = [(100, "too short"), (101, None), (102, " ".join(["w###"] * 90)), (103, "the cat sat " * 60), (104, " ".join(f"ZZ{i}!!" for i in range(80)))]
    return rows + junk


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = documents(random.Random(9))
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    good = [(k, t) for k, t in rows if k < 100]
    kept = {k: t for k, t in brute(good).items() if t == dict(good)[k] or len(t) >= corpus_pipeline.MIN_KEPT * len(dict(good)[k])}
    want = {k: kept[k] for k in plain_kept(list(kept.items()))}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
    found = {r.doc_id: r.text for r in docs.collect()}
    assert found == want and all(r.n_chars == len(r.text) for r in docs.collect())

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = Counter()
    for r in pieces:
        got[r.doc_id] += r.length
        ids = [*whole.encode(want[r.doc_id], add_special_tokens=False).ids, 0]
        assert bytes(r.ids) == np.array(ids[r.start : r.start + r.length], "<u4").tobytes() and zlib.crc32(r.ids)
    assert got == {k: len(whole.encode(t, add_special_tokens=False).ids) + 1 for k, t in want.items()}


def test_stages_on_odd_rows(spark, tmp_path, odd_texts):
    text = documents(random.Random(3))[0][1]
    rows = [(i, t, None, None, None) for i, t in enumerate(odd_texts)] + [(None, text, "en", "s", 1), (None, text, "en", "s", 1), (700, text + " of", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.doc_id is None for r in pieces) >= 1
    # All lines of document 700 are another's but for the last, which is three edits from one: more than its length
    # allows. A document goes only when no line with words is left, so it stays with that line.
    assert {r.doc_tokens for r in pieces if r.doc_id == 700} == {len(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text.split("\n")[-1] + " of", add_special_tokens=False).ids) + 1}
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert line_dedup.allowed(15) == 0
