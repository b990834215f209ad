import random

import corpus_pipeline


def test_line_dedup_keeps_what_stands_nowhere_else(spark):
    rng = random.Random(4)
    shared = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(9)) for _ in range(9)]
    rows = [(1, "\n".join(shared)), (2, "\n".join([*shared, "own words of the second"])), (3, "\n".join([*shared, "", " "]))]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, df, "").collect()}
    assert got == {1: rows[0][1], 2: "own words of the second"}
