from tablewright.llm import queries


def test_exact_copies_of_short_lines_are_repeats(spark, tmp_path):
    rows = [(1, "Les.\nAnd so on.\n\nLes."), (2, "  Les.\nLas.\n\nAnd so on"), (3, "And so on.\t\n15 characters..\n16 characters..."), (4, "15 characters.,\n16 characters..,\n15 characters..")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_repeated, r.repeated_lines) for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (4, 1, [3]), 2: (4, 1, [0]), 3: (3, 1, [0]), 4: (3, 2, [1, 2])}
