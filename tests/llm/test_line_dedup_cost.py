import hashlib

from tablewright.llm import line_dedup


def test_lines_are_numbered_and_named_without_python_or_text(spark, monkeypatch):
    plans, write = {}, line_dedup.written

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(line_dedup, "written", noted)
    lines = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(40)] + ["a line that comes again and again"] * 3
    docs = spark.createDataFrame([(i, f"{line}\n{line}  \né") for i, line in enumerate(lines)], "doc_id long, text string").repartition(3)
    got = {r.id: r.places for r in line_dedup.repeated_lines(docs).collect()}
    assert got == {i: [1, *[2] * (i > 0)] if i <= 40 else [0, 1, 2] for i in range(43)}
    assert "MapIn" not in plans["lines"] and "md5" not in plans["line-classes"]
