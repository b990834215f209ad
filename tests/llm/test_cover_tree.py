import math

import numpy as np

from tablewright.llm import cover_tree, queries


def usable(row):
    key, vector, label = row[:3]
    return key is not None and label is not None and bool(vector) and None not in vector and all(map(math.isfinite, vector)) and any(vector)


def brute(rows, cosine=cover_tree.COSINE):
    """(id, links, component, kept) of each row, by comparing all rows."""
    units = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float) / max(map(abs, r[1]))) / max(map(abs, r[1])) if usable(r) else None for r in rows]
    near = [[] for _ in rows]
    for i, x in enumerate(units):
        for j, y in enumerate(units):
            if i != j and x is not None and y is not None and rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y >= cosine:
                near[i].append(j)
    out = []
    for i, row in enumerate(rows):
        reached, left = {i}, [i]
        while left:
            more = set(near[left.pop()]) - reached
            reached |= more
            left += more
        low = min((rows[k][0] for k in reached), default=None) if row[0] is not None else None
        out.append((row[0], len(near[i]), low, row[0] == low))
    return sorted(out, key=str)


def run(spark, rows, kind="long"):
    frame = spark.createDataFrame([(*r, "a", "b", 0) for r in rows], f"vec_id {kind}, embedding array<double>, label string, unit string, cell string, weight int").repartition(3)
    return sorted((tuple(r) for r in cover_tree.near_duplicates(frame).collect()), key=str)


def planted(n, width, seed, labels=("a/b", "c:1", "c")):
    """Groups about common directions, some wide enough to link in chains only."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 9, width))
    rows = []
    for i in range(n):
        spread = (0.0, 0.05, 0.2, 0.35)[i % 4]
        vector = centres[i % len(centres)] + spread * rng.normal(size=width)
        rows.append((i, (vector * (1 + i % 3)).tolist(), labels[i % len(centres) % 3]))
    return rows


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "LEAF", 16)
    monkeypatch.setattr(cover_tree, "SAMPLE", 24)
    rows = planted(260, 8, 3)
    want = brute(rows)
    assert sum(w[1] for w in want) > 500 and any(not w[3] for w in want)
    assert run(spark, rows) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, [1.0, 0.0], "y"), (4, [1.0, 0.0], None), (5, None, "x"), (6, [], "x"), (7, [0.0, 0.0], "x"),
        (8, [1.0, None], "x"), (9, [nan, 1.0], "x"), (10, [inf, 1.0], "x"), (None, [1.0, 0.0], "x"), (None, None, None), (11, [1.0, 0.0, 0.0], "x"),
        (12, [1e200, 1e199], "x"), (13, [1e-200, 1e-201], "x"), (1, [1.0, 0.0], "x"),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_repeated_ids_with_other_vectors(spark):
    rows = [(5, [1.0, 0.0], "x"), (5, [0.0, 1.0], "x"), (6, [1.0, 0.0], "x")]
    assert run(spark, rows) == [(5, 0, 5, True), (5, 1, 5, True), (6, 1, 5, False)] == brute(rows)


def test_text_ids(spark):
    rows = [("b", [1.0, 0.1], "x"), ("a10", [1.0, 0.0], "x"), ("a9", [0.0, 1.0], "x"), ("c", [1.0, 0.0], "x")]
    assert run(spark, rows, "string") == brute(rows)


def test_query_equals_brute_force(spark, tmp_path):
    rows = planted(120, 6, 8)
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.op10_cover_tree(spark, str(tmp_path))
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)
