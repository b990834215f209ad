import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import vantage


def frame(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"vec_id {kind}, embedding array<double>, shard int, size string, row string")


def brute(rows, k, asked):
    good = [(i, r[0], r[1]) for i, r in enumerate(rows) if r[0] is not None and r[1] and None not in r[1] and all(map(math.isfinite, r[1])) and any(r[1])]
    out = []
    for i, q, x in good:
        if asked(q):
            found = []
            for j, c, y in good:
                if i != j and len(x) == len(y):
                    score = 0.0
                    for a, b in zip(x, y):
                        score += a * b
                    found.append((-score, c))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(sorted(found)[:k])]
    return sorted(out)


def run(spark, rows, k=5, kind="long", asked=None, **options):
    options = {"shard": 60, "leaf": 8, "block": 20} | options
    asked = F.col("vec_id") % 3 == 0 if asked is None else asked
    return sorted(tuple(r) for r in vantage.nearest(frame(spark, rows, kind), asked, k, **options).collect())


def scattered(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    return [(i, (centres[i % 12] + 0.2 * rng.normal(size=width)).tolist(), 1, "x", "y") for i in range(n)]


def test_factor_one_is_exact(spark):
    rows = scattered(400, 8, 1)
    assert run(spark, rows) == brute(rows, 5, lambda q: q % 3 == 0)


def test_odd_vectors_ties_and_repeats(spark):
    rng = np.random.default_rng(2)
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 0.0], [math.inf, 0.0, 0.0], [math.nan, 1.0, 1.0], [1e-200, 0.0, 0.0], [2.0, 2.0], [1.0]]
    rows = [(i, v, None, None, None) for i, v in enumerate(odd)] + [(None, [1.0, 1.0, 1.0], 1, "a", "b")]
    # Small whole numbers: very many equal products and equal vectors, and ids that repeat.
    rows += [(int(rng.integers(0, 90)), [float(x) for x in rng.integers(-1, 2, 3)], 1, "a", "b") for _ in range(300)]
    rows += [(500 + i, [1.0, 1.0, 0.0], 1, "a", "b") for i in range(80)]
    assert run(spark, rows) == brute(rows, 5, lambda q: q % 3 == 0)


def test_fewer_candidates_than_asked_for(spark):
    rows = [(0, [1.0, 0.0], 1, "a", "b"), (1, [0.5, 0.5], 1, "a", "b")]
    assert run(spark, rows) == [(0, 1, 1, 0.5)]
    assert run(spark, rows[:1]) == [] and run(spark, []) == []


def test_text_ids(spark):
    rows = [(str(i), v, *rest) for i, v, *rest in scattered(60, 4, 3)]
    asked = F.col("vec_id").endswith("0")
    assert run(spark, rows, kind="string", asked=asked) == brute(rows, 5, lambda q: q.endswith("0"))


@pytest.mark.parametrize("factor", [1.0, 1.1])
def test_relaxed_pruning_finds_most(spark, factor):
    rows = scattered(600, 6, 4)
    exact = vantage.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, 10, shard=300, leaf=16)
    found = vantage.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, 10, factor=factor, shard=300, leaf=16)
    share = vantage.recall(found, exact)
    assert share == 1 if factor == 1 else share >= 0.9


def test_a_larger_factor_compares_less():
    points = np.array([r[1] for r in scattered(3000, 4, 5)])
    order, nodes = vantage.grow(np.column_stack([points, np.sqrt((points**2).sum(1).max() - (points**2).sum(1))]), 32)
    work = []
    for factor in (1.0, 2.0):
        search = vantage.Search(points[order], order, order, nodes, points[:50], np.arange(50), 5, factor)
        search.run()
        work.append(search.compared)
    assert work[1] < work[0] < 50 * 3000
