import random
import time
from collections import defaultdict

import pytest

from tablewright.llm import common, line_dedup
from test_line_dedup import distance


def lines_of(spark, rng, n):
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(16, 40))) for _ in range(8)] + ["a heading that all pages have, number 1"]
    found = set()
    while len(found) < n:
        line = rng.choice(base)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(line))
            line = line[:at] + rng.choice(["", "x", "yy"]) + line[at + rng.randint(0, 1) :]
        if len(line) >= 16:
            found.add(line)
    return spark.createDataFrame(list(enumerate(sorted(found))), "node long, line string").repartition(4)


@pytest.mark.parametrize("hot", [False, True])
def test_pivots_of_keys_whether_hot_or_not(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "EVERY", 2)
    monkeypatch.setattr(line_dedup, "HOT_SEEN", 4 if hot else 10**9)
    monkeypatch.setattr(line_dedup, "SLICES", 3)
    lines = lines_of(spark, random.Random(3), 150)
    of_key = defaultdict(set)
    rows = lines.mapInArrow(line_dedup._keys(2, line_dedup.np.zeros(0, "int64")), line_dedup._KEY_ROWS).collect()
    for r in rows:
        assert r.slice == 0
        of_key[r.key].add((r.node, r.kind, r.mark))
    got = defaultdict(set)
    for r in line_dedup._with_pivots(lines, 2).collect():
        assert (r.pivot, 0, r.pivot_mark) in of_key[r.key]
        got[r.key, r.pivot].add((r.node, r.kind, r.mark))
    assert len({k for k, _ in got}) == len(got)
    for (key, pivot), found in got.items():
        assert found == {r for r in of_key[key] if r[0] != pivot}
    shared = {k for k, found in of_key.items() if any(kind == 0 for _, kind, _ in found) and len({n for n, _, _ in found}) > 1}
    assert {k for k, _ in got} == shared


@pytest.mark.parametrize("hot", [False, True])
def test_links_connect_what_is_near(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "EVERY", 3)
    monkeypatch.setattr(line_dedup, "HOT_SEEN", 3 if hot else 10**9)
    lines = lines_of(spark, random.Random(8), 120)
    texts = {r.node: r.line for r in lines.collect()}

    def parts(pairs):
        parent = {n: n for n in texts}
        for a, b in pairs:
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        out = {}
        for n in texts:
            r = n
            while parent[r] != r:
                r = parent[r]
            out[n] = r
        return out

    near = [(a, b) for a in texts for b in texts if a < b and distance(texts[a], texts[b]) <= line_dedup.allowed(max(len(texts[a]), len(texts[b])))]
    assert near and parts((r.a, r.b) for r in line_dedup.links(lines).collect()) == parts(near)


def test_key_rows_are_shuffled_once(spark, tmp_path):
    lines = lines_of(spark, random.Random(1), 100)
    lines.write.parquet(f"{tmp_path}/lines")
    found = line_dedup._with_pivots(spark.read.parquet(f"{tmp_path}/lines"), 2)
    found.write.mode("overwrite").parquet(f"{tmp_path}/met")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("SortMergeJoin") == 0
    assert plan.replace("ReusedExchange", "").count("Exchange hashpartitioning") <= 2


def test_written_tables_leave_no_shuffle_files(spark):
    before = spark.conf.get(common.CLEANUP)
    files_of = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    old = set(_list(files_of))
    df = spark.range(1000).selectExpr("id % 7 as k", "id").groupBy("k").agg({"id": "max"})
    assert common.written(df, "few").count() == 7
    assert spark.conf.get(common.CLEANUP) == before
    for _ in range(50):  # files go in the background
        new = [f for f in _list(files_of) if f not in old and f.endswith(".data") and "shuffle" in f]
        if len(new) <= 1:  # of the count itself
            return
        time.sleep(0.2)
    raise AssertionError(new)


def _list(manager):
    files = manager.getAllFiles()
    return [files.apply(i).getName() for i in range(files.size())]
