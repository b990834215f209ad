"""Rows whose number Spark cannot tell from the size of files are not broadcast, as the driver would hold them."""

import random

from tablewright.llm import components, jaccard, simhash
from test_jaccard import changed


def planned(monkeypatch, module):
    """By label, the plans of the tables that a module writes."""
    plans, own = {}, module.written

    def kept(df, label):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return own(df, label)

    monkeypatch.setattr(module, "written", kept)
    return plans


def test_keys_of_fingerprints_are_not_broadcast(spark, monkeypatch, tmp_path):
    plans, rng = planned(monkeypatch, simhash), random.Random(1)
    prints = [rng.randrange(1 << 62) for _ in range(40)]
    prints += [p ^ 5 for p in prints]
    spark.createDataFrame([(p,) for p in prints], "fp long").write.parquet(f"{tmp_path}/prints")
    got = simhash.links(spark.read.parquet(f"{tmp_path}/prints")).distinct().count()
    assert got >= 40 and not any("Broadcast" in p for p in plans["simhash-keys"])


def test_many_links_are_not_broadcast(spark, monkeypatch):
    plans = planned(monkeypatch, components)
    links = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    monkeypatch.setattr(components, "SMALL_LINKS", 10)
    assert {r.component for r in components.components(links).collect()} == {0}
    rounds = [p for p in plans["links"] if "Join" in p]
    assert rounds and not any("Broadcast" in p for p in rounds)


def test_rows_of_shingles_are_not_broadcast(spark, monkeypatch):
    plans, rng, rows = planned(monkeypatch, jaccard), random.Random(2), []
    for _ in range(10):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows += [(len(rows) + k, " ".join(changed(rng, words, k))) for k in range(3)]
    monkeypatch.setattr(jaccard, "SMALL_ROWS", 0)
    assert jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).count() == 10
    for label in ("similar-met", "similar-links"):
        assert plans[label] and not any("Broadcast" in p for p in plans[label]), label
