import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tablewright.llm import merkle

FIELDS = ["doc_id", "source", "text"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Levels from the nodes up to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return levels


def climb(levels, i, value):
    """The root with another node ``i``, and the siblings on the way."""
    beside = ""
    for level in levels[:-1]:
        start = i // 16 * 16
        run = level[start : start + 16]
        beside += "".join(run[: i - start] + run[i - start + 1 :])
        run[i - start] = value
        value, i = digest("".join(run)), i // 16
    return value, beside


def brute(rows, change):
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    groups = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for g in groups:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append(tree([leaf(r) for r in by[g]]))
    top, out = tree([t[-1][0] for t in trees]), []
    for place, (g, levels) in enumerate(zip(groups, trees)):
        for i, row in enumerate(by[g]):
            changed = leaf((*row[:2], change(row)))
            value, beside = climb(levels, i, changed)
            folded, above = climb(top, place, value)
            root = top[-1][0]
            out.append((row[0], leaf(row), levels[-1][0], root, digest(beside + above), folded, folded == root))
    return out


def run(spark, rows, extra=False):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    if extra:
        for c in ("key", "pos", "n", "digest", "block", "replaced", "root", "leaf", "path"):
            docs = docs.withColumn(c, F.lit(1))
    changed = F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    found = merkle.manifest(docs, FIELDS, {"text": changed})
    return [tuple(r) for r in found.collect()]


def change(row):
    return row[2].lower() if row[0] is not None and row[0] % 3 == 0 and row[2] is not None else row[2]


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("size", [1, 2, 16, 17, 33])
def test_one_group(spark, size):
    rows = [(i, "a", f"Text {i}") for i in range(size)]
    assert order(run(spark, rows)) == order(brute(rows, change))


def test_odd_rows_and_clashing_names(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", "a", "é", "日本", "B"]), rng.choice([None, "", "Ab", "É" * 9, "X" * 50_000])) for _ in range(150)]
    rows += rows[:9] * 3  # repeated rows
    assert order(run(spark, rows, extra=True)) == order(brute(rows, change))


def test_many_groups(spark):
    rows = [(i, f"s{i % 300}", f"T{i}") for i in range(700)]
    assert order(run(spark, rows)) == order(brute(rows, change))


def test_blocks_above_blocks(spark):
    """A group of more nodes than a block holds, beside ones that end below."""
    rows = [(i, "hot" if i % 10 else f"s{i % 7}", f"T{i}") for i in range(9000)]
    assert order(run(spark, rows)) == order(brute(rows, change))


def test_no_rows(spark):
    assert run(spark, []) == []


def test_fold_reads_from_the_state_before_the_child():
    children = [digest(str(i)).encode() for i in range(16)]
    node = merkle.Node(children)
    for slot in range(16):
        other = [*children]
        other[slot] = digest("x").encode()
        assert node.fold(slot, other[slot]) == merkle.Node(other).digest
