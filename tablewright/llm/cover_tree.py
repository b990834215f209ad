"""Embedding near-duplicates: a cover tree built level by level, and its dual traversal."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablewright.llm.common import groups, meetings, small_batches, unsized, written
from tablewright.llm.components import components

COSINE = 0.93
#: A cell of more vectors is split, around at most so many centres found among a sample of about so many vectors.
LEAF, CENTRES, SAMPLE = 1024, 128, 1024
LEVELS = 14
#: Vectors of a tile of leaves; tiles that a leaf may have; vectors that a round of meetings moves at least, if there
#: are as many to move; and pairs of tiles that are broadcast at most.
TILE, PARTS, LEAST_ROUND, SMALL_PAIRS = 16384, 1 << 16, 1 << 17, 200_000
#: Vectors of a cell that a task puts to their centres.
SLICE = 20_000
#: Slack for rounding in bounds on distances.
SLACK = 1e-9


def linkable_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, key, vector): vectors as bytes of their own type, and SHA-256 of their unit vectors; null for those that link with nothing."""
    label, raw = rows.schema[label_col].dataType.simpleString(), _raw(rows, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vectors = [], []
            for vector, kind, own in zip(batch.column(2).to_pylist(), batch.column(1), batch.column(0)):
                key = data = None
                if vector and kind.is_valid and own.is_valid and None not in vector:
                    v = np.array(vector, np.float64)
                    largest = np.abs(v).max()
                    if np.isfinite(largest) and largest > 0:
                        v = v / largest
                        key, data = hashlib.sha256((v / np.sqrt(v @ v)).tobytes()).digest(), np.array(vector, raw).tobytes()
                keys.append(key)
                vectors.append(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], ["id", "label", "key", "vector"])

    return rows.select(id_col, label_col, vector_col).transform(small_batches).mapInArrow(run, f"id {rows.schema[id_col].dataType.simpleString()}, label {label}, key binary, vector binary")


def _raw(rows: DataFrame, vector_col: str) -> str:
    """The type that vectors travel in: that of the column, so that floats are not made twice their size."""
    return "<f4" if rows.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"


def _matrix(column: pa.ChunkedArray, raw: str = "<f8") -> np.ndarray:
    found = column.to_pylist()
    return np.frombuffer(b"".join(found), raw).reshape(len(found), -1)


def _units(column: pa.ChunkedArray, raw: str) -> np.ndarray:
    """Unit vectors of vectors."""
    found = _matrix(column, raw).astype(np.float64)
    found /= np.abs(found).max(axis=1, keepdims=True)
    return found / np.sqrt((found * found).sum(axis=1, keepdims=True))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows; the squares of their lengths need not be one, as a root's centre is the origin."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))


def _centres(radius: float, raw: str):
    """Of each cell's sample, vectors farther than ``radius`` from each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cell,), rows in groups(batches, ["cell"]):
            units, vectors = _units(rows["vector"], raw), rows["vector"].to_pylist()
            left, chosen = np.arange(len(units)), []
            while len(left) and len(chosen) < min(CENTRES, rows["most"][0].as_py()):
                chosen.append(int(left[0]))
                left = left[_distances(units[chosen[-1]][None], units[left])[0] > radius]
            columns = [pa.array(range(len(chosen)), pa.int64()), pa.array([vectors[c] for c in chosen], pa.binary()), pa.array([units[c].tobytes() for c in chosen], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([cell] * len(chosen)), *columns], ["cell", "id", "vector", "centre"])

    return run


def _assign(raw: str):
    """Each passing vector goes to the nearest of its cell's held centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cell, _), rows in groups(batches, ["cell", "slice"]):
            n = int((rows["side"].to_numpy() == 0).sum())
            centres, points = rows.slice(0, n), rows.slice(n)
            units, order = _units(centres["vector"], raw), centres["id"].to_pylist()
            for batch in points.to_batches(max_chunksize=2048):
                far = _distances(_units(pa.chunked_array([batch.column("vector")]), raw), units)
                near = far.argmin(axis=1)
                cells = [f"{cell}/{order[i]}" for i in near]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cells), pa.array(far[np.arange(len(near)), near])], ["id", "cell", "far"])

    return run


def _expand(reach: float):
    """Pairs of children that the covering radii leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (a, b, _, _), rows in groups(batches, ["a", "b", "block", "slice"]):
            n = int((rows["side"].to_numpy() == 0).sum())
            left, right = rows.slice(0, n), rows.slice(n)
            if not n or not len(right):
                continue
            apart = _distances(_matrix(left["centre"]), _matrix(right["centre"]))
            radii = left["radius"].to_numpy()[:, None] + right["radius"].to_numpy()[None, :]
            x, y = (np.array(t["cell"].to_pylist(), object) for t in (left, right))
            i, j = np.nonzero(apart - radii <= reach + SLACK)
            if a == b:
                once = x[i] <= y[j]
                i, j = i[once], j[once]
            ends = np.logical_and(left["leaf"].to_numpy(zero_copy_only=False)[i], right["leaf"].to_numpy(zero_copy_only=False)[j])
            # Both balls together no wider than the reach: all their vectors link. A cell meets itself at its own width.
            wide = np.where(x[i] == y[j], 0, apart[i, j]) + radii[i, j]
            arrays = [pa.array(x[i], pa.string()), pa.array(y[j], pa.string()), pa.array(ends), pa.array(wide <= reach - SLACK)]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "ends", "inside"])

    return run


def _connected(close: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int, int]]:
    """A chain over the rows and columns of each connected block of the matrix, as far as other points are reached."""
    found, rest = [], np.flatnonzero((close & (left[:, None] != right[None, :])).any(axis=1))
    while len(rest):
        rows, columns = np.zeros(len(left), bool), close[rest[0]].copy()
        rows[rest[0]] = True
        while True:
            more = close[:, columns].any(axis=1)
            wider = close[more].any(axis=0)
            if (more == rows).all() and (wider == columns).all():
                break
            rows, columns = more, wider
        first = int(left[rest[0]])
        found += [(first, int(x), 0) for x in np.concatenate([left[rows], right[columns]]) if x != first]
        rest = rest[~rows[rest]]
    return found


def _compare(cosine: float, raw: str):
    """Exact cosines of leaves' vectors in two tiles: rows with the weight linked to a vector, and links that connect them.

    A tile's rows are pairs of leaves (side 0), vectors of the one tile (1) and, if it is another, of the other (2).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (s, t), rows in groups(batches, ["s", "t"]):
            side = rows["side"].to_numpy()
            leaf, other = rows["leaf"].to_numpy()[side == 0], rows["other"].to_numpy()[side == 0]
            sides = []
            for k in (1, 2) if s != t else (1,):
                own = np.flatnonzero(side == k)
                own = own[np.argsort(rows["leaf"].to_numpy()[own], kind="stable")]
                part = rows.take(pa.array(own))
                units = _units(part["vector"], raw) if len(own) else np.zeros((0, 0))
                sides.append((part["leaf"].to_numpy(), part["id"].to_numpy(), part["weight"].to_numpy(), units, np.zeros(len(own), np.int64)))
            (xs, i, w, u, sums), (ys, j, v, units, others) = sides[0], sides[-1]
            found, order = [], np.lexsort((other, leaf))
            for part in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1) if len(order) else []:
                x, partners = leaf[part[0]], other[part]
                rows_of = np.arange(*np.searchsorted(xs, [x, x + 1]))
                if s == t and x in partners:
                    close = u[rows_of] @ u[rows_of].T >= cosine
                    np.fill_diagonal(close, True)  # a point links with itself, whatever its product is rounded to
                    sums[rows_of] += close @ w[rows_of]
                    found += _connected(close, i[rows_of], i[rows_of])
                    partners = partners[partners != x]
                columns = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b) for a, b in zip(np.searchsorted(ys, partners), np.searchsorted(ys, partners + 1)))])
                for at in range(0, len(rows_of), LEAF):
                    own = rows_of[at : at + LEAF]
                    for to in range(0, len(columns), 2 * LEAF):
                        its = columns[to : to + 2 * LEAF]
                        close = u[own] @ units[its].T >= cosine
                        if close.any():
                            sums[own] += close @ v[its]
                            others[its] += w[own] @ close
                            found += _connected(close, i[own], j[its])
            for ids, total in ((i, sums), (j, others))[: len(sides)]:
                found += [(x, None, n) for x, n in zip(ids[total > 0].tolist(), total[total > 0].tolist())]
            for k in range(0, len(found), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found[k : k + 8192])], ["id", "other", "weight"])

    return run


def build(vectors: DataFrame, reach: float, raw: str) -> tuple[DataFrame, DataFrame]:
    """(id, cell) of the vectors' leaves, and the tree's nodes: cell, parent, centre, radius, leaf.

    ``vectors`` has id, vector, cell (its root, whose centre is the origin). A cell of more than ``LEAF``
    vectors is split on every level around centres farther apart than the level's radius, which halves from level
    to level; a vector goes to the nearest centre. Centres come from a bounded sample, which decides the tree's shape
    only: the covering radius is the largest distance of the cell's own vectors. A cell whose vectors all link with
    each other is not split. What is written on a level tells a vector's cell by its id, without the vector.
    """
    width = f"cast(octet_length(vector) as int) * {8 // int(raw[-1])}"
    origin = F.expr(f"cast(repeat(decode(X'00', 'UTF-8'), {width}) as binary)")
    placed, nodes, here = vectors.select("id", "cell", F.lit(1.0).alias("far")), [], vectors.select("id", "vector", "cell")
    centres = vectors.groupBy("cell").agg(F.first(origin).alias("centre"))
    for level in range(1, LEVELS + 2):
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
        sizes = written(sizes.withColumn("split", (F.col("n") > LEAF) & (2 * F.col("radius") > reach - SLACK) & F.lit(level <= LEVELS)), "cover-cells")
        fresh = sizes.where(F.size(F.split("cell", "/")) == level).join(centres, "cell")
        nodes.append(fresh.select("cell", F.when(F.lit(level > 1), F.regexp_replace("cell", "/[^/]*$", "")).alias("parent"), "centre", "radius", (~F.col("split")).alias("leaf")))
        big = sizes.where("split").select("cell", "n")
        many = big.count()
        if not many:
            break
        if level > 1:
            here = vectors.select("id", "vector").join(placed.select("id", "cell").join(big.select("cell"), "cell", "left_semi"), "id")
        dealt = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 30))
        sample = here.join(big, "cell").where(dealt * F.col("n") < F.lit(SAMPLE << 30))
        sample = sample.select("cell", "vector", dealt.alias("order"), F.greatest(F.lit(4), F.ceil(4 * F.col("n") / LEAF)).cast("long").alias("most"))
        sample = sample.repartition("cell").sortWithinPartitions("cell", "order")
        found = written(sample.transform(small_batches).mapInArrow(_centres(2.0 ** (1 - level), raw), "cell string, id long, vector binary, centre binary"), "cover-centres")
        centres = found.select(F.concat("cell", F.lit("/"), "id").alias("cell"), "centre")
        # A cell's vectors are dealt to slices, each of which gets all its centres.
        slices = big.select("cell", F.ceil(F.col("n") / SLICE).alias("slices"))
        slices = F.broadcast(slices) if many <= SMALL_PAIRS else unsized(slices)
        held = found.join(slices, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("side"), "id", "vector")
        split = here.join(slices, "cell").select("cell", F.pmod(F.xxhash64("id"), "slices").alias("slice"), F.lit(1).alias("side"), "id", "vector")
        met = held.unionByName(split).repartition("cell", "slice").sortWithinPartitions("cell", "slice", "side")
        moved = met.transform(small_batches).mapInArrow(_assign(raw), "id long, cell string, far double")
        rest = placed.join(big.select("cell"), "cell", "left_anti")
        placed = written(rest.select("id", "cell", "far").unionByName(moved), "cover-points")
    return placed.select("id", "cell"), functools.reduce(DataFrame.unionByName, nodes)


def compare(vectors: DataFrame, placed: DataFrame, pairs: DataFrame, cosine: float, raw: str) -> DataFrame:
    """(id, other, weight): of the vectors (id, vector, weight) in pairs of leaves (a, b), the weight linked to each, and links.

    Leaves next to each other are put together in tiles of about ``TILE`` vectors, a larger leaf has tiles of its own.
    Two tiles that hold a pair of leaves meet in one task, so a vector travels once for each such tile, not for each
    leaf. Tiles meet in rounds, whose shuffle files go before the next: a round moves about half as many vectors as there are.
    """
    cells = placed.groupBy("cell").agg(F.count("*").alias("n")).withColumn("root", F.split("cell", "/")[0])
    cells = written(cells.coalesce(64).withColumn("leaf", F.monotonically_increasing_id()), "cover-leaves")
    before = Window.partitionBy("root").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # Tiles of many leaves are numbered by their first leaf, each tile of a larger leaf by the leaf and its own number.
    numbered = cells.withColumn("parts", F.ceil(F.col("n") / TILE)).withColumn("at", F.when(F.col("parts") > 1, F.lit(-1)).otherwise(F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / TILE)))
    first = F.when(F.col("parts") > 1, F.col("leaf")).otherwise(F.min("leaf").over(Window.partitionBy("root", "at")))
    leaves = written(numbered.select("cell", "leaf", "n", "parts", (first * PARTS).alias("tile")), "cover-tiles")
    tile = F.col("tile") + F.pmod(F.xxhash64("id"), "parts")
    where = placed.join(leaves, "cell").select("id", "leaf", tile.alias("tile"))
    dealt = written(vectors.select("id", "vector", "weight").join(where, "id"), "cover-vectors")
    sizes = written(dealt.groupBy("tile").agg(F.count("*").alias("n")), "cover-tile-sizes")

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    tiles = leaves.select("cell", "leaf", "tile", every.alias("part")).select("cell", "leaf", (F.col("tile") + F.col("part")).alias("tile"))
    both = pairs.join(tiles.toDF("a", "x", "s"), "a").join(tiles.toDF("b", "y", "t"), "b")
    # Of a leaf with itself each pair of tiles once; the smaller tile comes first, with its own leaf.
    both = both.where("a != b or s <= t").select("s", "t", F.when(F.expr("s <= t"), F.struct("s", "t", "x", "y")).otherwise(F.struct(F.col("t").alias("s"), F.col("s").alias("t"), F.col("y").alias("x"), F.col("x").alias("y"))).alias("p"))
    both = written(both.select("p.s", "p.t", F.col("p.x").alias("leaf"), F.col("p.y").alias("other")), "cover-open")
    met = both.select("s", "t").distinct().join(sizes.toDF("s", "m"), "s").join(sizes.toDF("t", "n"), "t")
    met = written(met.select("s", "t", F.when(F.expr("s = t"), F.col("m")).otherwise(F.expr("m + n")).alias("n")), "cover-meetings")
    total = F.coalesce(F.sum("n"), F.lit(0))
    (moved, many), (held,) = met.agg(total, F.count("*")).first(), sizes.agg(total).first()
    rounds = max(1, -(-moved // max(held // 2, LEAST_ROUND)))
    turn = F.pmod(F.xxhash64("s", "t"), F.lit(rounds))
    out = []
    for k in range(rounds):
        now = met.where(turn == k).select("s", "t")
        now = F.broadcast(now) if many <= SMALL_PAIRS else unsized(now)
        sides = [now.withColumns({"side": F.lit(1), "tile": F.col("s")}), now.where("s != t").withColumns({"side": F.lit(2), "tile": F.col("t")})]
        rows = [dealt.join(x, "tile").select("s", "t", "side", "leaf", F.lit(None).cast("long").alias("other"), "id", "weight", "vector") for x in sides]
        wanted = both.where(turn == k).select("s", "t", F.lit(0).alias("side"), "leaf", "other", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("weight"), F.lit(None).cast("binary").alias("vector"))
        rows = functools.reduce(DataFrame.unionByName, [*rows, wanted]).repartition("s", "t").sortWithinPartitions("s", "t", "side")
        out.append(written(rows.transform(small_batches).mapInArrow(_compare(cosine, raw), "id long, other long, weight long"), "vector-links"))
    return functools.reduce(DataFrame.unionByName, out)


def traverse(nodes: DataFrame, reach: float) -> DataFrame:
    """(a, b, inside): pairs of leaves that may hold linked vectors; ``inside`` if all of theirs link.

    Starts at the pairs of each root with itself and descends both sides at once, a leaf standing for its own child.
    A pair is dropped when its centres are farther apart than both covering radii and the reach.
    """
    shape = ["parent", "cell", "centre", "radius", "leaf"]
    below = nodes.where("parent is not null").select(shape).unionByName(nodes.where("leaf").withColumn("parent", F.col("cell")).select(shape))
    below = written(below, "cover-nodes")
    frontier = nodes.where("parent is null").select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    ended = []
    for _ in range(LEVELS + 2):
        left = frontier.join(below, F.col("a") == F.col("parent")).drop("parent")
        right = frontier.join(below, F.col("b") == F.col("parent")).drop("parent")
        met = meetings(left, right, ["a", "b"], "cell", 2048, 2048)
        found = written(met.transform(small_batches).mapInArrow(_expand(reach), "a string, b string, ends boolean, inside boolean"), "cover-pairs")
        ended.append(found.where("ends").select("a", "b", "inside"))
        frontier = found.where("not ends").select("a", "b")
        if not frontier.limit(1).count():
            break
    return functools.reduce(DataFrame.unionByName, ended)


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) for each row: cosines of at least ``cosine`` within a label.

    Equal unit vectors of a label are one point with a weight. Points have numbers of their own, so ids may be of any
    type that sorts and may repeat: each row has its own links, and rows of one id link only if their vectors do. A
    component goes by its smallest id. Vectors that are null, zero or hold a null or a non-finite component, vectors of
    other widths, and rows without label or without id, link with nothing; a row without id has no component and is kept. Rows that
    repeat link to each other. Other columns, whatever their names, are not read. No rows give none.
    """
    reach, raw = float(np.sqrt(2 - 2 * cosine)), _raw(rows, vector_col)
    vectors = linkable_vectors(rows, id_col, vector_col, label_col)
    classes = vectors.where("key is not null").groupBy("label", "key").agg(F.min("id").alias("first"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    # Numbered before the table is written, so that every reader sees the same numbers.
    classes = written(classes.select("label", "key", F.monotonically_increasing_id().alias("id"), "first", "weight", "vector"), "vector-classes")
    root = F.concat(F.hex(F.col("label").cast("string")), F.lit(":"), F.octet_length("vector").cast("string"))
    placed, nodes = build(classes.select("id", "vector", root.alias("cell")), reach, raw)
    pairs = written(traverse(nodes, reach), "cover-leaf-pairs")
    compared = compare(classes, placed, pairs.where("not inside").select("a", "b"), cosine, raw)

    points = placed.join(classes.select("id", "weight"), "id")
    cells = points.groupBy("cell").agg(F.min("id").alias("low"), F.sum("weight").alias("weight"))
    inside = pairs.where("inside").select("a", "b")
    both = inside.unionByName(inside.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    whole = both.join(cells, F.col("b") == F.col("cell")).select("a", "low", "weight")
    summed = whole.groupBy("a").agg(F.min("low").alias("other"), F.sum("weight").alias("weight"))
    by_cell = points.select("id", "cell").join(summed, F.col("cell") == F.col("a")).select("id", "other", "weight")
    cell_links = whole.join(cells.select(F.col("cell").alias("a"), F.col("low").alias("id")), "a").select("id", F.col("low").alias("other"))

    counted = compared.where("other is null").select("id", "weight").unionByName(by_cell.select("id", "weight")).groupBy("id").agg(F.sum("weight").alias("weight"))
    links = compared.where("other is not null").select("id", "other").unionByName(by_cell.select("id", "other")).unionByName(cell_links)
    groups_ = components(links, "id", "other")
    grouped = classes.select("label", "key", "id", "first").join(groups_, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    grouped = written(grouped.select("label", "key", "id", "first", "component"), "vector-groups")
    named = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    known = grouped.join(counted, "id", "left").join(named, "component")
    known = known.select("label", "key", (F.coalesce("weight", F.lit(1)) - 1).cast("long").alias("n_links"), "component_id")
    return vectors.select("id", "label", "key").join(known, ["label", "key"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
