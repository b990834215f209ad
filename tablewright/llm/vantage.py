"""Nearest neighbours by inner product: a vantage-point tree for each shard, searched by blocks of queries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.llm.common import groups, small_batches, written

NEIGHBOURS = 20
#: A subtree is passed by once its bound times this is beyond the nearest found; one finds every neighbour.
FACTOR = 1.0
#: Vectors of a shard, of a leaf, and queries of a block, at most about so many.
SHARD, LEAF, BLOCK = 8192, 128, 2048
#: Slack for rounding in products and bounds, as a share of the lengths.
SLACK = 1e-9


def grow(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points and the tree over it: rows of vantage point, start, middle, end, inner and outer child, radius.

    The first point of a node's range is its vantage point; the others follow by distance from it, those before the
    middle within the radius. Leaves have no children (-1). The vantage point is that farthest from the range's mean,
    which spreads the distances.
    """
    order, nodes = np.arange(len(points)), []

    def add(start: int, end: int) -> int:
        at = len(nodes)
        if end - start <= leaf:
            nodes.append((start, start, end, end, -1, -1, 0.0))
            return at
        part = order[start:end]
        centre = points[part].mean(axis=0)
        first = int(((points[part] - centre) ** 2).sum(axis=1).argmax())
        part[0], part[first] = part[first], part[0]
        far = np.sqrt(((points[part[1:]] - points[part[0]]) ** 2).sum(axis=1))
        by = np.argsort(far, kind="stable")
        order[start:end] = np.concatenate([part[:1], part[1:][by]])
        middle = start + 1 + len(by) // 2
        nodes.append(None)
        inner, outer = add(start + 1, middle), add(middle, end)
        nodes[at] = (start, start, middle, end, inner, outer, float(far[by[len(by) // 2 - 1]]))
        return at

    add(0, len(points))
    return order, np.array(nodes, np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first component to the last, whatever the machine's libraries do."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


class Search:
    """Searches one tree for a block of queries, keeping for each query the best (score, id) seen."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, nodes: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, factor: float):
        self.points, self.ids, self.rows, self.nodes = points, ids, rows, nodes
        self.queries, self.own, self.k, self.factor = queries, own, k, factor
        # Points lifted to one length: what is nearest to a query among them has the largest inner product with it.
        self.scale = np.abs(points).max()
        small = points / self.scale
        squares = (small * small).sum(axis=1)
        self.lifted = np.column_stack([small, np.sqrt(np.maximum(squares.max() - squares, 0))])
        self.reach = squares.max()
        self.size = np.abs(queries).max(axis=1)
        self.small = queries / self.size[:, None]
        self.length = (self.small * self.small).sum(axis=1)
        self.slack = SLACK * (1 + np.sqrt(self.length * self.reach))
        self.least = np.full(len(queries), -np.inf)  # the k-th largest scaled product so far
        self.best = np.zeros((4, 0))  # query, score, place of the point, scaled product
        self.seen = np.full(len(queries), -1)
        self.compared = 0

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, place of the point and score of everything found, best first within a query."""
        every = np.arange(len(self.queries))
        self._near(0, every)
        self._rest(0, every)
        return self.best[0].astype(int), self.best[2].astype(int), self.best[1]

    def _far(self, vantage: int, at: np.ndarray) -> np.ndarray:
        """Distances of queries from a vantage point."""
        products = self.small[at] @ self.lifted[vantage, :-1]
        return np.sqrt(np.maximum(self.length[at] + self.reach - 2 * products, 0))

    def _near(self, node: int, at: np.ndarray) -> None:
        """Each query goes down to one leaf, which gives it a first bound."""
        if not len(at):
            return
        start, _, _, end, inner, outer, radius = self.nodes[node]
        if inner < 0:
            self.seen[at] = node
            self._take(int(start), int(end), at)
            return
        inside = self._far(int(start), at) <= radius
        self._near(int(inner), at[inside])
        self._near(int(outer), at[~inside])

    def _rest(self, node: int, at: np.ndarray) -> None:
        """All other leaves that the triangle inequality does not rule out."""
        if not len(at):
            return
        start, _, _, end, inner, outer, radius = self.nodes[node]
        if inner < 0:
            self._take(int(start), int(end), at[self.seen[at] != node])
            return
        self._take(int(start), int(start) + 1, at)
        far = self._far(int(start), at)
        for child, bound in ((inner, far - radius), (outer, radius - far)):
            # The bound is looked at again behind the first child, which may have found nearer ones.
            limit = np.sqrt(np.maximum(self.length[at] + self.reach - 2 * (self.least[at] - self.slack[at]), 0))
            self._rest(int(child), at[self.factor * (bound - SLACK * (1 + far)) <= limit])

    def _take(self, start: int, end: int, at: np.ndarray) -> None:
        if not len(at) or start == end:
            return
        self.compared += len(at) * (end - start)
        close = self.small[at] @ self.lifted[start:end, :-1].T
        q, p = np.nonzero((close >= (self.least[at] - self.slack[at])[:, None]) & (self.rows[start:end][None, :] != self.own[at][:, None]))
        if not len(q):
            return
        near, q, p = close[q, p], at[q], p + start
        fresh = np.vstack([q, products(self.queries[q], self.points[p]), p, near])
        touched = np.isin(self.best[0], q)
        both = np.concatenate([self.best[:, touched], fresh], axis=1)
        both = both[:, np.lexsort((self.rows[both[2].astype(int)], self.ids[both[2].astype(int)], -both[1], both[0]))]
        owner = both[0].astype(int)
        first = np.searchsorted(owner, owner)
        both = both[:, np.arange(len(owner)) - first < self.k]
        full, counts = np.unique(both[0].astype(int), return_counts=True)
        ends = np.cumsum(counts)
        for i in np.flatnonzero(counts == self.k):
            self.least[full[i]] = max(self.least[full[i]], both[3, ends[i] - self.k : ends[i]].min())
        self.best = np.concatenate([self.best[:, ~touched], both], axis=1)


def _bytes(vectors: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(v).tobytes() for v in vectors], pa.binary())


def usable(rows: DataFrame, id_col: str, vector_col: str, query: Column) -> DataFrame:
    """(row, id, query, size, vector) of the rows that take part; ``vector`` holds doubles as bytes, ``row`` is a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            keep, found = [], []
            for i, vector in enumerate(batch.column(2).to_pylist()):
                if vector and None not in vector:
                    v = np.array(vector, np.float64)
                    if np.isfinite(v).all() and v.any():
                        keep.append(i)
                        found.append(v + 0.0)
            some = batch.take(pa.array(keep, pa.int64()))
            size = pa.array([len(v) for v in found], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(keep))), some.column(0), some.column(1), size, pa.array([v.tobytes() for v in found], pa.binary())],
                ["row", "id", "query", "size", "vector"],
            )
            row += len(keep)

    shape = f"row long, id {rows.schema[id_col].dataType.simpleString()}, query boolean, size int, vector binary"
    chosen = rows.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(query, F.lit(False)).alias("query"), F.col(f"`{vector_col}`").alias("vector"))
    return written(chosen.where("id is not null").transform(small_batches).mapInArrow(run, shape), "vectors")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    found = column.to_pylist()
    return np.frombuffer(b"".join(found), np.float64).reshape(len(found), -1)


def _trees(leaf: int):
    """A shard's vectors to one row with its tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (size, shard), rows in groups(batches, ["size", "shard"]):
            points = _matrix(rows["vector"])
            small = points / np.abs(points).max()
            squares = (small * small).sum(axis=1)
            order, nodes = grow(np.column_stack([small, np.sqrt(np.maximum(squares.max() - squares, 0))]), leaf)
            placed = rows.take(pa.array(order))
            arrays = [pa.array([size], pa.int32()), pa.array([shard], pa.int64()), pa.array([placed["id"].to_pylist()], pa.list_(rows.schema.field("id").type)), pa.array([placed["row"].to_pylist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*arrays, _bytes([points[order]]), _bytes([nodes])], ["size", "shard", "ids", "rows", "points", "nodes"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (size, block), rows in groups(batches, ["size", "block"]):
        arrays = [pa.array([size], pa.int32()), pa.array([block], pa.int64()), pa.array([rows["id"].to_pylist()], pa.list_(rows.schema.field("id").type)), pa.array([rows["row"].to_pylist()], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*arrays, _bytes([_matrix(rows["vector"])])], ["size", "block", "query_ids", "own", "queries"])


def _searched(k: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                size = row["size"].as_py()
                matrix = {c: np.frombuffer(row[c].as_buffer(), np.float64).reshape(-1, width) for c, width in (("points", size), ("queries", size), ("nodes", 7))}
                ids, rows, own = (row[c].values.to_numpy(zero_copy_only=False) for c in ("ids", "rows", "own"))
                q, p, score = Search(matrix["points"], ids, rows, matrix["nodes"], matrix["queries"], own, k, factor).run()
                arrays = [row["query_ids"].values.take(pa.array(q)), pa.array(own[q]), row["ids"].values.take(pa.array(p)), pa.array(rows[p]), pa.array(score)]
                yield pa.RecordBatch.from_arrays(arrays, ["query_id", "query_row", "id", "row", "score"])

    return run


def nearest(
    rows: DataFrame, query: Column, k: int = NEIGHBOURS, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding",
    shard: int = SHARD, leaf: int = LEAF, block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` rows of largest inner product with each row that ``query`` names, its own left out.

    Rows are dealt into shards of about ``shard`` vectors, each with a vantage-point tree; every block of queries
    visits every shard. Within a tree a query first goes down to one leaf and then to all others that may hold
    something nearer: a subtree is ruled out when its bound by the triangle inequality, times ``factor``, is beyond the
    k-th nearest found. Factor 1 is exact; above 1 more is ruled out and neighbours can be missed. Scores are inner
    products of the vectors as given, in double precision; ties go to the smaller id.

    Vectors that are null, zero, empty or hold a null or a non-finite component take no part, nor do rows without id;
    vectors of other lengths are not compared. Of equal vectors the k + 1 smallest ids are enough for any list, so a
    vector of any frequency costs no more. Repeated ids are rows of their own. No rows give none.
    """
    vectors = usable(rows, id_col, vector_col, query)
    equal = Window.partitionBy("size", "vector").orderBy("id", "row")
    some = written(vectors.withColumn("_copy", F.row_number().over(equal)).where(F.col("_copy") <= k + 1).select("size", "row", "id", "vector"), "vector-candidates")
    counts = some.groupBy("size").agg(F.ceil(F.count("*") / shard).alias("shards"))
    dealt = some.join(F.broadcast(counts), "size").withColumn("shard", F.pmod(F.xxhash64("row"), "shards")).drop("shards")
    kind = vectors.schema["id"].dataType.simpleString()
    dealt = dealt.repartition("size", "shard").sortWithinPartitions("size", "shard").transform(small_batches)
    trees = written(dealt.mapInArrow(_trees(leaf), f"size int, shard long, ids array<{kind}>, rows array<long>, points binary, nodes binary"), "vantage-trees")

    asked = vectors.where("query").drop("query")
    blocks = asked.groupBy("size").agg(F.ceil(F.count("*") / block).alias("blocks")).join(counts, "size")
    asked = asked.join(F.broadcast(blocks), "size").withColumn("block", F.pmod(F.xxhash64("row"), "blocks"))
    asked = asked.select("size", "block", "id", "row", "vector").repartition("size", "block").sortWithinPartitions("size", "block").transform(small_batches)
    packed = written(asked.mapInArrow(_blocks, f"size int, block long, query_ids array<{kind}>, own array<long>, queries binary"), "query-blocks")
    visits = packed.join(F.broadcast(counts), "size").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).drop("shards")
    met = visits.join(trees.drop("block"), ["size", "shard"]).repartition("size", "block", "shard")
    found = met.mapInArrow(_searched(k, factor), f"query_id {kind}, query_row long, id {kind}, row long, score double")
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "id", "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def recall(found: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> float:
    """The share of exact neighbours that were found."""
    keys = ["query_id", id_col]
    return found.select(keys).distinct().join(exact.select(keys).distinct(), keys).count() / max(exact.select(keys).distinct().count(), 1)
