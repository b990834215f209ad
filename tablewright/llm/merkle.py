"""A Merkle manifest of a table: nodes keep the hash state before each child, so that a changed child is folded in midway."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.llm.common import groups, small_batches, written

#: Children of a node, and levels that one task works off: a block of ``ARITY ** LEVELS`` nodes is a subtree of its own.
ARITY, LEVELS = 16, 3
BLOCK = ARITY**LEVELS
#: monotonically_increasing_id keeps the partition above and the row within it below this bit.
ROW_BITS = 33
#: The levels above a node, lowest first: its place among the children, and their digests (32 bytes each).
PATH = "array<struct<slot: int, run: binary>>"


class Node:
    """A node over its children's digests (hex); ``states`` are copies of the hash state taken before each child."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: list[bytes]):
        self.children, self.states = children, []
        state = hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, replacement: bytes) -> bytes:
        """The digest with another child at ``slot``: resumes the state before it, reads that child and those right of it."""
        state = self.states[slot].copy()
        state.update(replacement)
        state.update(b"".join(self.children[slot + 1 :]))
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> bytes:
        return b"".join(self.children[:slot] + self.children[slot + 1 :])


def height(n: int) -> int:
    """Levels over ``n`` nodes: none over one, else as many as leave a single node."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def subtree(digests: list[bytes], n: int) -> list[list[Node]]:
    """The nodes of each level over a block of a tree that has ``n`` nodes at the block's lowest level."""
    levels = []
    for _ in range(min(LEVELS, height(n))):
        nodes = [Node(digests[i : i + ARITY]) for i in range(0, len(digests), ARITY)]
        levels.append(nodes)
        digests = [x.digest for x in nodes]
    return levels


def _hex(column: pa.ChunkedArray) -> list[bytes]:
    return [x.encode() for x in column.to_pylist()]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's nodes to the one over them."""
    for (key, block), rows in groups(batches, ["key", "block"]):
        digests, n = _hex(rows["digest"]), rows["n"][0].as_py()
        levels = subtree(digests, n)
        top = levels[-1][0].digest if levels else digests[0]
        arrays = [pa.array([key]), pa.array([block], pa.int64()), pa.array([-(-n // BLOCK)], pa.int64()), pa.array([top.decode()])]
        yield pa.RecordBatch.from_arrays(arrays, ["key", "pos", "n", "digest"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of each of a block's nodes: its levels within the block, then the block's own path."""
    for (key, _), rows in groups(batches, ["key", "block"]):
        above, nodes = rows["path"][0].as_py() or [], rows.slice(1)
        levels, found = subtree(_hex(nodes["digest"]), nodes["n"][0].as_py()), []
        for i in range(len(nodes)):
            own = []
            for level in levels:
                i, slot = divmod(i, ARITY)
                own.append({"slot": slot, "run": bytes.fromhex(b"".join(level[i].children).decode())})
            found.append(own + above)
        paths = pa.array(found, pa.list_(pa.struct([("slot", pa.int32()), ("run", pa.binary())])))
        yield pa.RecordBatch.from_arrays([pa.array([key] * len(nodes)), nodes["pos"].combine_chunks(), paths], ["key", "pos", "path"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's leaves to their proofs and the roots that their replacements fold to."""
    for _, rows in groups(batches, ["key", "block"]):
        above, leaves = rows["path"][0].as_py() or [], rows.slice(1)
        digests = _hex(leaves["digest"])
        levels = subtree(digests, leaves["n"][0].as_py())
        upper = [(x["slot"], Node([x["run"][i : i + 32].hex().encode() for i in range(0, len(x["run"]), 32)])) for x in above]
        tail = b"".join(node.siblings(slot) for slot, node in upper)
        beside: dict[tuple[int, int], bytes] = {}
        over: dict[bytes, bytes] = {}
        proofs, roots = [], []
        for i, (digest, replaced) in enumerate(zip(digests, leaves["replaced"].to_pylist())):
            value, proof = replaced.encode() if replaced is not None else digest, hashlib.sha256()
            for depth, level in enumerate(levels):
                if depth and (depth, i) not in beside:
                    beside[depth, i] = level[i // ARITY].siblings(i % ARITY)
                proof.update(beside[depth, i] if depth else level[i // ARITY].siblings(i % ARITY))
                value, i = level[i // ARITY].fold(i % ARITY, value), i // ARITY
            if value not in over:
                at = value
                for slot, node in upper:
                    at = node.fold(slot, at)
                over[value] = at
            proof.update(tail)
            proofs.append(proof.hexdigest())
            roots.append(over[value].decode())
        arrays = [leaves[c].combine_chunks() for c in ("key", "id", "digest")]
        subroot = pa.array([rows["subroot"][0].as_py()] * len(leaves), pa.string())
        yield pa.RecordBatch.from_arrays([*arrays, subroot, pa.array(proofs), pa.array(roots)], ["key", "id", "leaf", "subroot", "proof_sha256", "folded_root"])


def field(value: Column) -> Column:
    """A field's part of a leaf: ``-`` for null, else the byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def _placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``pos``, their place within ``key`` from 0, and ``n``, the rows of the key.

    Range partitions count their rows of each key, and counts before them are added up, so a key of any size is
    spread over tasks. Rows that ``order`` leaves equal are told apart by where they were read.
    """
    keys = [F.col("key"), *order, F.monotonically_increasing_id()]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    ranged = written(ranged, "merkle-order").withColumn("_seg", F.shiftright("_place", ROW_BITS))
    sizes = ranged.groupBy("_seg", "key").agg(F.count("*").alias("_size"), F.min("_place").alias("_first"))
    whole = Window.partitionBy("key")
    before = F.coalesce(F.sum("_size").over(whole.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_seg", "key", "_first", before.alias("_before"), F.sum("_size").over(whole).alias("n"))
    return ranged.join(starts, ["_seg", "key"]).select(*rows.columns, (F.col("_before") + F.col("_place") - F.col("_first")).alias("pos"), "n")


def _dealt(nodes: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """The nodes in blocks; with ``paths`` each block begins with a row that holds its own path."""
    rows = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))
    if paths is not None:
        rows = rows.unionByName(paths.withColumnRenamed("pos", "block").withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "pos").transform(small_batches)


def _grown(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tables of nodes that blocks are made of, lowest first, and the last node of each key: key, pos, n, digest."""
    tables, shape, ended = [nodes], "key string, pos long, n long, digest string", None
    while True:
        above = written(_dealt(tables[-1].select("key", "pos", "n", "digest")).mapInArrow(_blocks, shape), "merkle-nodes")
        done = above.where("n = 1")
        ended = done if ended is None else ended.unionByName(done)
        more = above.where("n > 1")
        if not more.limit(1).count():
            return tables, ended
        tables.append(more)


def _descended(tables: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(key, pos, path) of the blocks over the lowest table; ``tops`` has the paths of the keys' last nodes."""
    paths, known = tops, tops
    for nodes in reversed(tables[1:]):
        here = nodes.select("key").distinct()
        # A key whose tree ends below this table has no nodes in it; its path waits.
        found = _dealt(nodes.select("key", "pos", "n", "digest"), paths.join(here, "key", "left_semi")).mapInArrow(_paths, f"key string, pos long, path {PATH}")
        paths = written(found.unionByName(known.join(here, "key", "left_anti")), "merkle-paths")
    return paths


def manifest(
    docs: DataFrame, fields: list[str], replaced: dict[str, Column], id_col: str = "doc_id", group_col: str = "source"
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``docs``.

    A leaf hashes ``fields``. Leaves of a group ascend by id (null first, then by leaf), groups by their value (null
    first, then bytewise); runs of ``ARITY`` nodes become the hash of their digests until one is left, first within
    groups and then over their subroots. ``replaced`` gives fields' other values; ``folded_root`` is what the root
    becomes with the row's leaf replaced so, and ``verified`` says that it is the root.

    A task holds a block of 4,096 nodes as a subtree whose nodes keep their hash states, and the path above it, of one
    node for each level, so a group of any size is shared out. Repeated rows are leaves of their own. No rows give
    none; other columns play no part.
    """
    named = {c: F.col(f"`{c}`") for c in fields}
    group = F.coalesce(F.concat(F.lit("s"), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    changed = [(replaced[c], c) for c in fields if c in replaced]
    differs = F.lit(False)
    for value, c in changed:
        differs = differs | ~value.eqNullSafe(named[c])
    other = F.when(differs, leaf([replaced.get(c, named[c]) for c in fields]))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), group.alias("key"), leaf(list(named.values())).alias("digest"), other.alias("replaced"))
    leaves = written(_placed(rows, [F.col("id"), F.col("digest")]), "merkle-leaves")
    tables, subroots = _grown(leaves)

    top = subroots.select(F.lit("").alias("key"), F.col("key").alias("group"), "digest")
    top = written(_placed(top, [F.col("group")]), "merkle-subroots")
    top_tables, roots = _grown(top)
    none = F.array().cast(PATH)
    found = _descended([top.limit(0), *top_tables], roots.select("key", "pos", none.alias("path")))
    paths = top.select("pos", F.col("group").alias("key"), F.col("digest").alias("subroot")).join(found.select("pos", "path"), "pos").drop("pos")
    paths = written(paths.withColumn("pos", F.lit(0).cast("long")), "merkle-tops")
    below = _descended(tables, paths.select("key", "pos", "path")).join(paths.select("key", "subroot"), "key")

    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"key string, id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string"
    folded = _dealt(leaves, below).mapInArrow(_folded, shape)
    root = F.broadcast(roots.select(F.col("digest").alias("root")))  # one row
    found = folded.join(root).withColumn("verified", F.col("folded_root") == F.col("root"))
    return found.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
