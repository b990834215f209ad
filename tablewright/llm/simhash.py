"""SimHash near-duplicates through fuzzy keys of the Golay code."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tablewright.llm import golay
from tablewright.llm.common import groups, meetings, small_batches, unsized, written
from tablewright.llm.components import components

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Width of the four segments of a fingerprint, and the pairs of an equal and a nearly equal one that are looked for.
WIDTH, SEGMENTS = 16, 4
PAIRS = [(i, (i + step) % SEGMENTS) for step in (1, 2) for i in range(SEGMENTS)]
#: Rows of a bucket that one task holds, and rows that it lets pass by them.
HELD, PASSING = 512, 8192


def majority(parts: Iterable[Sequence[int]]) -> int:
    """The bits that are set in over half of all hashes, as a signed number."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in parts:
        ones += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total).view(">i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A signed 64-bit fingerprint; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    width = min(shingle, len(words))
    spans = zip(starts[: len(words) - width + 1], ends[width - 1 :])
    digest = xxhash.xxh64_intdigest
    return majority([digest(joined[a:b], SEED) for a, b in part] for part in itertools.batched(spans, 1 << 16))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text, lower-cased in A-Z; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["id", "fp"])

    return docs.select(id_col, text_col).transform(small_batches).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def fuzzy_keys(fps: DataFrame) -> DataFrame:
    """(key, fp, own): of any two fingerprints with at most four differing bits, one has a key that is the other's own.

    Of the four segments with four errors at most, either each has one error, or some segment has none and at least
    two of the others have one at most, of which ``PAIRS`` holds one. A segment's own codeword is its nearest. With
    one error at most it is among the codewords near the other's segment, which are six at most. So keys are an equal
    segment with a codeword near another. For one error in each segment they are a codeword near the first with an
    equal half of the second and of the third, and the parities of all four, each of which the other has opposite.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for part in np.array_split(values, max(1, len(values) // 2048)):
                bits = part.view(np.uint64)
                segments = [(bits >> np.uint64(WIDTH * i) & np.uint64((1 << WIDTH) - 1)).astype(np.int64) for i in range(SEGMENTS)]
                near = [golay.keys(x) for x in segments]
                found = []
                for kind, (same, other) in enumerate(PAIRS):
                    row, place = np.nonzero(near[other] >= 0)
                    found.append((kind << 48 | segments[same][row] << 12 | near[other][row, place], row, place == 0))
                parity = sum((np.bitwise_count(x) & 1).astype(np.int64) << i for i, x in enumerate(segments))
                row, place = np.nonzero(near[0] >= 0)
                for kind, (a, b) in enumerate(itertools.product((0, 8), repeat=2), len(PAIRS)):
                    halves = kind << 48 | (segments[1] >> a & 255) << 12 | (segments[2] >> b & 255) << 4
                    found.append((halves | near[0][:, 0] << 20 | parity, np.arange(len(part)), np.ones(len(part), bool)))
                    found.append((halves[row] | near[0][row, place] << 20 | parity[row] ^ 15, row, np.zeros(len(row), bool)))
                keys, rows, own = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows]), pa.array(own)], ["key", "fp", "own"])

    return fps.select("fp").transform(small_batches).mapInArrow(run, "key long, fp long, own boolean")


def _forest(held: np.ndarray, passing: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what any pair of a held and a passing fingerprint connects."""
    out, parent = [], list(range(len(held)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for part in np.array_split(passing, len(passing) // 4096 + 1):
        close = np.bitwise_count(part[:, None] ^ held[None, :]) <= max_bits
        first = close.argmax(axis=1)
        hit = close[np.arange(len(part)), first] if len(part) else np.zeros(0, bool)
        out += zip(part[hit].tolist(), held[first[hit]].tolist())
        x, h = np.nonzero(close)
        for both in np.unique(first[x] * len(held) + h).tolist():
            a, b = root(both // len(held)), root(both % len(held))
            if a != b:
                parent[a] = b
                out.append((int(held[a]), int(held[b])))
    return [(a, b) for a, b in out if a != b]


def _verify(max_bits: int):
    """Held and passing fingerprints of each block and slice to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, ["key", "part", "block", "slice"]):
            held = int((rows["side"].to_numpy() == 0).sum())
            fps = rows["fp"].to_numpy()
            if 0 < held < len(fps) and (found := _forest(fps[:held], fps[held:], max_bits)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints, as many as connect what pairs with ``max_bits`` (to 4) connect.

    Pairs meet under a key that is one's own. Of each key the smallest fingerprint that owns it is the pivot. Rows
    near the pivot are linked to it and so connected to each other. What is left are pairs of an owner and another
    row, not both near the pivot: owners are held in blocks, and the rows they need pass by each block in slices, so
    that a key of any size is shared out over tasks of bounded size. A large group of near copies costs its size, not
    its square, as long as it is near its pivot.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("max_bits is from 0 to 4")
    rows = fuzzy_keys(fps)
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.when(F.col("own"), F.col("fp"))).alias("pivot"))
    keys = keys.where("n > 1 and pivot is not null").select("key", "pivot")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= max_bits
    met = written(rows.join(unsized(keys), "key").where("fp != pivot").withColumn("near", near), "simhash-keys")
    star = met.where("near").select(F.col("fp").alias("a"), F.col("pivot").alias("b")).distinct()

    sizes = met.groupBy("key").agg(F.count("*").alias("n"), F.count(F.when(~F.col("near"), 1)).alias("far"), F.count(F.when(F.col("own"), 1)).alias("owners"))
    left = met.join(unsized(sizes.where("n > 1 and far > 0 and owners > 0").select("key")), "key", "left_semi").select("key", "fp", "own", "near")
    # Owners not near the pivot meet all rows; owners near it meet those that are not.
    held = left.where("own").select("key", F.col("near").cast("int").alias("part"), "fp")
    passing = left.select("key", F.lit(0).alias("part"), "fp").unionByName(left.where("not near").select("key", F.lit(1).alias("part"), "fp"))
    shared = meetings(held, passing, ["key", "part"], "fp", HELD, PASSING)
    return star.unionByName(shared.transform(small_batches).mapInArrow(_verify(max_bits), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fingerprint, component_id) for each row.

    Rows link when their fingerprints differ in at most ``max_bits`` bits; ``component_id`` is the smallest id
    reachable over links. Texts without words (null, empty) have the fingerprint zero and link like any other;
    rows that repeat, or share an id, are kept. An empty table gives no rows.
    """
    found = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = written(found.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    groups = components(links(distinct, max_bits))
    rooted = distinct.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return found.join(named, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates: that of the smallest id, of these the smallest hash of the text."""
    names = [f"_own_{i}" for i in range(len(docs.columns))]
    own_id, own_text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    marked = docs.toDF(*names).withColumn("_key", F.struct(F.col(own_id).alias("id"), F.xxhash64(F.coalesce(own_text, F.lit(""))).alias("mark")))
    groups_ = near_duplicates(marked, "_key", own_text, shingle, max_bits)
    first = groups_.where(F.col("_key").eqNullSafe(F.col("component_id"))).select(F.col("_key").alias("_first")).distinct()
    kept = marked.join(first, F.col("_key").eqNullSafe(F.col("_first")), "left_semi")
    return kept.dropDuplicates(["_key"]).select(*names).toDF(*docs.columns)
