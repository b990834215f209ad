"""Near copies of texts: every pair of at least a similarity, the Jaccard index of their word shingles."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tablewright.llm import simhash
from tablewright.llm.common import groups, meetings, small_batches, unsized, written
from tablewright.llm.components import components

SHINGLE, SEED = 5, 42
#: Least share of common shingles among all shingles of two texts.
SIMILARITY = Fraction(4, 5)
#: Rows of a key whose texts a task holds, and those it lets pass by them; the same for rows with sketches only.
HELD, PASSING = 64, 256
SKETCHES_HELD, SKETCHES_PASSING = 512, 4096
#: The same for fine sketches, of 8 KB at most, which few rows are left to have.
FINE_HELD, FINE_PASSING = 2048, 8192
#: Texts of a key that its other texts are verified against one by one, before those still apart meet each other.
PIVOTS = 4
#: A table of at most so many nodes (under 50 bytes each) is broadcast.
SMALL_ROWS = 200_000
#: Of one text in so many all shingles are counted; sightings among these that make a shingle common; common ones at most.
#: They decide in which order shingles are taken as keys, not what is found.
EVERY, COMMON_SEEN, COMMON = 16, 4, 1 << 17
#: Bits of the shortest sketch.
LEAST_BITS = 512
#: Places of a fine sketch: for each shingle, at least and at most.
FINE_EACH, FINE_LEAST, FINE_MOST = 16, 1 << 12, 1 << 16
#: Cells of a text's histogram of shingles.
CELLS = 256


def shingles(text: str | None, width: int = SHINGLE) -> set[bytes]:
    """Runs of ``width`` words, lower-cased in A-Z; of a text with fewer words all of them are one shingle."""
    words = (text or "").encode().lower().split()
    if len(words) <= width:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def needed(a: int, b: int, similarity: Fraction = SIMILARITY) -> int:
    """Common shingles that sets of ``a`` and ``b`` shingles need: c / (a + b - c) is at least the similarity."""
    p, q = similarity.numerator, similarity.denominator
    return -(-p * (a + b) // (p + q))


def similar(a: set[bytes], b: set[bytes], similarity: Fraction = SIMILARITY) -> bool:
    return len(a & b) >= needed(len(a), len(b), similarity)


def hashed(found: set[bytes]) -> np.ndarray:
    return np.sort(np.array([xxhash.xxh64_intdigest(s, SEED) for s in found], np.uint64))


def prefix(hashes: np.ndarray, similarity: Fraction = SIMILARITY, common: np.ndarray | None = None) -> np.ndarray:
    """The smallest of a set's sorted hashes, as many as make sure that two similar sets have one in common.

    Of n shingles a similar set has at least the similarity's share, so at most n less that share are its alone;
    of one more than those, taken in an order that all sets follow, one is common and among the other's too. Hashes
    that are ``common`` (sorted) to many texts come last in that order.
    """
    least = -(-similarity.numerator * len(hashes) // similarity.denominator)
    if common is not None and len(common):
        last = common[np.searchsorted(common, hashes).clip(max=len(common) - 1)] == hashes
        hashes = np.concatenate([hashes[~last], hashes[last]])
    return hashes[: len(hashes) - least + 1].view(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity of a set's hashes by their lowest bits, in at least as many places as there are hashes (packed bits)."""
    return _parity(hashes, max(LEAST_BITS, 1 << (len(hashes) - 1).bit_length()))


def fine_sketch(hashes: np.ndarray) -> np.ndarray:
    """The same in so many places that few hashes share one, within bounds."""
    return _parity(hashes, min(max(FINE_LEAST, 1 << (FINE_EACH * len(hashes) - 1).bit_length()), FINE_MOST))


def _parity(hashes: np.ndarray, places: int) -> np.ndarray:
    return np.packbits(np.bincount((hashes & np.uint64(places - 1)).astype(np.int64), minlength=places).astype(np.uint8) & 1)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A sketch in fewer places: what it would be with so many bytes."""
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def may_be_similar(x: bytes, y: bytes, apart: int) -> bool:
    """Whether the sketches differ in at most ``apart`` places; sets differ by at least what their sketches do."""
    u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(u), len(v))
    return int(np.bitwise_count(folded(u, size) ^ folded(v, size)).sum()) <= apart


def most_apart(a: int, b: int, similarity: Fraction = SIMILARITY) -> int:
    """Shingles that only one of two similar sets has, at most; below 0 if their sizes rule it out."""
    common = needed(a, b, similarity)
    return a + b - 2 * common if common <= min(a, b) else -1


def histogram(found: set[bytes]) -> np.ndarray:
    """Number of a set's shingles by cell; two differ by no more than the shingles that only one of the sets has."""
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED + 1) for s in found], np.uint64)
    return np.bincount((hashes % np.uint64(CELLS)).astype(np.int64), minlength=CELLS).astype(np.int32)


#: What stands for a text until texts are compared: keys, number of shingles, sketch, SimHash fingerprint of the set.
SHAPE = {"prefix": "array<long>", "size": "int", "sketch": "binary", "fingerprint": "long"}


def _counted(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashed(shingles(text.as_py(), width)) for text in batch.column(0)]
            key, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    return run


def common_shingles(texts: DataFrame, text_col: str, width: int) -> np.ndarray:
    """Sorted hashes of shingles that many of the texts have, as far as a part of these shows it; at most ``COMMON``."""
    some = texts.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark")).where(F.pmod("mark", F.lit(EVERY)) == 0).dropDuplicates(["mark"])
    counted = some.select("text").transform(small_batches).mapInArrow(_counted(width), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = written(counted.where(f"n >= {COMMON_SEEN}").orderBy(F.desc("n"), "key").limit(COMMON), "common-shingles").toPandas()
    return np.sort(found["key"].to_numpy(np.int64).view(np.uint64))


def _prefixes(width: int, similarity: Fraction, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, prefixes, sizes, sketches, fingerprints = [], [], [], [], []
            for text in batch.column(1):
                words = b" ".join((text.as_py() or "").encode().lower().split())
                hashes = hashed(shingles(text.as_py(), width))
                digests.append(xxhash.xxh3_128_digest(words))
                prefixes.append(prefix(hashes, similarity, common) if len(hashes) else [])
                sizes.append(len(hashes))
                sketches.append(sketch(hashes).tobytes() if len(hashes) else b"")
                fingerprints.append(simhash.majority(hashes[i : i + (1 << 16)] for i in range(0, len(hashes), 1 << 16)))
            columns = [pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(fingerprints, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "digest", *SHAPE])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node = TaskContext.get().partitionId() << 36
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(node, node + batch.num_rows)), *batch.columns], ["node", *batch.schema.names])
        node += batch.num_rows


def _verified(pairs: DataFrame, sketches: DataFrame, fetch: Callable[[DataFrame], DataFrame], width: int, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar; texts are fetched only for pairs that sizes and sketches leave."""
    p, q = similarity.numerator, similarity.denominator
    fits = f"{p} * (a_size + b_size) <= {p + q} * least(a_size, b_size)"
    sized = unsized(pairs.distinct()).join(sketches.toDF("a", "a_size", "a_sketch"), "a").join(sketches.toDF("b", "b_size", "b_sketch"), "b").where(fits)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("a_size", "b_size", "a_sketch", "b_sketch")])
            yield batch.select(["a", "b"]).filter(pa.array([may_be_similar(x, y, most_apart(m, n, similarity)) for m, n, x, y in rows], pa.bool_()))

    left = written(sized.transform(small_batches).mapInArrow(sketched, "a long, b long"), "similar-pairs")
    texts = unsized(fetch(left.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    both = left.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = functools.lru_cache(64)(lambda text: shingles(text, width))
        for batch in batches:
            texts = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())
            yield batch.select(["a", "b"]).filter(pa.array([similar(held(x), held(y), similarity) for x, y in texts], pa.bool_()))

    return written(both.transform(small_batches).mapInArrow(run, "a long, b long"), "similar-links")


def _alike(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes, as many as connect what fingerprints of at most four differing bits connect."""
    prints = nodes.where("size > 0").select("node", F.col("fingerprint").alias("fp"))
    heads = written(prints.groupBy("fp").agg(F.min("node").alias("head")), "similar-fingerprints")
    equal = prints.join(heads, "fp").where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    near = simhash.links(heads.select("fp")).join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b")
    return equal.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _fine(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashed(shingles(text.as_py(), width)) for text in batch.column("text")]
            columns = [pa.array([len(h) for h in found], pa.int32()), pa.array([fine_sketch(h).tobytes() for h in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), *columns], ["node", "size", "sketch"])

    return run


def _promising(similarity: Fraction, bits: int = LEAST_BITS):
    """Of a key's held and passing rows those with a partner of another group that sizes and sketches leave."""
    p, q = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, _, _), rows in groups(batches, ["key", "block", "slice"]):
            n = int((rows["side"].to_numpy() == 0).sum())
            node, group = rows["node"].to_numpy(), rows["group"].to_numpy()
            size, full = rows["size"].to_numpy().astype(np.int64), rows["sketch"].to_pylist()
            short = np.stack([folded(np.frombuffer(x, np.uint8), bits // 8).view(np.uint64) for x in full])
            good = np.zeros(len(node), bool)
            for i in range(n):
                total = size[i] + size[n:]
                common = -(-p * total // (p + q))
                apart = np.bitwise_count(short[n:] ^ short[i]).sum(axis=1)
                likely = (apart <= total - 2 * common) & (common <= np.minimum(size[i], size[n:])) & (group[n:] != group[i])
                for j in (np.flatnonzero(likely) + n).tolist():
                    if not (good[i] and good[j]) and may_be_similar(full[i], full[j], most_apart(int(size[i]), int(size[j]), similarity)):
                        good[i] = good[j] = True
            if good.any():
                kept = np.flatnonzero(good)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(kept), pa.int64()), pa.array(kept >= n), pa.array(node[kept]), pa.array(group[kept])], ["key", "passes", "node", "group"])

    return run


def _connected(width: int, similarity: Fraction):
    """Links that connect what similar pairs of a key's held and passing texts connect, beyond the groups they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, ["key", "block", "slice"]):
            n = int((rows["side"].to_numpy() == 0).sum())
            node, group, sets = rows["node"].to_pylist(), rows["group"].to_pylist(), [shingles(t, width) for t in rows["text"].to_pylist()]
            if not 0 < n < len(node):
                continue
            cells, sizes = np.stack([histogram(s) for s in sets]), np.array([len(s) for s in sets])
            parent, found = {x: x for x in group}, []

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for i in range(n):
                apart = np.abs(cells[n:] - cells[i]).sum(axis=1)
                most = sizes[i] + sizes[n:] - 2 * np.array([needed(int(sizes[i]), int(s), similarity) for s in sizes[n:]])
                for j in (np.flatnonzero(apart <= most) + n).tolist():
                    a, b = root(group[i]), root(group[j])
                    if a != b and similar(sets[i], sets[j], similarity):
                        parent[a] = b
                        found.append((node[i], node[j]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return run


def _apart(met: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, group, main): rows of the keys whose texts ``found`` has not connected yet; ``main`` is a key's largest group."""
    rows = unsized(met).join(components(found), "node", "left").select("key", "node", F.coalesce("component", "node").alias("group"))
    rows = written(rows, "similar-groups")
    main = rows.groupBy("key", "group").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("groups"), F.max(F.struct("n", "group")).alias("most"))
    return written(unsized(rows).join(main.where("groups > 1").select("key", F.col("most.group").alias("main")), "key"), "similar-apart")


def links(nodes: DataFrame, fetch: Callable[[DataFrame], DataFrame], width: int = SHINGLE, similarity: Fraction = SIMILARITY) -> DataFrame:
    """(a, b): links that connect what pairs of similar texts connect.

    ``nodes`` has node, prefix, size, sketch and fingerprint; ``fetch`` gives (node, text) for a table of nodes.

    SimHash fingerprints near each other, found by Golay keys, tell the first pairs; these are verified like all others.
    As texts just as similar can have fingerprints far apart, the rest is found exactly.

    Similar texts meet under a hash of both prefixes. Hashes that the same texts have are one key. All texts of a key
    are verified against one of them, its pivot; while texts of a key are in different groups of linked texts, up to
    ``PIVOTS`` times, against another pivot, drawn by hash, of another group. A group of near copies so costs its size,
    not its square. Only texts that are still outside their key's largest group meet the key's texts of other groups,
    in blocks, so that a key of any size is shared out and no pair is lost. Sizes and sketches drop most pairs that are
    not similar, and none that is, before any text is fetched; of the texts left, fine sketches drop most of the others
    before texts meet.
    """
    sketches = nodes.select("node", "size", "sketch")
    alike = _verified(_alike(nodes), sketches, fetch, width, similarity)
    rows = nodes.select("node", F.explode("prefix").alias("key"))
    keys = written(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1").select("key", "pivot"), "similar-heads")
    keys = F.broadcast(keys) if keys.count() <= SMALL_ROWS else unsized(keys)
    met = written(rows.join(keys, "key").where("node != pivot"), "similar-met")
    marks = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"m{seed}") for seed in (0, 1)]
    once = met.groupBy("key", "pivot").agg(F.count("*").alias("n"), *marks).groupBy("n", "m0", "m1", "pivot").agg(F.min("key").alias("key"))
    met = written(met.join(once.select("key"), "key", "left_semi").select("key", "node", "pivot"), "similar-keys")
    pairs = unsized(met.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()).join(alike, ["a", "b"], "left_anti")
    found = alike.unionByName(_verified(pairs, sketches, fetch, width, similarity))

    rest = _apart(met, found)
    for turn in range(1, PIVOTS):
        if rest.isEmpty():
            return found
        drawn = rest.groupBy("key").agg(F.min_by(F.struct("node", "group"), F.xxhash64("node", F.lit(turn))).alias("pivot"))
        pairs = unsized(rest).join(drawn, "key").where("group != pivot.group").select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b"))
        found = written(found.unionByName(_verified(pairs, sketches, fetch, width, similarity)), "similar-found")
        rest = _apart(rest.select("key", "node"), found)
    left = unsized(rest).join(sketches, "node")
    promising = _left(left.where("group != main").drop("main"), left.drop("main"), SKETCHES_HELD, SKETCHES_PASSING, _promising(similarity))
    texts = fetch(promising.select("node").distinct())
    fine = written(texts.select("node", "text").transform(small_batches).mapInArrow(_fine(width), "node long, size int, sketch binary"), "similar-fine")
    left = promising.join(fine, "node")
    promising = _left(left.where("not passes").drop("passes"), left.where("passes").drop("passes"), FINE_HELD, FINE_PASSING, _promising(similarity, FINE_LEAST))
    left = promising.join(unsized(texts), "node")
    shared = meetings(left.where("not passes").drop("passes"), left.where("passes").drop("passes"), ["key"], "node", HELD, PASSING)
    return found.unionByName(shared.transform(small_batches).mapInArrow(_connected(width, similarity), "a long, b long"))


def _left(held: DataFrame, passing: DataFrame, held_rows: int, passing_rows: int, run: Callable) -> DataFrame:
    """(key, passes, node, group): rows that ``run`` leaves of those that meet."""
    shared = meetings(held, passing, ["key"], "node", held_rows, passing_rows)
    return written(shared.transform(small_batches).mapInArrow(run, "key long, passes boolean, node long, group long").distinct(), "similar-promising")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, similarity: Fraction = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each group of near copies: that of the smallest id, of these the smallest hash of the text.

    Texts are near copies when they are similar; groups are what is reached over near copies. Texts of the same words
    are copies, also those without words (null, empty). An empty table stays empty.
    """
    names = [f"_own_{i}" for i in range(len(docs.columns))]
    own_id, own_text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    marked = docs.toDF(*names).withColumn("_key", F.struct(F.col(own_id).alias("id"), F.xxhash64(F.coalesce(own_text, F.lit(""))).alias("mark")))
    kind = marked.schema["_key"].dataType.simpleString()
    common = common_shingles(marked, own_text, width)
    rows = marked.select(F.col("_key").alias("id"), own_text).transform(small_batches)
    shape = ", ".join(f"{name} {of}" for name, of in SHAPE.items())
    found = rows.mapInArrow(_prefixes(width, similarity, common), f"id {kind}, digest binary, {shape}")
    copies = found.groupBy("digest").agg(F.min(F.struct("id", *SHAPE)).alias("low"))
    copies = copies.select(F.col("low.id").alias("low"), *[f"low.{name}" for name in SHAPE])
    nodes = written(copies.transform(small_batches).mapInArrow(_numbered, f"node long, low {kind}, {shape}"), "text-nodes")
    texts = marked.select(F.col("_key").alias("low"), F.col(own_text).alias("text"))

    def fetch(some: DataFrame) -> DataFrame:
        # Structs are equal when their fields are, null to null, so a row without id is found too.
        wanted = written(nodes.select("node", "low").join(some, "node"), "similar-wanted")
        if wanted.count() <= SMALL_ROWS:
            wanted = F.broadcast(wanted)
        return written(texts.join(wanted, "low").groupBy("node").agg(F.first("text").alias("text")), "similar-texts")

    groups_ = components(links(nodes, fetch, width, similarity))
    rooted = nodes.select("node", "low").join(groups_, "node", "left").select("low", F.coalesce("component", "node").alias("root"))
    first = rooted.groupBy("root").agg(F.min("low").alias("_first")).select("_first")
    # Most rows stay and are alone with their key: the others' keys are looked up, so that no text of theirs is shuffled.
    odd = marked.groupBy(F.col("_key").alias("_odd")).agg(F.count("*").alias("n")).join(first, F.col("_odd") == F.col("_first"), "left")
    odd = written(odd.where("n > 1 or _first is null").select("_odd", F.col("_first").isNotNull().alias("_stays")), "similar-odd")
    looked_up = marked.join(F.broadcast(odd) if odd.count() <= SMALL_ROWS else unsized(odd), F.col("_key") == F.col("_odd"), "left")
    again = looked_up.where("_stays").dropDuplicates(["_key"])
    return looked_up.where("_odd is null").select(*names).unionByName(again.select(*names)).toDF(*docs.columns)
