"""Line dedup over a corpus: exact copies, and near copies by a segment-partition edit join."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.common import groups, meetings, small_batches, unsized, written
from tablewright.llm.components import components

#: Edits that two lines may be apart, and the characters of a line for each edit; shorter lines have only exact copies.
THRESHOLD, CHARS_PER_EDIT = 2, 16
#: Rows of a key that a task holds, and those it lets pass by them.
HELD, PASSING = 512, 8192
#: So many line ids (8 bytes each) are broadcast at most.
SMALL_IDS = 500_000
#: Every so many lines one is looked at for hot keys; sightings among these that make a key hot; hot keys at most, which
#: decide how rows are shared out, not what is found; and the slices of a hot key.
EVERY, HOT_SEEN, HOT_KEYS, SLICES = 32, 64, 1000, 64


def allowed(chars: int, threshold: int = THRESHOLD) -> int:
    """Edits allowed between lines of which the longer has ``chars`` characters."""
    return min(threshold, chars // CHARS_PER_EDIT)


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """(start, length) of threshold + 1 segments of a line, whose lengths differ by one at most."""
    count = threshold + 1
    short, longer = divmod(length, count)
    sizes = [short] * (count - longer) + [short + 1] * longer
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist()
    return list(zip(starts, sizes))


def probes(length: int, indexed: int, threshold: int) -> list[tuple[int, int, int]]:
    """(segment, start, length) of the substrings of a line that may equal a segment of a line of ``indexed`` characters.

    Some segment is free of edits. Seen from the left, segment i then has shifted by at most i places, as each edit
    before it shifts it by one; seen from the right, by at most threshold - i besides the difference in length.
    """
    difference = length - indexed
    out = []
    for i, (start, size) in enumerate(segments(indexed, threshold)):
        low = max(start - i, start + difference - (threshold - i), 0)
        high = min(start + i, start + difference + (threshold - i), length - size)
        out += [(i, p, size) for p in range(low, high + 1)]
    return out


def within(a: str, b: str, limit: int) -> bool:
    """Whether the edit distance is at most ``limit``: bit k of word e says that diagonal k - limit is reached with e edits."""
    if abs(len(a) - len(b)) > limit:
        return False
    a, b = _unlike(a, b)
    a, b = (x[::-1] for x in _unlike(a[::-1], b[::-1]))
    if abs(len(a) - len(b)) > limit or min(len(a), len(b)) == 0:
        return max(len(a), len(b)) <= limit
    band = (1 << 2 * limit + 1) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i + limit
    reached = [((1 << e + 1) - 1) << limit & band for e in range(limit + 1)]
    outside = ~((1 << limit) - 1)
    for j, c in enumerate(b):
        same = places.get(c, 0) >> j & band
        new: list[int] = []
        for e, word in enumerate(reached):
            found = word & same
            if e:
                found |= reached[e - 1] | reached[e - 1] >> 1 | new[e - 1] << 1
            new.append(found & band)
        if j + 1 < limit:  # diagonals that begin before the line does
            new = [w & (outside >> j + 1) for w in new]
        reached = new
        if not reached[limit]:
            return False
    return bool(reached[limit] >> (len(a) - len(b) + limit) & 1)


def _unlike(a: str, b: str) -> tuple[str, str]:
    """Both without their common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return a[low:], b[low:]


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lines with a space before, between and behind them; the place of the space before each."""
    codes = np.frombuffer(" ".join(["", *lines, ""]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(x) + 1 for x in lines])
    return codes, np.cumsum(sizes) - sizes


def sketches(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each line the parity of its pairs of characters in 63 bits; an edit changes four at most."""
    pairs = (codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    return np.bitwise_xor.reduceat(np.uint64(1) << pairs % np.uint64(63), starts).view(np.int64)


def sketch(line: str) -> int:
    return int(sketches(*_codes([line]))[0])


#: A number's hash among keys, and the base of the hash of a substring.
_MIX, _BASE = np.uint64(0xD6E8FEB86659FD93), 0x9E3779B97F4A7C15


def _shape(length: int, threshold: int) -> np.ndarray:
    """Columns of a line's keys: segment's length and number hashed, start, end, side (0: its own segments)."""
    own = [(length, i, p, size, 0) for i, (p, size) in enumerate(segments(length, threshold))]
    seen = {(m, i, p) for m, i, p, _, _ in own}
    other = [(m, i, p, size, 1) for m in range(max(length - threshold, 0), length + 1) for i, p, size in probes(length, m, threshold) if (m, i, p) not in seen]
    return np.array([(m * (threshold + 1) + i, p, p + size, side) for m, i, p, size, side in own + other]).T


def _keys(threshold: int, hot: np.ndarray):
    """Lines to (key, slice, node, kind, mark): kind 0 for segments, 1 for substrings of other lengths or places.

    A key hashes a substring, as a difference of running sums of characters times powers, with the segment it may be.
    Rows of the ``hot`` keys (sorted) are dealt to slices from 1 on by node, all others are in slice 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes: dict[int, np.ndarray] = {}
        inverse = pow(_BASE, -1, 1 << 64)
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                lines = part.column("line").to_pylist()
                if len(shapes) > 20_000:
                    shapes.clear()
                for n in {len(x) for x in lines} - shapes.keys():
                    shapes[n] = _shape(n, threshold)
                found = [shapes[len(x)] for x in lines]
                codes, starts = _codes(lines)
                counts = np.array([x.shape[1] for x in found])
                tag, low, high, kind = np.concatenate(found, axis=1)
                base = np.repeat(starts + 1, counts)
                low, high = low + base, high + base
                powers, back = (np.cumprod(np.r_[np.ones(1, np.uint64), np.full(len(codes), f, np.uint64)]) for f in (_BASE, inverse))
                sums = np.r_[np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * powers[:-1])]
                keys = (sums[high] - sums[low]) * back[low]
                keys = (keys ^ keys >> np.uint64(31)) * _MIX + tag.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
                keys = ((keys ^ keys >> np.uint64(29)) * _MIX).view(np.int64)
                node, slices = np.repeat(part.column("node").to_numpy(), counts), np.zeros(len(keys), np.int32)
                if len(hot):
                    found = hot[np.searchsorted(hot, keys).clip(max=len(hot) - 1)] == keys
                    slices[found] = 1 + (node[found].view(np.uint64) * _MIX >> np.uint64(32)) % np.uint64(SLICES)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys), pa.array(slices), pa.array(node),
                        pa.array(kind.astype(np.int8)), pa.array(np.repeat(sketches(codes, starts), counts)),
                    ],
                    ["key", "slice", "node", "kind", "mark"],
                )

    return run


def _close(x: np.ndarray, y: np.ndarray, threshold: int) -> np.ndarray:
    return np.bitwise_count(x[:, None] ^ y[None, :]) <= 4 * threshold


def _promising(threshold: int):
    """Of a key's held and passing rows those with a partner whose sketch is close enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, part, _, _), rows in groups(batches, ["key", "part", "block", "slice"]):
            n = int((rows["side"].to_numpy() == 0).sum())
            node, mark = rows["node"].to_numpy(), rows["mark"].to_numpy()
            held, passing = np.zeros(n, bool), np.zeros(len(node) - n, bool)
            for k in range(n, len(node), 2048):
                close = _close(mark[:n], mark[k : k + 2048], threshold) & (node[:n, None] != node[None, k : k + 2048])
                held |= close.any(axis=1)
                passing[k - n : k - n + 2048] = close.any(axis=0)
            kept = np.concatenate([held, passing])
            if kept.any():
                size = int(kept.sum())
                side = np.concatenate([np.zeros(n, bool), np.ones(len(passing), bool)])[kept]
                yield pa.RecordBatch.from_arrays([pa.array([key] * size, pa.int64()), pa.array([part] * size, pa.int32()), pa.array(side), pa.array(node[kept])], ["key", "part", "passes", "node"])

    return run


def _connected(threshold: int):
    """Links that connect what a key's held and passing lines within the edits allowed connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, ["key", "part", "block", "slice"]):
            n = int((rows["side"].to_numpy() == 0).sum())
            node, lines = rows["node"].to_pylist(), rows["line"].to_pylist()
            if not 0 < n < len(node):
                continue
            marks, parent, found = sketches(*_codes(lines)), {x: x for x in node}, []

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for i in range(n):
                for j in (np.flatnonzero(_close(marks[i : i + 1], marks[n:], threshold)[0]) + n).tolist():
                    a, b = root(node[i]), root(node[j])
                    if a != b and within(lines[i], lines[j], allowed(max(len(lines[i]), len(lines[j])), threshold)):
                        parent[a] = b
                        found.append((node[i], node[j]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return run


def _texts(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """(node, line) of the nodes; their ids are broadcast where they are few, so that other lines are not shuffled."""
    ids = written(nodes.select("node").distinct(), "line-ids")
    return written(lines.select("node", "line").join(F.broadcast(ids) if ids.count() <= SMALL_IDS else ids, "node", "left_semi"), "line-texts")


def _verified(pairs: DataFrame, lines: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose lines are within the edits allowed."""
    pairs = written(pairs.distinct(), "line-pairs")
    texts = unsized(_texts(pairs.select(F.explode(F.array("a", "b")).alias("node")), lines))
    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            good = pa.array([within(p, q, allowed(max(len(p), len(q)), threshold)) for p, q in zip(x, y)], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    return written(both.transform(small_batches).mapInArrow(run, "a long, b long"), "line-links")


#: What ``_keys`` gives. Columns without nulls need no filters for them, with which the exchange below would not be shared.
_KEY_ROWS = "key long not null, slice int not null, node long not null, kind byte not null, mark long not null"


def _with_pivots(lines: DataFrame, threshold: int) -> DataFrame:
    """(key, node, kind, mark, pivot, pivot_mark) for each row of a key that has an indexed line and another one, but the pivot's.

    Rows go through one exchange, which both the keys' pivots and the join with these read. A key's pivot is its
    smallest indexed line. Only hot keys, of which a part of the lines shows many rows, are dealt to slices: the
    smallest indexed line of that part is the pivot of all their slices.
    """
    indexed = F.when(F.col("kind") == 0, F.col("node"))
    # Minima of numbers alone, which are aggregated by hash and need no sort.
    pivots = [F.count("*").alias("n"), F.min(indexed).alias("pivot"), F.min_by("mark", indexed).alias("pivot_mark")]

    def keyed(df: DataFrame, hot: np.ndarray) -> DataFrame:
        return df.select("node", "line").transform(small_batches).mapInArrow(_keys(threshold, hot), _KEY_ROWS)

    seen = keyed(lines.where(F.col("node") % EVERY == 0), np.zeros(0, np.int64)).groupBy("key").agg(*pivots)
    hot = seen.where(f"n >= {HOT_SEEN} and pivot is not null").orderBy(F.desc("n"), "key").limit(HOT_KEYS).collect()
    rows = keyed(lines, np.array(sorted(r.key for r in hot), np.int64)).repartition("key", "slice")
    keys = rows.groupBy("key", "slice").agg(*pivots).where("slice > 0 or n > 1 and pivot is not null").drop("n")
    if hot:
        own = lines.sparkSession.createDataFrame([(r.key, r.pivot, r.pivot_mark) for r in hot], "key long, hot long, hot_mark long")
        keys = keys.join(F.broadcast(own), "key", "left")
        keys = keys.select("key", "slice", F.coalesce("hot", "pivot").alias("pivot"), F.coalesce("hot_mark", "pivot_mark").alias("pivot_mark"))
    # Pivots are hashed, as they are few beside the rows, which then need no sort.
    return rows.join(keys.hint("shuffle_hash"), ["key", "slice"]).where("node != pivot").drop("slice")


def links(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): links that connect distinct lines (node, line) within the edits allowed for their length.

    A line is cut into threshold + 1 segments, of which an edited line keeps at least one. The index has a key for
    each segment, with the line's length and the segment's number; a line probes it with those of its substrings
    that could be a segment of a line as long as itself or shorter by up to the threshold. Of each key one
    indexed line is the pivot, which all others are verified against first. Only where a line is not linked to its
    pivot are the key's other pairs needed, since lines linked to the pivot are connected already; those keys are
    worked off in blocks, so that a key of any size is shared out, and give links enough to connect what is near, not
    all pairs. Sketches of a line's character pairs drop most pairs before the edit distance, without dropping any
    that is near enough.
    """
    met = written(_with_pivots(lines, threshold), "line-keys")
    like = F.bit_count(F.col("mark").bitwiseXOR(F.col("pivot_mark"))) <= 4 * threshold
    first = _verified(met.where(like).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")), lines, threshold)

    near = met.withColumns({"a": F.least("node", "pivot"), "b": F.greatest("node", "pivot")}).join(first.withColumn("near", F.lit(True)), ["a", "b"], "left")
    near = written(near.select("key", "node", "kind", "mark", F.coalesce("near", F.lit(False)).alias("near")), "line-near")
    open_keys = near.groupBy("key").agg(F.count(F.when(~F.col("near"), 1)).alias("far"), F.count(F.when(F.col("kind") == 0, 1)).alias("held"), F.count("*").alias("n"))
    open_rows = near.join(open_keys.where("far > 0 and held > 0 and n > 1").select("key"), "key", "left_semi")
    held = open_rows.where("kind = 0").withColumn("part", F.col("near").cast("int"))
    passing = open_rows.withColumn("part", F.lit(0)).unionByName(open_rows.where("not near").withColumn("part", F.lit(1)))
    shared = meetings(held.drop("kind", "near"), passing.drop("kind", "near"), ["key", "part"], "node", HELD, PASSING)
    promising = shared.transform(small_batches).mapInArrow(_promising(threshold), "key long, part int, passes boolean, node long")
    promising = written(promising.distinct(), "line-promising")
    texts = promising.join(unsized(_texts(promising, lines)), "node")
    shared = meetings(texts.where("not passes").drop("passes"), texts.where("passes").drop("passes"), ["key", "part"], "node", HELD, PASSING)
    return first.unionByName(shared.transform(small_batches).mapInArrow(_connected(threshold), "a long, b long"))


def _occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, mark, place, line) for each line long enough; ``mark`` tells texts of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Below the generator, so that a text is hashed and searched for white space once, not once for each of its lines;
    # most texts have none but spaces and line ends, which a search for single bytes tells faster than a pattern. Every
    # text has a line; the outer generator spares Spark's own filter for that, which would split the texts once more.
    rare = functools.reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in "\t\x0b\x0c\r"])
    plain = F.when(rare, F.regexp_replace(text, r"[\x09\x0B-\x0D]+", " ")).otherwise(text)
    marked = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), F.split(plain, "\n").alias("lines"))
    found = marked.select("id", "mark", F.posexplode_outer("lines").alias("place", "line")).withColumn("line", F.trim("line"))
    return found.where(F.length("line") >= min_chars if min_chars > 1 else F.col("line") != "")


def _digest(line: Column) -> Column:
    """128 bits that stand for a line, as two numbers."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = 1) -> DataFrame:
    """(id, mark, places): numbers of the lines of each text that repeat an earlier line of the corpus.

    Lines are compared without white space around them; lines of fewer than ``min_chars`` characters, and blank ones,
    never count as repeats. Lines of fewer than ``CHARS_PER_EDIT`` repeat exact copies only. Near lines form classes by reachability. The earliest line of a class, by id, then ``mark``,
    then place, is no repeat; rows equal in id and text are one text. Texts without repeats have no row.
    """
    seen = _occurrences(docs, id_col, text_col, min_chars)
    first = F.min(F.struct("id", "mark", "place")).alias("first")
    per_text = seen.groupBy("line").agg(first, F.count("*").alias("n"))
    # Numbered by Spark itself; the numbers stay, as they are written.
    lines = written(per_text.select(F.monotonically_increasing_id().alias("node"), "line", "first", "n"), "lines")
    classes = components(links(lines.where(F.length("line") >= CHARS_PER_EDIT), threshold))
    named = lines.select("node", _digest(F.col("line")).alias("digest"), "first", "n").join(classes, "node", "left")
    named = written(named.select("digest", "first", "n", F.coalesce("component", "node").alias("class")), "line-classes")
    heads = named.groupBy("class").agg(F.min("first").alias("head"), F.sum("n").alias("total")).where("total > 1")
    heads = written(named.join(heads, "class").select("digest", "head"), "line-heads")
    places = seen.select("id", "mark", "place", _digest(F.col("line")).alias("digest")).join(heads, "digest")
    later = ~F.struct("id", "mark", "place").eqNullSafe(F.col("head"))
    return places.where(later).groupBy("id", "mark").agg(F.sort_array(F.collect_set("place")).alias("places"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_kept: float = 0.0, min_chars: int = CHARS_PER_EDIT) -> DataFrame:
    """``docs`` with repeated lines taken out of the texts; a null text stays null, an empty table stays empty.

    Lines of fewer than ``min_chars`` characters stay, as prose and dialogue repeat them by chance.
    A row of which less than the share ``min_kept`` of its characters is left, though it had repeats, is dropped.
    """
    places = repeated_lines(docs, id_col, text_col, threshold, min_chars)
    names = [f"_own_{i}" for i in range(len(docs.columns))]
    own_id, own_text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    mark = F.xxhash64(F.coalesce(F.col(own_text), F.lit("")))
    joined = docs.toDF(*names).withColumn("mark", mark).join(places.toDF("_id", "_mark", "places"), F.col(own_id).eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    kept = F.array_join(F.filter(F.split(own_text, "\n"), lambda x, i: ~F.array_contains("places", i)), "\n")
    text: Column = F.when(F.col("places").isNull(), F.col(own_text)).otherwise(kept)
    found = joined.withColumn("_text", text)
    found = found.where(F.col("places").isNull() | (F.length("_text") >= F.lit(min_kept) * F.length(own_text)))
    return found.withColumn(own_text, F.col("_text")).select(*names).toDF(*docs.columns)
