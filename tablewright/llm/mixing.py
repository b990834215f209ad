"""Language-model scores by online logistic mixing of hashed-context bit predictors."""

from __future__ import annotations

import functools
import heapq
import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.common import BATCH_ROWS, small_batches, written

#: What a byte's context has where the word has not begun, and what ends a word.
GAP = 32
#: Slots of each predictor's table as powers of two, and of the parts they travel in. The predictors' contexts are
#: the last three bytes of the word so far, the last five, and all of them, each with the text's class so far.
SLOT_BITS, PART_BITS = (20, 22, 23), 16
PREDICTORS = len(SLOT_BITS)
#: Sightings of a slot from which on it counts as more certain; gates are pairs of certainties of the longer contexts.
CERTAIN = (1, 2, 4, 16, 64)
LEVELS = len(CERTAIN) + 1
GATES = LEVELS * LEVELS
#: A slot's smoothing.
PRIOR = 0.1
#: How fast the weights learn.
RATE = 0.005
#: Texts that a task mixes in step, steps after which ended texts make room for others, and lanes that go one by one.
LANES, STEPS, FEW = 512, 256, 12
#: Parts of a logit that decisions are kept in, and numbers they are kept in: a logit for each predictor, and the gate.
LOGIT, NUMBERS = 4096, 4
#: Frequent words that tell a text's class, and the number of classes.
MARKERS, CLASSES = 96, 8
#: The most frequent words, whose counts every task gets; the other words are joined.
TOP_WORDS = 100_000
#: Sightings from which on a frequent word's decisions are kept by a task, and decisions that it keeps.
KEPT_SEEN, KEPT_ROWS = 16, 1 << 21
#: Words of texts, and their bytes, from which on a task hands their counts on.
HELD_WORDS, HELD_BYTES = 1 << 21, 1 << 25
#: Bytes of texts whose words are split and looked up together for mixing, and rows that come in one Arrow batch for it.
BYTES_TOGETHER, MIXED_ROWS = 1 << 21, 200
#: Words that are worked on at once, and decisions from which on 32 bits may not hold a count.
WORDS_AT_ONCE, FULL = 1 << 12, 1 << 32
#: Bytes of words that are looked up at once, and words of a text that are laid out at once.
BYTES_AT_ONCE, PART_WORDS = 1 << 15, 1 << 8
#: A text of more words than that is long.
LONG_WORDS = 1 << 10
#: Words of a long text that are looked up at once.
LOOKED_UP = 1 << 9


def words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, lower-cased in A-Z."""
    return (text or "").encode().lower().split()


def split(texts: pa.Array) -> pa.ListArray:
    """The same of each text of a column, without a Python object for each word."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    found = parts.flatten()
    kept = pc.not_equal(found, "")
    ends = np.append(0, np.cumsum(kept.to_numpy(zero_copy_only=False), dtype=np.int32)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends[parts.offsets.to_numpy()]), found.filter(kept).cast(pa.binary()))


def sizes(texts: pa.ListArray) -> np.ndarray:
    """The number of words of each text."""
    return np.diff(texts.offsets.to_numpy()).astype(np.int64)


@dataclass
class Code:
    """A Huffman code of numbers, such as bytes: every bit is a decision at an inner node.

    If it has ``whole`` words, each word begins with their code, whose last number says that the word is none of them
    and is spelled in bytes. A whole word includes the space behind it. If there is a code of ``pairs`` of a byte and
    the one before it, bytes are spelled in that. ``train`` has all words spelled, as a whole word's bytes are not
    predicted from those before them; ``names`` are then its frequent words.
    """

    length: np.ndarray  # by number
    first: np.ndarray  # by number: where its decisions begin below
    node: np.ndarray  # hashed number of the node decided at
    bit: np.ndarray
    names: dict[bytes, int] = field(default_factory=dict)
    whole: "Code | None" = None
    pairs: "Code | None" = None
    place: np.ndarray | None = None  # twice the number of the node decided at, plus the bit

    def steps(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each number its decisions; where the decisions of all are found."""
        length = self.length[numbers]
        return length, np.arange(length.sum()) + np.repeat(self.first[numbers] - (np.cumsum(length) - length), length)


def huffman(counts: np.ndarray) -> Code:
    """A code for all numbers, as many as there are counts."""
    many = len(counts)
    heap = [(int(n) + 1, b, b) for b, n in enumerate(counts)]
    heapq.heapify(heap)
    # Of each number and then of each inner node twice the number of the inner node above it, plus the side.
    above = np.full(2 * many - 1, -1, np.int64)
    for k in range(many - 1):
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        above[a], above[b] = 2 * k, 2 * k + 1
        heapq.heappush(heap, (n + m, many + k + 1, many + k))
    climbs, at = [], above[:many]
    while (at >= 0).any():
        climbs.append(at)
        at = np.where(at >= 0, above[many + (at >> 1)], -1)
    length = sum([(c >= 0).astype(np.int64) for c in climbs], np.zeros(many, np.int64))
    first = np.cumsum(length) - length
    place = np.empty(length.sum(), np.int32)
    for up, c in enumerate(climbs):
        below = c >= 0
        place[(first + length - 1 - up)[below]] = c[below]
    nodes = ((place >> 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
    return Code(length, first, nodes, (place & 1).astype(np.uint8), place=place)


def _word_pairs(found: list[bytes], n: np.ndarray) -> np.ndarray:
    """By the byte before and the byte, how often words and the space behind them hold the two; a word begins after a space."""
    data = np.frombuffer(b" ".join([b"", *found, b""]), np.uint8).astype(np.int64)
    return np.bincount(data[:-1] << 8 | data[1:], np.repeat(n, [len(w) + 1 for w in found]), 1 << 16).astype(np.int64)


def with_words(code: Code, counted: list[tuple[bytes, int]], others: int, pairs: np.ndarray) -> Code:
    """The code with whole words, from their counts and that of all ``others``; and with codes of bytes by the one before.

    ``pairs``: counts of ``_word_pairs`` over all words, whole or not.
    """
    names, n = {w: i for i, (w, _) in enumerate(counted)}, np.array([n for _, n in counted], np.int64)
    spelled = np.maximum(pairs - (_word_pairs(list(names), n) if names else 0), 0)
    codes = [huffman(row) for row in spelled.reshape(256, 256)]
    length = np.concatenate([c.length for c in codes])
    by_pair = Code(length, np.cumsum(length) - length, np.concatenate([c.node for c in codes]), np.concatenate([c.bit for c in codes]))
    return Code(code.length, code.first, code.node, code.bit, names, huffman(np.append(n, others)) if names else None, by_pair)


def _mixed(context: np.ndarray) -> np.ndarray:
    mixed = context * np.uint32(0x9E3779B1)
    return (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D)


def _slots(contexts: list[np.ndarray], node: np.ndarray) -> list[np.ndarray]:
    """By predictor, the slots of nodes in mixed contexts."""
    return [context + node >> np.uint32(32 - size) for context, size in zip(contexts, SLOT_BITS)]


def _whole_slots(kinds: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
    """The slots of nodes of whole words, whose context is their class alone, or for the middle predictor none."""
    kind = _mixed(kinds.astype(np.uint32) * np.uint32(0x9E3779B9) + np.uint32(0x5BD1E995))
    return _slots([kind, np.zeros_like(kind), kind], node)


def decisions(code: Code, found: list[bytes], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each word, in a text of a class, with the space behind it: its number of decisions, their bits, and their slot for each predictor."""
    if code.whole is None:
        return _spelled(code, found, kinds)
    number = np.fromiter(map(code.names.get, found, itertools.repeat(len(code.names))), np.int64, len(found))
    length, step = code.whole.steps(number)
    bit, slots = code.whole.bit[step], _whole_slots(np.repeat(kinds, length), code.whole.node[step])
    rare = np.flatnonzero(number == len(code.names))
    if not len(rare):
        return length, bit, slots
    more, rest, others = _spelled(code, [found[i] for i in rare.tolist()], kinds[rare])
    total = length.copy()
    total[rare] += more
    spelled = np.zeros(total.sum(), bool)
    begin = (np.cumsum(total) - total + length)[rare]
    spelled[np.arange(more.sum()) + np.repeat(begin - (np.cumsum(more) - more), more)] = True
    out = [np.empty(len(spelled), x.dtype) for x in (bit, *slots)]
    for column, heads, tails in zip(out, (bit, *slots), (rest, *others)):
        column[~spelled], column[spelled] = heads, tails
    return total, out[0], out[1:]


def _spelled(code: Code, found: list[bytes], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The decisions of words that are spelled in bytes."""
    data = np.frombuffer(b" ".join([*found, b""]), np.uint8)
    sizes = np.array([len(w) + 1 for w in found])
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(data)) - start
    before = []
    for k in range(1, 6):
        shifted = np.concatenate([np.full(min(k, len(data)), GAP, np.uint8), data[:-k]])
        before.append(np.where(place >= k, shifted, GAP).astype(np.uint32))
    three = before[0] | before[1] << 8 | before[2] << 16
    five = (three | before[3] << 24) * np.uint32(0x27D4EB2F) + before[4] * np.uint32(0x165667B1)
    # The word so far: a difference of running sums of bytes times powers, scaled back to the word's beginning.
    odd, count = 0x9E3779B97F4A7C15, len(data)
    powers, inverse = (np.cumprod(np.r_[np.ones(1, np.uint64), np.full(count - 1, f, np.uint64)]) for f in (odd, pow(odd, -1, 1 << 64)))
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers)]
    word = (sums[:-1] - sums[start]) * inverse[start]
    word = (word ^ word >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
    kind = np.repeat(kinds.astype(np.uint32), sizes) * np.uint32(0x9E3779B9)
    contexts = [three * np.uint32(0x85EBCA6B) + kind, five * np.uint32(0xC2B2AE35) + kind, word.astype(np.uint32) + kind]

    # Every context tells the byte before, so nodes of its code need no other mark.
    own = code.pairs or code
    length, step = own.steps(before[0].astype(np.int64) << 8 | data if code.pairs else data)
    slots = _slots([np.repeat(_mixed(context), length) for context in contexts], own.node[step])
    return np.add.reduceat(length, np.cumsum(sizes) - sizes), own.bit[step], slots


@functools.cache
def _packings(left_out: int) -> list[np.ndarray]:
    """For each predictor, by bit and pair of counts: its logit and its share of the gate in their places of 64 bits."""
    other, own = (a.ravel().astype(np.int64) for a in np.meshgrid(np.arange(256), np.arange(256), indexing="ij"))
    own = np.maximum(own - left_out * (np.maximum(own, other) < 255), 0)
    logit, sure = np.rint(LOGIT * np.log((own + PRIOR) / (other + PRIOR))).astype(np.int16), np.searchsorted(CERTAIN, own + other, "right")
    out = []
    for k, share in enumerate((0, LEVELS, 1)):
        row = np.zeros((len(own), NUMBERS), np.int16)
        row[:, k], row[:, PREDICTORS] = logit, share * sure
        square = row.view(np.int64).reshape(256, 256)
        out.append(np.stack([square, square.T]).ravel())
    return out


def packed(bit: np.ndarray, slots: list[np.ndarray], tables: list[np.ndarray], left_out: int = 0) -> np.ndarray:
    """Each decision as 64 bits: the predictors' logits of the bit that comes, in parts of ``LOGIT``, and its gate.

    ``left_out`` of the bit's own sightings are not counted, unless the slot's counts were scaled down.
    """
    side, total = bit.astype(np.int64) << 16, np.zeros(len(bit), np.int64)
    # Each predictor's numbers have places of their own, and gates are below 2 to the 15th: nothing is carried.
    for packing, table, slot in zip(_packings(left_out), tables, slots):
        total += packing.take(table.view("<u2")[:, 0].take(slot) | side)
    return total


def inputs(bit: np.ndarray, slots: list[np.ndarray], tables: list[np.ndarray], left_out: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of each decision the predictors' logits of the bit that comes (predictor by decision), and its gate."""
    rows = packed(bit, slots, tables, left_out).view(np.int16).reshape(-1, NUMBERS)
    return rows[:, :PREDICTORS].T / np.float32(LOGIT), rows[:, PREDICTORS].astype(np.int32)


def whole_rows(code: Code, tables: list[np.ndarray], left_out: int = 0) -> np.ndarray:
    """The packed decisions at the nodes of whole words, by class and place: there are few, so each is looked up once."""
    if code.whole is None:
        return np.zeros((CLASSES + 1, 0), np.int64)
    node, bit = (np.zeros(code.whole.place.max() + 1, x.dtype) for x in (code.whole.node, code.whole.bit))
    node[code.whole.place], bit[code.whole.place] = code.whole.node, code.whole.bit
    return np.stack([packed(bit, _whole_slots(np.full(len(node), k), node), tables, left_out) for k in range(CLASSES + 1)])


def coded(found: list[bytes], kind: np.ndarray, code: Code, tables: list[np.ndarray], left_out: int = 0, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each word its number of decisions; and the packed decisions of all. ``whole``: those of ``whole_rows``."""
    if code.whole is None or whole is None:
        ends = np.cumsum([len(w) + 1 for w in found])
        cuts = [0, *(np.flatnonzero(np.diff(ends // BYTES_AT_ONCE)) + 1).tolist(), len(found)] if found else []
        lengths, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in itertools.pairwise(cuts):
            length, bit, slots = decisions(code, found[a:b], kind[a:b])
            lengths.append(length)
            rows.append(packed(bit, slots, tables, left_out))
        return np.concatenate(lengths), np.concatenate(rows)
    number = np.fromiter(map(code.names.get, found, itertools.repeat(len(code.names))), np.int64, len(found))
    length, step = code.whole.steps(number)
    heads = whole.ravel().take(np.repeat(kind.astype(np.int64) * whole.shape[1], length) + code.whole.place.take(step))
    rare = np.flatnonzero(number == len(code.names))
    if not len(rare):
        return length, heads
    bare, more, tails = Code(code.length, code.first, code.node, code.bit, pairs=code.pairs), np.zeros(len(found), np.int64), []
    ends = np.cumsum([len(found[i]) + 1 for i in rare.tolist()])
    for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(ends // BYTES_AT_ONCE)) + 1).tolist(), len(rare)]):
        own = rare[a:b]
        more[own], bit, slots = decisions(bare, [found[i] for i in own.tolist()], kind[own])
        tails.append(packed(bit, slots, tables, left_out))
    spelled = np.repeat(np.tile([False, True], len(found)), np.stack([length, more], axis=1).ravel())
    rows = np.empty(len(spelled), np.int64)
    rows[spelled], rows[~spelled] = np.concatenate(tails), heads
    return length + more, rows


class Kept:
    """Looks words up as ``coded`` does, and keeps the decisions of frequent words by class, as these come in most texts."""

    def __init__(self, names: dict[bytes, int], look_up: Callable):
        self.names, self.look_up, self.many = names, look_up, 0
        self.start, self.length = np.full(len(names) * (CLASSES + 1), -1, np.int32), np.zeros(len(names) * (CLASSES + 1), np.int32)
        self.rows = np.zeros(KEPT_ROWS, np.int64)

    def __call__(self, found: list[bytes], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number = np.fromiter(map(self.names.get, found, itertools.repeat(-1)), np.int64, len(found))
        own = np.flatnonzero(number >= 0)
        key = number[own] * (CLASSES + 1) + kind[own]
        there = self.start[key] >= 0
        fresh = np.ones(len(found), bool)
        fresh[own[there]] = False
        new, old = np.flatnonzero(fresh), key[there]
        more, rows = self.look_up([found[i] for i in new.tolist()], kind[new])
        length = np.zeros(len(found), np.int64)
        length[new], length[~fresh] = more, self.length[old]
        out, spread = np.empty(length.sum(), np.int64), np.repeat(fresh, length)
        out[spread] = rows
        ends = np.cumsum(self.length[old], dtype=np.int64)
        out[~spread] = self.rows.take(np.arange(len(out) - len(rows)) + np.repeat(self.start[old] - ends + self.length[old], self.length[old]))
        # Each word and class comes once, so what is new is kept once, as far as there is room.
        begin, at = np.cumsum(more) - more, np.searchsorted(new, own[~there])
        many = more[at]
        fits = np.cumsum(many) <= KEPT_ROWS - self.many
        at, many, key = at[fits], many[fits], key[~there][fits]
        ends = np.cumsum(many)
        if len(at):
            self.rows[self.many : self.many + ends[-1]] = rows.take(np.arange(ends[-1]) + np.repeat(begin[at] - ends + many, many))
            self.start[key], self.length[key] = self.many + ends - many, many
            self.many += int(ends[-1])
        return length, out


def kinds(found: list[bytes], markers: dict[bytes, int], sizes: np.ndarray | None = None) -> np.ndarray:
    """Of each word the class that most markers before it in the text belong to; 0 where there was none.

    ``sizes``: the words are those of several texts, of so many words each.
    """
    sizes = np.array([len(found)]) if sizes is None else sizes
    return _kinds(np.fromiter(map(markers.get, found, itertools.repeat(-1)), np.int8, len(found)), sizes)


def _kinds(seen: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``kinds`` from the class of each word that is a marker, and -1 for the others."""
    begin = np.cumsum(sizes) - sizes
    best, most = np.zeros(len(seen), np.int8), np.zeros(len(seen), np.int32)
    for k in range(CLASSES):
        hits = seen == k
        before = np.cumsum(hits, dtype=np.int32) - hits
        before -= np.repeat(np.append(before, 0)[begin], sizes)
        best[before > most] = k + 1
        np.maximum(most, before, out=most)
    return best


def cluster(together: np.ndarray) -> np.ndarray:
    """Classes of markers from the number of texts that hold both of a pair: average linkage of their cosines."""
    own = np.sqrt(np.maximum(np.diag(together), 1))
    like = together / own[:, None] / own[None, :]
    parts = [[i] for i in range(len(like))]
    while len(parts) > CLASSES:
        score = np.array([[like[np.ix_(a, b)].mean() if i < j else -1 for j, b in enumerate(parts)] for i, a in enumerate(parts)])
        i, j = np.unravel_index(score.argmax(), score.shape)
        parts[i] += parts.pop(j)
    found = np.zeros(len(like), np.int64)
    for k, members in enumerate(sorted(parts, key=min)):
        found[members] = k
    return found


def _count_together(names: list[bytes]):
    """Texts to the numbers of this task's texts that hold both of a pair of markers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), len(names)))
        for batch in batches:
            found = split(batch.column("text"))
            own = pc.fill_null(pc.index_in(found.values, value_set=pa.array(names, pa.binary())), -1).to_numpy()
            held = np.zeros((batch.num_rows, len(names)), np.float32)
            text = np.repeat(np.arange(batch.num_rows), sizes(found))
            held[text[own >= 0], own[own >= 0]] = 1
            total += held.T @ held
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j].astype(np.int64))], ["i", "j", "n"])

    return run


def _count_words(markers: dict[bytes, int] | None):
    """Texts to counts of words, by the class of the text so far if there are markers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            found = pa.chunked_array([x.values for x in held], pa.binary()).combine_chunks().dictionary_encode()
            at, names = found.indices.to_numpy(), found.dictionary
            if markers:
                at = at * np.int64(CLASSES + 1) + _kinds(_classes(names, markers)[at], np.concatenate([sizes(x) for x in held]))
            n = np.bincount(at)
            key = np.flatnonzero(n)
            word, kind = np.divmod(key, CLASSES + 1) if markers else (key, np.zeros(len(key), np.int64))
            return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), names.take(pa.array(word)).cast(pa.string()), pa.array(n[key])], ["kind", "word", "n"])

        held: list[pa.ListArray] = []
        for batch in batches:
            held.append(split(batch.column("text")))
            if sum(len(x.values) for x in held) >= HELD_WORDS or sum(x.nbytes for x in held) >= HELD_BYTES:
                yield out()
                held = []
        if held:
            yield out()

    return run


def _classes(names: pa.Array, markers: dict[bytes, int]) -> np.ndarray:
    """The class of each word that is a marker, -1 of others."""
    own = pc.fill_null(pc.index_in(names, value_set=pa.array(list(markers), pa.binary())), -1).to_numpy()
    return np.array([*markers.values(), -1], np.int8)[own]


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        total += _word_pairs([w.encode() for w in batch.column("word").to_pylist()], batch.column("n").to_numpy())
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["pair", "n"])


def _word_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    for batch in batches:
        found, n, kind = [w.encode() for w in batch.column("word").to_pylist()], batch.column("n").to_numpy(), batch.column("kind").to_numpy()
        start, size = 0, 0
        for i, w in enumerate(found):
            size += len(w) + 1
            if size >= 8 * WORDS_AT_ONCE or i == len(found) - 1:
                yield found[start : i + 1], n[start : i + 1], kind[start : i + 1]
                start, size = i + 1, 0


def _count_decisions(code: Broadcast):
    """Counted words to parts of the predictors' tables: how often a slot's bit was 0 and 1.

    While a task counts, its tables hold 32 bits for each count, and are handed on before one might not be enough.
    """
    width = 2 << PART_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, tables, held = zstandard.ZstdCompressor(level=1), [np.zeros(2 << size, np.uint32) for size in SLOT_BITS], 0

        def out(k: int, part: int, counts: np.ndarray) -> pa.RecordBatch:
            blob = packer.compress(counts.astype(np.int64).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([blob], pa.binary())], ["predictor", "part", "counts"])

        def handed_on() -> Iterator[pa.RecordBatch]:
            for k, table in enumerate(tables):
                for part, counts in enumerate(table.reshape(-1, width)):
                    if counts.any():
                        yield out(k, part, counts)
                        counts[:] = 0

        for found, n, kind in _word_parts(batches):
            length, bit, slots = decisions(code.value, found, kind)
            places, times = [slot << np.uint32(1) | bit for slot in slots], np.repeat(n.astype(np.int64), length)
            most = int(times.sum(dtype=np.float64))
            if held + most >= FULL:
                yield from handed_on()
                held = 0
            if most < FULL:
                held += most
                for table, place in zip(tables, places):
                    np.add.at(table, place, times.astype(np.uint32))
                continue
            for k, place in enumerate(places):
                place, at = np.unique(place, return_inverse=True)
                total = np.zeros(len(place), np.int64)
                np.add.at(total, at, times)
                for part in np.unique(place // width).tolist():
                    counts, own = np.zeros(width, np.int64), place // width == part
                    counts[place[own] % width] = total[own]
                    yield out(k, part, counts)
        yield from handed_on()

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted parts to one row for each part, its pairs scaled to at most 255."""
    unpacker, key, total = zstandard.ZstdDecompressor(), None, np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        pairs = total.reshape(-1, 2)
        scale = np.maximum(pairs.max(axis=1, keepdims=True) / 255, 1)
        small = np.where(pairs > 0, np.maximum(pairs / scale, 1), 0).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([small.tobytes()], pa.binary())], ["predictor", "part", "counts"])

    for batch in batches:
        for k, part, blob in zip(*(batch.column(c).to_pylist() for c in ("predictor", "part", "counts"))):
            if (k, part) != key:
                if key is not None:
                    yield out()
                key, total = (k, part), np.zeros(2 << PART_BITS, np.int64)
            total += np.frombuffer(unpacker.decompress(blob), np.int64)
    if key is not None:
        yield out()


def first_weights() -> np.ndarray:
    """Where learning begins, by gate and predictor: trust in the longest context seen."""
    w = np.zeros((LEVELS, LEVELS, PREDICTORS))
    w[:, :] = (0.3, 0.8, 0.5)
    w[:, 0] = (0.5, 0.7, 0.0)
    w[0, :] = (0.8, 0.0, 0.0)
    w[-1, :, 2] = np.linspace(0.0, 0.8, LEVELS)
    return w.reshape(GATES, PREDICTORS)


@dataclass
class Block:
    """Words of some texts, each with its class once, and their decisions."""

    words: list[bytes]
    length: np.ndarray
    rows: np.ndarray

    def __post_init__(self):
        self.start = np.cumsum(self.length) - self.length

    def parts(self, places: np.ndarray) -> Iterator[np.ndarray]:
        """The decisions of a text of such words, in order."""
        for i in range(0, len(places), PART_WORDS):
            part = places[i : i + PART_WORDS]
            length = self.length[part]
            ends = np.cumsum(length)
            yield self.rows.take(np.arange(ends[-1]) + np.repeat(self.start[part] - ends + length, length))


def block(names: list[bytes], key: np.ndarray, look_up: Callable) -> tuple[Block, np.ndarray]:
    """The words and classes that keys (place of the name, class) hold; and the place of each key in it."""
    there = np.zeros(len(names) * (CLASSES + 1), bool)
    there[key] = True
    word, kind = np.divmod(np.flatnonzero(there), CLASSES + 1)
    names = [names[k] for k in word.tolist()]
    return Block(names, *look_up(names, kind)), (np.cumsum(there) - 1)[key]


@dataclass
class Long:
    """A long text: its words, each once; their decisions are looked up as they are needed, for a lane holds them long."""

    words: list[bytes]
    kind: np.ndarray  # by word of the text, in order
    look_up: Callable

    def parts(self, places: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(0, len(places), LOOKED_UP):
            own, at = np.unique(places[i : i + LOOKED_UP], return_inverse=True)
            held, key = block([self.words[k] for k in own.tolist()], at * (CLASSES + 1) + self.kind[i : i + LOOKED_UP], self.look_up)
            yield from held.parts(key)


def blocks(texts: pa.ListArray | list[list[bytes]], markers: dict[bytes, int], look_up: Callable) -> Iterator[tuple[Block | Long, list[tuple[int, np.ndarray]]]]:
    """The texts in blocks, each with its number and the places of its words; a long text comes by itself."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.list_(pa.binary()))
    many, found = sizes(texts), texts.flatten().dictionary_encode()
    names, at = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
    kind, begin = _kinds(_classes(found.dictionary, markers)[at], many), np.cumsum(many) - many
    short = many <= LONG_WORDS
    numbers, own = np.flatnonzero(short), np.repeat(short, many)
    if len(numbers):
        held, places = block(names, at[own] * np.int64(CLASSES + 1) + kind[own], look_up)
        yield held, list(zip(numbers.tolist(), np.split(places, np.cumsum(many[short])[:-1])))
    for i in np.flatnonzero(~short).tolist():
        own = slice(begin[i], begin[i] + many[i])
        yield Long(names, kind[own], look_up), [(i, at[own])]


class Mixer:
    """Mixes the predictors of texts bit by bit, as many texts in step as there are lanes.

    A bit is predicted with the weights of its lane and gate, which learn from it before the lane's next bit is
    predicted. ``fresh``: each text begins with the given weights; else it begins with what its lane has learned.
    """

    def __init__(self, weights: np.ndarray, fresh: bool):
        # Weights are those of logits in parts of ``LOGIT``.
        self.scale, self.fresh = LOGIT, fresh
        self.first = np.zeros((GATES, NUMBERS), np.float32)
        self.first[:, :PREDICTORS] = weights / self.scale
        self.weights = np.tile(self.first, (LANES, 1))
        self.seen = np.zeros(LANES * GATES, np.int64)

    def learned(self) -> tuple[np.ndarray, np.ndarray]:
        """By gate the number of bits seen and, summed over these, the weights of their lanes."""
        seen = self.seen.reshape(LANES, GATES, 1)
        weights = self.weights[:, :PREDICTORS].reshape(LANES, GATES, PREDICTORS).astype(np.float64) * self.scale
        return seen.sum(axis=0)[:, 0], (weights * seen).sum(axis=0)

    def run(self, texts: Iterator[tuple[int, Iterator[np.ndarray]]]) -> Iterator[tuple[int, float]]:
        """The texts' numbers and, if they begin fresh, bits, as they end."""
        key, parts, part, bits = [-1] * LANES, [iter(())] * LANES, [np.zeros(0, np.int64)] * LANES, np.zeros(LANES)
        at, many = np.zeros(LANES, np.int64), np.zeros(LANES, np.int64)
        held = np.zeros((LANES, STEPS), np.int64)
        more = True
        while True:
            for lane in np.flatnonzero(at == many).tolist():
                while part[lane] is not None and at[lane] == many[lane]:
                    at[lane], part[lane] = 0, next(parts[lane], None)
                    if part[lane] is not None:
                        many[lane] = len(part[lane])
                        continue
                    many[lane] = 0
                    if key[lane] >= 0:
                        yield key[lane], float(bits[lane])
                    new = next(texts, None) if more else None
                    more = new is not None
                    if more:
                        (key[lane], parts[lane]), part[lane], bits[lane] = new, np.zeros(0, np.int64), 0
                        if self.fresh:
                            self.weights[lane * GATES : (lane + 1) * GATES] = self.first
            size = np.minimum(many - at, STEPS)
            if not size.any():
                return
            order = np.argsort(-size, kind="stable")
            for row, lane, n, a in zip(itertools.count(), order[: np.count_nonzero(size)].tolist(), size[order].tolist(), at[order].tolist()):
                held[row, :n] = part[lane][a : a + n]
            at += size
            mixed = self._steps if np.count_nonzero(size) > FEW else self._one_by_one
            bits[order] += mixed(held, size[order], order)

    def _steps(self, held: np.ndarray, size: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        """Mix the rows' next decisions, of which each row has as many as its size, longest first; the bits they take."""
        lanes, steps, taken = lanes[: np.count_nonzero(size)], int(size[0]), np.zeros(len(size))
        rows = held[: len(lanes), :steps].T.copy()
        gate = rows >> 16 * PREDICTORS
        gate += lanes * GATES
        x = rows.view(np.int16).reshape(steps, len(lanes), NUMBERS).astype(np.float32)
        odds = np.empty(x.shape[:2], np.float32)
        # Four numbers of a row are moved as one. The last of them is the gate, whose weight is zero and learns nothing.
        weights, minus, begin = self.weights.view(np.complex128)[:, 0], np.full(NUMBERS, -1, np.float32), 0
        learn = np.array([[1] * PREDICTORS + [0], [-1] * PREDICTORS + [0]], np.float32) * np.float32(RATE / LOGIT**2)
        with np.errstate(over="ignore"):
            for end in np.unique(size[: len(lanes)]).tolist():
                n = int(np.count_nonzero(size >= end))
                own, step = np.empty(n, np.complex128), np.empty((n, NUMBERS), np.float32)
                w, right = own.view(np.float32).reshape(n, NUMBERS), np.ones((n, 2), np.float32)
                flat = right[:, 1]
                for a, i, u in zip(x[begin:end, :n], gate[begin:end, :n], odds[begin:end, :n]):
                    weights.take(i, out=own, mode="clip")
                    np.multiply(w, a, step)
                    np.dot(step, minus, u)
                    np.exp(u, u)
                    np.add(u, 1, u)
                    np.divide(1, u, flat)
                    # One less the chance of the bit that came, for each weight.
                    np.dot(right, learn, step)
                    np.multiply(a, step, step)
                    np.add(w, step, w)
                    weights[i] = own
                if self.fresh:
                    taken[:n] += np.log2(np.minimum(odds[begin:end, :n], np.float32(math.exp(80)))).sum(axis=0, dtype=np.float64)
                else:
                    self.seen += np.bincount(gate[begin:end, :n].ravel(), minlength=len(self.seen))
                begin = end
        return taken

    def _one_by_one(self, held: np.ndarray, size: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        """The same for a few rows, whose steps would take longer to begin than to do."""
        taken, rate = np.zeros(len(size)), RATE / LOGIT**2
        for row, lane in enumerate(lanes[: np.count_nonzero(size)].tolist()):
            own, rows, bits = self.weights[lane * GATES : (lane + 1) * GATES], held[row, : size[row]].view(np.int16).reshape(-1, NUMBERS), 0.0
            weights = own.tolist()
            for x, y, z, gate in rows.tolist():
                w = weights[gate]
                odds = math.exp(min(-(w[0] * x + w[1] * y + w[2] * z), 80))
                step = rate * odds / (1 + odds)
                w[0] += step * x
                w[1] += step * y
                w[2] += step * z
                bits += math.log2(1 + odds)
            own[:] = weights
            taken[row] = bits
            if not self.fresh:
                self.seen[lane * GATES : (lane + 1) * GATES] += np.bincount(rows[:, PREDICTORS], minlength=GATES)
        return taken


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``BYTES_TOGETHER``, from smaller and larger ones."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(ends // BYTES_TOGETHER)) + 1).tolist(), batch.num_rows]
        for a, b in itertools.pairwise(cuts):
            if b > a:
                held.append(batch.slice(a, b - a))
                size += int(ends[b - 1] - (ends[a - 1] if a else 0))
            if size >= BYTES_TOGETHER:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _longest_first(texts: DataFrame) -> DataFrame:
    """Each task's texts, so that no long one is left to be mixed alone when the others have ended."""
    return texts.sortWithinPartitions(F.desc(F.length("text")))


def _learn(code: Broadcast, tables: Broadcast, markers: dict[bytes, int], weights: np.ndarray):
    """Texts to what a task's lanes learn from them, each word predicted without one of its own sightings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, look_up = Mixer(weights, fresh=False), Kept(code.value.names, lambda w, k: coded(w, k, code.value, tables.value, 1))

        def texts() -> Iterator[tuple[int, Iterator[np.ndarray]]]:
            for batch in _cut(batches):
                for block, members in blocks(split(batch.column("text")), markers, look_up):
                    yield from ((i, block.parts(places)) for i, places in members)

        for _ in mixer.run(texts()):
            pass
        seen, total = mixer.learned()
        arrays = [pa.array(np.arange(GATES)), pa.array(seen), *(pa.array(c) for c in total.T)]
        yield pa.RecordBatch.from_arrays(arrays, ["gate", "seen", *(f"w{i}" for i in range(PREDICTORS))])

    return run


@dataclass
class Model:
    """What is learned: word counts in a table; code, tables of a fixed size, weights and markers in a broadcast."""

    vocabulary: DataFrame
    tokens: int
    types: int
    ends: int
    mixer: Broadcast
    top: Broadcast


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Learn from all rows of ``docs``.

    Words are counted in tasks and added up by word. The most frequent are markers, clustered by the texts that hold
    them; a text's class at a word is what most markers before it say. As the predictors' contexts are a class and
    bytes of the word so far, decisions are counted from the words' counts by class, in tables of a fixed size whose
    parts are added up in a shuffle. The gates' weights are learned online: each task goes through its texts bit by
    bit, predicts a bit without one of its word's own sightings and corrects the weights it came from before the next
    one. What the tasks' lanes have learned is averaged by the bits they saw; so weights depend a little on how rows
    are dealt to tasks. What is broadcast is bounded by parameters: two bytes for each slot, the weights, and
    ``TOP_WORDS`` words of at most 64 characters.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    ddl = "kind int, word string, n long"
    counted = texts.transform(small_batches).mapInArrow(_count_words(None), ddl).groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = written(counted, "vocabulary")
    seen, types = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = texts.count()
    top = vocabulary.where(F.length("word") <= 64).orderBy(F.desc("n"), "word").limit(TOP_WORDS).collect()
    names = [r.word.encode() for r in top[:MARKERS]]
    together = np.zeros((len(names), len(names)))
    pairs = texts.transform(small_batches).mapInArrow(_count_together(names), "i long, j long, n long")
    for r in pairs.groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        together[r.i, r.j] = r.n
    markers = dict(zip(names, cluster(together).tolist()))
    by_pair = vocabulary.transform(small_batches).mapInArrow(_count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 << 16, np.int64)
    for r in by_pair:
        counts[r.pair] = r.n
    spelled = with_words(huffman(counts.reshape(256, 256).sum(axis=0)), [], 0, counts)
    often = [r.word.encode() for r in top if r.n >= KEPT_SEEN]
    code = replace(spelled, names={w: i for i, w in enumerate(often)})
    shared_bare, shared_code = spark.sparkContext.broadcast(spelled), spark.sparkContext.broadcast(code)

    by_kind = texts.transform(small_batches).mapInArrow(_count_words(markers), ddl).groupBy("kind", "word").agg(F.sum("n").alias("n"))
    by_kind = written(by_kind, "vocabulary-by-class")
    parts = by_kind.transform(small_batches).mapInArrow(_count_decisions(shared_bare), "predictor int, part int, counts binary")
    summed = parts.repartition("predictor", "part").sortWithinPartitions("predictor", "part")
    summed = written(summed.transform(small_batches).mapInArrow(_add_up, "predictor int, part int, counts binary"), "predictors")
    tables = [np.zeros((1 << size, 2), np.uint8) for size in SLOT_BITS]
    for r in summed.toLocalIterator():
        tables[r.predictor][r.part << PART_BITS : (r.part + 1) << PART_BITS] = np.frombuffer(r.counts, np.uint8).reshape(-1, 2)
    shared = spark.sparkContext.broadcast(tables)
    weights, columns = first_weights(), [f"w{i}" for i in range(PREDICTORS)]
    learned = texts.transform(_longest_first).transform(small_batches, MIXED_ROWS).mapInArrow(_learn(shared_code, shared, markers, weights), "gate long, seen long, " + ", ".join(f"{c} double" for c in columns))
    for r in learned.groupBy("gate").agg(F.sum("seen"), *[F.sum(c) for c in columns]).where("sum(seen) > 0").collect():
        weights[r[0]] = np.array(r[2:]) / r[1]
    mixer = spark.sparkContext.broadcast((code, tables, weights, markers))
    return Model(vocabulary, seen + ends, types + (ends > 0), ends, mixer, spark.sparkContext.broadcast({r.word.encode(): r.n for r in top}))


def _score(mixer: Broadcast, top: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words, (code, tables, weights, markers) = top.value, mixer.value
        waiting: dict[int, tuple] = {}
        look_up = Kept(code.names, lambda w, k: coded(w, k, code, tables))

        def texts() -> Iterator[tuple[int, Iterator[np.ndarray]]]:
            number, names = itertools.count(), None
            for batch in _cut(batches):
                found, row, own = split(batch.column("text")), batch.column("row").to_pylist(), batch.column("id")
                so_far = np.append(0, np.cumsum(pc.binary_length(found.values).to_numpy().astype(np.int64) + 1))
                size = np.diff(so_far[found.offsets.to_numpy()]).tolist()
                for block, members in blocks(found, markers, look_up):
                    if block.words is not names:  # long texts that come together share theirs
                        names = block.words
                        seen = np.fromiter(map(known_words.get, names, itertools.repeat(-1)), np.int64, len(names))
                        known = seen >= 0
                        log = np.where(known, np.log10(np.maximum(seen, 0) + 0.5), 0.0)
                    for i, places in members:
                        rare, times = np.unique(places[~known[places]], return_counts=True) if len(places) else (places, places)
                        n_known, n_bytes = len(places) - int(times.sum()), size[i]
                        key = next(number)
                        waiting[key] = row[i], own[i], len(places) + 1, n_known, float(log[places].sum()), [block.words[k].decode() for k in rare], times, n_bytes
                        yield key, block.parts(places)

        def out(ended: list[tuple]) -> pa.RecordBatch:
            row, own, n_tokens, known, sums, rare, times, n_bytes, bits = zip(*ended)
            offsets = np.cumsum([0, *map(len, rare)])
            rest = pa.StructArray.from_arrays([pa.array(itertools.chain(*rare), pa.string()), pa.array(np.concatenate(times), pa.int64())], ["word", "times"])
            columns = [
                pa.array(row, pa.int64()), pa.array(own, id_type), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rest), pa.array(bits, pa.float64()), pa.array(n_bytes, pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["row", "id", "n_tokens", "known", "sums", "rest", "bits", "n_bytes"])

        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        id_type, batches, ended = first.column("id").type, itertools.chain([first], batches), []
        for key, bits in Mixer(weights, fresh=True).run(texts()):
            ended.append((*waiting.pop(key), bits))
            if len(ended) == BATCH_ROWS:
                yield out(ended)
                ended = []
        if ended:
            yield out(ended)

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, bits_per_byte) for each row.

    A text is its lower-cased words and an end. ``score`` is the model's log10 probability of it: of its words with
    the space behind each, and of going on or ending after each. The weights begin as trained and learn from each bit
    of the text, so the model's score of one text does not depend on the others. ``base_score`` is that of a smoothed unigram model
    of words. Null and empty texts are an end alone; rows that repeat are scored each. Frequent words are looked up in
    each task, the others joined with the vocabulary by word and added up by row.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ddl = f"row long, id {id_type}, n_tokens long, known long, sums double, rest array<struct<word: string, times: long>>, bits double, n_bytes long"
    found = written(rows.transform(_longest_first).transform(small_batches, MIXED_ROWS).mapInArrow(_score(model.mixer, model.top), ddl), "scores")
    rare = found.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.times")
    rare = rare.join(model.vocabulary, "word", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("c"))
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("rare_sums")
    )
    norm, end = math.log10(model.tokens + 0.5 * (model.types + 1)), math.log10(model.ends + 0.5)
    stop = (model.ends + 0.5) / (model.tokens + 1)
    joined = found.drop("rest").join(rare, "row", "left")
    known = F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(model.ends > 0))
    base = F.col("sums") + F.coalesce("rare_sums", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(norm)
    bits = F.col("bits") - (F.col("n_tokens") - 1) * F.lit(math.log2(1 - stop)) - F.lit(math.log2(stop))
    return joined.select(
        F.col("id").alias(id_col), "n_tokens", known.cast("long").alias("n_known"), base.alias("base_score"),
        (-bits * F.lit(math.log10(2))).alias("score"), (bits / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def held_out(key: str) -> Column:
    """Whether a row is kept out of training: the checksum of its id as text leaves 1 when divided by 5; a null id is empty."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 1
