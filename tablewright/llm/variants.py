"""Spelling variants: words one edit apart, found in tries over how often groups of letters occur in a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.common import groups, meetings, small_batches, written

#: Words are runs of these letters.
RUN = "[A-Za-zÀ-ÿ]+"
MIN_CHARS, MIN_COUNT = 5, 3
#: Letters fall into so many groups by code point, each of a-z into one of its own. Groups are taken in the order of
#: their letters here, frequent ones first; the counts of the first few and the length are a word's shard.
GROUPS, SHARD, ORDER = 32, 3, "eaoinrtslucdmpghbvfyqxzjwk"
#: A word has to be found so many times as often as its variant.
DOMINANCE = 2
#: Words whose trie a task holds, and those that it looks up in it.
HELD, PASSING = 16_384, 131_072
#: So few words below a node of a trie are looked at without going further down.
LEAF = 8
#: Letters of words compared as numbers; longer ones are compared as text.
WIDTH = 32
#: Far above the logarithm of any chain of forms.
MAX_ROUNDS = 60
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_first = [ord(c) % GROUPS for c in ORDER]
#: The place of each group among a word's counts.
_PLACE = np.argsort(_first + [g for g in range(GROUPS) if g not in _first])


def vectors(words: list[str]) -> np.ndarray:
    """The counts of each word's letters by group."""
    sizes = np.array([len(w) for w in words])
    codes = _PLACE[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32) % GROUPS]
    owner = np.repeat(np.arange(len(words)), sizes)
    return np.bincount(owner * GROUPS + codes, minlength=len(words) * GROUPS).reshape(len(words), GROUPS).astype(np.int32)


def shards(words: list[str]) -> np.ndarray:
    """The counts of each word's first groups, and the number of its other letters."""
    counts = vectors(words)
    return np.column_stack([counts[:, :SHARD], counts[:, SHARD:].sum(axis=1)])


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point inserted, deleted or replaced turns one into the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)
    while low < high:  # the length of the common beginning
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def reachable(shard: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Shards that a surplus and a deficit of one each lead to, own one first, with what the first groups spend of them (1: surplus, 2: deficit)."""
    base = tuple(shard.tolist())
    out = [(base, 0)]
    steps = [(i, 1 if i < SHARD else 0) for i in range(SHARD + 1)]
    for i, cost in steps:
        more = (*base[:i], base[i] + 1, *base[i + 1 :])
        out.append((more, cost))
        if base[i]:
            out.append(((*base[:i], base[i] - 1, *base[i + 1 :]), 2 * cost))
        out += [((*more[:j], more[j] - 1, *more[j + 1 :]), cost + 2 * other) for j, other in steps if j != i and more[j]]
    return out


class Spelled:
    """Words as rows of letters from the left and from the right, as far as ``WIDTH`` letters."""

    def __init__(self, words: list[str]):
        self.words, self.sizes = words, np.array([len(w) for w in words])
        self.left, self.right = (self._letters([cut(w) for w in words]) for cut in (lambda w: w[:WIDTH].ljust(WIDTH, "\0"), lambda w: w[-WIDTH:].rjust(WIDTH, "\0")))

    @staticmethod
    def _letters(rows: list[str]) -> np.ndarray:
        text = "".join(rows)
        wide = max(text, default="") > "\xff"
        return np.frombuffer(text.encode("utf-32-le" if wide else "latin-1"), np.uint32 if wide else np.uint8).reshape(-1, WIDTH)

    def near(self, place: int, other: Spelled, places: np.ndarray) -> np.ndarray:
        """Those of the other's places whose words are one edit from the word at ``place``.

        One edit leaves all of the longer word but a letter to a common beginning and a common end.
        """
        size = self.sizes[place]
        places = places[np.abs(other.sizes[places] - size) <= 1]
        if size >= WIDTH:
            return np.array([i for i in places.tolist() if one_edit(self.words[place], other.words[i])], int)
        apart = other.left[places] != self.left[place]
        same = apart.argmax(axis=1) + (other.right[places] != self.right[place])[:, ::-1].argmax(axis=1)
        return places[(same >= np.maximum(other.sizes[places], size) - 1) & apart.any(axis=1)]


class Trie:
    """Words arranged by successive letter-group counts: sorted vectors, of which a node is a range with one beginning."""

    def __init__(self, words: list[str], counts: np.ndarray):
        order = np.lexsort(counts.T[::-1]) if len(words) else np.zeros(0, int)
        self.order, self.counts, self.words = order, counts[order], Spelled([words[i] for i in order])

    def search(self, words: list[str], counts: np.ndarray, spent: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place of a word looked up, place of a held word) for each two within one edit.

        Goes down depth first with all words that still have budget: a child's count may exceed a word's by one
        once (surplus) and fall short of it by one once (deficit). Words at the leaves are compared themselves.
        """
        spelled = Spelled(words)
        stack = [(SHARD, 0, len(self.order), np.arange(len(words)), (spent & 1).astype(bool), (spent & 2).astype(bool))]
        while stack:
            level, low, high, at, surplus, deficit = stack.pop()
            if high - low <= LEAF or level == GROUPS or (self.counts[low, level:] == self.counts[high - 1, level:]).all():
                yield from self._leaf(level, low, high, spelled, counts, at, surplus, deficit)
                continue
            column, own = self.counts[low:high, level], counts[at, level]
            cuts = np.flatnonzero(np.diff(column)) + low + 1
            for a, b in zip([low, *cuts.tolist()], [*cuts.tolist(), high]):
                apart = self.counts[a, level] - own
                open_ = (apart == 0) | ((apart == 1) & ~surplus) | ((apart == -1) & ~deficit)
                if open_.any():
                    stack.append((level + 1, a, b, at[open_], surplus[open_] | (apart[open_] == 1), deficit[open_] | (apart[open_] == -1)))

    def _leaf(self, level: int, low: int, high: int, words: Spelled, counts: np.ndarray, at: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[int, int]]:
        one = (self.counts[low, level:] == self.counts[high - 1, level:]).all()
        for held in range(low, high):
            if held == low or not one:
                apart = self.counts[held, level:] - counts[at, level:]
                good = (np.maximum(apart, 0).sum(axis=1) <= ~surplus) & (np.maximum(-apart, 0).sum(axis=1) <= ~deficit)
                some = at[good]
            for i in self.words.near(held, words, some).tolist():
                yield i, int(self.order[held])


#: Of a word looked up in another shard than its own.
FOREIGN = 4


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A word's shard (held) and those that it looks itself up in: its own, and of the others those behind it in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        kept, around = np.unique(shards(batch.column("word").to_pylist()), axis=0, return_inverse=True)
        near = [[(s, k + FOREIGN * bool(i)) for i, (s, k) in enumerate(reachable(p)) if i == 0 or s > tuple(p.tolist())] for p in kept]
        which = [near[i] for i in around.ravel()]
        source = np.repeat(np.arange(batch.num_rows), [len(w) for w in which])
        rows = batch.take(pa.array(source))
        shard = pa.array(["-".join(map(str, s)) for w in which for s, _ in w])
        spent = pa.array([k for w in which for _, k in w], pa.int32())
        yield pa.RecordBatch.from_arrays([shard, rows.column("word"), rows.column("n"), spent], ["shard", "word", "n", "spent"])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word how many near words a block and a slice show, and the most frequent of these.

    In their own shard all words are held and looked up; a pair of two shards is met once and counts for both.
    """
    for _, rows in groups(batches, ["shard", "block", "slice"]):
        held = int((rows["side"].to_numpy() == 0).sum())
        words, n, spent = rows["word"].to_pylist(), rows["n"].to_pylist(), rows["spent"].to_numpy()
        if not 0 < held < len(words):
            continue
        counts, near, best = vectors(words), [0] * len(words), [(1, "")] * len(words)
        foreign = (spent & FOREIGN).tolist()
        for i, j in Trie(words[:held], counts[:held]).search(words[held:], counts[held:], spent[held:]):
            i += held
            near[i] += 1
            best[i] = min(best[i], (-n[j], words[j]))
            if foreign[i]:
                near[j] += 1
                best[j] = min(best[j], (-n[i], words[i]))
        some = np.flatnonzero(near).tolist()
        if some:
            arrays = [pa.array([words[i] for i in some]), pa.array([near[i] for i in some], pa.int64()), pa.array([best[i][0] for i in some], pa.int64()), pa.array([best[i][1] for i in some])]
            yield pa.RecordBatch.from_arrays(arrays, ["word", "n_near", "less", "form"])


def deleted(run: Column, mark: Column) -> Column:
    """``run`` without its code point at ``mark`` modulo its length, from 0."""
    place = F.pmod(mark, F.length(run)).cast("int")
    return F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.length(run)))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop: int | None = None) -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case, at least ``MIN_CHARS`` long and found ``MIN_COUNT`` times.

    With ``drop`` a run loses a code point where the CRC-32 of ``<id>:<run>`` is divisible by it, which plants
    misspellings; rows without id keep theirs. A null text has no words.
    """
    found = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(RUN), F.lit(0))).alias("run"))
    found = found.withColumn("run", F.translate("run", _UPPER, _LOWER)).where(F.length("run") >= MIN_CHARS)
    word = F.col("run")
    if drop:
        found = found.withColumn("mark", F.crc32(F.concat("id", F.lit(":"), "run")))
        word = F.when(F.col("mark") % drop == 0, deleted(F.col("run"), F.col("mark"))).otherwise(F.col("run"))
    words = found.select(word.alias("word")).where(F.length("word") >= MIN_CHARS)
    return written(words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT), "vocabulary")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): of each word with near ones their number and the most frequent (smallest first).

    Words are held in shards by the counts of the first ``SHARD`` groups and their length, and looked up in the shards
    that one surplus and one deficit lead to, with what is left of the budget. Held words of a shard are cut into blocks and those
    looked up into slices, so that a shard of any size is shared out; only totals leave a task, no pairs.
    """
    keys = words.select("word", "n").transform(small_batches).mapInArrow(_keys, "shard string, word string, n long, spent int")
    keys = written(keys, "variant-keys")
    met = meetings(keys.where("spent = 0"), keys, ["shard"], "word", HELD, PASSING)
    found = met.transform(small_batches).mapInArrow(_found, "word string, n_near long, less long, form string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("b"))
    return best.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.form").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that forms (word, form) lead to; counts rise along them, so there are no circles."""
    ahead = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    for _ in range(MAX_ROUNDS):
        further = ahead.join(ahead.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        further = written(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        if not further.where("moved").limit(1).count():
            return ahead
        ahead = further.select("word", "root")
    raise RuntimeError("forms did not settle")


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of ``words`` (word, n; words distinct).

    Near words differ by exactly one code point inserted, deleted or replaced. ``form`` is the near word of largest n,
    of these the smallest, if it occurs at least ``DOMINANCE`` times as often; ``root`` is where forms end. Words
    without near ones count 0 and are their own root. No words give no rows.
    """
    near = words.select("word", "n").join(near_words(words), "word", "left")
    strong = F.col("best_n") >= DOMINANCE * F.col("n")
    formed = written(
        near.select("word", F.when(strong, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best_n")).alias("form_n")),
        "variant-forms",
    )
    last = roots(formed.where("form is not null"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
