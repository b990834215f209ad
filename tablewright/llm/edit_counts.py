"""Token counts that follow edits: a segment tree of pre-token runs for each document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm import bpe
from tablewright.llm.common import small_batches

#: Characters of a leaf at least; a leaf ends at the next place where a pre-token surely ends.
LEAF = 512

#: White space behind something else begins a pre-token, whatever stands around the two characters.
_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])")

#: Personal data and what stands for it after redaction.
REDACTIONS = (
    (re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"), "<email>"),
    (re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"), "<address>"),
    (re.compile(r"(?<!\d)\+?\d{1,3}[ -]\(?\d{3}\)?[ -]\d{3}[ -]?\d{4}(?!\d)"), "<phone>"),
)

EDIT = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])
EDIT_DDL = "array<struct<start: long, end: long, text: string>>"
TREE_DDL = "leaf_chars array<int>, token_tree array<long>"


def cut(text: str, leaf: int = LEAF) -> list[int]:
    """Lengths of the leaves of a text; no leaves for an empty text."""
    lengths, start = [], 0
    while len(text) - start > leaf:
        found = _CUT.search(text, start + leaf)
        if found is None:
            break
        lengths.append(found.start() - start)
        start = found.start()
    return lengths + [len(text) - start] * (start < len(text))


def grow(tokens: list[int]) -> list[int]:
    """A segment tree over the leaves' counts: node i has the children 2i and 2i+1, node 1 is the sum of all."""
    size = 1 << max(0, len(tokens) - 1).bit_length()
    tree = [0] * size + tokens + [0] * (size - len(tokens))
    for i in range(size - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return tree


class Counted:
    """A text with its tree."""

    def __init__(self, text: str, encoder: bpe.Encoder, chars: list[int] | None = None, tree: list[int] | None = None, leaf: int = LEAF):
        self.text, self.encoder, self.leaf, self.encoded = text, encoder, leaf, 0
        self.chars = cut(text, leaf) if chars is None else list(chars)
        self.tree = self._counted() if tree is None else list(tree)

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return len(self.encoder.encode(text)) // 4

    def _counted(self) -> list[int]:
        ends = np.cumsum(self.chars, dtype=np.int64).tolist()
        return grow([self._count(self.text[e - n : e]) for e, n in zip(ends, self.chars)])

    @property
    def tokens(self) -> int:
        return self.tree[1] if self.tree else 0

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans of the text, which may touch but not overlap; encode only the leaves they reach.

        A leaf is reached if the edit lies in it or at its ends: the cut between two leaves is decided by the
        characters on either side. Runs of leaves that edits reach are cut and encoded anew. If their number of
        leaves stays, sums are updated from the leaves up; else the tree's sums are added up again, without encoding.
        """
        if not edits:
            return
        ends = np.cumsum(self.chars, dtype=np.int64)
        edits = sorted(edits)
        regions: list[list] = []  # first leaf, last leaf, edits
        for start, end, new in edits:
            # The cut at e stays if the characters before and behind it do.
            a = int(np.searchsorted(ends, start, "left"))
            b = int(np.searchsorted(ends, end, "right"))
            a, b = min(a, max(len(ends) - 1, 0)), min(b, max(len(ends) - 1, 0))
            if regions and a <= regions[-1][1] + 1:
                regions[-1][1] = max(b, regions[-1][1])
                regions[-1][2].append((start, end, new))
            else:
                regions.append([a, b, [(start, end, new)]])
        size = len(self.tree) // 2
        counts = self.tree[size : size + len(self.chars)]
        parts, chars, done = [], [], 0
        updated, moved = {}, False
        for a, b, inside in regions:
            low = int(ends[a - 1]) if a else 0
            high = int(ends[b]) if len(ends) else 0
            parts.append(self.text[done:low])
            piece, at = [], low
            for start, end, new in inside:
                piece += [self.text[at:start], new]
                at = end
            whole = "".join([*piece, self.text[at:high]])
            parts.append(whole)
            done = high
            lengths = cut(whole, self.leaf)
            at, found = 0, []
            for n in lengths:
                found.append(self._count(whole[at : at + n]))
                at += n
            updated[a] = (b, lengths, found)
            moved |= len(lengths) != b + 1 - a or not self.chars
        self.text = "".join([*parts, self.text[done:]])
        if not moved:
            for a, (b, lengths, found) in updated.items():
                self.chars[a : b + 1] = lengths
                for i, n in enumerate(found, size + a):
                    change = n - self.tree[i]
                    while i:
                        self.tree[i] += change
                        i //= 2
            return
        chars, tokens, done = [], [], 0
        for a, (b, lengths, found) in updated.items():
            chars += self.chars[done:a] + lengths
            tokens += counts[done:a] + found
            done = b + 1
        self.chars, self.tree = chars + self.chars[done:], grow(tokens + counts[done:])


def _with(df: DataFrame, ddl: str, fn, drop: tuple[str, ...] = ()) -> DataFrame:
    kept = [f for f in df.schema if f.name not in drop]
    prefix = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                new = fn(part)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *new.values()], [*(f.name for f in kept), *new])

    return df.transform(small_batches).mapInArrow(run, f"{prefix}, {ddl}")


def _vocabulary(path: str | None) -> str:
    return path or public_tokenizers.path("byte_bpe_50k.tiktoken")


def count(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Adds each text's tree: ``leaf_chars`` and ``token_tree``, whose second entry is the text's number of tokens.

    A null text is empty. Columns of these names give way.
    """
    path = _vocabulary(vocabulary)

    def trees(part: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [Counted(t.as_py() or "", bpe.encoder(path)) for t in part.column(text_col)]
        return {"leaf_chars": pa.array([c.chars for c in found], pa.list_(pa.int32())), "token_tree": pa.array([c.tree for c in found], pa.list_(pa.int64()))}

    return _with(docs.drop("leaf_chars", "token_tree"), TREE_DDL, trees)


def redactions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``edits``: spans of e-mail addresses, network addresses and telephone numbers, with placeholders."""

    def found(part: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = []
        for t in part.column(text_col):
            text, edits, end = t.as_py() or "", [], 0
            spans = sorted((m.start(), m.end(), new) for pattern, new in REDACTIONS for m in pattern.finditer(text))
            for a, b, new in spans:
                if a >= end:
                    edits.append({"start": a, "end": b, "text": new})
                    end = b
            rows.append(edits)
        return {"edits": pa.array(rows, pa.list_(EDIT))}

    return _with(docs.drop("edits"), f"edits {EDIT_DDL}", found)


def attach(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds ``edits`` from a table of (id, start, end, text); documents without edits get an empty list."""
    lists = edits.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("start", "end", "text"))).alias("edits"))
    joined = docs.drop("edits").join(lists, id_col, "left")
    return joined.withColumn("edits", F.coalesce("edits", F.array().cast(EDIT_DDL)))


def apply(counted: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Apply ``edits`` to the texts and trees of ``count``; adds n_edits, tokens_before, tokens_after, encoded_chars.

    Edits of a document are spans of its text before any of them, in code points, which do not overlap.
    ``encoded_chars`` says how much of the new text was encoded. The text and the tree are replaced by the new ones.
    """
    path = _vocabulary(vocabulary)
    names = ["n_edits", "tokens_before", "tokens_after", "encoded_chars"]

    def edited(part: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = []
        for text, chars, tree, edits in zip(*(part.column(n) for n in (text_col, "leaf_chars", "token_tree", "edits"))):
            doc = Counted(text.as_py() or "", bpe.encoder(path), chars.as_py(), tree.as_py())
            before, spans = doc.tokens, [(e["start"], e["end"], e["text"] or "") for e in edits.as_py() or []]
            doc.edit(spans)
            rows.append((text.as_py() if not spans else doc.text, doc.chars, doc.tree, len(spans), before, doc.tokens, doc.encoded))
        types = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.int64()] * 4]
        return {n: pa.array(c, t) for n, c, t in zip([text_col, "leaf_chars", "token_tree", *names], zip(*rows), types)}

    ddl = f"`{text_col}` string, {TREE_DDL}, " + ", ".join(f"{n} long" for n in names)
    return _with(counted.drop(*names), ddl, edited, (text_col, "leaf_chars", "token_tree", "edits"))
