import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard

from tablewright.llm import mixing
from test_mixing_counts import Shared


def totals(rows, code):
    """All counts of the predictors' tables, by predictor and place."""
    found = Counter()
    for b in mixing._count_decisions(Shared(code))(iter([rows])):
        k, part, blob = (b.column(c)[0].as_py() for c in ("predictor", "part", "counts"))
        counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64)
        for i in np.flatnonzero(counts).tolist():
            found[k, part, i] += int(counts[i])
    return found


def some_words(rng, n):
    words = [f"w{rng.randrange(10**4)}" for _ in range(n)]
    return pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array(words), pa.array([rng.randint(1, 50) for _ in words], pa.int64())], ["kind", "word", "n"])


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_counting_holds_half_the_memory():
    rows, code = some_words(random.Random(1), 300), mixing.huffman(np.ones(256))
    slots = sum(2 << size for size in mixing.SLOT_BITS)
    assert peak(lambda: totals(rows, code)) < 6 * slots


def test_counts_handed_on_early_add_up(monkeypatch):
    rows, code = some_words(random.Random(2), 900), mixing.huffman(np.ones(256))
    monkeypatch.setattr(mixing, "WORDS_AT_ONCE", 20)
    want = totals(rows, code)
    for full in (1 << 10, 1 << 14, 1 << 16):
        monkeypatch.setattr(mixing, "FULL", full)
        assert totals(rows, code) == want


def test_long_texts_in_lanes_hold_little():
    rng, code = random.Random(3), mixing.huffman(np.ones(256))
    texts = [[f"{i}x{rng.randrange(10**6)}".encode() for _ in range(12_000)] for i in range(6)]
    tables = [np.zeros((1 << size, 2), np.uint8) for size in mixing.SLOT_BITS]
    look_up = lambda w, k: mixing.coded(w, k, code, tables)
    whole = sum(look_up(t, np.zeros(len(t), np.int8))[1].nbytes for t in texts)
    lanes, first = [], []

    def begin():
        for found, members in mixing.blocks(texts, {}, look_up):
            for i, places in members:
                lanes.append(found.parts(places))
                first.append(next(lanes[-1]))

    assert peak(begin) < whole / 2
    parts = [np.concatenate([a, *rest]) for a, rest in zip(first, lanes)]
    found = [i for _, members in mixing.blocks(texts, {}, look_up) for i, _ in members]
    for i, rows in zip(found, parts):
        assert (rows == look_up(texts[i], np.zeros(len(texts[i]), np.int8))[1]).all()
