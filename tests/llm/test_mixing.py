import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tablewright.llm import mixing, queries


def split(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).replace(" ", "\n").split("\n")


def brute_base(rows):
    """By row: held out, tokens, known tokens and base score."""
    texts = [(key, [w for w in split(text) if w]) for key, text in rows]
    out = [zlib.crc32(("" if key is None else str(key)).encode()) % 5 == 1 for key, _ in texts]
    counts = Counter()
    for (_, found), held in zip(texts, out):
        if not held:
            counts.update([*found, None])
    total, types = sum(counts.values()), len(counts)
    scores = []
    for (_, found), held in zip(texts, out):
        tokens = [*found, None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in tokens)
        scores.append((held, len(tokens), sum(counts[w] > 0 for w in tokens), total, base))
    return scores


def test_codes_of_bytes_are_complete():
    code = mixing.huffman(np.array([0, 5, 1000] + [1] * 253))
    assert sum(2.0 ** -int(n) for n in code.length) == 1
    paths = {tuple(zip(code.node[a : a + n], code.bit[a : a + n])) for a, n in zip(code.first, code.length)}
    assert len(paths) == 256


def test_a_word_and_its_alternatives_add_up_to_one():
    rng = np.random.default_rng(0)
    tables = [rng.integers(0, 255, (1 << size, 2), dtype=np.uint8) for size in mixing.SLOT_BITS]
    weights = rng.normal(0.4, 0.2, (1, mixing.GATES, mixing.PREDICTORS))
    code = mixing.huffman(np.ones(256))
    # All words of one byte, and the mass of going on behind each: one decision after the other is a binary split.
    words = [(2, bytes([b])) for b in range(256) if b != mixing.GAP]
    first = []
    for _, w in words:
        length, bit, slots = mixing.decisions(code, [w], np.array([2]))
        x, gate = mixing.inputs(bit, slots, tables)
        s = (weights[0][gate].T * x).sum(axis=0)[: code.length[w[0]]]
        first.append(np.prod(1 / (1 + np.exp(-s))))
    length, bit, slots = mixing.decisions(code, [b""], np.array([2]))
    x, gate = mixing.inputs(bit, slots, tables)
    none = np.prod(1 / (1 + np.exp(-(weights[0][gate].T * x).sum(axis=0))))
    assert sum(first) + none == pytest.approx(1)


def test_classes_follow_the_text_before():
    markers = {b"the": 0, b"der": 1}
    assert mixing.kinds([b"x", b"the", b"y", b"der", b"der", b"z"], markers).tolist() == [0, 0, 1, 1, 1, 2]
    together = np.array([[9, 8, 0, 0], [8, 9, 0, 1], [0, 0, 5, 4], [0, 1, 4, 6.0]])
    with pytest.MonkeyPatch.context() as m:
        m.setattr(mixing, "CLASSES", 2)
        assert mixing.cluster(together).tolist() == [0, 0, 1, 1]


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(0)
    rows = [(None, None), (None, "the"), (7, ""), (7, ""), (8, " \n\t"), (9, "x" * 70_000), (10, "É é E \x1c a")]
    rows += [(i, " ".join(rng.choice(["the", "Of", "and,", "cat", f"w{i}"]) for _ in range(rng.randint(1, 60)))) for i in range(20, 90)]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_context_mixing(spark, str(tmp_path)).collect()
    want = sorted((str(k), *s) for (k, _), s in zip(rows, brute_base(rows)))
    found = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    for a, b in itertools.zip_longest(found, want):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_held_out_texts_are_predicted(spark, sf_dir):
    got = [r for r in queries.op9_context_mixing(spark, sf_dir).collect() if r.held_out]
    # An even guess is 8 bits a byte.
    assert 0 < sum(r.bits_per_byte for r in got) / len(got) < 3.5


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op9_context_mixing(spark, str(tmp_path)).count() == 0
