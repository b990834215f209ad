import math
import random

import numpy as np
import pytest

from tablewright.llm import mixing


def plain_rows(found, kinds, code, tables, left_out=0):
    """Of each bit of the words in order: (logits of the bit that comes, gate), from the counts themselves."""
    rows = []
    for w, kind in zip(found, kinds):
        _, bits, slots = mixing.decisions(code, [w], np.array([kind]))
        for i, bit in enumerate(bits.tolist()):
            logits, sure = [], []
            for slot, table in zip(slots, tables):
                own, other = int(table[slot[i], bit]), int(table[slot[i], 1 - bit])
                own = max(own - left_out, 0) if max(own, other) < 255 else own
                logits.append(math.log((own + 0.1) / (other + 0.1)))
                sure.append(sum(own + other >= c for c in mixing.CERTAIN))
            rows.append((logits, sure[1] * mixing.LEVELS + sure[2]))
    return rows


def plain_mixing(rows, weights):
    """Bits of a text by logistic mixing: predict one bit, then let the gate's weights learn from it. Changes ``weights``."""
    bits = 0.0
    for logits, gate in rows:
        w = weights[gate]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, logits))))
        bits -= math.log2(p)
        for k, x in enumerate(logits):
            w[k] += mixing.RATE * (1 - p) * x
    return bits


def texts(rng, n):
    names = [f"w{i}" for i in range(40)] + ["the", "Of", "and,", "é", "z" * 300]
    return [" ".join(rng.choice(names) for _ in range(rng.choice([0, 1, 5, 60, 300]))) for _ in range(n)]


@pytest.mark.parametrize("few", [0, 1000])
def test_scores_equal_mixing_bit_by_bit(spark, monkeypatch, few):
    rng = random.Random(few)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts(rng, 50) + ["", " \n"])], "doc_id long, text string").repartition(3)
    model = mixing.train(docs)
    code, tables, weights, markers = model.mixer.value
    rows = docs.selectExpr("doc_id as row", "doc_id as id", "text").toArrow().to_batches()
    monkeypatch.setattr(mixing, "LANES", 7)
    monkeypatch.setattr(mixing, "STEPS", 64)
    monkeypatch.setattr(mixing, "FEW", few)
    monkeypatch.setattr(mixing, "PART_WORDS", 50)
    monkeypatch.setattr(mixing, "LONG_WORDS", 200)
    got = {r["id"]: r["bits"] for b in mixing._score(model.mixer, model.top)(iter(rows)) for r in b.to_pylist()}
    want = {}
    for r in docs.collect():
        found = mixing.words(r.text)
        want[r.doc_id] = plain_mixing(plain_rows(found, mixing.kinds(found, markers), code, tables), weights.tolist())
    assert got == pytest.approx(want, rel=1e-3) and got.keys() == want.keys()


@pytest.mark.parametrize("few", [0, 1000])
def test_weights_learn_from_one_text_after_the_other(monkeypatch, few):
    rng = random.Random(5)
    monkeypatch.setattr(mixing, "LANES", 1)
    monkeypatch.setattr(mixing, "FEW", few)
    tables = [np.random.default_rng(k).integers(0, 256, (1 << size, 2), dtype=np.uint8) for k, size in enumerate(mixing.SLOT_BITS)]
    code, found = mixing.huffman(np.ones(256)), [mixing.words(t) for t in texts(rng, 12)]
    want, seen, bits = mixing.first_weights().tolist(), [0] * mixing.GATES, []
    for t in found:
        rows = plain_rows(t, [0] * len(t), code, tables, 1)
        bits.append(plain_mixing(rows, want))
        for _, gate in rows:
            seen[gate] += 1
    mixer = mixing.Mixer(mixing.first_weights(), fresh=False)
    ended = []
    for block, members in mixing.blocks(found, {}, lambda w, k: mixing.coded(w, k, code, tables, 1)):
        ended += [i for i, _ in mixer.run((i, block.parts(places)) for i, places in members)]
    n, total = mixer.learned()
    assert sorted(ended) == list(range(len(found))) and n.tolist() == seen
    used = n > 0
    assert total[used] / n[used, None] == pytest.approx(np.array(want)[used], abs=2e-3)


def test_what_a_text_says_first_changes_the_weights_for_the_rest(spark):
    words = [f"river{i % 7} w{i % 11}x" for i in range(60)]
    one, other = " ".join(words), " ".join(sorted(words))
    docs = spark.createDataFrame([(i, one) for i in range(5)], "doc_id long, text string")
    # No markers, so all words are of one class and only the order differs.
    with pytest.MonkeyPatch.context() as m:
        m.setattr(mixing, "MARKERS", 0)
        model = mixing.train(docs)
        both = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
        a, b = (r.score for r in mixing.score(both, model).orderBy("doc_id").collect())
    assert a != pytest.approx(b, rel=1e-6)
