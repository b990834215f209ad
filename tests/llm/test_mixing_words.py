import itertools

import numpy as np
import pytest

from tablewright.llm import mixing


def code_of(counted, others):
    words = [w for w, _ in counted] + others
    n = np.array([n for _, n in counted] + [1] * len(others), np.int64)
    return mixing.with_words(mixing.huffman(np.ones(256)), counted, len(others), mixing._word_pairs(words, n))


def test_a_frequent_word_takes_few_decisions():
    code = code_of([(b"the", 1000), (b"extraordinary", 400)], [b"xyz", b"q", b"thee"])
    length, bit, slots = mixing.decisions(code, [b"the", b"extraordinary", b"thee"], np.array([0, 3, 3]))
    assert length[0] <= 2 and length[1] <= 2 < length[2]
    assert len(bit) == length.sum() and all(len(s) == length.sum() for s in slots)


def test_words_together_have_the_decisions_that_each_has():
    code = code_of([(b"the", 50), (b"of", 30), (b"\xc3\xa9t", 4)], [b"xyz", b"q", b"thee", b"z" * 300])
    found, kinds = [b"q", b"the", b"the", b"unseen", b"\xc3\xa9t", b"", b"z" * 300, b"of"], np.array([0, 0, 5, 8, 1, 2, 3, 0])
    length, bit, slots = mixing.decisions(code, found, kinds)
    alone = [mixing.decisions(code, [w], kinds[i : i + 1]) for i, w in enumerate(found)]
    assert length.tolist() == [int(n[0]) for n, _, _ in alone]
    assert bit.tolist() == np.concatenate([b for _, b, _ in alone]).tolist()
    for k in range(mixing.PREDICTORS):
        assert slots[k].tolist() == np.concatenate([s[k] for _, _, s in alone]).tolist()


@pytest.mark.parametrize("whole", [[], [(b"a", 9), (b"\x07", 4)]])
def test_words_add_up_to_no_more_than_one(whole):
    rng = np.random.default_rng(0)
    tables = [rng.integers(0, 255, (1 << size, 2), dtype=np.uint8) for size in mixing.SLOT_BITS]
    weights = rng.normal(0.4, 0.2, (mixing.GATES, mixing.PREDICTORS))
    code = code_of(whole, [b"xyz", b"q"])

    def chances(word):
        """Of the word's bits one after the other, as whole or spelled."""
        _, bit, slots = mixing.decisions(code, [word], np.array([2]))
        x, gate = mixing.inputs(bit, slots, tables)
        return 1 / (1 + np.exp(-(weights[gate].T * x).sum(axis=0)))

    names = [w for w, _ in whole]
    bare = mixing.Code(code.length, code.first, code.node, code.bit, pairs=code.pairs)
    as_whole = sum(np.prod(chances(w)) for w in names)
    spelled = 1 - as_whole if names else 1.0
    escape = code.whole.length[len(names)] if names else 0
    total = as_whole
    for b in range(256):
        if b != mixing.GAP and bytes([b]) not in names:
            n = int(mixing.decisions(bare, [bytes([b])], np.array([2]))[0][0]) - int(code.pairs.length[b << 8 | mixing.GAP])
            total += np.prod(chances(bytes([b]))[: escape + n])
    total += np.prod(chances(b""))
    # All first bytes and the empty word, but for those only whole words have: nothing is counted twice.
    assert total <= 1 + 1e-9 and total > as_whole
    if not names:
        assert total == pytest.approx(spelled)


def test_bytes_after_one_another_have_codes_of_their_own():
    code = code_of([], [b"qu" * 20, b"ab" * 20])
    lengths = code.pairs.length.reshape(256, 256)
    assert lengths[ord("q"), ord("u")] < lengths[ord("a"), ord("u")]
    for row in lengths[[0, ord("q"), 255]]:
        assert sum(2.0 ** -int(n) for n in row) == 1


def test_known_words_cost_less_than_spelled_ones(spark):
    texts = [" ".join(f"common{i % 5}" for i in range(20)) + f" rare{k}x" for k in range(40)]
    model = mixing.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    code = model.mixer.value[0]
    assert {f"common{i}".encode() for i in range(5)} == set(itertools.islice(code.names, 5)) and b"rare3x" not in code.names
    rows = spark.createDataFrame([(1, "common1 common2"), (2, "rare3x rare77x")], "doc_id long, text string")
    known, rare = (r.score for r in mixing.score(rows, model).orderBy("doc_id").collect())
    assert rare < known < 0
