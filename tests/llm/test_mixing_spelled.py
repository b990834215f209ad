import numpy as np

from tablewright.llm import mixing
from test_mixing_words import code_of


def test_bytes_of_frequent_words_are_predicted_in_their_contexts(spark):
    texts = [" ".join(f"common{i % 5}" for i in range(40)) + f" rare{k}x" for k in range(40)]
    model = mixing.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    code, tables, _, _ = model.mixer.value
    assert b"common1" in code.names
    bare = mixing.Code(code.length, code.first, code.node, code.bit, pairs=code.pairs)
    for w in (b"common1", b"rare3x"):
        length, bit, slots = mixing.decisions(code, [w], np.array([2]))
        # Every byte of the word and the space behind it, and each predictor in a context of its own.
        own = bare.pairs.length[[b << 8 | a for b, a in zip(b" " + w, w + b" ")]].sum()
        assert length[0] == own and bit.tolist() == mixing.decisions(bare, [w], np.array([2]))[1].tolist()
        spelled = slice(int(bare.pairs.length[32 << 8 | w[0]]), None)
        widest = max(mixing.SLOT_BITS)
        shown = [s[spelled] << np.uint32(widest - n) >> np.uint32(widest - min(mixing.SLOT_BITS)) for s, n in zip(slots, mixing.SLOT_BITS)]
        assert all((x != y).any() for x, y in zip(shown, shown[1:])) and (shown[0] != shown[2]).any()
        # The trained word's sightings are counted at each of its bits.
        assert w != b"common1" or all((t[x, b] > 0).all() for x, t, b in zip(mixing.decisions(code, [w], np.array([1]))[2], tables, [bit] * 3))


def test_kept_words_are_looked_up_once(monkeypatch):
    code = mixing.Code(*(getattr(code_of([], [b"xyz"]), x) for x in ("length", "first", "node", "bit")), pairs=code_of([], [b"xyz"]).pairs)
    tables = [np.random.default_rng(k).integers(0, 256, (1 << size, 2), dtype=np.uint8) for k, size in enumerate(mixing.SLOT_BITS)]
    names = {b"the": 0, b"of": 1, b"\xc3\xa9t": 2, b"a" * 90: 3}
    seen = []

    def look_up(found, kind):
        seen.extend(zip(found, kind.tolist()))
        return mixing.coded(found, kind, code, tables, 1)

    for room in (1 << 14, 60, 0):
        monkeypatch.setattr(mixing, "KEPT_ROWS", room)
        kept, rng = mixing.Kept(names, look_up), np.random.default_rng(3)
        seen.clear()
        for _ in range(20):
            pairs = sorted({(int(i), int(k)) for i, k in zip(rng.integers(0, 6, 12), rng.integers(0, 9, 12))})
            found = [[*names, b"q", b"unseen"][i] for i, _ in pairs]
            kind = np.array([k for _, k in pairs])
            for a, b in zip(kept(found, kind), mixing.coded(found, kind, code, tables, 1)):
                assert a.tolist() == b.tolist()
        assert kept.many <= room and all(n.size == 0 for n in kept([], np.zeros(0, np.int64)))
        frequent = [x for x in seen if x[0] in names]
        assert (len(frequent) == len(set(frequent))) == (room == 1 << 14)
