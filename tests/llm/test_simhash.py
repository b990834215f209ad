import random

import numpy as np
import pytest
import xxhash

from tablewright.llm import golay, queries, simhash
from tablewright.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(ids, fps, limit=4):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= limit:
                parent[root(i)] = root(j)
    low = {}
    for i, key in enumerate(ids):
        low[root(i)] = min(low.get(root(i), key), key)
    return [low[root(i)] for i in range(len(ids))]


def test_fingerprints(odd_texts):
    for text in odd_texts:
        assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)
    assert simhash.fingerprint("One two\nTHREE four") == simhash.fingerprint("one  two three\tfour")


def test_golay_words_share_keys_within_two_errors():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 20_000)
    for errors in range(3):
        other = words.copy()
        for _ in range(errors):
            other ^= 1 << rng.integers(0, 23, len(words))
        a, b = golay.keys(words), golay.keys(other)
        assert ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any((1, 2)).all()
        if errors < 2:  # the nearest codeword of one is near the other
            assert (a[:, :1] == b).any(axis=1).all()


def near_fingerprints(rng, n):
    fps = []
    for _ in range(n):
        base = rng.choice(fps) if fps and rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            base ^= 1 << rng.randrange(64)
        fps.append(base)
    return fps


@pytest.mark.parametrize("held, passing", [(512, 8192), (3, 5)])
def test_links_of_crowded_fingerprints(spark, monkeypatch, held, passing):
    monkeypatch.setattr(simhash, "HELD", held)
    monkeypatch.setattr(simhash, "PASSING", passing)
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in near_fingerprints(random.Random(2), 700)})
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = {r.node: r.component for r in components(links).collect()}
    want = plain_groups(fps, [f % (1 << 64) for f in fps])
    assert [got.get(f, f) for f in fps] == want


def test_any_four_errors_share_a_key(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(400):
        fp = rng.getrandbits(64)
        for bits in (rng.sample(range(64), rng.randint(1, 4)), [rng.randrange(16) + 16 * i for i in range(4)]):
            other = fp
            for b in bits:
                other ^= 1 << b
            pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (fp, other)))
    found = {}
    for r in simhash.fuzzy_keys(spark.createDataFrame([(x,) for p in pairs for x in p], "fp long")).collect():
        found.setdefault(r.fp, (set(), set()))[r.own].add(r.key)
    assert all(found[a][1] & (found[b][0] | found[b][1]) for a, b in pairs)


def test_query(spark, tmp_path, odd_texts):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["a", "bb", "c", "dd"]) for _ in range(200)) for _ in range(10)]
    rows = [(i, t) for i, t in enumerate(odd_texts)] + [(500 + i, rng.choice(base) + rng.choice(["", " x", " Y z"])) for i in range(60)] + [(500, "twice"), (900, None)]
    spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, fp string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op5_simhash(spark, str(tmp_path)).collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    assert got == sorted(zip([k for k, _ in rows], [f"{f:016x}" for f in fps], plain_groups([k for k, _ in rows], fps)))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(200, 260)] + [(200, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 3 for i in [3, 5, *range(200, 260)]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_documents(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
