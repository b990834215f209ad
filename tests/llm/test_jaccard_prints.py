import random

import corpus_pipeline
from tablewright.llm import jaccard, simhash
from tablewright.llm.components import components
from test_jaccard import changed, plain_kept


def long_texts(rng):
    """Texts, near copies of them, and texts whose fingerprints are near although they are not similar."""
    rows = []
    for i in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(900)]
        rows += [(len(rows) + k, " ".join(changed(rng, words, k))) for k in range(3)]
    return rows


def test_majority_is_the_fingerprint_of_a_set():
    text = " ".join(f"w{i}" for i in range(300))
    hashes = jaccard.hashed(jaccard.shingles(text))
    assert simhash.majority([hashes[:100], hashes[100:]]) == simhash.fingerprint(text, jaccard.SHINGLE) and simhash.majority([]) == 0


def test_fingerprints_pair_what_is_within_four_bits(spark):
    rng = random.Random(3)
    prints = [rng.randrange(1 << 62) for _ in range(30)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(62), rng.randint(0, 6))) for p in prints for _ in range(2)]
    nodes = spark.createDataFrame([(i, [1], 1, p) for i, p in enumerate(prints)], "node long, prefix array<long>, size int, fingerprint long")
    got = {r.node: r.component for r in components(jaccard._alike(nodes)).collect()}
    want = list(range(len(prints)))
    for _ in prints:
        want = [min(want[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 4) for p in prints]
    assert {i: c for i, c in enumerate(want)} == {i: got.get(i, i) for i in range(len(prints))} and len(got) > 20


def test_stage_takes_its_first_links_from_fingerprints_and_verifies_them(spark, monkeypatch):
    rows = long_texts(random.Random(6))
    seen, calls = [], []
    own_links, own_verified = simhash.links, jaccard._verified

    def spied(fps, *args):
        calls.append({r.fp for r in fps.collect()})
        return own_links(fps, *args)

    def verified(pairs, *args):
        found = own_verified(pairs, *args)
        seen.append((pairs.distinct().count(), found.count()))
        return found

    monkeypatch.setattr(simhash, "links", spied)
    monkeypatch.setattr(jaccard, "_verified", verified)
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert got == plain_kept(rows)
    assert calls == [{simhash.majority([jaccard.hashed(jaccard.shingles(t))]) for _, t in rows}]
    assert seen[0][1] > 0


def test_pairs_near_by_fingerprint_alone_are_kept(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for i in range(6)]
    # All fingerprints are said to be near: the exact check has to refuse every pair.
    near = lambda fps: fps.toDF("a").crossJoin(fps.toDF("b")).where("a < b")
    monkeypatch.setattr(simhash, "links", near)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.one_of_each(df).collect()) == list(range(6))
