import random

import numpy as np

from tablewright.llm import jaccard
from test_jaccard import changed, plain_kept


def test_common_shingles_come_last_and_lose_no_pair():
    rng, common = random.Random(1), np.arange(0, 4000, 3, dtype=np.uint64)
    for _ in range(300):
        a = set(rng.sample(range(4000), rng.randint(1, 60)))
        b = set(rng.sample(sorted(a), len(a) - rng.randint(0, len(a) // 5))) | set(rng.sample(range(4000), rng.randint(0, 4)))
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        p, q = (jaccard.prefix(h, common=common) for h in (x, y))
        assert len(p) == len(jaccard.prefix(x)) and (sum(v % 3 > 0 for v in p.tolist()) == min(len(p), sum(v % 3 > 0 for v in a)))
        if jaccard.similar(a, b):
            assert set(p.tolist()) & set(q.tolist())


def test_texts_with_a_passage_in_common_do_not_meet(spark, monkeypatch):
    rng, sizes, own = random.Random(4), {}, jaccard.written
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([f"w{rng.randrange(10**9)}" for _ in range(90)] + passage)) for i in range(400)]
    rows += [(1000 + i, " ".join(changed(rng, text.split(), 1))) for i, text in rows[:5]]

    def kept(df, label):
        out = own(df, label)
        sizes.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", kept)
    got = sorted(r.doc_id for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain_kept(rows) == list(range(400))
    # What meets are the near copies alone; the passage's shingles would bring all texts together.
    assert max(sizes["similar-met"]) < 200


def test_copies_and_rows_that_repeat(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "x y"), (None, "x y"), (3, None), (3, None), (4, ""), (5, "z"), (5, "other")]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("1", "a b c d e f g"), ("3", None), ("5", "other"), ("5", "z"), ("None", "x y")]
