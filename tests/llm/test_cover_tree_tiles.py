import numpy as np
import pytest

from tablewright.llm import cover_tree
from test_cover_tree import brute, planted, run


@pytest.mark.parametrize("tile, least", [(40, 1), (8, 200), (5, 1 << 17)])
def test_tiles_and_rounds_lose_no_pair(spark, monkeypatch, tile, least):
    for name, value in (("LEAF", 16), ("SAMPLE", 24), ("TILE", tile), ("LEAST_ROUND", least)):
        monkeypatch.setattr(cover_tree, name, value)
    rows = planted(200, 6, 5)
    # A leaf of many vectors, none of which is split, so that its tiles meet each other.
    rows += [(1000 + i, (np.eye(6)[0] + 1e-3 * np.random.default_rng(i).normal(size=6)).tolist(), "c") for i in range(30)]
    assert run(spark, rows) == brute(rows)


def test_a_vector_moves_once_for_each_tile_and_rounds_are_bounded(spark, monkeypatch):
    rng, written, meetings = np.random.default_rng(7), {}, []
    for name, value in (("LEAF", 16), ("TILE", 100), ("LEAST_ROUND", 1)):
        monkeypatch.setattr(cover_tree, name, value)
    own = cover_tree.written

    def kept(df, label):
        out = own(df, label)
        written.setdefault(label, []).append(out)
        return out

    def tasks(cosine, raw):
        meetings.append(raw)
        return compare(cosine, raw)

    compare = cover_tree._compare
    monkeypatch.setattr(cover_tree, "written", kept)
    monkeypatch.setattr(cover_tree, "_compare", tasks)
    rows = [(i, [float(x) for x in rng.normal(size=24).astype(np.float32)], 0) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert cover_tree.near_duplicates(frame).count() == 600
    leaves, met = written["cover-leaf-pairs"][0], written["cover-meetings"][0].collect()
    moved = sum(r.n for r in met)
    # Scattered vectors: nearly all leaves meet each other, but a vector meets at most the tiles that there are.
    assert leaves.count() > 200 and moved <= 600 * 9
    assert len(meetings) == -(-moved // 300)
    # Floats stay floats, and one table holds all vectors besides their classes.
    assert meetings[0] == "<f4" and written["vector-classes"][0].selectExpr("max(octet_length(vector))").first()[0] == 96
    assert [x for x in written if "vector" in written[x][0].columns] == ["vector-classes", "cover-centres", "cover-vectors"]
