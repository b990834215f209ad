import numpy as np
import pyarrow as pa
import zstandard

from tablewright.llm import mixing


class Shared:
    def __init__(self, value):
        self.value = value


def test_counts_of_frequent_words_are_not_cut():
    code = mixing.huffman(np.ones(256))
    many = [1 << 20, 1 << 33]
    rows = pa.RecordBatch.from_arrays([pa.array([0, 0], pa.int32()), pa.array(["often", "always"]), pa.array(many, pa.int64())], ["kind", "word", "n"])
    parts = [b for b in mixing._count_decisions(Shared(code))(iter([rows])) if b.column("predictor")[0].as_py() == 2]
    found = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(b.column("counts")[0].as_py()), np.int64) for b in parts])
    decisions = code.length[list(b"often ")].sum() * many[0] + code.length[list(b"always ")].sum() * many[1]
    assert found.sum() == decisions and found.max() >= many[1]


def test_parts_are_added_up_beyond_32_bits():
    pack = zstandard.ZstdCompressor().compress
    pairs = np.zeros(2 << mixing.PART_BITS, np.int64)
    pairs[:2] = 3 << 31, 1 << 31
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0], pa.int32()), pa.array([0, 0], pa.int32()), pa.array([pack(pairs.tobytes())] * 2, pa.binary())], ["predictor", "part", "counts"])
    (out,) = mixing._add_up(iter([batch]))
    assert np.frombuffer(out.column("counts")[0].as_py(), np.uint8)[:2].tolist() == [255, 85]
