import numpy as np
import pyarrow as pa

from tablewright.llm import mixing
from test_mixing_words import code_of


def test_whole_words_are_looked_up_by_node():
    code = code_of([(b"the", 50), (b"of", 30), (b"\xc3\xa9t", 20)], [b"xyz", b"q"])
    rng = np.random.default_rng(0)
    tables = [rng.integers(0, 255, (1 << size, 2), dtype=np.uint8) for size in mixing.SLOT_BITS]
    found, kinds = [b"q", b"the", b"the", b"unseen", b"\xc3\xa9t", b"", b"of"] * 3, np.arange(21) % 9
    for left_out in (0, 1):
        whole = mixing.whole_rows(code, tables, left_out)
        for a, b in zip(mixing.coded(found, kinds, code, tables, left_out), mixing.coded(found, kinds, code, tables, left_out, whole)):
            assert a.tolist() == b.tolist()


def test_words_of_a_column_are_those_of_each_text():
    texts = ["".join(map(chr, range(1, 128))) + "\x85 É x", "", None, "  A  b\n", "x"]
    assert mixing.split(pa.array(texts)).to_pylist() == [mixing.words(t) for t in texts]
