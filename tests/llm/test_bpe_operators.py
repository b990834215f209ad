import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tablewright.llm import bpe, byte_bpe, packing, queries


def plain_encoding(name):
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_units_equal_whole_texts(odd_texts):
    plain = plain_encoding("byte_bpe_multi_50k.tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoder, pieces = bpe.encoder(path), bpe.pieces(path)
    for text in odd_texts:
        ids = np.frombuffer(encoder.encode(text or ""), "<u4").tolist()
        assert ids == plain.encode_ordinary(text or "")
        assert b"".join(pieces[i] for i in ids) == (text or "").encode()


@pytest.mark.parametrize("chunk, overlap", [(50, 20), (97, 5), (4000, 100)])
def test_chunked_encoding(spark, odd_texts, chunk, overlap):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts)] + [(None, "twice the"), (None, "twice the")], "doc_id long, text string")
    plain = plain_encoding("byte_bpe_multi_50k.tiktoken")
    got = byte_bpe.decode(byte_bpe.encode(docs, chunk=chunk, overlap=overlap)).collect()
    want = {i: plain.encode_ordinary(t or "") for i, t in enumerate(odd_texts)} | {None: plain.encode_ordinary("twice the")}
    assert len(got) == len(odd_texts) + 2
    for r in got:
        assert r.ids == want[r.doc_id]
        assert bytes(r.decoded) == (("twice the" if r.doc_id is None else odd_texts[r.doc_id]) or "").encode()


def test_byte_bpe_query(spark, sf_dir):
    plain = plain_encoding("byte_bpe_multi_50k.tiktoken")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op6_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_place_fills_every_sequence():
    lengths = [1, 5000, 700, 700, 700, 1024, 3, 999, 1025, 2]
    pieces = packing.place(lengths)
    used = defaultdict(list)
    for d, start, n, s, offset in pieces:
        used[s].append((offset, n))
    for spans in used.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end == 1024 or end & (end - 1) == 0
    for d, n in enumerate(lengths):
        spans = sorted((a, b) for x, a, b, _, _ in pieces if x == d)
        assert spans[0][0] == 0 and sum(b for _, b in spans) == n
        assert all(a + b == c for (a, b), (c, _) in zip(spans, spans[1:]))


def test_place_balances_cost():
    cost = defaultdict(float)
    for _, _, n, s, _ in packing.place([512] * 8 + [256] * 8 + [128] * 16):
        cost[s] += n + n * n / 2048
    assert max(cost.values()) == min(cost.values())


def check_pieces(rows, texts):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(texts)
    for key, text in texts.items():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        end = 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert r.start == end and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            end += r.length
        assert end == len(ids)
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    assert all(n <= 1024 and (n == 1024 or n & (n - 1) == 0) for n in used.values())


def test_packing_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_pieces(queries.op4_packing(spark, sf_dir).collect(), texts)


def test_packing_of_odd_texts(spark, odd_texts, tmp_path):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(odd_texts)], "doc_id long, text string, start string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    check_pieces(queries.op4_packing(spark, str(tmp_path)).collect(), dict(enumerate(odd_texts)))
    assert packing.pack(docs.limit(0)).count() == 0
    again = docs.limit(1).select("doc_id", "text")
    assert packing.pack(again.union(again)).count() == 2
