import random
import re
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tablewright.llm import variants


def edits(a, b):
    """Edit distance, by the full table; lengths more than one apart count as 2."""
    if abs(len(a) - len(b)) > 1:
        return 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def brute(words):
    near = {w: [x for x in words if edits(w, x) == 1] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()), key=str)


def run(spark, words):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return sorted(map(tuple, variants.variants(df).collect()), key=str)


@settings(max_examples=300, deadline=None)
@given(st.text("abé", max_size=7), st.text("abé", max_size=7))
def test_one_edit(a, b):
    assert variants.one_edit(a, b) == (edits(a, b) == 1)


@settings(max_examples=100, deadline=None)
@given(st.text("abcnoé", min_size=1, max_size=6), st.text("abcnoé", min_size=1, max_size=6))
def test_words_one_edit_apart_reach_each_others_shard(a, b):
    if edits(a, b) == 1:
        x, y = variants.shards([a, b])
        assert tuple(y.tolist()) in {p for p, _ in variants.reachable(x)}


def test_trie_finds_all_pairs_of_its_shard():
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abnoé", k=rng.randint(4, 7))) for _ in range(400)})
    counts, shard = variants.vectors(words), variants.shards(words).tolist()
    found = set(variants.Trie(words, counts).search(words, counts, np.zeros(len(words), int)))
    same = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if shard[i] == shard[j] and edits(a, b) == 1}
    assert same <= found and all(edits(words[i], words[j]) == 1 for i, j in found)


def test_variants_of_random_words(spark):
    rng = random.Random(2)
    words = {"".join(rng.choices("abnoé", k=rng.randint(5, 8))): rng.choice([3, 3, 4, 7, 20, 60, 200]) for _ in range(400)}
    assert run(spark, words) == brute(words)


def test_hot_shard_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 16)
    monkeypatch.setattr(variants, "PASSING", 32)
    rng = random.Random(3)
    words = {"".join(rng.choices("ef", k=rng.randint(5, 9))): rng.choice([3, 9, 30]) for _ in range(300)}
    assert run(spark, words) == brute(words)


def test_ties_chains_and_long_words(spark):
    words = {"aaaaa": 3, "aaaab": 6, "aaaac": 6, "aaabb": 12, "zzzzz": 5, "y" * 300: 3, "y" * 301: 9}
    found = {r[0]: r[1:3] for r in run(spark, words)}
    assert found["aaaaa"] == ("aaaab", "aaabb") and found["zzzzz"] == (None, "zzzzz") and found["y" * 300][0] == "y" * 301
    assert run(spark, words) == brute(words)
    assert run(spark, {}) == []


def test_vocabulary(spark):
    texts = [None, "", "Hello hello HELLO, héllo2hello ÀÉÎÕÜ àéîõü", "hello " * 40_000, "ÀÉÎÕÜ ÀÉÎÕÜ x×÷yz x×÷yz x×÷yz", "hello hello"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "hello ÀÉÎÕÜ", 2), (3, "hello", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumn("word", F.lit("w"))
    wanted: dict = {}
    for doc_id, text, _ in rows:
        for found in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in found)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if doc_id is not None and h % 5 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            wanted[word] = wanted.get(word, 0) + 1
    wanted = {w: n for w, n in wanted.items() if len(w) >= 5 and n >= 3}
    assert {r.word: r.n for r in variants.vocabulary(docs, drop=5).collect()} == wanted
    assert variants.vocabulary(docs.limit(0)).collect() == []
