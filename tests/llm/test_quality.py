import re
from collections import Counter

from tablewright.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The base counts of a text, by loops."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered)


def test_counts_of_odd_texts(spark, odd_texts):
    texts = [*odd_texts, "the cat sat " * 5000, "one two three four " * 2 + "x", "a\n\na\n \n \nb\na", "the cat and the dog of a house " * 3, "🙂 " * 60]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, "same"), (1, "same")]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = quality.judge(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.doc_id, *(r[n] for n in names), r.base_failed) for r in judged.collect())
    want = [(i, *plain(t)) for i, t in rows]
    assert got == sorted((*w, w[1] < 50 or 100 * w[5] > 50 * w[1]) for w in want)
    assert all(not r.kept for r in judged.where("base_failed").collect())


def test_clashing_names(spark):
    good = "the window of a stone house is near to the river and it was for that garden " + " ".join(f"word{i}" for i in range(45))
    names = ["_text", "_words", "_lines", "_windows", "_twice", "_starts", "_row", "_own_0", "_own_1"]
    schema = "doc_id long, text string, N_WORDS string, Kept string, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(1, good, "own", "own", *names), (2, "bad", "own", "own", *names)], schema)
    found = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert found[1].kept and not found[2].kept and found[1].n_words == len(good.split())
    assert all(r[n] == n for r in found.values() for n in names)
    assert "N_WORDS" not in quality.judge(docs).columns and "Kept" not in quality.judge(docs).columns
    assert [r.asDict() for r in quality.keep_good(docs).collect()] == [docs.first().asDict()]
    assert quality.counts(docs).columns[:2] == ["doc_id", "text"] and quality.judge(docs.limit(0)).count() == 0


def test_rules_decide(spark):
    words = [f"word{i}" for i in range(60)]
    rows = [(1, " ".join([*words, "the of and to in is"])), (2, " ".join(words)), (3, " ".join([*words, "the of and to in is", "# " * 30]))]
    judged = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert judged[1].kept
    assert not judged[2].ok_stop_word_share and not judged[2].kept
    assert not judged[3].ok_symbols_per_word and not judged[3].kept and not judged[3].base_failed
