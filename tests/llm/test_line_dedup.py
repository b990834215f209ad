import random
from collections import defaultdict

from hypothesis import given, settings, strategies as st

from tablewright.llm import line_dedup

SHORT = st.text("ab c", max_size=14)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


@settings(max_examples=600)
@given(SHORT, SHORT, st.integers(0, 4))
def test_within(a, b, limit):
    assert line_dedup.within(a, b, limit) == (distance(a, b) <= limit)


@settings(max_examples=400)
@given(st.text("abc", min_size=3, max_size=20), st.lists(st.tuples(st.integers(0, 20), st.sampled_from(["", "a", "x", "bc"])), max_size=2))
def test_near_lines_share_a_key(line, edits):
    other = line
    for at, new in edits:
        other = other[:at] + new + other[at + 1 :]
    for threshold in (1, 2, 3):
        if distance(line, other) <= threshold:
            long, short = sorted((line, other), key=len, reverse=True)
            parts = line_dedup.segments(len(short), threshold)
            assert any(long[p : p + n] == short[parts[i][0] : parts[i][0] + n] for i, p, n in line_dedup.probes(len(long), len(short), threshold))
            assert bin(line_dedup.sketch(line) ^ line_dedup.sketch(other)).count("1") <= 4 * threshold


def brute(docs):
    """Lines that stay, by document row."""
    places = []
    for row, (key, text) in enumerate(docs):
        for place, line in enumerate((text or "").split("\n")):
            line = line.strip()
            if len(line) >= line_dedup.CHARS_PER_EDIT:
                places.append((key, row, place, line))
    parent = list(range(len(places)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, p in enumerate(places):
        for j in range(i):
            longest = max(len(p[3]), len(places[j][3]))
            if distance(p[3], places[j][3]) <= line_dedup.allowed(longest):
                parent[root(i)] = root(j)
    first = {}
    for i, p in enumerate(places):
        first[root(i)] = min(first.get(root(i), p), p)
    gone = {p[1:3] for i, p in enumerate(places) if first[root(i)] != p}
    return {key: "\n".join(x for k, x in enumerate(text.split("\n")) if (row, k) not in gone) for row, (key, text) in enumerate(docs)}


def test_dedup_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HELD", 3)
    monkeypatch.setattr(line_dedup, "PASSING", 5)
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(14, 60))).strip() + "." for _ in range(12)]
    base += ["common heading of every page %s" % c for c in "abcdefghijkl"]

    def edited(line):
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(line))
            line = line[:at] + rng.choice(["", "x", "yy"]) + line[at + rng.randint(0, 1) :]
        return line

    docs = [(i, "\n".join(edited(rng.choice(base)) for _ in range(rng.randint(1, 5)))) for i in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, place int")
    got = {r.doc_id: r.text for r in line_dedup.dedup(df).collect()}
    assert got == brute(docs)


def test_odd_rows(spark):
    line = "a line that is long enough"
    rows = [(1, line), (1, line), (2, None), (2, ""), (None, line + "!"), (3, f"{line}\nshort\nshort\n  {line}s  ")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, mark string")
    found = defaultdict(list)
    for r in line_dedup.dedup(df).collect():
        found[r.doc_id].append(r.text)
        assert r.mark == "x"
    # Nulls sort first, so the row without id is the earliest.
    assert set(found.pop(2)) == {None, ""}
    assert found == {1: ["", ""], None: [line + "!"], 3: ["short\nshort"]}
    assert line_dedup.dedup(df.limit(0)).count() == 0
