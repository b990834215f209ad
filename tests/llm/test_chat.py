import random

from hypothesis import given, strategies as st

from tablewright.llm import chat, queries

PIECES = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", ">", "[", "/", "s", " ", "\n", "é", "INST]"]), max_size=12).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool"]), PIECES), PIECES), max_size=6))
def test_round_trip(turns):
    formatted, spans = chat.format_turns(turns)
    assert chat.parse_turns(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def brute(nodes, best):
    children, by_id = {}, {n[0]: n for n in nodes}
    for n in nodes:
        children.setdefault(n[1], []).append(n[0])
    out = []
    for root in children.get(None, []):
        paths, stack = [], [[root]]
        while stack:
            path = stack.pop()
            below = children.get(path[-1], [])
            if below:
                stack += [[*path, c] for c in below]
            else:
                paths.append((-sum(by_id[x][2] for x in path) / len(path), path[-1], path))
        for place, (_, leaf, path) in enumerate(sorted(paths)[:best], 1):
            out.append((root, leaf, place, chat.format_turns([(by_id[x][3], by_id[x][4]) for x in path])[0]))
    return sorted(out)


def test_best_paths_of_random_trees(spark):
    rng = random.Random(3)
    nodes = []
    for i in range(120):
        tree = i // 40
        parent = None if i % 40 == 0 else rng.randrange(tree * 40, i)
        nodes.append((i, parent, float(rng.randrange(8)), rng.choice(["user", "assistant", None]), rng.choice(["a", None, "</s>", ""])))
    nodes += [(200 + i, 199 + i if i else None, 1.0, "user", str(i)) for i in range(70)]  # a chain
    df = spark.createDataFrame(nodes, "node long, parent long, score double, role string, text string")
    for best in (1, 3):
        got = sorted((r.root, r.leaf, r.place, r.formatted) for r in chat.conversations(df, best).collect())
        assert got == brute(nodes, best)


def test_nodes_without_root(spark):
    rows = [(1, None, 1.0, "user", "a"), (2, 99, 1.0, "user", "lost"), (3, 2, 1.0, "user", "lost"), (4, 5, 1.0, "user", "x"), (5, 4, 1.0, "user", "x")]
    df = spark.createDataFrame(rows, "node long, parent long, score double, role string, text string")
    assert [r.formatted for r in chat.conversations(df).collect()] == ["<s>[INST] a [/INST]"]
    assert chat.conversations(df.limit(0)).count() == 0


def test_odd_conversations(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, "system", "s"), (1, 7, None, "x"), (None, 0, "user", "n"), (2, 0, "assistant", "a\\</s>")]
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, node int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op8_reply_trees(spark, str(tmp_path)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 4, None: 1, 2: 1, -1: 2}
    assert got[2].loss_chars == 6 and got[-1].loss_chars == 21 and got[1].loss_chars == 0
