"""Reply trees to formatted conversations, with a loss mask, and back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.llm.common import small_batches, written

#: The strings that mark turns; inside texts they are escaped.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>")
#: What stands before and behind a turn's text.
AROUND = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>")}
START, OTHER, OTHER_END = "<s>", "<<ROLE>>", "<</ROLE>>"

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Double backslashes, then break control strings with one behind their first character."""
    return _CONTROL.sub(lambda m: f"{m.group()[0]}\\{m.group()[1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of its assistant texts in code points. Nulls are empty."""
    out, spans, at = [START], [], len(START)
    for role, text in turns:
        role, text = role or "", escape(text or "")
        before, after = AROUND.get(role) or (f"{OTHER}{escape(role)}{START}", OTHER_END)
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(text)))
        out += [before, text, after]
        at += len(before) + len(text) + len(after)
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts back from ``format_turns``."""
    if not formatted.startswith(START):
        raise ValueError("no conversation")
    at, turns = len(START), []
    while at < len(formatted):
        role = next((r for r, (before, _) in AROUND.items() if formatted.startswith(before, at)), None)
        before, after = AROUND[role] if role else (OTHER, OTHER_END)
        start = at + len(before)
        stop = formatted.index(after, start)
        text = formatted[start:stop]
        if role is None:
            role, _, text = text.partition(START)
            role = unescape(role)
        turns.append((role, unescape(text)))
        at = stop + len(after)
    return turns


def best_paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """(root, leaf, score, place, path_depth): the ``best`` root-to-leaf paths of each tree, and their nodes.

    ``nodes`` has ``node``, ``parent`` (null at a root) and ``score``. A path's score is its nodes' mean; ties go to
    the smaller leaf. Returns a row for each path and node on it: ``root``, ``leaf``, ``place`` (1 is the best),
    ``node``, ``above`` (the nodes above it).

    Every node keeps a pointer to an ancestor with the sum of scores on the way; a self-join replaces each pointer by
    its target's, which doubles its reach, so that chains of n replies take log n joins. The pointers of each round
    are kept, and the chosen leaves' ancestors are gathered over them in the same number of joins. A node whose
    parent is not in the table, or is its own ancestor, belongs to no path.
    """
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    step = written(nodes.select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("far"), score.alias("sum"), F.when(F.col("parent").isNull(), F.col("node")).alias("root")), "reply-tree")
    jumps, limit = [], step.count().bit_length() + 1
    while len(jumps) < limit:
        moving = step.where("up is not null")
        if not moving.limit(1).count():
            break
        jumps.append(moving.select("node", "up"))
        target = step.select(F.col("node").alias("up"), *[F.col(c).alias(f"_{c}") for c in ("up", "far", "sum", "root")])
        moved = moving.join(target, "up").select(
            "node", F.col("_up").alias("up"), (F.col("far") + F.col("_far")).alias("far"), (F.col("sum") + F.col("_sum")).alias("sum"), F.col("_root").alias("root")
        )
        step = written(moved.unionByName(step.where("up is null")), "reply-tree")
    inner = nodes.select(F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = step.where("up is null").join(inner, "node", "left_anti").withColumn("mean", F.col("sum") / F.col("far"))
    ranked = leaves.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("mean"), "node"))).where(F.col("place") <= best)
    members = written(ranked.select("root", F.col("node").alias("leaf"), "place", "node", F.col("far").alias("depth")), "reply-paths")
    for k, jump in enumerate(jumps):
        # Only members so near the leaf that the jump was not taken for them yet.
        higher = members.join(jump, "node").select("root", "leaf", "place", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        members = written(members.unionByName(higher), "reply-paths")
    return members.withColumn("above", F.col("depth") - 1).drop("depth")


def conversations(nodes: DataFrame, best: int = 1) -> DataFrame:
    """(root, leaf, place, formatted, loss_spans, n_turns): each chosen path as one conversation.

    ``nodes`` has ``node``, ``parent``, ``score``, ``role``, ``text``. Null roles and texts are empty. No nodes give
    no rows. A conversation is one row of the result, so its turns are gathered in one task.
    """
    paths = best_paths(nodes, best)
    turns = paths.join(nodes.select("node", "role", "text"), "node").groupBy("root", "leaf", "place")
    gathered = turns.agg(F.sort_array(F.collect_list(F.struct("above", "role", "text"))).alias("turns"))
    id_type = nodes.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [format_turns([(t["role"], t["text"]) for t in x.as_py()]) for x in batch.column("turns")]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in found], spans_type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([f for f, _ in found], pa.string()), spans], ["root", "leaf", "place", "formatted", "loss_spans"])

    ddl = f"root {id_type}, leaf {id_type}, place int, formatted string, loss_spans array<struct<start: long, end: long>>"
    return gathered.transform(small_batches).mapInArrow(run, ddl)


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``loss_text``, the unescaped text under the mask, both from the formatted text."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in formatted.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            texts = batch.column("formatted").to_pylist()
            turns = pa.array([[{"role": r, "text": t} for r, t in parse_turns(x)] for x in texts], turn)
            losses = [[unescape(x[s["start"] : s["end"]]) for s in spans] for x, spans in zip(texts, batch.column("loss_spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, turns, pa.array(["".join(x) for x in losses], pa.string())], [*batch.schema.names, "turns", "loss_text"])

    return formatted.transform(small_batches).mapInArrow(run, f"{ddl}, turns array<struct<role: string, text: string>>, loss_text string")


def linear_tree(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations kept by turn as reply trees: every row replies to the one before it.

    Rows of a conversation are ordered by turn (nulls first), role, text, so equal rows stay, one after the other.
    Rows without conversation form one together.
    """
    name = F.coalesce(F.col(conv).cast("string"), F.lit(""))
    place = F.row_number().over(Window.partitionBy(conv).orderBy(turn, "role", "text"))
    numbered = rows.select(name.alias("_name"), place.alias("_place"), "role", "text")

    def node(number: Column) -> Column:
        return F.concat_ws(":", "_name", number.cast("string"))

    return numbered.select(
        node(F.col("_place")).alias("node"), F.when(F.col("_place") > 1, node(F.col("_place") - 1)).alias("parent"), F.lit(0.0).alias("score"), "role", "text"
    )
