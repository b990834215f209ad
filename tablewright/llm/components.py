"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.llm.common import unsized, written

#: Far above the logarithm of any chain's length.
MAX_ROUNDS = 60
#: Links for each task of a round. A round has many exchanges, so few links are not dealt to all shuffle partitions.
LINKS_A_TASK = 2048
#: Of more links than that none of a round's tables is broadcast: files hold numbers of nodes in a part of their size.
SMALL_LINKS = 200_000


def _state(links: DataFrame) -> tuple:
    hashes = [F.sum(h % F.lit(1 << 31)) for h in (F.xxhash64("v", "r"), F.xxhash64("r", "v"))]
    return tuple(links.agg(F.count("*"), *hashes).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of ``links`` with the smallest node it reaches.

    Each round turns links towards the smallest neighbour of either end, first among larger and then among smaller
    neighbours, so that trees become stars in a logarithmic number of rounds. Minima are aggregated before the
    shuffle and joined back, so a node with very many links is no single task's work; each round is written to the
    shared folder. A round has as many tasks as its links are worth, or as the shuffle has partitions if these are
    fewer. Only counts and sums reach the driver. No links give no rows.
    """
    x, y = F.col(a), F.col(b)
    links = links.where(x != y).select(F.greatest(x, y).alias("v"), F.least(x, y).alias("r")).distinct()
    links = written(links, "links")
    state = _state(links)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        tasks, many = 2 + state[0] // LINKS_A_TASK, state[0] > SMALL_LINKS
        both = links.unionByName(links.select(F.col("r").alias("v"), F.col("v").alias("r"))).coalesce(tasks)
        low = both.groupBy("v").agg(F.min("r").alias("m")).coalesce(tasks).select("v", F.least("v", "m").alias("m"))
        low = unsized(low) if many else low
        # Larger neighbours of a node go to its smallest one.
        large = both.where("r > v").join(low, "v").coalesce(tasks).select(F.col("r").alias("v"), F.col("m").alias("r"))
        large = large.where("v != r").distinct().coalesce(tasks)
        # Smaller neighbours of a node, and the node, go to its smallest one.
        low = large.groupBy("v").agg(F.min("r").alias("m")).coalesce(tasks)
        low = unsized(low) if many else low
        small = large.join(low, "v").coalesce(tasks).select(F.explode(F.array("v", "r")).alias("v"), F.col("m").alias("r"))
        links = written(small.where("v != r").distinct().coalesce(tasks), "links")
        found = _state(links)
        if found == state:
            break
        state = found
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("r").alias("node")).distinct()
    return links.select(F.col("v").alias("node"), F.col("r").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
