"""What the operators of this folder share: tables, written intermediates, Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.durable import scratch_path

#: What separates words in the contracts of this folder: the space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAPS = r"[\x20\x09-\x0D]+"

#: Spark's setting by which a query's shuffle files go when it ends, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of an Arrow batch.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    Cuts the lineage with files that outlive an executor, so that several readers see the same rows. The shuffle files
    that the rows came through are deleted, as nothing reads them again.
    """
    path, conf = scratch_path(df.sparkSession, label), df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsized(df: DataFrame) -> DataFrame:
    """``df``, not to be broadcast in a join.

    Spark tells the size of a table from the files below it. Rows that are exploded or made in Python, and texts that
    files hold compressed, may be many times that size, and the driver holds a table whole to broadcast it.
    """
    return df.hint("merge")


def small_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """``df``, in a session whose Python tasks get few rows at once: a row may hold a long text."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each key, from batches sorted by ``keys``; a key's rows must be few enough to hold."""
    key, parts = None, []
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(max(batch.num_rows - 1, 0), bool)
        for c in columns:
            changed |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            found = tuple(c[a] for c in columns)
            if found != key and parts:
                yield key, pa.Table.from_batches(parts)
                parts = []
            key = found
            parts.append(batch.slice(a, b - a))
    if parts:
        yield key, pa.Table.from_batches(parts)


def meetings(held: DataFrame, passing: DataFrame, key: list[str], place: str, held_rows: int, passing_rows: int) -> DataFrame:
    """Bring the held and the passing rows of each key together, in groups of bounded size.

    Both sides have the columns of ``key`` and the same others; ``place`` names a column that rows are spread by.
    Held rows of a key are cut into blocks of about ``held_rows``, passing rows into slices of about
    ``passing_rows``; every block meets every slice, so a hot key is shared out over many tasks. Keys without rows
    on one side are left out. The result is sorted by key, ``block``, ``slice`` and ``side`` (0: held) within tasks.
    """
    both = held.withColumn("side", F.lit(0)).unionByName(passing.withColumn("side", F.lit(1)))
    sizes = both.groupBy(*key).agg(F.count(F.when(F.col("side") == 0, 1)).alias("_h"), F.count(F.when(F.col("side") == 1, 1)).alias("_p"))
    sizes = sizes.where("_h > 0 and _p > 0")
    sizes = sizes.select(*key, F.ceil(F.col("_h") / held_rows).alias("_blocks"), F.ceil(F.col("_p") / passing_rows).alias("_slices"))
    spread = F.xxhash64(place)
    own, every = F.when(F.col("side") == 0, F.pmod(spread, "_blocks")), F.sequence(F.lit(0).cast("long"), F.when(F.col("side") == 0, F.col("_slices")).otherwise(F.col("_blocks")) - 1)
    rows = both.join(sizes, key).withColumn("_own", F.coalesce(own, F.pmod(spread, "_slices"))).withColumn("_other", F.explode(every))
    rows = rows.withColumn("block", F.when(F.col("side") == 0, F.col("_own")).otherwise(F.col("_other")))
    rows = rows.withColumn("slice", F.when(F.col("side") == 0, F.col("_other")).otherwise(F.col("_own")))
    rows = rows.drop("_blocks", "_slices", "_own", "_other").repartition(*key, "block", "slice")
    return rows.sortWithinPartitions(*key, "block", "slice", "side")
