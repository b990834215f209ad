"""Byte-level BPE encoding over overlapping chunks, and decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tablewright.llm import bpe
from tablewright.llm.common import small_batches, written

#: Characters of a chunk, and those it shares with the next one.
CHUNK, OVERLAP = 32_768, 512


def _encode(df: DataFrame, path: str, keep: str) -> DataFrame:
    """Rows of (columns to keep..., text) to (columns to keep..., ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(path)
        for batch in batches:
            found = [encoder.encode(t.as_py() or "") for t in batch.column("text")]
            offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in found])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), ids], [*names, "ids"])

    return df.transform(small_batches).mapInArrow(run, f"{keep}, ids array<int>")


def _chunks(df: DataFrame, key_ddl: str, chunk: int, overlap: int) -> DataFrame:
    """(key, text) to a row for each chunk: row, key, k, last, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                count = -(-len(text) // chunk)
                for k in range(count):
                    columns = {"row": [row], "k": [k], "last": [k == count - 1], "text": [text[k * chunk : (k + 1) * chunk + overlap]]}
                    arrays = [pa.array([row], pa.int64()), batch.column("key").slice(i, 1), *(pa.array(columns[c]) for c in ("k", "last", "text"))]
                    yield pa.RecordBatch.from_arrays(arrays, ["row", "key", "k", "last", "text"])
                row += 1

    return df.transform(small_batches).mapInArrow(run, f"row long, {key_ddl}, k long, last boolean, text string")


def _pre_tokenise(df: DataFrame, key_ddl: str, chunk: int, overlap: int) -> DataFrame:
    """Adds the pre-token boundaries of a chunk within the overlap at its head and at its tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for text, last in zip(batch.column("text"), batch.column("last")):
                whole = text.as_py()
                found = bpe.boundaries(whole, last.as_py())
                heads.append([b for b in found if b <= overlap])
                # Behind white space the piece alone could split otherwise: the pattern looks past it.
                tails.append([b - chunk for b in found if b >= chunk and not whole[b - 1].isspace()])
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, "head", "tail"])

    return df.transform(small_batches).mapInArrow(run, f"row long, {key_ddl}, k long, last boolean, text string, head array<int>, tail array<int>")


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """One row for each document: the id column and ``ids``, an array of token ids.

    A text longer than ``chunk`` is cut into chunks that overlap; tasks pre-tokenise them side by side. At a seam
    the pieces meet at the first boundary that both chunks have within the overlap: from a common boundary on, both
    see the same text and so the same pre-tokens. Chunks whose seam has none (one run of letters or of white space
    may be longer than the overlap) are joined before encoding. Then the pieces are encoded side by side and put
    together by document. Shorter texts are one piece and need no shuffle.

    Null texts are empty and give no ids; repeated rows are encoded each; an empty table gives no rows.
    ``vocabulary`` is a rank file on every executor.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    key_ddl = f"key {docs.schema[id_col].dataType.simpleString()}"
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = _encode(rows.where(F.length("text") <= chunk), path, key_ddl)

    cut = _chunks(rows.where(F.length("text") > chunk), key_ddl, chunk, overlap).repartition("row", "k")
    cut = written(_pre_tokenise(cut, key_ddl, chunk, overlap), "bpe-chunks")
    by_row = Window.partitionBy("row").orderBy("k")
    seams = cut.select("row", "k", "head", F.lag("tail").over(by_row).alias("before"))
    seams = seams.select("row", "k", F.when(F.col("k") == 0, 0).otherwise(F.array_min(F.array_intersect("head", "before"))).alias("start"))
    seams = seams.withColumn("run", F.count("start").over(by_row)).withColumn("next", F.lead("start").over(by_row))
    seams = seams.withColumn("parts", F.count("k").over(Window.partitionBy("row", "run")))
    start, end = F.coalesce("start", F.lit(0)), F.when(F.col("last"), F.length("text")).otherwise(chunk + F.coalesce("next", F.lit(0)))
    pieces = cut.drop("head", "tail").join(seams, ["row", "k"]).withColumn("text", F.substring("text", start + 1, end - start))
    one = pieces.where("parts = 1").select("row", "key", "run", "text")
    joined = (
        pieces.where("parts > 1")
        .groupBy("row", "key", "run")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "").alias("text"))
    )
    encoded = _encode(one.unionByName(joined), path, f"row long, {key_ddl}, run long")
    ordered = F.sort_array(F.collect_list(F.struct("run", "ids")))
    long = encoded.groupBy("row").agg(F.first("key").alias("key"), F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
    return short.unionByName(long.select("key", "ids")).withColumnRenamed("key", id_col)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Adds ``decoded``, the raw bytes of ``ids`` one after the other; null ids give null."""
    path = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = bpe.pieces(path)
        for batch in batches:
            raw = [None if not x.is_valid else b"".join(map(pieces.__getitem__, x.values.to_pylist())) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.transform(small_batches).mapInArrow(run, f"{ddl}, decoded binary")
