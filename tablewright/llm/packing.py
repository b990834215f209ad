"""Cost-balanced packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tablewright.llm import bpe
from tablewright.llm.common import small_batches

CAPACITY = 1024
END = 0
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1 / 2048
#: Documents of one task are packed together until they hold so many tokens.
POOL_TOKENS = 1 << 21

SCHEMA = pa.schema([
    ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])


def capacities(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Full sequences, and the rest as powers of two, so that nothing is padded."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def place(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece, for documents of these lengths.

    A document gives pieces of ``capacity`` tokens and a rest. Pieces go in descending order, each to the
    sequence of the lowest cost among those with room for it. What fits nowhere is cut at the roomiest sequence,
    and its remainder waits for its turn in the descending order.
    """
    room = np.array(capacities(sum(lengths), capacity), np.int64)
    cost = np.zeros(len(room))
    used = np.zeros(len(room), np.int64)
    out, waiting, full = [], [], 0
    for d, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            out.append((d, k * capacity, capacity, full, 0))
            full += 1
        if n % capacity:
            waiting.append((-(n % capacity), d, whole * capacity))
    room[:full] = 0
    heapq.heapify(waiting)
    while waiting:
        n, d, start = heapq.heappop(waiting)
        n = -n
        fits = np.flatnonzero(room >= n)
        if len(fits):
            s, part = int(fits[np.argmin(cost[fits])]), n
        else:
            s = int(np.argmax(room))
            part = int(room[s])
            heapq.heappush(waiting, (part - n, d, start + part))
        out.append((d, start, part, s, int(used[s])))
        room[s] -= part
        used[s] += part
        cost[s] += linear * part + quadratic * part * part
    return out


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
) -> DataFrame:
    """One row for each piece: the id column, start, length, ids, doc_tokens, sequence_id, offset.

    ``vocabulary`` is a rank file on every executor. ``ids`` holds little-endian unsigned 32-bit ids; each document
    ends with the id 0. The documents of a task are packed in pools of about ``POOL_TOKENS``, so memory is bounded,
    nothing is shuffled and a repeated task gives the same sequences; ``sequence_id`` counts on from the partition's
    number. Null texts are empty, repeated rows are packed each, an empty table gives no rows.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    id_type = docs.schema[id_col].dataType
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(path)
        number = TaskContext.get().partitionId() << 33
        keys, pool, tokens, key_type = [], [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            pieces = place([len(b) // 4 for b in pool], capacity, linear, quadratic)
            for i in range(0, len(pieces), 4096):
                d, start, length, s, offset = zip(*pieces[i : i + 4096])
                ids = [pool[x][4 * a : 4 * (a + n)] for x, a, n in zip(d, start, length)]
                columns = [start, length, ids, [len(pool[x]) // 4 for x in d], [number + x for x in s], offset]
                arrays = [pa.array([keys[x] for x in d], key_type), *(pa.array(c, f.type) for c, f in zip(columns, SCHEMA))]
                yield pa.RecordBatch.from_arrays(arrays, [id_col, *SCHEMA.names])
            number += 1 + max((p[3] for p in pieces), default=-1)

        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                keys.append(key)
                pool.append(ids)
                tokens += len(ids) // 4
                if tokens >= POOL_TOKENS:
                    yield from flush()
                    keys, pool, tokens = [], [], 0
        if pool:
            yield from flush()

    schema = f"`{id_col}` {id_type.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(id_col, text_col).transform(small_batches).mapInArrow(run, schema)
