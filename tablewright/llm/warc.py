"""WARC archives without repeated payloads: revisit records, written and read back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.llm.common import small_batches, written

MIN_BYTES = 100
#: Records of an archive file, which one task reads as a whole.
RECORDS_PER_FILE = 2000
#: A table of repeated digests of at most so many rows (under 100 bytes each) is broadcast.
SMALL_ROWS = 50_000

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Adds ``payload_digest``, ``payload_bytes``, ``record_type`` and ``refers_to`` to ``pages``.

    Of rows with equal payloads of at least ``min_bytes`` bytes the smallest id is a response and the others are
    revisits of it; rows that repeat that id are all responses, as are smaller payloads. A null payload is empty; a
    row without id is a response. Only digests and ids are shuffled to find repeats, with minima taken before the
    shuffle, so a payload that fills a third of the table is no single task's work.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    own = ["payload_digest", "payload_bytes", "record_type", "refers_to"]
    found = pages.drop(*own).withColumns({"payload_digest": F.sha2(payload, 256), "payload_bytes": F.octet_length(payload).cast("long")})
    headers = found.where(F.col("payload_bytes") >= min_bytes).select("payload_digest", F.col(id_col).alias("_id"))
    repeats = headers.groupBy("payload_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    repeats = written(repeats.where("_n > 1").drop("_n"), "warc-repeats")
    if repeats.count() <= SMALL_ROWS:
        repeats = F.broadcast(repeats)
    joined = found.join(repeats, "payload_digest", "left")
    again = F.col("_first").isNotNull() & F.col(id_col).isNotNull() & (F.col(id_col) != F.col("_first"))
    return joined.select(
        *[c for c in found.columns], F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to")
    )


def record_id(page: Column, digest: Column) -> Column:
    """A URN that follows from a page's id and payload, so that revisits can name it."""
    h = F.md5(F.concat_ws("|", page.cast("string"), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; none for a null. Control characters, which would end the line, are escaped."""
    clean = F.regexp_replace(value.cast("string"), r"[\x00-\x1F\x7F]", "%00")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(END)), F.lit(""))


def write_archives(records: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE) -> None:
    """Write rows of ``with_revisits`` as WARC 1.1 files, each record with fresh headers; revisits have no payload.

    Spark's own writer commits the files, so a lost task leaves none behind, on any file system Spark writes to.
    """
    revisit = F.col("record_type") == "revisit"
    payload = F.when(revisit, "").otherwise(F.coalesce(F.col(payload_col).cast("string"), F.lit("")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(END * 2))
    block = F.concat(http, payload)
    digest = F.concat(F.lit("sha256:"), F.col("payload_digest"))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", record_id(F.col(id_col), F.col("payload_digest"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col(url_col)),
        _line("WARC-Payload-Digest", digest),
        _line("WARC-Page-ID", F.col(id_col)),
        _line("WARC-Refers-To", F.when(revisit, record_id(F.col("refers_to"), F.col("payload_digest")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block)),
        F.lit(END),
    )
    # A record ends with two line ends; the writer adds the second.
    lines = records.select(F.concat(head, block, F.lit(END)).alias("value"))
    lines.write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode().split(END)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        start = stop + 4
        at = start + int(fields["content-length"])
        yield fields, data[start:at]
        at += 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, record_id, refers_to_record, uri, page_id, payload): a row for each record of the files in ``path``."""
    names = ["warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-page-id"]
    columns = ["record_type", "record_id", "refers_to_record", "uri", "page_id", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                for fields, block in _records(content.as_py()):
                    rows.append((*(fields.get(n) for n in names), block[block.index(b"\r\n\r\n") + 4 :]))
                for i in range(0, len(rows), 500):
                    arrays = [pa.array(c, pa.binary() if n == "payload" else pa.string()) for n, c in zip(columns, zip(*rows[i : i + 500]))]
                    yield pa.RecordBatch.from_arrays(arrays, columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.transform(small_batches).mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'payload' else 'string'}" for c in columns))


def resolve(records: DataFrame) -> DataFrame:
    """Size and digest of the full payload of every record, and the page a revisit refers to.

    Revisits are joined to the response they name by record id; only headers are shuffled. A revisit whose response
    is not among ``records`` has nulls.
    """
    heads = written(
        records.select("record_type", "record_id", "refers_to_record", "uri", "page_id", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("d")),
        "warc-headers",
    )
    first = heads.where("record_type = 'response'").groupBy("record_id").agg(F.min("page_id").alias("to"), F.min("n").alias("to_n"), F.min("d").alias("to_d"))
    names = ["page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    new = heads.where("record_type = 'response'").select("page_id", "uri", F.col("n"), F.col("d"), "record_type", F.lit(None).cast("string")).toDF(*names)
    old = heads.where("record_type = 'revisit'").drop("record_id").join(first, F.col("refers_to_record") == F.col("record_id"), "left")
    return new.unionByName(old.select("page_id", "uri", "to_n", "to_d", "record_type", "to").toDF(*names))
