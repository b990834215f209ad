import hashlib

import pytest

from tablewright.llm import queries, warc

LONG = "<p>" + "same " * 40 + "</p>"
ODD = "x" * 90 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n" + "é" * 20
ROWS = [
    (5, "http://a/5", LONG), (3, "http://a/3\r\nX: y", LONG), (9, None, LONG), (3, "http://a/3b", LONG), (1, "u", "short"), (2, "u", "short"),
    (4, "u", None), (6, "u", ""), (7, "u", ODD), (8, "u", ODD), (10, "u", "y" * 99), (11, "u", "y" * 99), (12, "u", "z" * 100), (13, "u", "z" * 100),
]


def want(rows):
    first = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= 100:
            first[html] = min(page, first.get(html, page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        to = first.get(html)
        again = page is not None and to is not None and page != to
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def test_revisits_with_odd_pages(spark, tmp_path):
    rows = [*ROWS, (None, "u", LONG)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, record_type string")
    pages.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in queries.op1_warc_revisits(spark, str(tmp_path)).collect()), key=str)
    assert got == want(rows)


def test_archives_hold_a_payload_once(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(2)
    warc.write_archives(warc.with_revisits(pages), f"{tmp_path}/warc")
    records = warc.read_archives(spark, f"{tmp_path}/warc").collect()
    assert len(records) == len(ROWS)
    assert sum(LONG.encode() in bytes(r.payload) for r in records) == 2  # both rows of the smallest id
    assert all(not r.payload for r in records if r.record_type == "revisit")
    assert {r.uri for r in records if r.page_id == "3"} == {"http://a/3%00%00X: y", "http://a/3b"}


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op1_warc_revisits(spark, str(tmp_path)).count() == 0


def test_unresolved_revisit(spark, tmp_path):
    pages = spark.createDataFrame(ROWS[:3], "page_id long, url string, html string")
    warc.write_archives(warc.with_revisits(pages).where("record_type = 'revisit'"), f"{tmp_path}/warc")
    got = warc.resolve(warc.read_archives(spark, f"{tmp_path}/warc")).collect()
    assert {(r.record_type, r.payload_bytes, r.refers_to) for r in got} == {("revisit", None, None)}


@pytest.mark.parametrize("bad", [b"junk\r\n\r\n"])
def test_junk_is_no_record(bad):
    with pytest.raises(ValueError):
        list(warc._records(bad))
