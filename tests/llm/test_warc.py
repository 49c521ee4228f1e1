import base64
import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from lotwise.llm import warc
from lotwise.llm.common import new_path, ready

SCHEMA = "page_id long, url string, html string"
ROWS = [
    (5, "http://a/5", "same"), (2, "http://a/2", "same"), (9, None, "same"), (1, "http://a/%\r\n1", "é" * 3000),
    (3, "http://a/3", None), (4, "http://a/4", ""), (6, "http://a/6", "x" * 300_000), (7, "http://a/7", "\r\n\r\nWARC/1.1\x00"),
    (8, "http://a/8", "alone"),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows, least=0):
    first = {}
    for page, _, html in rows:
        html = html or ""
        first[html] = min(page, first.get(html, page))
    out = []
    for page, _, html in rows:
        html = html or ""
        revisit = first[html] != page and len(html.encode()) >= least
        out.append((page, len(html.encode()), digest(html), "revisit" if revisit else "response", first[html] if revisit else None))
    return sorted(out)


@pytest.fixture
def pages(spark):
    ready(spark)
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("sha1", F.lit("clash")).withColumn("first", F.lit(0))


def test_round_trip(spark, pages):
    assert sorted(map(tuple, warc.round_trip(pages).collect())) == brute(ROWS)
    assert sorted(map(tuple, warc.round_trip(pages, 5).collect())) == brute(ROWS, 5)


def written(spark, pages):
    path = new_path(spark, "warc-test")
    warc.write(warc.records_of(pages), path)
    return path


def test_payloads_and_headers_come_back(spark, pages):
    path = written(spark, pages)
    html = {p: (h or "").encode() for p, _, h in ROWS}
    urls = {p: u for p, u, _ in ROWS}
    rows = warc.read(spark, path).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r["url"] == urls[r["page_id"]]
        assert r["payload"] == (None if r["record_type"] == "revisit" else html[r["page_id"]])


def test_archives_are_ordinary_gzip_members(spark, pages):
    path = written(spark, pages).removeprefix("file:")
    whole = b"".join(gzip.open(f).read() for f in glob.glob(f"{path}/*.warc.gz"))
    # A payload that looks like a header is skipped by its stated length.
    at = count = 0
    while at < len(whole):
        end = whole.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in whole[at:end].decode().split("\r\n")[1:])
        at = end + 4 + int(fields["Content-Length"]) + 4
        assert whole[at - 4 : at] == b"\r\n\r\n"
        count += 1
    assert count == len(ROWS)


def test_filters_go_to_the_source(spark, pages):
    path = written(spark, pages)
    some = warc.read(spark, path).filter("record_type = 'revisit' AND page_id IN (5, 9, 4)")
    assert sorted(r["page_id"] for r in some.collect()) == [4, 5, 9]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo" in plan or "record_type" in plan
    reader = warc.WarcReader(some.schema, path)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    asked = [EqualTo(("record_type",), "response"), In(("page_id",), (1, 6)), GreaterThan(("page_id",), 1)]
    assert list(reader.pushFilters(asked)) == asked[2:]
    got = [p for part in reader.partitions() for b in reader.read(part) for p in b.column("page_id").to_pylist()]
    assert sorted(got) == [1, 6]


def test_payloads_that_are_not_wanted_are_not_inflated(spark, pages, monkeypatch):
    path = written(spark, pages)
    inflated = []
    whole = warc.inflate
    monkeypatch.setattr(warc, "inflate", lambda member: inflated.append(len(member)) or whole(member))
    frame = warc.read(spark, path, ["page_id", "record_type"])
    reader = warc.WarcReader(frame.schema, path)
    rows = [p for part in reader.partitions() for b in reader.read(part) for p in b.column("page_id").to_pylist()]
    assert len(rows) == len(ROWS) and len(inflated) == len(ROWS)  # headers only
    assert sorted(r["page_id"] for r in frame.collect()) == sorted(p for p, _, _ in ROWS)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    ready(spark)
    rows = [(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (None, None, None), (2, "u", "a")]
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"]) == [
        (0, "revisit", 1), (1, "response", None), (1, "response", None), (2, "revisit", 1)]
    assert len(got) == 5
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
