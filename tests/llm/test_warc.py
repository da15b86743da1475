"""Operator 11: round trips, revisits against brute force, pushdown, foreign archives, manifests."""

import gzip
import hashlib
import io
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, Not, StringStartsWith
from pyspark.sql.types import StructType

from procmon.llm import queries, warc
from procmon.llm.common import scratch
from procmon.llm.tokenstore import file_system

SF = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string"


def expected(rows):
    latest = {}
    for i, _, h in rows:
        if h is not None and len(h.encode()) >= 1000 and i is not None:
            latest[h] = max(i, latest.get(h, i))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = latest.get(h)
        revisit = i is not None and to is not None and i < to
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return Counter(out)


def test_op11_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert Counter(map(tuple, queries.QUERIES["op11_warc"](spark, SF).collect())) == expected(rows)


LONG = "<p>" + "lang ünd breit " * 400_000
ROWS = [
    (1, "http://a/1", "x" * 1000), (2, "http://a/2", "x" * 1000), (2, "http://a/2", "x" * 1000), (None, "http://a/3", "x" * 1000),
    (3, None, "x" * 999), (4, "http://b", "x" * 999), (5, "http://b\r\nX: y", None), (6, "http://ü", ""), (-7, "u", "ä" * 500), (8, "u", "ä" * 500),
    (9, "l", LONG), (10, "l", LONG), (11, "WARC", "WARC/1.1\r\n\r\nHTTP/1.1 200\r\n\r\n" * 50),
]


def test_op11_odd_rows(spark):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in ROWS], PAGES + ", salt long, latest long, payload int")
    folder = scratch(spark, "warc-test")
    warc.write(df, folder)
    got = warc.read_pages(spark, folder)
    assert Counter(map(tuple, got.collect())) == expected(ROWS)
    urls = {r.target_uri for r in warc.read(spark, folder, "target_uri string").collect()}
    assert urls == {"http://a/1", "http://a/2", "http://a/3", None, "http://b", "http://b%0D%0AX: y", "http://ü", "u", "l", "WARC"}
    text = {r.record_id: bytes(r.payload) for r in warc.read(spark, folder, "payload binary, record_id string").where("record_id = '<urn:page:10>'").collect()}
    assert text == {"<urn:page:10>": LONG.encode()}
    warc.write(df.limit(0), empty := scratch(spark, "warc-empty"))
    assert warc.read_pages(spark, empty).count() == 0


def test_predicates_are_pushed(spark):
    warc.write(spark.createDataFrame(ROWS, PAGES), folder := scratch(spark, "warc-push"))
    all_ = warc.read(spark, folder)
    kept = all_.where("record_type = 'revisit' and refers_to like '<urn:page:2>%' and payload_bytes > 10")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "revisit" not in plan and "> 10" in plan  # what is pushed is not tested again
    assert [r.record_id for r in kept.collect()] == ["<urn:page:1>"]
    assert all_.where("not (record_type = 'response')").count() == 3 and all_.where("target_uri is null").count() == 1


def reader(folder="/nowhere", columns="record_id string, record_type string"):
    return warc.WarcReader({"path": folder}, StructType.fromDDL(columns))


def test_filters_follow_sql(spark):
    r = reader()
    own = [EqualTo(("record_type",), "revisit"), In(("refers_to",), ("a", "b")), Not(StringStartsWith(("target_uri",), "http:"))]
    other = [GreaterThan(("record_type",), "r"), EqualTo(("payload_bytes",), 1)]
    assert list(r.pushFilters([*own, *other])) == other
    row = {"record_type": "revisit", "refers_to": "b", "target_uri": "ftp:"}
    assert r.accept(row) and not r.accept(row | {"target_uri": None}) and not r.accept(row | {"refers_to": None}) and not r.accept(row | {"record_type": "response"})


class Counting(io.BytesIO):
    """A file that counts the bytes read."""

    read_bytes = 0

    def read_at(self, n, place):
        self.seek(place)
        out = self.read(n)
        self.read_bytes += len(out)
        return out


def foreign(i, payload, end=b"\r\n"):
    http = b"HTTP/1.0 200 OK" + end + b"Server: x" + end * 2
    head = [b"WARC/1.0", b"warc-type:response", b"WARC-Record-ID: <r%d>" % i, b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(http + payload), b"X-Folded: a", b"  b"]
    return end.join(head) + end * 2 + http + payload + end * 2


@pytest.mark.parametrize("end", [b"\r\n", b"\n"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_foreign_archives(pack, end):
    payloads = [b"", b"one", b"two\r\n\r\nWARC/1.0\r\n" * 9, b"\x00" * 3_000_000, b"last"]
    raw = b"".join(pack(foreign(i, p, end)) for i, p in enumerate(payloads))
    got = list(warc.read_records(Counting(raw), len(raw), "f", ["record_id", "payload", "payload_bytes"], lambda row: row["record_id"] != "<r1>"))
    assert got == [(f"<r{i}>", p, len(p)) for i, p in enumerate(payloads) if i != 1]


def test_unwanted_payloads_are_stepped_over():
    noise = hashlib.shake_256(b"n").digest(8 << 20)
    rows = [{"record_id": f"<{i}>", "record_type": "response", "target_uri": "u", "refers_to": None, "payload_digest": None, "payload_bytes": None, "payload": noise} for i in range(6)]
    raw = b"".join(warc.member(warc.record(r, "2024-01-01T00:00:00Z")) for r in rows)
    f = Counting(raw)
    assert len(list(warc.read_records(f, len(raw), "f", ["record_id"], lambda row: True))) == 6
    assert f.read_bytes < 0.2 * len(raw)
    f = Counting(raw)
    assert [r[0] for r in warc.read_records(f, len(raw), "f", ["payload"], lambda row: row["record_id"] == "<3>")] == [noise]
    assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == 6  # any reader of gzip can read them
    with pytest.raises(EOFError):
        list(warc.read_records(Counting(raw[:-9]), len(raw) - 9, "f", ["payload"], lambda row: True))


def test_only_committed_files_count(spark):
    df = spark.createDataFrame(ROWS[:4], PAGES)
    folder = scratch(spark, "warc-commit")
    warc.write(df, folder)
    fs, base = file_system(folder)
    with fs.open_output_stream(f"{base}/lost.warc.gz", compression=None) as f:
        f.write(b"half a record of a lost attempt")
    assert warc.read_pages(spark, folder).count() == 4
    warc.write(df, folder)
    assert warc.read_pages(spark, folder).count() == 8
    warc.records(df).write.format("warc").mode("overwrite").option("fileBytes", 1).save(folder)
    assert warc.read_pages(spark, folder).count() == 4
    files = warc.listed(fs, base)
    assert len(files) == 4 and len(warc.manifests(fs, base)) == 1
    parts = warc.WarcReader({"path": folder, "splitbytes": "1"}, StructType.fromDDL("record_id string")).partitions()
    assert sorted(f for p in parts for f in p.files) == sorted(files) and len(parts) == 4
    one = spark.read.format("warc").load(files[0][0])
    assert one.select(F.count("*")).first()[0] == 1


def test_unknown_columns_are_refused(spark):
    with pytest.raises(ValueError):
        reader(columns="record_id string, other int")
