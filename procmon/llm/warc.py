"""WARC archives as a Spark data source (format ``warc``), written and read.

Reading: files are planned into partitions of about ``splitBytes`` bytes (small files share one,
a file is never cut).  Predicates on the record type and on other header columns
are pushed down; a record's headers are parsed first, and the payload of a record that
fails them, or that the schema does not ask for, is not decoded: gzip members that carry
their own length (the ``sl`` extra field, as this writer's do) are stepped over, others
are inflated and thrown away.  Plain ``.warc`` files are read too.  The schema may name any
of the columns of ``SCHEMA``, in any order; it decides what is decoded.

Writing: rows with columns of ``WRITTEN`` become one gzip member each, in files of about
``fileBytes`` bytes.  A row of type ``revisit`` holds HTTP headers alone and names the
record it refers to.  Files are named after the attempt that wrote them and count when the
job's manifest names them, which the driver writes at the end (a row a file); a task that is
lost or run twice leaves files that no manifest names.  A folder without a manifest is read
by its ``*.warc`` and ``*.warc.gz`` files.

``records`` decides which of many pages with equal payloads is the response, the others
being revisits of it.

Null payloads are empty ones.  A null URL gives a record without a target.  Pages without an id are always responses,
and so are all that share the largest id of a payload.  Control characters in header values
are percent-encoded.  Empty tables give empty archives, which are read as no rows.  Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from procmon.llm.tokenstore import file_system

SCHEMA = "record_id string, record_type string, date string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, file string, offset long"
WRITTEN = ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload")
# Fixed names of the format.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
LEAST_REVISIT = 1000  # bytes of a payload worth a revisit record
SALTS = 64
CHUNK = 1 << 20
LONGEST_HEAD = 1 << 20
LEVEL = 6


# -- the format -------------------------------------------------------------------


def member(data: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` holds its own length and that of the data."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    length = 12 + 12 + len(body) + 8
    fits = max(length, len(data)) < 1 << 32
    head = b"\x1f\x8b\x08" + (b"\x04" if fits else b"\x00") + struct.pack("<IBB", 0, 0, 255)
    extra = struct.pack("<HccHII", 12, b"s", b"l", 8, length, len(data)) if fits else b""
    return head + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _value(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(row: dict, date: str) -> bytes:
    """The record of a row of ``WRITTEN`` columns."""
    payload = row["payload"] or b""
    size = len(payload) if row["payload_bytes"] is None else row["payload_bytes"]
    lines = ["WARC/1.1"]
    for column, name in HEADERS.items():
        value = date if column == "date" else row[column]
        if value is None:
            continue
        if column == "payload_digest":
            value = "sha1:" + base64.b32encode(bytes.fromhex(value)).decode()
        lines.append(f"{name}: {_value(value)}")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    else:
        block += payload
    lines += [f"Content-Type: {HTTP}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(raw: bytes) -> dict[str, str]:
    """Names (lower case) and values of a block of headers, its first line under an empty name."""
    lines = re.sub(r"\r?\n[ \t]+", " ", raw.decode("utf-8", "replace"))
    lines = re.split(r"\r?\n", lines)
    out = {"": lines[0] if lines else ""}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _digest(value: str | None) -> str | None:
    """A payload digest as bare lower-case hexadecimal digits."""
    if value is None:
        return None
    label, _, digits = value.rpartition(":")
    if len(digits) == 32 and label.lower() in ("", "sha1"):
        return base64.b32decode(digits.upper()).hex()
    return digits.lower()


class Window:
    """Random access to a file through one buffered part of it."""

    def __init__(self, file):
        self.file, self.start, self.data = file, 0, b""

    def at(self, place: int, n: int) -> bytes:
        inner = place - self.start
        if inner < 0 or inner + n > len(self.data):
            self.start, self.data, inner = place, self.file.read_at(max(n, CHUNK), place), 0
        return self.data[inner : inner + n]


class Member:
    """The bytes of a gzip member, inflated as far as asked."""

    def __init__(self, window: Window, place: int):
        self.window, self.begin, self.place = window, place, place
        self.inflate, self.out, self.length = zlib.decompressobj(31), bytearray(), None
        head = window.at(place, 24)
        if head[3] & 4 and len(head) == 24 and head[12:14] == b"sl" and struct.unpack("<H", head[14:16])[0] == 8:
            self.length = struct.unpack("<I", head[16:20])[0]

    def until(self, n: int) -> bytearray:
        """At least the first ``n`` bytes, or all."""
        while len(self.out) < n and not self.inflate.eof:
            raw = self.inflate.unconsumed_tail
            if not raw:
                raw = self.window.at(self.place, 1 << 16)
                if not raw:
                    raise EOFError(f"the member at {self.begin} is cut short")
                self.place += len(raw)
            self.out += self.inflate.decompress(raw, max(n - len(self.out), 1 << 12))
        return self.out

    def end(self) -> int:
        """Where the next member begins; what is left is inflated only if the member does not tell its length."""
        if self.length is not None:
            return self.begin + self.length
        while not self.inflate.eof:
            raw = self.inflate.unconsumed_tail or self.window.at(self.place, 1 << 16)
            if not raw:
                raise EOFError(f"the member at {self.begin} is cut short")
            self.place += 0 if self.inflate.unconsumed_tail else len(raw)
            self.inflate.decompress(raw, 1 << 20)
        return self.place - len(self.inflate.unused_data)


class Plain:
    """The bytes of an uncompressed record."""

    def __init__(self, window: Window, place: int):
        self.window, self.begin = window, place

    def until(self, n: int) -> bytes:
        return self.window.at(self.begin, n)


def _head_end(source, at: int = 0, most: int | None = None) -> int:
    """Where the headers that begin at ``at`` end; at ``most`` if they don't."""
    n = at + 2048
    while True:
        raw = source.until(n if most is None else min(n, most))
        found = re.compile(rb"\r?\n\r?\n").search(raw, at)
        if found:
            return found.end() if most is None else min(found.end(), most)
        if most is not None and n >= most or len(raw) < n and (most is None or len(raw) < most):
            return len(raw) if most is None else most
        if n - at > LONGEST_HEAD:
            raise ValueError("no end of the headers")
        n = at + 2 * (n - at)


def read_records(file, size: int, name: str, columns: list[str], accept) -> Iterator[tuple]:
    """The ``columns`` of each record whose headers ``accept`` (a function of a row of header columns)."""
    window, place = Window(file), 0
    need_http, need_payload = "payload_bytes" in columns or "payload" in columns, "payload" in columns
    while place < size:
        start = window.at(place, 2)
        if start in (b"\r\n", b"\n", b"\n\n") or start[:1] == b"\n":  # between plain records
            place += 1 if start[:1] == b"\n" else 2
            continue
        zipped = start == b"\x1f\x8b"
        source = Member(window, place) if zipped else Plain(window, place)
        body = _head_end(source)
        head = parse_head(source.until(body)[:body])
        if not head[""].startswith("WARC/"):
            raise ValueError(f"{name}: no record at {place}")
        row = {c: head.get(h.lower()) for c, h in HEADERS.items()}
        row["payload_digest"] = _digest(row["payload_digest"])
        length = int(head.get("content-length", 0))
        if accept(row):
            row |= {"file": name, "offset": place, "payload_bytes": None, "payload": None}
            if need_http:
                http = (head.get("content-type") or "").startswith("application/http")
                first = _head_end(source, body, body + length) if http and length else body
                told = parse_head(source.until(first)[body:first]).get("content-length") if http else None
                revisit = row["record_type"] == "revisit"
                row["payload_bytes"] = int(told) if told and told.isdigit() and revisit else None if revisit else body + length - first
                if need_payload and not revisit:
                    row["payload"] = bytes(source.until(body + length)[first : body + length])
                    if zipped:
                        source.until(1 << 62)  # to the member's checksum
                    if len(row["payload"]) != row["payload_bytes"]:
                        raise EOFError(f"{name}: the record at {place} is cut short")
            yield tuple(row[c] for c in columns)
        place = source.end() if zipped else place + body + length


# -- the data source ----------------------------------------------------------------


@dataclass
class Files(InputPartition):
    files: list  # (path, bytes)


@dataclass
class Written(WriterCommitMessage):
    files: list  # {"name", "bytes", "records"}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.split = options["path"], int(options.get("splitbytes", 64 << 20))
        self.columns, self.schema, self.tests = schema.names, schema, []
        if unknown := set(self.columns) - {c.split()[0] for c in SCHEMA.split(",")}:
            raise ValueError(f"no such columns: {sorted(unknown)}")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take the predicates on header columns; Spark tests the others."""
        for f in filters:
            if (test := header_test(f)) is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self) -> list[Files]:
        fs, base = file_system(self.path)
        out, held = [Files([])], 0
        for path, size in sorted(listed(fs, base)):
            if out[-1].files and held + size > self.split:
                out.append(Files([]))
                held = 0
            out[-1].files.append((path, size))
            held += size
        return out

    def accept(self, row: dict) -> bool:
        return all(_holds(test, row) for test in self.tests)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, _ = file_system(self.path)
        arrow = to_arrow_schema(self.schema)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

        held, size = [], 0
        for path, length in partition.files:
            with fs.open_input_file(path) as f:
                for row in read_records(f, length, path.rsplit("/", 1)[-1], self.columns, self.accept):
                    held.append(row)
                    size += 200 + sum(len(v) for v in row if isinstance(v, bytes))
                    if size > 4 << 20 or len(held) == 4096:
                        yield batch(held)
                        held, size = [], 0
        yield batch(held)


def header_test(f: Filter) -> tuple | None:
    """A predicate on a header column as (kind, column, value); None for others."""
    if isinstance(f, Not):
        inner = header_test(f.child)
        return None if inner is None else ("not", inner[1], inner)
    kinds = {EqualTo: "=", EqualNullSafe: "<=>", In: "in", StringStartsWith: "starts", IsNotNull: "some", IsNull: "none"}
    if type(f) not in kinds or len(f.attribute) != 1 or f.attribute[0] not in HEADERS:
        return None
    return kinds[type(f)], f.attribute[0], tuple(f.value) if isinstance(f, In) else getattr(f, "value", None)


def _truth(test: tuple, row: dict) -> bool | None:
    """SQL's truth of a test: None if it is unknown."""
    kind, column, value = test
    have = row[column]
    if kind == "not":
        inner = _truth(value, row)
        return None if inner is None else not inner
    if kind in ("some", "none", "<=>"):
        return (have is not None) if kind == "some" else have is None if kind == "none" else have == value
    if have is None or value is None:
        return None
    if kind == "in":
        return True if have in value else None if None in value else False
    return have == value if kind == "=" else have.startswith(value)


def _holds(test: tuple, row: dict) -> bool:
    return _truth(test, row) is True


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.most, self.overwrite = options["path"], int(options.get("filebytes", 256 << 20)), overwrite
        self.date = options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        if missing := {"record_id", "record_type", "payload"} - set(schema.names):
            raise ValueError(f"columns are missing: {sorted(missing)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = file_system(self.path)
        fs.create_dir(base, recursive=True)
        files, out = [], None
        for batch in iterator:
            columns = {c: batch.column(c) for c in WRITTEN if c in batch.schema.names}
            for i in range(batch.num_rows):
                if out is None:
                    files.append({"name": f"{uuid.uuid4().hex}.warc.gz", "bytes": 0, "records": 0})
                    out = fs.open_output_stream(f"{base}/{files[-1]['name']}", compression=None)
                raw = member(record({c: columns[c][i].as_py() if c in columns else None for c in WRITTEN}, self.date))
                out.write(raw)
                files[-1]["bytes"] += len(raw)
                files[-1]["records"] += 1
                if files[-1]["bytes"] >= self.most:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Write the manifest; when overwriting, those of earlier jobs and their files go afterwards."""
        fs, base = file_system(self.path)
        fs.create_dir(base, recursive=True)
        earlier = manifests(fs, base) if self.overwrite else []
        stale = [path for m in earlier for path, _ in named(fs, base, m)]
        name = f"{base}/_manifest-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{name}.part", compression=None) as f:
            for m in messages:
                for file in m.files if m else []:
                    f.write(json.dumps(file).encode() + b"\n")
        fs.move(f"{name}.part", f"{name}.json")
        for path in [*earlier, *stale]:
            fs.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = file_system(self.path)
        for m in messages:
            for file in m.files if m else []:
                fs.delete_file(f"{base}/{file['name']}")


def manifests(fs: pafs.FileSystem, base: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return [f.path for f in found if re.search(r"/_manifest-\w+\.json$", f.path)]


def named(fs: pafs.FileSystem, base: str, manifest: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a manifest."""
    with fs.open_input_stream(manifest, compression=None) as f:
        rows = [json.loads(line) for line in f.read().splitlines()]
    return [(f"{base}/{r['name']}", r["bytes"]) for r in rows]


def listed(fs: pafs.FileSystem, base: str) -> list[tuple[str, int]]:
    """(path, bytes) of the archives of a folder, or of one file."""
    info = fs.get_file_info(base)
    if info.is_file:
        return [(info.path, info.size)]
    if known := manifests(fs, base):
        return [f for m in known for f in named(fs, base, m)]
    found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return [(f.path, f.size) for f in found if f.is_file and re.search(r"\.warc(\.gz)?$", f.path)]


class Warc(DataSource):
    """``spark.read.format("warc").schema(...).load(folder)``; ``df.write.format("warc").mode("append").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with its filter pushdown."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


# -- pages as records ------------------------------------------------------------------


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row of ``WRITTEN`` columns for each page.

    Of the pages with equal payloads of at least ``LEAST_REVISIT`` bytes, those with
    the largest id are responses, and the others revisit it.  Groups are counted per
    salt first, and their pages meet their largest id salt by salt, so a group of any size spreads.
    """
    payload = F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("group", F.when(F.col("payload_bytes") >= LEAST_REVISIT, F.sha2("payload", 256)))
    some = F.xxhash64("id", "target_uri", "payload_bytes")  # pages without a group spread by it
    rows = rows.withColumn("salt", F.when(F.col("group").isNotNull(), F.pmod(some, F.lit(SALTS))).otherwise(some))
    salted = rows.where(F.col("group").isNotNull()).groupBy("group", "salt").agg(F.max("id").alias("latest"), F.count("*").alias("n"))
    groups = salted.groupBy("group").agg(F.max("latest").alias("latest"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).where("n > 1")
    known = groups.select("group", "latest", F.explode("salts").alias("salt"))
    told = rows.join(known, ["group", "salt"], "left")
    revisit = F.coalesce(F.col("id") < F.col("latest"), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return told.select(
        urn("id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(revisit, urn("latest")).alias("refers_to"),
        F.sha1("payload").alias("payload_digest"),
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def page_of(urn: str):
    """The page id in a record's name (null if it has none)."""
    return F.expr(f"try_cast(regexp_extract({urn}, r'^<urn:page:(-?[0-9]+)>$', 1) as long)")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write the pages' records into a folder that all executors share."""
    register(pages.sparkSession)
    records(pages, id_col, url_col, html_col).write.format("warc").mode("append").save(folder)


def read(spark: SparkSession, folder: str, columns: str = SCHEMA) -> DataFrame:
    """The records of a folder, with the columns of a schema; what it leaves out is not decoded."""
    register(spark)
    return spark.read.format("warc").schema(columns).load(folder)


def read_pages(spark: SparkSession, folder: str, id_col: str = "page_id") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of each page's record.

    Length and digest of a response are those of the payload read back; it is an error if its header tells another digest.
    """
    rows = read(spark, folder, "record_id string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary")
    rows = rows.where(F.col("record_type").isin("response", "revisit"))
    response = F.col("record_type") == "response"
    found = F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest"))
    checked = F.when(found == F.col("payload_digest"), found).otherwise(F.raise_error(F.concat(F.lit("payload and digest differ: "), F.col("record_id"))))
    return rows.select(
        page_of("record_id").alias(id_col),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        checked.alias("payload_digest"),
        "record_type",
        page_of("refers_to").alias("refers_to"),
    )
