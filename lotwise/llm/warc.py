"""WARC archives as a Spark data source in Python, for writing and reading.

Writing: each task writes one archive, record by record, each record a gzip member
of its own, so records can be skipped without reading them further. Equal payloads
are stored once: the record with the smallest page_id is a response, the others
revisit it and hold headers only.

Reading: the partitions are whole files, packed up to a number of bytes. Filters on
record type, target and page_id are taken over by the source and tested on the
headers, which are inflated first; the payload of a record that fails, or of any
record when the schema has no payload column, is never inflated: its compressed
bytes are skipped by the length that the header's extra field states.

Each gzip member pair is laid out as ``header member`` and ``payload member``; the
gzip extra field ``WL`` of the header member holds the length of both. Readers that
know nothing of it see ordinary concatenated gzip members.

Defined cases: a null payload is empty; a null URL leaves out the target header;
an empty table gives archives without records; rows that repeat a page_id are
written each, and rows that share the smallest page_id of a payload are all
responses; a null page_id never stands for others and comes back null.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

from lotwise.llm.common import new_path, written

LEAST_REVISIT = 0  # bytes of payload from which equal ones are stored once
PACK_BYTES = 32 << 20
WRITTEN_AT = datetime(2000, 1, 1, tzinfo=timezone.utc)  # so that equal input gives equal archives

RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long,"
    " payload_digest string, payload binary"
)
_FILTERS = {"page_id", "url", "record_type", "refers_to", "payload_digest"}


def _files(path: str):
    """File system and path within it, for any address Arrow knows (local, HDFS, S3 and others)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def gzip_member(data: bytes, extra: bytes = b"") -> bytes:
    """One gzip member, with an extra field if given."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    flags = 4 if extra else 0
    head = b"\x1f\x8b\x08" + bytes([flags]) + b"\0\0\0\0\0\xff"
    if extra:
        head += struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record_bytes(row) -> bytes:
    """A WARC record: header member with the lengths of both members, payload member."""
    payload = b"" if row["record_type"] == "revisit" else bytes(row["payload"] or b"")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}"]
    named = "none" if row["page_id"] is None else str(row["page_id"])
    lines += [f"WARC-Record-ID: <urn:page:{named}>", f"WARC-Date: {WRITTEN_AT:%Y-%m-%dT%H:%M:%SZ}"]
    if row["url"] is not None:
        # A header is one line; bytes that would break it are percent-encoded.
        target = row["url"].replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
        lines.append(f"WARC-Target-URI: {target}")
    if row["refers_to"] is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{row['refers_to']}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    lines.append(f"X-Payload-Length: {row['payload_bytes']}")
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}", "", ""]
    body = gzip_member(payload + b"\r\n\r\n")
    header = "\r\n".join(lines).encode()
    size = len(gzip_member(header, b"WL" + struct.pack("<HII", 8, 0, 0)))
    return gzip_member(header, b"WL" + struct.pack("<HII", 8, size, len(body))) + body


def parse_header(data: bytes) -> dict:
    fields = {}
    for line in data.decode().split("\r\n")[1:]:
        name, colon, value = line.partition(": ")
        if colon:
            fields[name] = value
    page = lambda text: None if text in (None, "<urn:page:none>") else int(text[10:-1])
    target = fields.get("WARC-Target-URI")
    if target is not None:
        target = target.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return {
        "page_id": page(fields["WARC-Record-ID"]),
        "url": target,
        "record_type": fields["WARC-Type"],
        "refers_to": page(fields.get("WARC-Refers-To")),
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
    }


def inflate(member: bytes) -> bytes:
    return zlib.decompress(member, 31)


def records(file, passes, with_payload: bool) -> Iterator[dict]:
    """Records of an open archive whose header passes; payloads of others are skipped."""
    while head := file.read(24):
        # 10 bytes of gzip header, 2 of the extra field's length, then WL, its size and both lengths.
        size, body = struct.unpack_from("<II", head, 16)
        header = parse_header(inflate(head + file.read(size - 24)))
        if with_payload and passes(header) and header["record_type"] != "revisit":
            yield header | {"payload": inflate(file.read(body))[:-4]}
        else:
            file.seek(body, 1)
            if passes(header):
                yield header | {"payload": None}


class Archives(InputPartition):
    def __init__(self, paths: Sequence[str]):
        super().__init__(tuple(paths))
        self.paths = tuple(paths)


class WarcReader(DataSourceReader):
    def __init__(self, schema, path: str):
        self.columns = [field.name for field in schema.fields]
        self.path = path
        self.tests: list[tuple[str, tuple | None]] = []

    def pushFilters(self, filters: list[Filter]):
        for one in filters:
            name = one.attribute[0] if hasattr(one, "attribute") and len(one.attribute) == 1 else None
            if name in _FILTERS and isinstance(one, EqualTo):
                self.tests.append((name, (one.value,)))
            elif name in _FILTERS and isinstance(one, In):
                self.tests.append((name, tuple(one.value)))
            elif name in _FILTERS and isinstance(one, IsNotNull):
                self.tests.append((name, None))
            else:
                yield one  # Spark tests these itself

    def partitions(self):
        from pyarrow import fs

        system, folder = _files(self.path)
        found = [f for f in system.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".warc.gz")]
        packs, size = [[]], 0
        for file in sorted(found, key=lambda f: f.path):
            if packs[-1] and size + file.size > PACK_BYTES:
                packs.append([])
                size = 0
            packs[-1].append(file.path)
            size += file.size
        return [Archives(p) for p in packs if p] or [Archives([])]

    def passes(self, header: dict) -> bool:
        return all(
            header[name] is not None if values is None else header[name] is not None and header[name] in values
            for name, values in self.tests
        )

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        system, _ = _files(self.path)
        kinds = {"payload": pa.binary(), "url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string()}
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array([r[c] for r in rows], kinds.get(c, pa.int64())) for c in self.columns]
            return pa.record_batch(columns, self.columns)

        for path in partition.paths:
            with system.open_input_file(path) as file:
                for record in records(file, self.passes, "payload" in self.columns):
                    rows.append(record)
                    size += 100 + len(record["payload"] or b"")
                    if size > 1 << 22 or len(rows) >= 2000:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class WarcWriter(DataSourceWriter):
    """One archive per task attempt; only archives of successful attempts keep their name."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        system, folder = _files(self.path)
        system.create_dir(folder, recursive=True)
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        with system.open_output_stream(f"{name}.open", compression=None) as file:
            for row in rows:
                file.write(record_bytes(row))
        return Written(name)

    def commit(self, messages) -> None:
        system, folder = _files(self.path)
        for message in messages:
            if message is not None:
                system.move(f"{message.path}.open", f"{message.path}.warc.gz")

    def abort(self, messages) -> None:
        system, _ = _files(self.path)
        for message in messages:
            if message is not None:
                system.delete_file(f"{message.path}.open")


class WarcSource(DataSource):
    """``warc``: archives in a folder; the columns are those of ``RECORD`` or a choice of them."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, self.options["path"])

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records_of(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Pages (page_id, url, html) as records; of equal payloads that with the smallest page_id is the response."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    # Only payloads that occur more than once need to meet.
    groups = (
        rows.filter(F.col("payload_bytes") >= least)
        .groupBy("sha1")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1 AND first IS NOT NULL")
    )
    groups = written(groups.select("sha1", "first"), "warc-copies")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(groups, "sha1", "left").select(
        "page_id",
        "url",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
        "payload_bytes",
        _base32(F.col("sha1")).alias("payload_digest"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def _base32(sha1: F.Column) -> F.Column:
    """Base32 of a 40-digit hexadecimal digest: eight groups of 20 bits, four letters each."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    groups = [F.lpad(F.conv(F.substring(sha1, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), digits, letters)


def write(rows: DataFrame, path: str) -> None:
    register(rows.sparkSession)
    rows.write.format("warc").mode("append").option("path", path).save()


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records of all archives in a folder; without ``payload`` among the columns no payload is inflated."""
    register(spark)
    reader = spark.read.format("warc").option("path", path)
    if columns:
        kinds = dict(f.strip().split() for f in RECORD.split(","))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load()


def round_trip(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Write archives to the shared folder and read them back, payloads included.

    Responses are measured anew from the payload read; revisits, which hold none,
    take what their headers state of the full payload.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(records_of(pages, least), path)
    got = read(spark, path)
    full = F.col("payload").isNotNull()
    return got.select(
        "page_id",
        F.when(full, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(full, _base32(F.sha1("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
