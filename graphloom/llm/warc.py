"""WARC archives as a data source, and pages archived with revisit records for equal payloads.

``spark.read.format("warc")`` plans partitions of whole files of about equal size. A record's headers
are parsed first; filters on its type and other header columns are pushed down, and the payload of a
record they drop, or that is not asked for (option ``payload`` = false), is neither read nor decoded.
Files are compressed record by record, with the record's lengths in the gzip header (``sl``
field), so that a record can be passed over; members without that field, and files without compression, are read too.

``df.write.format("warc")`` takes the columns of the reader. Files are written under a hidden name, and named on commit.

Defined results: a null payload is an empty one. Of pages with equal payloads of at least
``least`` bytes the smallest key is the response, the others revisit it; rows that repeat that
key are responses too. A page without a key is archived without an identifier. Payloads of any length are
kept whole. An empty table gives an empty archive and no rows. Extra columns play no part.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from graphloom.session import broadcast_if_small, ensure_checkpoint_dir

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, content_type string, content_length long, payload binary, file string, offset long"
HEADERS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type",
}
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
#: Payloads shorter than this are always written out.
LEAST_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    local = re.match(r"file:/+(.*)", path)
    if local or "://" not in path:
        return fs.LocalFileSystem(), "/" + local[1] if local else path
    return fs.FileSystem.from_uri(path)


def member(record: bytes) -> bytes:
    """A record as a gzip member whose header holds its compressed and its plain length."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(record) + packer.flush()
    lengths = struct.pack("<2sHII", b"sl", 8, (32 + len(body)) & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(lengths)) + lengths
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _skip_length(head: bytes) -> int:
    """Compressed length of a member by its ``sl`` field; 0 if it has none, or may be longer than the field can say."""
    if len(head) >= 24 and head[3] & 4 and head[12:16] == b"sl\x08\0":
        packed, plain = struct.unpack("<II", head[16:24])
        return packed if plain < 1 << 31 else 0
    return 0


def _headers(text: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in text.split(b"\r\n")[1:])
    return {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, _, v in pairs if k}


class _Source:
    """Plain bytes of a file from an offset on, whether members or not."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()

    def records(self, wanted, with_payload: bool) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
        at = 0
        while at < self.size:
            self.file.seek(at)
            start = self.file.read(4096)
            if start[:2] == b"\x1f\x8b":
                at, record = self._member(at, start, wanted, with_payload)
            else:
                at, record = self._plain(at, start, wanted, with_payload)
            if record:
                yield record

    def _plain(self, at, text, wanted, with_payload):
        while (end := text.find(b"\r\n\r\n")) < 0:
            more = self.file.read(65536)
            if not more:
                return self.size, None
            text += more
        headers = _headers(text[:end])
        length = int(headers.get("content-length") or 0)
        payload = None
        if wanted(headers) and with_payload:
            self.file.seek(at + end + 4)
            payload = self.file.read(length)
        return at + end + 8 + length, (at, headers, payload) if wanted(headers) else None

    def _member(self, at, data, wanted, with_payload):
        skip = _skip_length(data)
        unpack = zlib.decompressobj(zlib.MAX_WBITS | 16)
        text, place = [unpack.decompress(data)], at + len(data)

        def more(most: int = 1 << 20) -> bool:
            nonlocal place
            if unpack.eof:
                return False
            self.file.seek(place)
            data = self.file.read(most)
            place += len(data)
            text.append(unpack.decompress(data))
            return bool(data)

        while b"\r\n\r\n" not in (head := b"".join(text)) and more():
            pass
        end = head.find(b"\r\n\r\n")
        headers = _headers(head[: max(0, end)])
        keep = wanted(headers)
        if skip and not (keep and with_payload):
            return at + skip, (at, headers, None) if keep else None
        while more():
            if not (keep and with_payload):
                text.clear()
        payload = None
        if keep and with_payload:
            length = int(headers.get("content-length") or 0)
            payload = b"".join(text)[end + 4 : end + 4 + length]
        return place - len(unpack.unused_data), (at, headers, payload) if keep else None


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, path = _store(self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        files = [f for f in found if f.type == fs.FileType.File and not re.search(r"(^|/)[._][^/]*$", f.path[len(path) :])]
        out, now, size = [], [], 0
        for f in sorted(files, key=lambda f: (-f.size, f.path)):
            if now and size + f.size > self.most:
                out.append(Files(tuple(now)))
                now, size = [], 0
            now.append(f.path)
            size += f.size
        return [*out, Files(tuple(now))] if now else out or [Files(())]

    def _wanted(self, headers: dict[str, str]) -> bool:
        for f in self.tests:
            value = headers.get(HEADERS[f.attribute[0]])
            if value is None or isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value or isinstance(f, StringStartsWith) and not value.startswith(f.value):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        kinds = [pa.string()] * 7 + [pa.int64(), pa.binary(), pa.string(), pa.int64()]
        names = [field.split()[0] for field in SCHEMA.split(", ")]
        rows, size = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as file:
                for at, headers, payload in _Source(file).records(self._wanted, self.with_payload):
                    rows.append((*(headers.get(h) for h in HEADERS.values()), int(headers.get("content-length") or 0), payload, path, at))
                    size += 200 + len(payload or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


@dataclass
class Written(WriterCommitMessage):
    hidden: str | None
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = _store(self.path)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        hidden = f"{path}/.{name}"
        store.create_dir(path, recursive=True)
        empty = True
        with store.open_output_stream(hidden, compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    block = row.get("payload") or b""
                    lines = ["WARC/1.1", *(f"{h.title().replace('Warc', 'WARC').replace('-Id', '-ID').replace('-Uri', '-URI')}: {row[c]}" for c, h in HEADERS.items() if row.get(c) is not None), f"Content-Length: {len(block)}"]
                    head = "\r\n".join(re.sub(r"[\r\n]+", " ", x) for x in lines).encode("utf-8", "replace")
                    out.write(member(head + b"\r\n\r\n" + block + b"\r\n\r\n"))
                    empty = False
        return Written(None if empty else hidden, f"{path}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        for m in messages:
            if m and m.hidden:
                store.move(m.hidden, m.name)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m and m.hidden:
                store.delete_file(m.hidden)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame, text: str = "html", url: str = "url", key: str = "page_id", least: int = LEAST_REVISIT) -> DataFrame:
    """Rows for the writer, one for each page: responses with their payload, and revisits without."""
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("url"), F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b"")).alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256))
    # Only payloads that occur again are joined, by their digest; payloads themselves are not shuffled while those are few.
    again = rows.where(F.octet_length("body") >= least).groupBy("digest").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull())
    rows = rows.join(broadcast_if_small(again.select("digest", "first")), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("k").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    return rows.select(
        name("k").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit("2000-01-01T00:00:00Z").alias("date"),
        F.when(revisit, name("first")).alias("refers_to"),
        F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.when(revisit, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), F.col("body"))).alias("payload"),
    )


def archive(pages: DataFrame, path: str, **columns) -> None:
    """Writes a record for each page under ``path``."""
    register(pages.sparkSession)
    records(pages, **columns).write.format("warc").mode("append").save(path)


def pages_of(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri`` of archived pages.

    Lengths and digests are those of the bytes read back; a revisit has those of the response it refers to.
    """
    register(spark)
    read = lambda: spark.read.format("warc").load(path)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).cast(kind)
    body = F.substring("payload", F.lit(len(_HTTP) + 1), F.octet_length("payload"))
    full = read().where(F.col("record_type") == "response").select(number("record_id").alias("page_id"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"), "target_uri")
    light = spark.read.format("warc").option("payload", "false").load(path).where(F.col("record_type") == "revisit")
    light = light.select(number("record_id").alias("page_id"), "record_type", number("refers_to").alias("refers_to"), "target_uri", F.substring_index("payload_digest", ":", -1).alias("digest"))
    known = full.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest")).agg(F.min("payload_bytes").alias("payload_bytes"))
    again = light.join(known, ["refers_to", "digest"], "left").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", "target_uri")
    return full.unionByName(again)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Archives ``pages`` in the session's shared folder and reads them back."""
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive(pages, path, **columns)
    return pages_of(spark, path, pages.schema[columns.get("key", "page_id")].dataType.simpleString())
