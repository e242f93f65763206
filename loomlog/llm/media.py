"""Media columns in archive files, by a custom Spark data source.

``loomlog_archive`` writes and reads a directory of archives. An archive holds members one after another; a member is a
small header (magic, key, original length, media length, crc32 of the media) and its media. The archive's end lists the
members' offsets. Each writing task streams its Arrow batches into one archive of its own name; the commit lists the
archives of the tasks that succeeded in a manifest, so what a lost or repeated task left is never read.

Reading plans partitions as byte ranges over the archives in the manifest: a range holds the members that begin in it.
A member is fetched by its offset alone, its header and checksum are verified, and a member that fails is fetched again
by itself, a few times, before the task fails. Members go to Spark in Arrow batches of bounded size. Paths are URIs of
any file system that pyarrow opens (local or mounted, HDFS, object stores).

Here a member's media is a PNG of 8-bit grey samples, 576 a row: a text's UTF-8 bytes, filled up with bytes 255.

Defined results for odd input: a null or empty text gives one row of 576 bytes 255, and 0 bytes unpadded; null ids are
kept; rows that repeat are stored each; an empty table gives an empty archive directory and no rows; other columns are
not read. Texts are whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from loomlog.llm.common import fresh_path

ROW = 576
MEMBER = struct.Struct("<4sBqqqI")  # magic, whether the key is null, key, original length, media length, crc32
MAGIC, TAIL = b"LMEM", struct.Struct("<QQ4s")
#: The signature and chunk names of PNG files.
PNG, IHDR, IDAT, IEND = b"\x89PNG\r\n\x1a\n", b"IHDR", b"IDAT", b"IEND"
SCHEMA = "doc_id long, n_bytes long, media binary"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _chunk(name: bytes, data: bytes) -> bytes:
    return b"".join((struct.pack(">I", len(data)), name, data, struct.pack(">I", zlib.crc32(data, zlib.crc32(name)))))


def padded(raw: bytes) -> bytes:
    size = max(1, -(-len(raw) // ROW)) * ROW
    return raw + b"\xff" * (size - len(raw))


def to_png(samples: bytes, width: int = ROW, level: int = 1) -> bytes:
    """A grey image of 8-bit samples, rows unfiltered. Equal samples give equal bytes."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return b"".join((PNG, _chunk(IHDR, head), _chunk(IDAT, zlib.compress(lines, level)), _chunk(IEND, b"")))


def from_png(media: bytes) -> bytes:
    """The samples of an image as ``to_png`` makes it; every chunk's checksum is verified."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, data, width = 8, [], 0
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        name, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(name)):
            raise ValueError("damaged PNG")
        if name == IHDR:
            (width,) = struct.unpack_from(">I", body)
        elif name == IDAT:
            data.append(body)
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return lines[:, 1:].tobytes()


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    members: int


@dataclass
class Range(InputPartition):
    name: str
    size: int
    begin: int
    end: int


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, uri: str) -> None:
        self.uri = uri

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = opened(self.uri)
        store.create_dir(path, recursive=True)
        name, at, offsets = f"{uuid.uuid4().hex}.arc", 0, []
        with store.open_output_stream(f"{path}/{name}") as out:
            for batch in iterator:
                for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    raw = text.as_py().encode("utf-8", "surrogatepass")
                    media = to_png(padded(raw))
                    out.write(MEMBER.pack(MAGIC, key is None, key or 0, len(raw), len(media), zlib.crc32(media)))
                    out.write(media)
                    offsets.append(at)
                    at += MEMBER.size + len(media)
            out.write(np.array(offsets, "<u8").tobytes())
            out.write(TAIL.pack(at, len(offsets), MAGIC))
        return Written(name, at, len(offsets))

    def commit(self, messages: list[Written | None]) -> None:
        store, path = opened(self.uri)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/manifest.json") as out:
            out.write(json.dumps([[m.name, m.size] for m in messages if m and m.members]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, path = opened(self.uri)
        for m in messages:
            if m:
                store.delete_file(f"{path}/{m.name}")


class ArchiveReader(DataSourceReader):
    TRIES = 4

    def __init__(self, uri: str, range_bytes: int, batch_bytes: int) -> None:
        self.uri, self.range_bytes, self.batch_bytes = uri, range_bytes, batch_bytes

    def partitions(self) -> list[Range]:
        store, path = opened(self.uri)
        with store.open_input_file(f"{path}/manifest.json") as f:
            archives = json.loads(f.read())
        found = [Range(name, size, at, min(at + self.range_bytes, size)) for name, size in archives for at in range(0, size, self.range_bytes)]
        return found or [Range("", 0, 0, 0)]

    @staticmethod
    def member(f: pa.NativeFile, offset: int) -> tuple[int | None, int, bytes]:
        magic, null, key, n_bytes, size, crc = MEMBER.unpack(f.read_at(MEMBER.size, offset))
        media = f.read_at(size, offset + MEMBER.size)
        if magic != MAGIC or len(media) != size or zlib.crc32(media) != crc:
            raise OSError(f"damaged member at {offset}")
        return None if null else key, n_bytes, media

    def fetched(self, store: fs.FileSystem, path: str, f: pa.NativeFile, offset: int) -> tuple[int | None, int, bytes]:
        """One member, tried again by itself from a newly opened file."""
        for k in range(self.TRIES):
            try:
                if k == 0:
                    return self.member(f, offset)
                with store.open_input_file(path) as again:
                    return self.member(again, offset)
            except (OSError, struct.error):
                if k == self.TRIES - 1:
                    raise
                time.sleep(0.2 * 2**k)
        raise AssertionError

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, path = opened(self.uri)
        path = f"{path}/{partition.name}"
        with store.open_input_file(path) as f:
            at, n, magic = TAIL.unpack(f.read_at(TAIL.size, f.size() - TAIL.size))
            if magic != MAGIC:
                raise OSError("not an archive")
            offsets = np.frombuffer(f.read_at(8 * n, at), "<u8")
            own, size = [], 0
            for offset in offsets[np.searchsorted(offsets, partition.begin) : np.searchsorted(offsets, partition.end)].tolist():
                own.append(self.fetched(store, path, f, offset))
                size += len(own[-1][2])
                if size >= self.batch_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*own, strict=True), ARROW.types, strict=True)], schema=ARROW)
                    own, size = [], 0
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*own, strict=True), ARROW.types, strict=True)], schema=ARROW)


class ArchiveSource(DataSource):
    """``path``: the directory's URI. ``range_bytes``, ``batch_bytes``: sizes of partitions and of Arrow batches."""

    @classmethod
    def name(cls) -> str:
        return "loomlog_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", 16 << 20)), int(self.options.get("batch_bytes", 4 << 20)))

    def writer(self, schema: object, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def write(docs: DataFrame, uri: str) -> None:
    """``docs`` (``doc_id, text``) as media members of a directory of archives."""
    docs.sparkSession.dataSource.register(ArchiveSource)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows.write.format("loomlog_archive").mode("append").option("path", uri).save()


def read(spark: SparkSession, uri: str, **options: int) -> DataFrame:
    """``doc_id, n_bytes, media`` of every member."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("loomlog_archive").options(path=uri, **options).load()


def described(samples: np.ndarray) -> str:
    """Features of an image: its rows, the mean and variance of its samples, how often neighbours differ by more than
    32, and the commonest sample. Whole numbers and four places, so equal samples give equal features."""
    x = samples.astype(np.int64)
    n, total, squares = len(x), int(x.sum()), int((x * x).sum())
    counts = np.bincount(samples, minlength=256)
    edges = int((np.abs(np.diff(samples.astype(np.int16))) > 32).sum())
    mean = total / n
    return f"rows={n // ROW};mean={mean:.4f};var={squares / n - mean * mean:.4f};edges={edges};mode={int(counts.argmax())}"


def features(members: DataFrame) -> DataFrame:
    """From stored media: checksums of the payload and of the media, and the image's features."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, n_bytes, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                media = media.as_py()
                payload = from_png(media)
                rows.append((key, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), described(np.frombuffer(payload, np.uint8))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return members.mapInArrow(describe, out)


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores every text of ``docs`` as media in the shared folder, reads the media back, and describes them."""
    spark = docs.sparkSession
    uri = fresh_path(spark, "media")
    write(docs, uri)
    return features(read(spark, uri))
