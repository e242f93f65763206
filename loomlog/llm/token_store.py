"""Token ids in binary files with Elias-Fano coded document boundaries.

The file format is a sequence of segments. A segment holds whole documents in order: the concatenated ids as 16-bit
(or, where an id needs it, 32-bit) little-endian integers, and the documents' ends as an Elias-Fano sequence. Of n
ends up to u, each end's lowest l = floor(log2(u / n)) bits lie packed side by side, and the rest is coded in unary in
a bit vector of n + (u >> l) + 1 bits; every 512th one's place in it is kept, so that ``select(i)`` reads a few bytes
to return the i-th end: about 2 + log2(u / n) bits a document instead of 64.

Segment layout, all little-endian: magic ``LSG1``; u32 documents; u64 ids; u8 bytes per id; u8 l; u32 length in bytes
of the low part, of the high part and of the samples; the three parts; the document ids as i64 with a null bitmap;
the token ids.

Segments are rows of a Parquet table in the shared folder: Spark's commit makes a lost or repeated task harmless, and
any store that Spark can write to will do. Rows are range-partitioned by document id before they are encoded; a task
writes its range's segments, each closed at ``segment_ids`` ids, so no task holds more than one segment and one
document. Where each partition's ids begin in the whole corpus is another Elias-Fano sequence (a few bits for each
partition) that readers get; a document's place is two selects, one there and one in its segment.

Defined results for odd input: a null text is empty, so it has only its end id; a null document id sorts first; rows
that repeat an id are all kept, ordered by text; an empty table gives an empty file table; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import written
from loomlog.llm.tokens import encoder

MAGIC = b"LSG1"
HEAD = struct.Struct("<4sIQBBIII")
SAMPLE = 512
#: The place of the j-th one of a byte.
BIT_OF_BYTE = np.array([([b for b in range(8) if byte >> b & 1] + [0] * 8)[:8] for byte in range(256)], np.int64)


class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n, most = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, int(most // max(n, 1)).bit_length() - 1)
        low = np.packbits(((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> bits) + np.arange(n)
        unary = np.zeros(n + (most >> bits) + 1, np.uint8)
        unary[places] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample, skip bytes by their number of ones, then read the low bits."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, bit = at >> 3, at & 7
        word = int(self.high[byte]) >> bit << bit
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - i
        low = 0
        for j in range(self.low_bits):
            place = i * self.low_bits + j
            low |= (int(self.low[place >> 3]) >> (place & 7) & 1) << j
        return high << self.low_bits | low

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """The values at many places: all of them go on together, from their samples, by words of 64 bits with their
        number of ones, then by bytes, then by a table of the bits of a byte."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.empty(0, np.int64)
        words = np.frombuffer(self.high.tobytes() + bytes(-len(self.high) % 8), "<u8")
        at, left = self.samples[i // SAMPLE].astype(np.int64), i % SAMPLE
        word_at = at >> 6
        word = words[word_at] >> (at & 63).astype(np.uint64) << (at & 63).astype(np.uint64)
        going = np.arange(len(i))
        while len(going):
            ones = np.bitwise_count(word[going])
            going, ones = going[left[going] >= ones], ones[left[going] >= ones]
            left[going] -= ones
            word_at[going] += 1
            word[going] = words[word_at[going]]
        byte = np.zeros(len(i), np.int64)
        for _ in range(7):
            ones = np.bitwise_count(word & np.uint64(255))
            on = left >= ones
            left, word, byte = np.where(on, left - ones, left), np.where(on, word >> np.uint64(8), word), byte + on
            if not on.any():
                break
        places = word_at * 64 + byte * 8 + BIT_OF_BYTE[(word & np.uint64(255)).astype(np.int64), left]
        high = places - i
        if not self.low_bits:
            return high
        packed = np.frombuffer(self.low.tobytes() + bytes(8), np.uint8)
        first = i * self.low_bits
        near = packed[(first >> 3)[:, None] + np.arange(8)].copy().view("<u8").ravel() >> (first & 7).astype(np.uint64)
        return high << self.low_bits | (near & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def __getitem__(self, i: int) -> int:
        return self.select(i)

    @property
    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.samples.nbytes


def write_segment(doc_ids: list[int | None], docs: list[bytes]) -> bytes:
    """``docs``: each document's ids as little-endian unsigned 32-bit integers."""
    ids = np.frombuffer(b"".join(docs), "<u4")
    wide = 2 if not len(ids) or int(ids.max()) < 65536 else 4
    ends = EliasFano.of(np.cumsum([len(x) // 4 for x in docs]))
    low, high, samples = ends.low.tobytes(), ends.high.tobytes(), ends.samples.tobytes()
    keys = np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes()
    nulls = np.packbits(np.array([x is None for x in doc_ids], np.uint8), bitorder="little").tobytes()
    head = HEAD.pack(MAGIC, len(docs), len(ids), wide, ends.low_bits, len(low), len(high), len(samples))
    return b"".join((head, low, high, samples, keys, nulls, ids.astype(f"<u{wide}").tobytes()))


class Segment:
    """Reads a segment; ids are views of the buffer."""

    def __init__(self, blob: bytes) -> None:
        magic, self.n, self.n_ids, wide, bits, low, high, samples = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        part = lambda kind, count, at: np.frombuffer(blob, kind, count, at)
        at = HEAD.size
        self.ends = EliasFano(self.n, bits, part(np.uint8, low, at), part(np.uint8, high, at + low), part("<u4", samples // 4, at + low + high))
        at += low + high + samples
        self.keys, at = part("<i8", self.n, at), at + 8 * self.n
        self.nulls, at = np.unpackbits(part(np.uint8, -(-self.n // 8), at), bitorder="little", count=self.n), at + -(-self.n // 8)
        self.ids = part(f"<u{wide}", self.n_ids, at)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, found by two selects."""
        return self.ids[self.ends[i - 1] if i else 0 : self.ends[i]]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Document id, start within the segment and ids, of each; where they begin and end is selected."""
        ends = self.ends.select_many(np.arange(self.n))
        starts = np.concatenate([[0], ends[:-1]]) if self.n else ends
        for key, null, a, b in zip(self.keys.tolist(), self.nulls.tolist(), starts.tolist(), ends.tolist(), strict=True):
            yield None if null else key, a, self.ids[a:b]


FILE_SCHEMA = "part int, seq int, start long, n_docs int, n_ids long, blob binary"


def write(docs: DataFrame, tokenizer: str, end_id: int, segment_ids: int = 2_000_000, partitions: int | None = None) -> DataFrame:
    """``docs`` (``doc_id, text``) to a table of segments. ``start``: ids of the same partition before the segment."""
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        keys, held, size, seq, start = [], [], 0, 0, 0

        def segment() -> pa.RecordBatch:
            row = {"part": [part], "seq": [seq], "start": [start], "n_docs": [len(held)], "n_ids": [size], "blob": [write_segment(keys, held)]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("blob", pa.binary())]))

        for batch in batches:
            for key, own in zip(batch.column(0).to_pylist(), enc.batch(batch.column(1).to_pylist()), strict=True):
                ids = own + end
                keys.append(key)
                held.append(ids)
                size += len(ids) // 4
                if size >= segment_ids:
                    yield segment()
                    seq, start = seq + 1, start + size
                    keys, held, size = [], [], 0
        if held:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(encode, FILE_SCHEMA), "segments")


def read(files: DataFrame) -> DataFrame:
    """Every document of a table of segments: ``doc_id, start, n_tokens, ids_crc32``, in the whole corpus's positions."""
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one number a partition
    parts = 1 + max(totals, default=-1)
    base = EliasFano.of(np.cumsum([0, *(totals.get(p, 0) for p in range(parts))]))  # where each partition's ids begin
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                first = base.select(part) + start
                rows = [(key, first + at, len(ids), zlib.crc32(ids.astype("<u4"))) for key, at, ids in Segment(blob.as_py()).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return files.select("part", "start", "blob").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
