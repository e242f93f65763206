"""Best-fit packing of token sequences by a configuration linear program.

Only lengths matter, so the program is solved over their histogram (at most ``capacity`` numbers, whatever the corpus).
A configuration is a multiset of lengths that fits into a sequence; the program asks for the fewest configurations, in
fractions, that cover every length of the histogram, full pieces and the shortest ones too. Multiplicative weights solve
it: a length's weight is its share of a sequence (the dual price that is always feasible) times a factor that falls
exponentially with the part of it that is covered. The pricing step finds the configuration of greatest weight by
knapsack dynamic programming over capacities, among the long end and a random choice of lengths that favours heavy ones
(so a step costs the same for any histogram), and uses it until one of its lengths has had its next share. Every step
ends a share of a length, so the number of steps is at most ``shares`` times the number of lengths, and the solution
covers each length exactly.

Rounding goes over the whole solution, greatest parts first, each to the nearest whole number that the pieces left
allow. Only what rounding loses is packed best-fit decreasing, by counts, into the rooms that configurations leave and
into new sequences. The solution is rounded at a few scales near 1, and the fewest sequences win; ``Solution.share`` says
which part of the sequences the program opened. The plan is a table of slots: the j-th piece of a length has its sequence
and offset by arithmetic.

Pieces get their number among those of their length without a large group: each task numbers its own, and a prefix sum
over (length, task) counts gives each task's first number. The numbered pieces are written to the shared folder once,
so that the numbers hold for every later read.

Defined results for odd input: a null text is empty and has one token, the separator; a null id is kept; rows that
repeat are packed each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomlog.llm.common import written
from loomlog.llm.tokens import encoder

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def knapsack(lengths: list[int], values: list[float], copies: list[int], capacity: int) -> Counter:
    """The multiset of greatest value within ``capacity``, by dynamic programming over capacities. Copies of a length
    are bounded; each is split into 1, 2, 4, ... at a time."""
    best = np.zeros(capacity + 1)
    items, took = [], []
    for length, value, most in zip(lengths, values, copies, strict=True):
        k, left = 1, min(most, capacity // length)
        while left > 0:
            n = min(k, left)
            left, k = left - n, k * 2
            w = n * length
            other = best[: capacity + 1 - w] + n * value
            better = other > best[w:]
            best[w:] = np.where(better, other, best[w:])
            items.append((length, n, w))
            took.append(better)
    at, found = int(np.argmax(best)), Counter()
    for (length, n, w), better in zip(reversed(items), reversed(took), strict=True):
        if at >= w and better[at - w]:
            found[length] += n
            at -= w
    return found


def program(hist: np.ndarray, capacity: int, shares: int = 2, rate: float = 0.5, block: int = 96, bias: float = 1.02) -> dict[Pattern, float]:
    """The fractional solution: configurations and how often each is used; together they hold every length as often as
    ``hist``. ``bias``: a power by which long pieces count for more, so that short ones are left to fill the last."""
    need = hist.astype(float)
    used: dict[Pattern, float] = defaultdict(float)
    if need[capacity]:
        used[((capacity, 1),)] = float(need[capacity])
    left = need.copy()
    left[capacity] = 0
    price = (np.arange(capacity + 1) / capacity) ** bias
    chance = np.random.default_rng(0)
    while len(live := np.flatnonzero(left)):
        covered = 1 - left[live] / need[live]
        weight = dict(zip(live.tolist(), (price[live] * np.exp(-rate * covered)).tolist(), strict=True))
        if len(live) > block:
            score = np.exp(-rate * covered) * np.sqrt(chance.random(len(live)))
            live = np.union1d(live[np.argpartition(-score, block)[:block]], live[-1:])
        lengths = live[::-1].tolist()
        found = knapsack(lengths, [weight[x] for x in lengths], [max(1, int(left[x])) for x in lengths], capacity)
        step = min(min(left[x], need[x] / shares) / k for x, k in found.items())
        for x, k in found.items():
            left[x] -= step * k
            if left[x] < 1e-9 * need[x]:
                left[x] = 0
        used[tuple(sorted(found.items(), reverse=True))] += step
    return used


class Rooms:
    """Kinds of sequences by the room they have left."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.by_free: dict[int, Counter] = defaultdict(Counter)
        self.free: list[int] = []

    def put(self, room: int, pattern: Pattern, n: int) -> None:
        if not self.by_free[room]:
            bisect.insort(self.free, room)
        self.by_free[room][pattern] += n

    def best_fit(self, hist: np.ndarray) -> Counter:
        """Packs ``hist`` best-fit decreasing, a length at a time; returns all kinds with how many of each."""
        capacity, free = self.capacity, self.free
        for length in np.flatnonzero(hist)[::-1].tolist():
            left = int(hist[length])
            while left:
                i = bisect.bisect_left(free, length)
                if i == len(free):
                    each = min(capacity // length, left)
                    n = left // each
                    self.put(capacity - each * length, ((length, each),), n)
                    left -= n * each
                    continue
                kind = self.by_free[room := free[i]]
                pattern, n = next(iter(kind.items()))
                each = min(room // length, left)
                use = min(n, left // each)
                if use == n:
                    del kind[pattern]
                    if not kind:
                        free.pop(i)
                else:
                    kind[pattern] -= use
                self.put(room - each * length, (*pattern, (length, each)), use)
                left -= use * each
        out: Counter = Counter()
        for kind in self.by_free.values():
            out.update(kind)
        return out


@dataclass
class Solution:
    """``kinds``: kinds of sequences with how many of each. ``value``: the program's. ``opened``: how many sequences are
    configurations of the program; best fit opened the others."""

    kinds: list[tuple[Pattern, int]]
    value: float
    opened: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.kinds)

    @property
    def share(self) -> float:
        return self.opened / self.sequences if self.kinds else 1.0


def rounded(hist: np.ndarray, capacity: int, used: dict[Pattern, float], scale: float) -> Solution:
    """The solution times ``scale`` in whole numbers; what that leaves is packed by best fit."""
    left, rooms, opened = hist.astype(np.int64).copy(), Rooms(capacity), 0
    for pattern, times in sorted(used.items(), key=lambda y: (-y[1], y[0])):
        n = min(int(times * (1.0 if pattern[0][0] == capacity else scale) + 0.5), *(int(left[x]) // k for x, k in pattern))
        if n > 0:
            for x, k in pattern:
                left[x] -= n * k
            rooms.put(capacity - sum(x * k for x, k in pattern), pattern, n)
            opened += n
    return Solution(sorted(rooms.best_fit(left).items(), reverse=True), sum(used.values()), opened)


def solve(hist: np.ndarray, capacity: int, scales: tuple[float, ...] = (1.0, 0.97, 0.94, 0.9), **how: float) -> Solution:
    """``hist[l]``: pieces of length l, 1 to capacity. The kinds of sequences hold every piece once."""
    used = program(hist, capacity, **how)
    return min((rounded(hist, capacity, used, scale) for scale in scales), key=lambda s: s.sequences)  # the first of the fewest


class Slots:
    """Where the j-th piece of a length goes. Its size is bounded by the number of configurations."""

    def __init__(self, kinds: list[tuple[Pattern, int]]) -> None:
        first, rows = 0, defaultdict(list)
        used: Counter = Counter()
        for pattern, n in kinds:
            at = 0
            for length, each in pattern:
                rows[length].append((used[length], each, first, at))
                used[length] += each * n
                at += length * each
            first += n
        self.rows = {length: np.array(x, dtype=np.int64).T for length, x in rows.items()}
        self.sequences = first

    def place(self, length: int, ordinal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence numbers and offsets."""
        start, each, first, at = self.rows[length]
        i = np.searchsorted(start, ordinal, side="right") - 1
        n, k = np.divmod(ordinal - start[i], each[i])
        return first[i] + n, at[i] + k * length


def pieces(docs: DataFrame, tokenizer: str, separator: int, capacity: int) -> DataFrame:
    """Every document cut into pieces of at most ``capacity`` tokens, numbered by ``nth`` among those of the same
    length of the same task ``part``."""
    end = struct.pack("<I", separator)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, seen = TaskContext.get().partitionId(), encoder(tokenizer), [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for key, own in zip(batch.column(0).to_pylist(), enc.batch(batch.column(1).to_pylist()), strict=True):
                ids = memoryview(own + end)
                for i in range(0, len(ids), 4 * capacity):
                    cut_ = ids[i : i + 4 * capacity]
                    n = len(cut_) // 4
                    rows.append((key, i // (4 * capacity), i // 4, n, zlib.crc32(cut_), part, seen[n]))
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(rows: DataFrame, capacity: int, **solver: float) -> DataFrame:
    """``rows`` with ``length, part, nth`` (a written table) plus ``sequence_id, offset``. Other columns are kept."""
    spark = rows.sparkSession
    counts = written(rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    hist = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        hist[r["length"]] = r["n"]
    slots = spark.sparkContext.broadcast(Slots(solve(hist, capacity, **solver).kinds))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    numbered = rows.join(bases, ["part", "length"])
    kept = [c for c in rows.columns if c not in ("part", "nth")]
    numbered = numbered.select(*kept, (F.col("_base") + F.col("nth")).alias("_ordinal"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, ordinal = batch.column(batch.schema.get_field_index("length")).to_numpy(), batch.column(batch.schema.get_field_index("_ordinal")).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, edges) if len(order) else []:
                sequence[own], offset[own] = slots.value.place(int(length[own[0]]), ordinal[own])
            columns = [batch.column(i) for i in range(len(kept))] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    return numbered.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, separator: int = 0, capacity: int = 2048) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every document."""
    return pack(written(pieces(docs, tokenizer, separator, capacity), "pieces"), capacity)
