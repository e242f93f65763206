"""Exact top-k inner-product search by vector-approximation files.

Vectors become integers, floor(scale * x). They are packed into blocks of a fixed number of rows; a block carries its
vectors and, apart, an approximation: each component's cell number on a grid of 256 cells between the block's least and
greatest value in that dimension. Candidate blocks are dealt to parts, and the query blocks (the query set is the stated
one) are sent once to each part; both are as narrow integers as hold them. Parts are so few that no more query rows are
sent than there are candidates. A part has its query blocks first, in chunks of at most ``HELD`` bytes, and then meets one
candidate block at a time, so nothing grows with the product of the two tables but the arithmetic, and nothing passes the
driver. For a pair of blocks, one product of the queries with the cell numbers gives an upper bound of every score; exact
vectors are read only where the bound reaches the query's k-th best score of the part so far. What remains of each part,
k rows a query, is merged by a top-k over the parts.

Defined results for odd input: vectors that are null, empty, or hold a null, NaN or infinite component take no part, nor
do rows with a null id. Only vectors of the same length are compared. A candidate with the query's own id is skipped, so
rows that repeat an id are never each other's results; as candidates for others rows that repeat are separate rows, as
queries they are one query each with equal results, returned once. Scores beyond a long are held at its ends. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CELLS = 256
#: Bytes of query vectors (as doubles) that a task holds, and scores that are merged at once.
HELD, MERGED = 1 << 26, 1 << 18
EXACT = 2**53
LONG = 2**63 - 1


def usable(vector: Column) -> Column:
    """Whether all components are there and finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def integers(flat: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(flat * scale)


def narrow(row: dict) -> dict:
    """The row with its vectors in the narrowest type that holds them."""
    x = np.frombuffer(row["vectors"])
    most = np.abs(x).max(initial=0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return row | {"kind": kind, "vectors": x.astype(kind).tobytes()}


def pack(pdf: pd.DataFrame, scale: float) -> dict:
    """A block's row: ids, integer vectors as doubles, and the approximation with its grid."""
    x = integers(np.array(pdf["vector"].tolist(), dtype=np.float64), scale)
    least, most = x.min(axis=0), x.max(axis=0)
    width = np.maximum(np.ceil((most - least + 1) / CELLS), 1.0)
    cells = np.minimum(np.floor((x - least) / width), CELLS - 1).astype(np.uint8)
    return {"ids": pdf["id"].to_numpy(np.int64).tobytes(), "vectors": x.tobytes(), "cells": cells.tobytes(), "least": least.tobytes(), "width": width.tobytes()}


def top_of_pair(ids: np.ndarray, vectors: np.ndarray, cells: np.ndarray, least: np.ndarray, width: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query (query ids, candidate ids, scores): its k best of the block, found by bounds."""
    found = []
    by_cell = (queries * width) @ cells.astype(np.float64).T + (queries @ least)[:, None]
    spread = width - 1.0
    above, below = np.maximum(queries, 0) @ spread, np.minimum(queries, 0) @ spread
    size = np.abs(queries).sum(axis=1) * (np.abs(least).max(initial=0) + CELLS * width.max(initial=1))
    slack = np.where(size < EXACT, 0.0, size * 1e-12)  # what the product of doubles may be off by
    for i in range(len(q_ids)):
        upper, lower = by_cell[i] + above[i] + slack[i], by_cell[i] + below[i] - slack[i]
        other = ids != q_ids[i]
        if not other.any():
            continue
        lower = np.where(other, lower, -np.inf)
        kth = np.partition(lower, len(lower) - k)[-k] if len(lower) > k else -np.inf
        open_ = np.flatnonzero(other & (upper >= kth))
        open_ = open_[np.argsort(-upper[open_], kind="stable")]
        best_ids, best = np.empty(0, np.int64), np.empty(0, np.float64 if size[i] < EXACT else object)
        step, at = 32, 0
        while at < len(open_):
            if len(best) >= k and upper[open_[at]] < best[k - 1]:
                break
            rows = open_[at : at + step]
            at, step = at + step, step * 2
            if size[i] < EXACT:
                score = vectors[rows] @ queries[i]
            else:
                score = np.array([min(max(sum(int(a) * int(b) for a, b in zip(v, queries[i], strict=True)), -LONG - 1), LONG) for v in vectors[rows]], dtype=object)
            best, best_ids = np.concatenate([best, score]), np.concatenate([best_ids, ids[rows]])
            order = np.lexsort((best_ids, -best))[:k] if best.dtype != object else np.array(sorted(range(len(best)), key=lambda j: (-best[j], best_ids[j]))[:k])
            best, best_ids = best[order], best_ids[order]
        found.append((np.full(len(best), q_ids[i]), best_ids, np.array([int(x) for x in best], dtype=np.int64)))
    return found


class Best:
    """The k best of a query block's queries so far: rows ``q, score, id`` in order, and each query's k-th score."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.q, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.least = np.full(len(ids), -np.inf)

    def merge(self, q: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        q, score, id_ = (np.concatenate(x) for x in ((self.q, q), (self.score, score), (self.id, id_)))
        order = np.lexsort((id_, ~score, q))  # highest scores first, a long's ends too
        q, score, id_ = q[order], score[order], id_[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        some, last = rank < self.k, rank == self.k - 1
        self.q, self.score, self.id = q[some], score[some], id_[some]
        self.least[q[last]] = score[last]

    def meet(self, ids: np.ndarray, vectors: np.ndarray, cells: np.ndarray, least: np.ndarray, width: np.ndarray) -> None:
        """Takes what a candidate block has."""
        size = np.abs(self.vectors).sum(axis=1) * (np.abs(least).max(initial=0) + CELLS * width.max(initial=1))
        for i in np.flatnonzero(size >= EXACT).tolist():  # beyond whole doubles: one by one
            for _, id_, score in top_of_pair(ids, vectors, cells, least, width, self.ids[i : i + 1], self.vectors[i : i + 1], self.k):
                self.merge(np.full(len(id_), i), score, id_)
        rows = np.flatnonzero(size < EXACT)
        if not len(rows):
            return
        queries, own = self.vectors[rows], self.ids[rows]
        upper = (queries * width) @ cells.astype(np.float64).T + (queries @ least + np.maximum(queries, 0) @ (width - 1.0))[:, None]
        other = ids != own[:, None]
        new = np.flatnonzero(np.isinf(self.least[rows]))
        floor = self.least[rows]
        if len(new) and len(ids) > self.k:  # no k-th score yet: the k-th lower bound
            lower = np.where(other[new], upper[new] - (np.abs(queries[new]) @ (width - 1.0))[:, None], -np.inf)
            floor[new] = np.partition(lower, len(ids) - self.k, axis=1)[:, -self.k]
        near = other & (upper >= floor[:, None])
        count = np.cumsum(near.sum(axis=1))
        begin = 0
        while begin < len(rows):  # as many queries at once as have few enough candidates, one at least
            end = max(begin + 1, int(np.searchsorted(count, (count[begin - 1] if begin else 0) + MERGED, "right")))
            q, c = np.nonzero(near[begin:end])
            score = np.concatenate([np.einsum("ij,ij->i", queries[begin + q[i : i + MERGED]], vectors[c[i : i + MERGED]]) for i in range(0, len(q), MERGED)] or [np.empty(0)])
            self.merge(rows[begin + q], score.astype(np.int64), ids[c])
            begin = end


def _blocks(rows: DataFrame, size: int, scale: float, dims: bool = True) -> DataFrame:
    """Rows ``id, vector, block`` to packed blocks. A block is a hash slice of about ``size`` rows, so its group is
    bounded; the hash takes the vector too, so that repeated ids do not gather."""

    names = ("dim", "block", "ids", "kind", "vectors", "cells", "least", "width")

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"dim": key[0], "block": key[1]} | narrow(pack(pdf, scale))])[list(names)]

    schema = "dim int, block int, ids binary, kind string, vectors binary, cells binary, least binary, width binary"
    return rows.groupBy("dim", "block").applyInPandas(packed, schema)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, block_rows: int = 4096) -> DataFrame:
    """``candidates`` and ``queries``: ``id long, vector array``. Returns ``query_id, rank, vec_id, score``."""
    rows = candidates.where(F.col("id").isNotNull() & usable(F.col("vector"))).select("id", F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("dim"))
    asked = queries.where(F.col("id").isNotNull() & usable(F.col("vector"))).select("id", F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("dim"))
    n, n_asked, asked_rows = rows.count(), asked.count(), max(1, block_rows // 4)
    counts, asked_blocks = max(1, -(-n // block_rows)), max(1, -(-n_asked // asked_rows))
    parts = min(counts, max(16, n // max(1, n_asked)))
    ordinal = F.pmod(F.xxhash64("id", "vector", F.monotonically_increasing_id()), F.lit(counts)).cast("int")
    blocks = _blocks(rows.withColumn("block", ordinal), block_rows, scale)
    asked = _blocks(asked.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(asked_blocks)).cast("int")), asked_rows, scale)
    a_chunk = F.greatest(F.lit(1), F.floor(F.lit(HELD) / (8 * asked_rows * F.col("dim")))).cast("int")  # query blocks
    data = ("ids", "kind", "vectors", "cells", "least", "width")
    none = F.lit(None).cast("binary")
    asked = asked.select("dim", F.floor(F.col("block") / a_chunk).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("side"), "block", *data[:3], *(none.alias(c) for c in data[3:]))
    chunks = F.sequence(F.lit(0), F.floor(F.lit(asked_blocks - 1) / a_chunk).cast("int"))
    blocks = blocks.select("dim", F.explode(chunks).alias("chunk"), F.pmod("block", F.lit(parts)).alias("part"), F.lit(1).alias("side"), "block", *data)
    place = ("dim", "chunk", "part")
    dealt = blocks.unionByName(asked).repartition(*place).sortWithinPartitions(*place, "side", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Best] = []
        at = None

        def done() -> Iterator[pa.RecordBatch]:
            for best in held:
                if len(best.q):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best.ids[best.q], best.id, best.score)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(len(batch)):
                dim, chunk, part, side, _, ids, kind, vectors, cells, least, width = (c[i].as_py() for c in batch.columns)
                if at != (dim, chunk, part):
                    yield from done()
                    held, at = [], (dim, chunk, part)
                ids, vectors = np.frombuffer(ids, np.int64), np.frombuffer(vectors, kind).reshape(-1, dim).astype(np.float64)
                if not side:
                    held.append(Best(ids, vectors, k))
                    continue
                for best in held:
                    best.meet(ids, vectors, np.frombuffer(cells, np.uint8).reshape(-1, dim), np.frombuffer(least), np.frombuffer(width))
        yield from done()

    local = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
    best_first = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
