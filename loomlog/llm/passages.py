"""Passages that repeat across documents, exactly or nearly, by collinear chaining of shared seeds.

* Seeds: hashes of ``K`` successive words, chosen by winnowing, the least hash of every ``WINDOW`` successive ones, so
  any run of ``K + WINDOW - 1`` equal words has a common seed, and a text gives about two seeds for ``WINDOW`` words.
* A seed's occurrence in the document of least id stands for all others, so a passage that a million documents share
  gives a million matches, not pairs. Occurrences are sorted by seed, so the representative comes first; those of the
  most frequent seeds are spread over tasks, and look their representatives up where they are chained.
* A document with the same text as an earlier one is one passage as a whole, and gives no seeds.
* Chains: the matches of a document with one representative document are chained in both texts' order. The best chain
  that ends at each match is found in n log n with a Fenwick tree of prefix maxima: a match weighs ``WEIGHT``, a gap
  costs ``GAP_COST`` for each word of either text. Matches over ``MAX_GAP`` words apart in the document are chained
  apart. Chains are cut where a gap is over ``MAX_GAP`` words, and at
  multiples of ``BLOCK`` words of the representative, so that texts can be fetched by blocks. Matches outside the
  spans of the parts make further chains, down to single matches; of these, those inside a longer chain of the same
  document, with whatever source, add nothing to what that one covers, and go.
* Alignment: each chain's windows of words meet (a document's by its own text; a representative's as blocks that are
  sent once each, to the one task that aligns all chains with them; a block that over ``CROWD`` chains want is sent
  several times) and are aligned: gaps between seeds by edit distance, ends by extension as long as more agrees than
  differs, for at most ``REACH`` words; single matches, of which there are most, many at once by array operations, for
  at most ``NEAR`` words to either side. A piece of too little identity is split at its differing words into the spans
  that have enough. Spans that lie side by side become one passage, by the same split.

A passage has at least ``min_words`` words of which at least ``min_identity`` are the same in both texts.

Defined results for odd input: null and empty texts, and those shorter than a seed, have no passages; rows with a null
id take no part; rows that repeat an id are one document (their matches are pooled); repetition inside one document is
not reported; texts are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import temporary, written

K, WINDOW, WEIGHT, GAP_COST, MAX_GAP, BLOCK, MARGIN, REACH, NEAR = 5, 6, 16.0, 0.25, 48, 256, 64, 96, 60
#: Frequent seeds whose occurrences are spread over ``SALTS`` tasks, and chains of a block that one task aligns.
HOT, SALTS, CROWD = 4096, 64, 1024
#: Copies of whole texts whose ids are sent to all tasks; more are joined.
SMALL = 1_000_000
SPLIT = re.compile(r"\S+")


class Words(dict):
    """A 32-bit hash of each word that was asked for, without the marks around it."""

    def __missing__(self, word: str) -> int:
        self[word] = out = zlib.crc32((word.strip(".,;:!?\"'()[]") or word).encode("utf-8", "surrogatepass"))
        return out


def word_hashes(text: str, known: Words) -> np.ndarray:
    """A hash of each lower-cased word between white space."""
    if len(known) > 150_000:
        known.clear()
    words = text.lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of a text's seeds."""
    h, at, _ = many_seeds([words])
    return h, at


def many_seeds(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and places of the seeds of many texts, in order, and the number of each one's text."""
    size = np.array([len(t) for t in texts])
    begin, words = np.cumsum(size) - size, np.concatenate(texts)
    n = len(words) - K + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(K):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n] + np.uint64(1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    at, windows = np.empty(0, np.int64), n - WINDOW + 1
    if windows > 0:
        least = h[:windows]
        for j in range(1, WINDOW):
            least = np.minimum(least, h[j : j + windows])
        at = np.arange(windows)
        for j in reversed(range(WINDOW)):  # the first of equal ones is taken
            at = np.where(h[j : j + windows] == least, np.arange(j, j + windows), at)
        end = np.repeat(begin + size, size)[:windows]
        at = at[np.arange(windows) + WINDOW + K - 1 <= end]  # windows within one text
        at = at[np.diff(at, prepend=-1) > 0]
    short = np.flatnonzero((size >= K) & (size < WINDOW + K - 1))  # less than a window: one seed
    if len(short):
        own = [begin[i] + h[begin[i] : begin[i] + size[i] - K + 1].argmin() for i in short.tolist()]
        at = np.sort(np.concatenate([at, own]))
    which = np.repeat(np.arange(len(texts)), size)[at]
    return h[at].view(np.int64), (at - begin[which]).astype(np.int32), which


def best_chains(a: np.ndarray, b: np.ndarray) -> tuple[list[float], list[int]]:
    """For each match (places ``a``, ascending, and ``b``) the score of the best chain that ends there, and the match
    before it in that chain (-1: none)."""
    n = len(a)
    rank = np.unique(b, return_inverse=True)[1] + 1
    size = int(rank.max())
    tree_value, tree_index = [-1e18] * (size + 1), [-1] * (size + 1)
    score, parent = [0.0] * n, [-1] * n
    pa_, pb, ranks, i = a.tolist(), b.tolist(), rank.tolist(), 0
    while i < n:
        j = i
        while j < n and pa_[j] == pa_[i]:  # matches at one place of the text don't follow each other
            r, best, at = ranks[j] - 1, -1e18, -1
            while r > 0:
                if tree_value[r] > best:
                    best, at = tree_value[r], tree_index[r]
                r -= r & -r
            gain = best - GAP_COST * (pa_[j] + pb[j])
            score[j], parent[j] = (WEIGHT + gain, at) if gain > 0 else (WEIGHT, -1)
            j += 1
        for m in range(i, j):
            value, r = score[m] + GAP_COST * (pa_[m] + pb[m]), ranks[m]
            while r <= size:
                if value > tree_value[r]:
                    tree_value[r], tree_index[r] = value, m
                r += r & -r
        i = j
    return score, parent


def best_chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which matches the chain of greatest score has."""
    score, parent = best_chains(a, b)
    out, m = [], int(np.argmax(score))
    while m >= 0:
        out.append(m)
        m = parent[m]
    return np.array(out[::-1])


def chains(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of chains, best chains first, until no match is left; chains are cut at long gaps and at the
    representative's blocks first, and only matches inside a part's span are taken as found with it."""
    n = len(a)
    if n == 1 or (b[1:] > b[:-1]).all() and (a[1:] > a[:-1]).all():
        score, parent = range(n), range(-1, n - 1)
    else:
        score, parent = best_chains(a, b)
    left = np.ones(n, bool)
    for m in np.argsort(-np.asarray(score), kind="stable").tolist():
        own = []
        while m >= 0 and left[m]:
            own.append(m)
            m = parent[m]
        if not own:
            continue
        x, y = a[own[::-1]], b[own[::-1]]
        cut = (np.diff(x) > MAX_GAP) | (np.diff(y) > MAX_GAP) | (np.diff(y // BLOCK) > 0)
        for part in np.split(np.arange(len(x)), np.flatnonzero(cut) + 1):
            yield x[part], y[part]
            left[np.searchsorted(a, x[part[0]]) : np.searchsorted(a, x[part[-1]], "right")] = False


def _gap(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each word of a short run the place of its equal in another, or -1, by an alignment with most in common."""
    out = np.full(len(u), -1)
    if not len(u) or not len(v):
        return out
    if len(u) == len(v):
        same = np.flatnonzero(u == v)
        if len(same) * 2 >= len(u):
            out[same] = same
            return out
    rows = np.zeros((len(u) + 1, len(v) + 1), np.int64)
    for i, x in enumerate(u):  # longest common subsequence, a row at a time
        rows[i + 1, 1:] = np.maximum.accumulate(np.maximum(rows[i, 1:], rows[i, :-1] + (v == x)))
    i, j = len(u), len(v)
    if rows[i, j]:
        table = rows.tolist()
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out[i] = j
    return out


def _extend(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """How far two runs agree from their start: for each word of the first as far as that, the place of its equal in the
    second, or -1. A word more or less on one side is followed; extension ends where too much differs."""
    i = j = 0
    best, score, end, runs = 0.0, 0.0, 0, []
    while i < len(u) and j < len(v):
        if u[i] == v[j]:
            n = min(len(u) - i, len(v) - j)
            differs = np.flatnonzero(u[i : i + n] != v[j : j + n])
            run = int(differs[0]) if len(differs) else n
            runs.append((i, j, run))
            i, j, score = i + run, j + run, score + run
            if score > best:
                best, end = score, i
            continue
        score -= 2
        if score < best - 8:
            break
        for di, dj in ((1, 1), (1, 0), (0, 1), (2, 2)):
            if i + di + 1 < len(u) and j + dj + 1 < len(v) and (u[i + di : i + di + 2] == v[j + dj : j + dj + 2]).all():
                i, j = i + di, j + dj
                break
        else:
            i, j = i + 1, j + 1
    out = np.full(end, -1)
    for i, j, run in runs:
        if i < end:
            out[i : i + run] = np.arange(j, j + run)
    return out


def extend_many(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_extend`` for many pairs of runs at once, a row each: how far each agrees, and for each word the place of its
    equal or -1. Rows are filled up with values that equal nothing on the other side."""
    n, width = u.shape
    u = np.concatenate([u, np.full((n, 3), -1, u.dtype)], axis=1)
    v = np.concatenate([v, np.full((n, 3), -2, v.dtype)], axis=1)
    places, ends = np.full((n, width), -1, np.int32), np.zeros(n, np.int64)
    rows = np.arange(n)
    i, j, score, best = (np.zeros(n, np.int64) for _ in range(4))
    while len(rows):

        def agree(di: int, dj: int) -> np.ndarray:
            return (u[rows, i + di] == v[rows, j + dj]) & (u[rows, i + di + 1] == v[rows, j + dj + 1])

        same = u[rows, i] == v[rows, j]
        places[rows[same], i[same]] = j[same]
        score = score + np.where(same, 1, -2)
        further = score > best
        best = np.maximum(best, score)
        ends[rows[further]] = i[further] + 1
        open_ = ~same & ~agree(1, 1)
        more = open_ & agree(1, 0)
        open_ &= ~more
        less = open_ & agree(0, 1)
        two = open_ & ~less & agree(2, 2)
        i, j = i + np.where(less, 0, 1 + two), j + np.where(more, 0, 1 + two)
        go = (score >= best - 8) & (i < width) & (j < width)
        rows, i, j, score, best = rows[go], i[go], j[go], score[go], best[go]
    places[np.arange(width) >= ends[:, None]] = -1
    return ends, places


def align_single(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For many single matches, a row of ``NEAR`` words, the seed and ``NEAR`` words each: how many words the span has
    before the seed, how many after it, and for each word its equal's place in the other row, or -1."""
    left, x = extend_many(u[:, NEAR - 1 :: -1], v[:, NEAR - 1 :: -1])
    right, y = extend_many(u[:, NEAR + K :], v[:, NEAR + K :])
    seed = np.broadcast_to(np.arange(NEAR, NEAR + K, dtype=np.int32), (len(u), K))
    return left, right, np.concatenate([np.where(x < 0, -1, NEAR - 1 - x)[:, ::-1], seed, np.where(y < 0, -1, NEAR + K + y)], axis=1)


def align(words: np.ndarray, source: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray]:
    """Where a chain's span begins in the document's window, and for each word of the span the place of its equal in
    the source's window, or -1; ``a`` and ``b`` are the places of the chain's seeds in the windows."""
    left = _extend(words[: a[0]][::-1], source[: b[0]][::-1])
    right = _extend(words[a[-1] + K :], source[b[-1] + K :])
    lo, end = int(a[0]) - len(left), int(a[-1]) + K
    out = np.full(end + len(right) - lo, -1)
    out[: len(left)] = np.where(left < 0, -1, b[0] - 1 - left)[::-1]
    out[end - lo :] = np.where(right < 0, -1, b[-1] + K + right)
    run = end - int(a[0])
    if run == int(b[-1]) + K - b[0] and (words[a[0] : end] == source[b[0] : b[0] + run]).all():
        out[a[0] - lo : end - lo] = np.arange(b[0], b[0] + run)
        return lo, out
    x = y = -1
    for p, q in zip(a.tolist(), b.tolist(), strict=True):
        if x >= 0 and p > x and q > y:
            found = _gap(words[x:p], source[y:q])
            out[x - lo : p - lo] = np.where(found < 0, -1, y + found)
        new = max(0, x - p, y - q)  # overlapping seeds: what is new in both
        out[p + new - lo : p + K - lo] = np.arange(q + new, q + K)
        x, y = p + K, q + K
    return lo, out


def similar(equal: np.ndarray, min_identity: float, least: int) -> list[tuple[int, int]]:
    """Spans of at least ``least`` words of which at least ``min_identity`` are ``equal``: all of it, or else the longest
    such span and those beside it. Spans begin and end with equal words."""
    out, todo = [], [(0, len(equal))]
    while todo:
        lo, hi = todo.pop()
        at = np.flatnonzero(equal[lo:hi])
        if not len(at) or at[-1] - at[0] + 1 < least:
            continue
        lo, hi = lo + int(at[0]), lo + int(at[-1]) + 1
        if len(at) >= min_identity * (hi - lo) - 1e-6:
            out.append((lo, hi))
            continue
        sums = np.concatenate([[0.0], np.cumsum(equal[lo:hi] - min_identity)])
        begin = np.searchsorted(-np.minimum.accumulate(sums), -sums - 1e-6)  # the first place from where the mean is enough
        length = np.arange(len(sums)) - begin
        j = int(length.argmax())
        i = int(begin[j])
        own = np.flatnonzero(equal[lo + i : lo + j])
        x, y = lo + i + int(own[0]), lo + i + int(own[-1]) + 1
        if y - x >= least:
            out.append((x, y))
        todo += [(lo, x), (y, hi)]
    return sorted(out)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def copies(docs: DataFrame) -> DataFrame:
    """``_id, _first``: documents whose whole text an earlier one has (two 64-bit hashes), and the earliest of these. Ids
    that rows repeat are left out."""
    marked = _texts(docs).select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    once = marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("h").alias("h"), F.first("g").alias("g")).where("n = 1")
    once = written(once.select(F.col("doc_id").alias("_id"), "h", "g"), "texts")
    first = once.groupBy(F.col("h").alias("_h"), F.col("g").alias("_g")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = once.join(first, (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g"))).where("_id != _first")
    return written(found.select("_id", "_first"), "copies")


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, pa.int32()))


def seeded(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """``seed, salt, doc_id, pos``: every seed of every text; ``salt`` is zero but for seeds that are in ``hot``."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            keys, texts, n = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(key)
                texts.append(word_hashes(text.as_py(), known))
                n += len(texts[-1])
                if n > 100_000:
                    yield joined(keys, texts)
                    keys, texts, n = [], [], 0
            if keys:
                yield joined(keys, texts)

    def joined(keys: list[int], texts: list[np.ndarray]) -> pa.RecordBatch:
        seed, at, which = many_seeds(texts)
        key = np.array(keys, np.int64)[which]
        spread = hot[np.minimum(np.searchsorted(hot, seed), len(hot) - 1)] == seed if len(hot) else np.zeros(len(seed), bool)
        salt = np.where(spread, 1 + key % SALTS, 0).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (seed, salt, key, at)], names=["seed", "salt", "doc_id", "pos"])

    return _texts(docs).mapInArrow(found, "seed long, salt int, doc_id long, pos int")


def hot_seeds(docs: DataFrame) -> np.ndarray:
    """Seeds that many documents have, at most ``HOT``, by one text in 256. They decide only which rows are spread over
    tasks, not what is found; any other seed has less than one in ``HOT`` of what the frequent ones have."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(256)) == 0)
    often = seeded(some, np.empty(0, np.int64)).groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n >= 8")
    return np.array(sorted(r["seed"] for r in often.orderBy(F.desc("n"), "seed").limit(HOT).collect()), np.int64)


def matches(docs: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``doc_id, pos, source, source_pos``: occurrences of seeds with their representatives in other documents. Each
    seed's occurrences come in order in one task, the representative first. Those of hot seeds are spread; they have the
    seed's number below zero (-1, -2, ...) as ``source_pos``, and the two arrays (at most ``HOT`` long) have the document
    and place of each one's representative."""
    hot = hot_seeds(docs)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the seed at hand with its representative
        for batch in batches:
            seed, salt, doc, pos = (batch.column(i).to_numpy() for i in range(4))
            if not len(seed):
                continue
            new = np.concatenate([[True], seed[1:] != seed[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(seed)), 0))
            source, source_pos = doc[at], pos[at]
            if last is not None and seed[0] == last[0]:
                run = int(new[1:].argmax()) + 1 if new[1:].any() else len(seed)
                source[:run], source_pos[:run] = last[1:]
            last = seed[-1], source[-1], source_pos[-1]
            spread = salt > 0
            take = spread | (doc != source)
            if spread.any():
                source, source_pos = np.where(spread, 0, source), np.where(spread, -1 - np.searchsorted(hot, seed), source_pos).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c[take]) for c in (doc, pos, source, source_pos)], names=["doc_id", "pos", "source", "source_pos"])

    placed = seeded(docs, hot).repartition("seed", "salt").sortWithinPartitions("seed", "salt", "doc_id", "pos")
    found = placed.mapInArrow(pair, "doc_id long, pos int, source long, source_pos int")
    source, source_pos = np.zeros(len(hot), np.int64), np.zeros(len(hot), np.int64)
    if len(hot):
        found = written(found, "matches")
        first = found.where("source_pos < 0").groupBy("source_pos").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
        for r in first.collect():
            source[-1 - r["source_pos"]], source_pos[-1 - r["source_pos"]] = r["first"]
    return found, source, source_pos


CHAIN = pa.schema([("doc_id", pa.int64()), ("source", pa.int64()), ("block", pa.int32()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])


def chained(found: DataFrame, hot_source: np.ndarray, hot_pos: np.ndarray) -> DataFrame:
    """``doc_id, source, block, a, b``: chains, cut at the source's blocks, with their seeds' places in both texts.
    Single matches inside a longer chain of the document, with whatever source, go."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(4)]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            edges = np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1
            last = int(edges[-1]) if len(edges) else 0
            yield from emit(*(c[:last] for c in columns))
            held = [c[last:] for c in columns]
        if held is not None:
            yield from emit(*held)

    def emit(doc: np.ndarray, source: np.ndarray, pos: np.ndarray, other: np.ndarray) -> Iterator[pa.RecordBatch]:
        pos, other = pos.astype(np.int64), other.astype(np.int64)
        if (other < 0).any():
            doc, source, pos, other = looked_up(doc, source, pos, other)
        if not len(doc):
            return
        new = doc[1:] != doc[:-1]
        number = np.concatenate([[0], np.cumsum(new)]) << 32  # before a place: orders all places of these documents
        dx, dy = np.diff(pos), np.diff(other)
        other_group = new | (source[1:] != source[:-1]) | (dx > MAX_GAP)  # chains would be cut there
        begin = np.concatenate([[0], np.flatnonzero(other_group) + 1])
        group_of = np.concatenate([[0], np.cumsum(other_group)])
        tangled = np.zeros(len(begin), bool)  # groups whose matches are not in order in both texts already
        tangled[group_of[1:][~other_group & ((dx <= 0) | (dy <= 0))]] = True
        straight = ~tangled[group_of]
        # a straight group is one chain: its parts are known at once
        part = np.concatenate([[0], np.flatnonzero(other_group | (dy > MAX_GAP) | (np.diff(other // BLOCK) > 0)) + 1])
        part = part[straight[part]]
        size = np.diff(np.append(np.searchsorted(np.flatnonzero(straight), part), straight.sum()))
        rows, lone = [], [part[size == 1]]
        after = np.append(begin[1:], len(doc))
        for i, j in zip(begin[tangled].tolist(), after[tangled].tolist(), strict=True):
            x, y = pos[i:j], other[i:j]
            for a, b in chains(x, y):
                if len(a) > 1:
                    rows.append((i, a, b))
                else:
                    lone.append(i + np.flatnonzero((x == a[0]) & (y == b[0]))[:1])
        single = np.concatenate(lone)
        first, size = part[size > 1], size[size > 1]
        ends = number[first] + pos[first + size - 1]
        longer = [np.stack([number[first] + pos[first], ends])[:, size > 2]]
        longer += [np.array([[number[i] + a[0]], [number[i] + a[-1]]]) for i, a, _ in rows if len(a) > 2]
        begins, ends = np.concatenate(longer, axis=1)
        if len(begins):
            order = np.argsort(begins, kind="stable")
            begins, ends = begins[order], np.maximum.accumulate(ends[order])
            at = number[single] + pos[single]
            before = np.searchsorted(begins, at, "right") - 1
            single = single[(before < 0) | (ends[before] < at)]
        for i in range(0, len(single), 50_000):
            at = single[i : i + 50_000]
            yield batch_of(doc[at], source[at], other[at], pos[at], other[at], np.ones(len(at), np.int64))
        for i in range(0, len(first), 5000):
            at, n = first[i : i + 5000], size[i : i + 5000]
            every = np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield batch_of(doc[at], source[at], other[at], pos[every], other[every], n)
        for i in range(0, len(rows), 5000):
            some = rows[i : i + 5000]
            at, heads = np.array([r[0] for r in some]), np.array([r[2][0] for r in some])
            yield batch_of(doc[at], source[at], heads, np.concatenate([r[1] for r in some]), np.concatenate([r[2] for r in some]), np.array([len(r[1]) for r in some]))

    def looked_up(doc: np.ndarray, source: np.ndarray, pos: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
        """The matches with the representatives of hot seeds, in order again, without these themselves."""
        hot = other < 0
        which = np.where(hot, -1 - other, 0)
        source, other = np.where(hot, hot_source[which], source), np.where(hot, hot_pos[which], other)
        number = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
        touched = np.zeros(number[-1] + 1, bool)
        touched[number[hot]] = True
        rows = np.flatnonzero(touched[number])
        order = rows[np.lexsort((other[rows], pos[rows], source[rows], number[rows]))]
        every = np.arange(len(doc))
        every[rows] = order
        every = every[doc[every] != source[every]]
        return doc[every], source[every], pos[every], other[every]

    def batch_of(doc: np.ndarray, source: np.ndarray, head: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(source), pa.array((head // BLOCK).astype(np.int32)), lists(a, n), lists(b, n)], schema=CHAIN)

    ordered = found.select("doc_id", "source", "pos", "source_pos").repartition("doc_id").sortWithinPartitions("doc_id", "source", "pos", "source_pos")
    return ordered.mapInArrow(group, "doc_id long, source long, block int, a array<int>, b array<int>")


def passages(docs: DataFrame, min_words: int = 50, min_identity: float = 0.8) -> DataFrame:
    """``doc_id, start_word, end_word, n_words, identity, source_doc_id, source_start_word``: a row for each passage
    that a document shares with an earlier one (of a lesser id)."""
    again = copies(docs)
    n_again = again.count()
    if n_again <= SMALL:
        again = F.broadcast(again)
    texts = _texts(docs)
    with temporary(docs.sparkSession):
        rest = texts.join(again, texts["doc_id"] == again["_id"], "left_anti") if n_again else texts
        found = written(chained(*matches(rest)), "chains", keep=True)
    crowds = found.groupBy(F.col("source").alias("_source"), F.col("block").alias("_block")).agg(F.count(F.lit(1)).alias("n"))
    crowds = written(crowds.where(F.col("n") > CROWD), "crowds")
    salt = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / CROWD))).cast("int").alias("salt")
    found = found.join(crowds, (found["source"] == crowds["_source"]) & (found["block"] == crowds["_block"]), "left").select("doc_id", "source", "block", salt, "a", "b")
    own = found.groupBy("doc_id").agg(F.collect_list(F.struct("source", "block", "salt", "a", "b")).alias("chains"))
    wanted = found.select(F.col("source").alias("doc_id"), "block", "salt").distinct().groupBy("doc_id").agg(F.collect_list(F.struct("block", "salt")).alias("blocks"))
    asked = own.join(wanted, "doc_id", "full_outer").select(F.col("doc_id").alias("_id"), "chains", "blocks")
    asked = written(asked, "asked")
    met = texts.join(asked, texts["doc_id"] == asked["_id"]).select("doc_id", "text", "chains", "blocks")
    ints = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.int64()), ("block", pa.int32()), ("salt", pa.int32()), ("from", pa.int32()), ("words", pa.binary()), ("a", ints), ("b", ints)])
    wide = 2 * NEAR + K

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()

        def rest(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        def singles(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            key, source, block, salt, at, other, near = (np.concatenate(x) for x in zip(*held, strict=True))
            one, ends = np.ones(len(key), np.int64), np.arange(len(key) + 1, dtype=np.int32) * (2 * wide)
            words = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(near))])
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(source), pa.array(block), pa.array(salt), pa.array((at - NEAR).astype(np.int32)), words, lists(at, one), lists(other, one)], schema=schema)

        for batch in batches:
            rows, held, n = [], [], 0
            mine, theirs = batch.column(2), batch.column(3)
            upto = np.cumsum(mine.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            source, block, salt, a, b = mine.flatten().flatten()
            source, block, salt = source.to_numpy(), block.to_numpy(), salt.to_numpy()
            sizes = a.value_lengths().to_numpy()
            begin = np.concatenate([[0], np.cumsum(sizes)])
            a, b = a.flatten().to_numpy(), b.flatten().to_numpy()
            for key, text, lo, hi, blocks in zip(batch.column(0).to_pylist(), batch.column(1), np.append(0, upto[:-1]).tolist(), upto.tolist(), theirs, strict=True):
                words = np.minimum(word_hashes(text.as_py(), known) & np.uint64(0xFFFF), np.uint64(0xFFFE)).astype("<u2")
                lone = lo + np.flatnonzero(sizes[lo:hi] == 1)
                if len(lone):
                    at = a[begin[lone]]
                    places = at[:, None] + np.arange(-NEAR, NEAR + K)
                    inside = (places >= 0) & (places < len(words))
                    near = np.where(inside, words[np.clip(places, 0, len(words) - 1)], 0xFFFF).astype("<u2")  # 0xFFFF: no word
                    held.append((np.full(len(lone), key, np.int64), source[lone], block[lone], salt[lone], at, b[begin[lone]], near))
                    n += len(lone)
                for c in (lo + np.flatnonzero(sizes[lo:hi] > 1)).tolist():
                    x, y = a[begin[c] : begin[c + 1]], b[begin[c] : begin[c + 1]]
                    before = min(REACH, int(y[0]) - int(block[c]) * BLOCK + MARGIN)  # within the source's window
                    after = min(REACH, (int(block[c]) + 1) * BLOCK + MARGIN - int(y[-1]))
                    start = max(0, int(x[0]) - before)
                    rows.append((key, source[c], block[c], salt[c], start, words[start : int(x[-1]) + K + after].tobytes(), x, y))
                for w in blocks.as_py() or ():
                    start = max(0, w["block"] * BLOCK - MARGIN)
                    rows.append((None, key, w["block"], w["salt"], start, words[start : (w["block"] + 1) * BLOCK + MARGIN + K].tobytes(), None, None))
                if len(rows) > 2000:
                    yield rest(rows)
                    rows = []
                if n > 10_000:
                    yield singles(held)
                    held, n = [], 0
            if rows:
                yield rest(rows)
            if held:
                yield singles(held)

    both = met.mapInArrow(windows, "doc_id long, source long, block int, salt int, from int, words binary, a array<int>, b array<int>")
    joined = both.repartition("source", "block", "salt").sortWithinPartitions("source", "block", "salt", "doc_id", "words")  # the block first, then its chains
    piece = pa.schema([("doc_id", pa.int64()), ("source", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("source_lo", pa.int32()), ("equal", pa.binary())])

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, np.ndarray]] = []  # the block at hand: source, block, its first word's place, words
        for batch in batches:
            if not len(batch):
                continue
            head = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            source, block, start = (batch.column(i).to_numpy() for i in (1, 2, 4))
            words = batch.column(5)
            blocks = held + [(source[i], block[i], start[i], np.frombuffer(words[i].as_py(), "<u2")) for i in np.flatnonzero(head).tolist()]
            which = np.cumsum(head) - 1 + len(held)
            if not blocks:
                continue
            held = blocks[-1:]
            size = batch.column(6).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            fits = ~head & (which >= 0)
            fits &= (np.array([x[0] for x in blocks])[which] == source) & (np.array([x[1] for x in blocks])[which] == block)
            rows = []

            def add(i: int, lo: int, places: np.ndarray, other: int, rows: list[tuple] = rows, batch: pa.RecordBatch = batch) -> None:
                equal = places >= 0
                for x, y in similar(equal, min_identity, min(K, min_words)):
                    rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), lo + x, lo + y, other + int(places[x]), np.packbits(equal[x:y]).tobytes()))

            for i in np.flatnonzero(fits & (size > 1)).tolist():
                _, _, other, v = blocks[which[i]]
                u, a, b = np.frombuffer(words[i].as_py(), "<u2"), batch.column(6)[i].values.to_numpy(), batch.column(7)[i].values.to_numpy()
                lo, places = align(u, v, a - start[i], b - other)
                add(i, int(start[i]) + lo, places, int(other))
            lone = np.flatnonzero(fits & (size == 1))
            if len(lone):
                of = which[lone]
                u = np.frombuffer(b"".join(words.take(pa.array(lone)).to_pylist()), "<u2").reshape(-1, wide).astype(np.int32)
                length = np.array([len(x[3]) for x in blocks])
                base, other = np.concatenate([[0], np.cumsum(length)[:-1]]), np.array([x[2] for x in blocks], np.int64)
                flat = np.concatenate([x[3] for x in blocks]).astype(np.int32)
                seed = batch.column(7).take(pa.array(lone)).flatten().to_numpy().astype(np.int64)
                places = (seed - other[of])[:, None] + np.arange(-NEAR, NEAR + K)
                inside = (places >= 0) & (places < length[of][:, None])
                v = np.where(inside, flat[np.clip(base[of][:, None] + places, 0, len(flat) - 1)], 0x10000)
                left, right, at = align_single(u, v)
                equal, n = at >= 0, left + K + right
                begin = NEAR - left
                fine = (equal.sum(axis=1) >= min_identity * n - 1e-6) & (n >= min(K, min_words))
                for r in np.flatnonzero(~fine).tolist():
                    i = int(lone[r])
                    add(i, int(start[i] + begin[r]), at[r, begin[r] : begin[r] + n[r]], int(seed[r]) - NEAR)
                if fine.any():
                    f = np.flatnonzero(fine)
                    moved = begin[f][:, None] + np.arange(wide)
                    bits = np.packbits((np.take_along_axis(equal[f], np.minimum(moved, wide - 1), 1)) & (np.arange(wide) < n[f][:, None]), axis=1)
                    ends = np.arange(len(f) + 1, dtype=np.int32) * bits.shape[1]
                    packed = pa.Array.from_buffers(pa.binary(), len(f), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(bits))])
                    lo = start[lone[f]] + begin[f]
                    first = seed[f] - NEAR + at[f, begin[f]]
                    took = pa.array(lone[f])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(took), batch.column(1).take(took), pa.array(lo.astype(np.int32)), pa.array((lo + n[f]).astype(np.int32)), pa.array(first.astype(np.int32)), packed], schema=piece)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), piece.types, strict=True)], schema=piece)

    spans = joined.mapInArrow(aligned, "doc_id long, source long, lo int, hi int, source_lo int, equal binary")
    final = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("n_words", pa.int32()), ("identity", pa.float64()), ("source_doc_id", pa.int64()), ("source_start_word", pa.int32())])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of a document in order; those side by side are one passage, with the source of its longest piece."""
        run: list[tuple] = []  # pieces side by side: doc, source, lo, hi, source_lo, equal words

        def done() -> list[tuple]:
            if not run:
                return []
            start, end = run[0][2], max(p[3] for p in run)
            if end - start < min_words:
                return []
            equal, out = np.zeros(end - start, bool), []
            for _, _, lo, hi, _, bits in run:
                equal[lo - start : hi - start] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
            for x, y in similar(equal, min_identity, min_words):
                x, y = start + x, start + y
                _, source, lo, _, s_lo, _ = max(run, key=lambda p: min(y, p[3]) - max(x, p[2]))
                out.append((run[0][0], x, y, y - x, round(float(equal[x - start : y - start].mean()), 4), source, max(0, s_lo + max(0, x - lo))))
            return out

        for batch in batches:
            rows = []
            for p in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if run and (run[0][0] != p[0] or p[2] > end + 4):
                    rows += done()
                    run = []
                end = max(end, p[3]) if run else p[3]
                run.append(p)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), final.types, strict=True)], schema=final)
        if rows := done():
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), final.types, strict=True)], schema=final)

    def wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.array([len(t.as_py().split()) for t in batch.column(1)], np.int32)
            fine, zero = pa.array((n >= min_words) & (n > 0)), pa.array(np.zeros(len(n), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), zero, pa.array(n), pa.array(n), pa.array(np.ones(len(n))), batch.column(2), zero], schema=final).filter(fine)

    columns = "doc_id long, start_word int, end_word int, n_words int, identity double, source_doc_id long, source_start_word int"
    ordered = spans.repartition("doc_id").sortWithinPartitions("doc_id", "lo", F.desc("hi"), "source", "source_lo")
    shared = ordered.mapInArrow(merged, columns)
    if not n_again:
        return shared
    return shared.unionByName(texts.join(again, texts["doc_id"] == again["_id"]).select("doc_id", "text", "_first").mapInArrow(wholes, columns))


def without_passages(docs: DataFrame, min_words: int = 50, min_identity: float = 0.8) -> DataFrame:
    """``docs`` with repeated passages cut from all documents but the one of least id that has them; a document that
    loses all its words goes. Same columns, whatever their names; ``n_chars`` follows the text. Rows with a null id or
    a null or empty text stay as they are; rows that repeat an id lose the same words."""
    with temporary(docs.sparkSession):
        spans = passages(docs, min_words, min_identity).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("_spans"))
        found = written(spans, "spans", keep=True)
    whole = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_key"))
    names = docs.columns
    free = "_" * (1 + max(map(len, names)))  # no column has this name
    joined = whole.join(found, whole["_key"] == found["_id"], "left").select(F.col("_spans").alias(free), "_row.*")
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts, keep = batch.column(0), batch.column(1 + text_at).to_pylist(), []
            changed = False
            for i, text in enumerate(texts):
                own = spans[i].as_py()
                keep.append(True)
                if own and text:
                    changed = True
                    places = [m.span() for m in SPLIT.finditer(text)]
                    parts, at = [], 0
                    for s in sorted(own, key=lambda s: s["start_word"]):
                        if s["start_word"] >= len(places):
                            break
                        a, b = max(at, places[s["start_word"]][0]), places[min(s["end_word"], len(places)) - 1][1]
                        if b > at:
                            parts.append(text[at:a])
                            at = b
                    texts[i] = "".join([*parts, text[at:]]).strip()
                    keep[i] = bool(texts[i])
            columns = [batch.column(1 + i) for i in range(len(names))]
            if changed:
                columns[text_at] = pa.array(texts, pa.string())
                if chars_at >= 0:
                    columns[chars_at] = pa.array([None if t is None else len(t) for t in texts], batch.schema.types[1 + chars_at])
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(cut, docs.schema)
