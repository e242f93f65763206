"""A quality and toxicity classifier from overlapping weak labellers.

Two questions are asked of a document: is it junk, and is it toxic. For each, several heuristic labellers vote for, vote
against, or abstain; an annotation, where there is one, is one more labeller and has no other standing. Expectation
maximisation estimates how reliable each labeller is and how common the class is, from their agreements alone; its posterior probabilities, which overrule annotations that better labellers contradict,
are the labels that train a hashed linear scorer (logistic, with an L1 penalty, on hashed words, word beginnings and
binned statistics of the text). Every document is scored by the two scorers, in one pass over its whole text, and is
rejected where either says so.

Fitting uses a bounded sample: ``sample_rows`` annotated documents and ``more_rows`` others, those with the least hashes
of their ids. Their hashed features, not their texts, go to the driver. Lexicons that labellers use are taken from one
half of the sample and vote on the other half. A document on which every labeller abstains, or about which they leave
doubt, trains nothing.

Defined results for odd input: a null or empty text is junk (score 1) and not toxic; null ids are scored (they have no
annotation); rows that repeat are scored each, and of several texts of a sampled id the least is used; of several
annotations of an id the greatest counts; without documents there are no rows; without annotations the heuristics alone
label; other columns are not read.
"""

from __future__ import annotations

import functools
import re
import uuid
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 20
#: Insults by which the lexicon labeller knows toxic English.
INSULTS = frozenset("asshole bastard bitch clown cretin disgusting dumb fool idiot imbecile jerk loser moron pathetic scum stupid trash vermin worthless".split())
WORD = re.compile(r"[^\W\d_]+")
MARKS = re.compile(r"[^\w\s]{2,}")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")

ROW = pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.int32())), ("style", pa.list_(pa.int32())), ("votes", pa.list_(pa.int8())), ("insults", pa.int32())])


def hashed(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def of_word(word: str) -> tuple[int, ...]:
    """A word's features: itself and its beginnings."""
    return (hashed(f"w={word}"), *(hashed(f"b={word[:n]}") for n in (4, 5) if len(word) >= n))


known_words = functools.lru_cache(20_000)(of_word)


def statistics(text: str) -> dict[str, float]:
    """Shares by which junk is told from prose."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    return {
        "marks": len(MARKS.findall(text)) / n, "upper": len(UPPER.findall(text)) / size, "bars": text.count("|") / n,
        "repeats": sum(map(eq, words, words[1:])) / n, "distinct": len(set(words)) / n if n >= 20 else 1.0, "length": size / n / 40, "letters": sum(map(len, WORD.findall(text))) / size,
    }


def style(text: str) -> list[int]:
    found = statistics(text)
    return [hashed("empty")] if not text.strip() else [hashed(f"{k}={min(19, int(v * 20))}") for k, v in found.items()]


def junk_votes(text: str) -> list[int]:
    """1: junk, -1: not, 0: abstains."""
    s = statistics(text)
    blank = not text.strip()
    rule = lambda high, low, value: 1 if blank or value > high else -1 if value < low else 0
    return [
        rule(0.25, 0.05, s["marks"]), rule(0.4, 0.1, s["upper"]), rule(0.1, 0.02, s["bars"]), rule(0.3, 0.05, s["repeats"]),
        rule(0.35, 0.2, 1 - s["letters"]), 1 if blank or s["distinct"] < 0.15 else -1 if s["distinct"] > 0.3 else 0,
        1 if blank or max(s["marks"] / 0.25, s["upper"] / 0.4, s["bars"] / 0.1, s["repeats"] / 0.3) > 1 else -1,
    ]


def features(texts: list[str | None]) -> Iterator[tuple[list[int], list[int], list[int], int]]:
    for text in texts:
        words = set(WORD.findall(text.lower()))
        yield sorted({f for w in words for f in known_words(w)}), style(text), junk_votes(text), len(words & INSULTS)


def expectation_maximisation(votes: np.ndarray, silent: bool = True, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """``votes``: rows by labellers, -1, 0 or 1. Returns each row's probability of the class, each labeller's accuracy
    where it votes, and how common the class is. No labeller is told from another beforehand. Equal rows of votes are
    counted once.

    ``silent``: an abstention says nothing, and a labeller is as often right about either class. Otherwise a labeller
    has a chance of each vote, abstention included, in either class: for labellers that nearly always vote."""
    patterns, inverse, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = np.clip(0.5 + patterns.sum(axis=1) / (2.0 * np.maximum(1, np.abs(patterns).sum(axis=1))), 0.02, 0.98)
    p = np.where((patterns == 1).any(axis=1), np.maximum(p, 0.6), p)
    voted = patterns != 0
    seen = n * voted.any(axis=1)
    accuracy, prior = np.full(votes.shape[1], 0.8), 0.1
    for i in range(rounds):
        if silent:
            if i:
                right = np.where(patterns == 1, p[:, None], 1 - p[:, None]) * voted
                accuracy = np.clip((n @ right + 4 * 0.8) / (n @ voted + 4), 0.05, 0.9999)
                prior = float(np.clip((p * seen).sum() / max(1, seen.sum()), 1e-4, 0.9))
            z = patterns @ np.log(accuracy / (1 - accuracy))
        else:
            chance = np.empty((2, votes.shape[1], 3))
            for c, weight in ((1, p * n), (0, (1 - p) * n)):
                for v in (-1, 0, 1):
                    chance[c, :, v + 1] = (weight @ (patterns == v) + 0.1) / (weight.sum() + 0.3)
            prior = float(np.clip((p * n).sum() / n.sum(), 1e-4, 0.9))
            says = np.log(chance[:, np.arange(votes.shape[1])[None, :], patterns + 1]).sum(axis=2)
            z = says[1] - says[0]
        p = 1 / (1 + np.exp(-np.clip(z + np.log(prior / (1 - prior)), -40, 40)))
    right = np.where(patterns == 1, p[:, None], 1 - p[:, None]) * voted
    return p[inverse.ravel()], (n @ right + 0.01) / (n @ voted + 0.02), prior


def train(rows: list[np.ndarray], labels: np.ndarray, l1: float = 1e-5, rounds: int = 300, keep: int = 20_000) -> tuple[np.ndarray, float]:
    """Weights over hashed features and a bias, for soft labels. Features that say most of the label by themselves are
    kept; the rest have weight 0."""
    weights = np.zeros(1 << BITS, np.float32)
    n = len(rows)
    if not n or labels.max() < 0.5 or labels.min() > 0.5:
        return weights, -20.0 if not n or labels.max() < 0.5 else 20.0
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    df = np.bincount(flat, minlength=1 << BITS).astype(float)
    pos = np.bincount(flat, weights=labels[owner], minlength=1 << BITS)
    share = labels.mean()
    strength = np.where(df >= 4, (pos - df * share) ** 2 / np.maximum(df * share * (1 - share), 1e-9), 0)
    chosen = np.sort(np.argsort(-strength, kind="stable")[:keep])
    chosen = chosen[strength[chosen] > 9]
    to = np.full(1 << BITS, -1, np.int32)
    to[chosen] = np.arange(len(chosen))
    inside = to[flat] >= 0
    column, owner = to[flat[inside]], owner[inside]
    w, bias, ahead, t = np.zeros(len(chosen)), 0.0, np.zeros(len(chosen)), 1.0
    balance = labels * 0.5 / share + (1 - labels) * 0.5 / (1 - share)  # both classes weigh the same
    scale = 1 / np.sqrt(np.maximum(df[chosen] / n, 1e-4))  # rare features count as much as common ones
    rate = 4.0 / max(1.0, float(np.bincount(owner, weights=scale[column] ** 2, minlength=n).max()) * 0.2)
    bias_rate = 4.0
    for _ in range(rounds):
        z = np.bincount(owner, weights=(ahead * scale)[column], minlength=n) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * balance / n
        grad = np.bincount(column, weights=error[owner], minlength=len(chosen)) * scale
        new = ahead - rate * n ** 0.5 * grad
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t, bias = new, t_new, bias - bias_rate * float(error.sum())
    weights[chosen] = w * scale
    return weights, bias


class Hits:
    """A worker's memory of words' weighty features, for the model that it used last: one at a time, so that a worker
    that outlives many models does not keep them."""

    of: str = ""
    words: dict[str, tuple[int, ...]] = {}

    @classmethod
    def for_model(cls, name: str) -> dict[str, tuple[int, ...]]:
        if cls.of != name or len(cls.words) > 150_000:
            cls.of, cls.words = name, {}
        return cls.words


class Model:
    """Two scorers: (weights, bias) for junk and for toxicity."""

    def __init__(self, junk: tuple[np.ndarray, float], toxic: tuple[np.ndarray, float]) -> None:
        self.junk, self.toxic = junk, toxic
        self.heavy = {i: float(toxic[0][i]) for i in np.flatnonzero(toxic[0])}
        self.name = uuid.uuid4().hex

    def scores(self, text: str) -> tuple[float, float]:
        if not text.strip():
            return 1.0, 0.0
        z = self.junk[1] + float(self.junk[0][style(text)].sum())
        cache, heavy, hit = Hits.for_model(self.name), self.heavy, set()
        for w in set(WORD.findall(text.lower())):
            if (own := cache.get(w)) is None:
                own = cache[w] = tuple(f for f in of_word(w) if f in heavy)
            hit.update(own)
        y = self.toxic[1] + sum(map(heavy.__getitem__, hit))
        squash = lambda v: float(1 / (1 + np.exp(-min(max(v, -30.0), 30.0))))
        return squash(z), squash(y)


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int, more_rows: int) -> DataFrame:
    """At most ``sample_rows`` documents with their annotations and ``more_rows`` (where none is annotated,
    ``sample_rows``) without: ``doc_id, text, quality, toxic``, a row for each id."""
    given = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = text.select("doc_id").where("doc_id IS NOT NULL").join(given.select("_id"), F.col("doc_id") == F.col("_id"), "left_anti")
    first = given.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    others = ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows if given.isEmpty() else more_rows)
    chosen = F.broadcast(first.unionByName(others.select(F.col("doc_id").alias("_id"), F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))))  # bounded by the two parameters
    found = text.join(chosen, text["doc_id"] == chosen["_id"])
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, more_rows: int = 2_000) -> Model:
    """The two scorers, from the sample."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            got = list(features(texts))
            if got:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[i] for g in got], ROW.types[i + 1]) for i in range(4)), batch.column(2), batch.column(3)], names=[*ROW.names, "quality", "toxic"])

    schema = "doc_id long, words array<int>, style array<int>, votes array<byte>, insults int, quality int, toxic int"
    bounded = sample(docs, labels, sample_rows, more_rows)
    got = bounded.mapInArrow(rows, schema).toArrow().to_pandas().sort_values(["doc_id", "insults"], kind="stable")
    if not len(got):
        return Model(train([], np.empty(0)), train([], np.empty(0)))
    words, styles = [np.asarray(x, np.int32) for x in got["words"]], [np.asarray(x, np.int32) for x in got["style"]]
    annotated = lambda c, bad: np.select([got[c].isna(), got[c] == bad], [0, 1], -1)
    bad, toxic = annotated("quality", 0), annotated("toxic", 1)
    junk = np.column_stack([np.array(got["votes"].tolist(), np.int64), bad])
    flat, owner = np.concatenate(words), np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
    half = got["doc_id"].fillna(0).astype("int64").map(lambda x: zlib.crc32(str(x).encode()) & 1).to_numpy()
    lexicons = []
    for least, most in ((3, 0.0), (6, 0.05)):  # rare cues that clean documents never have; common ones that few have
        vote = np.zeros(len(words), np.int64)
        for h in (0, 1):
            other = half[owner] != h
            with_, without = (np.bincount(flat[other & (toxic[owner] == v)], minlength=1 << BITS) for v in (1, -1))
            cue = (with_ >= least) & (without <= most * with_)
            hits = np.bincount(owner, weights=cue[flat], minlength=len(words)) > 0
            vote = np.where((half == h) & hits, 1, vote)  # no cue says little: it abstains, so nobody speaks against a toxic annotation
        lexicons.append(vote)
    insult = np.where(got["insults"] > 0, 1, 0)
    return Model(taught(styles, junk, silent=False, keep=1000), taught(words, np.column_stack([insult, *lexicons, toxic])))


def taught(rows: list[np.ndarray], votes: np.ndarray, silent: bool = True, doubt: float = 0.2, **how: int) -> tuple[np.ndarray, float]:
    """A scorer trained on the posterior labels of the rows about which there is little ``doubt``; rows on which every
    labeller abstains train nothing."""
    p, _, _ = expectation_maximisation(votes, silent)
    some = np.flatnonzero((votes != 0).any(axis=1) & (np.abs(p - 0.5) >= 0.5 - doubt))
    return train([rows[i] for i in some], p[some], **how)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``doc_id, junk_score, toxic_score, keep`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.scores(t) for t in batch.column(1).to_pylist()]
            a, b = (np.array([g[i] for g in got], float) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a), pa.array(b), pa.array((a < threshold) & (b < threshold))], names=["doc_id", "junk_score", "toxic_score", "keep"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(marked, "doc_id long, junk_score double, toxic_score double, keep boolean")


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000) -> DataFrame:
    """Fits on the sample and scores every document."""
    return score(docs, fit(docs, labels, sample_rows))


def filtered(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, whole and with all their columns, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample_rows))
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([max(shared.value.scores(t or "")) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
