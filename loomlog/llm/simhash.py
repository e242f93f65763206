"""SimHash near-duplicate detection with keys from the binary Golay code.

A document's fingerprint has a bit set where more than half of its shingles' 64-bit hashes do. Documents link where
fingerprints differ in at most two bits, found without comparing all pairs:

* Fingerprints are made distinct first, so copies cost nothing further.
* A fingerprint is cut into three segments of 22, 21 and 21 bits. Two errors leave one segment whole, and of the two
  others one has at most one error. Going round, (whole, next) is such a pair for one of the three choices.
* The whole segment is taken as it is. The next one is read as a word of the perfect (23, 12, 7) Golay code and decoded
  to the codewords within distance four: one where the nearest is within two, else the nearest at three and five more
  at four. Two words that differ in at most one bit share such a codeword. So a key is a segment's bits with a 12-bit
  codeword index, and a fingerprint has about sixteen of them.
* Fingerprints that share a key are joined and verified. Where more than ``cold`` share one, the members of the key are
  not paired. Each gives itself and its 64 neighbours at one bit instead: two fingerprints differ in at most two bits
  if and only if they share one of these, and all that share one are linked to the least of them. That is exact, and
  linear in the number of members; a neighbour can be shared by at most 65.

Components of the links are found by star contraction over distinct fingerprints.

Defined results for odd input: null or empty text, or one without words: fingerprint zero, linked like any other; fewer
words than a shingle: their sequence is the one shingle; a null id is kept, and its component is the least id of the
others (null where none has one); rows that repeat an id are kept; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomlog.llm.common import temporary, written
from loomlog.llm.components import components

SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: the generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def fingerprint(text: str, shingle: int = 3, block: int = 1 << 16) -> int:
    """Unsigned 64 bits of a text: words between ASCII white space, A-Z lower-cased, hashed by XXH64 with seed 42."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else iter([words])
    n, ones = max(1, len(words) - shingle + 1), np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for _ in range(0, n, block):
        hashes = [digest(join(g), 42) for g in islice(grams, block)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


@functools.cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error patterns that lead to codewords within distance four, padded with -1, and the syndromes
    of the three bytes of a word."""

    def syndrome(word: int) -> int:
        for i in range(22, 10, -1):
            if word >> i & 1:
                word ^= GENERATOR << (i - 11)
        return word

    of_bit = [syndrome(1 << i) for i in range(23)]
    near: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= of_bit[b]
            near[s].append(sum(1 << b for b in bits))
    errors = np.full((2048, 6), -1, np.int64)
    for s, patterns in enumerate(near):
        errors[s, : len(patterns)] = patterns
    bytes_ = np.array([[syndrome(b << shift) if b << shift < 1 << 23 else 0 for b in range(256)] for shift in (0, 8, 16)], np.int64)
    return errors, bytes_


def codewords(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords within distance four of each 23-bit word: six columns, -1 where there are fewer."""
    errors, of_byte = golay()
    s = of_byte[0][words & 255] ^ of_byte[1][words >> 8 & 255] ^ of_byte[2][words >> 16 & 255]
    e = errors[s]
    return np.where(e < 0, -1, (words[:, None] ^ e) >> 11)


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and row number, for every key of every fingerprint."""
    prints = prints.astype(np.uint64)
    parts = [(prints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    out, rows = [], []
    for i in range(3):
        found = codewords(parts[(i + 1) % 3])
        key = (i << 36 | parts[i] << 12)[:, None] | found
        row, column = np.nonzero(found >= 0)
        out.append(key[row, column])
        rows.append(row)
    return np.concatenate(out), np.concatenate(rows)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp, h``: the fingerprint as a signed long, and a hash of the text."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), batch.column(2)], names=["doc_id", "fp", "h"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_hash().alias("h"))
    return rows.mapInArrow(mark, "doc_id long, fp long, h long")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def links(prints: DataFrame, cold: int = 16) -> DataFrame:
    """``a, b``: links between distinct fingerprints (``fp``, a written table), as many as give the same components
    as all pairs within two bits."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            key, row = keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    each = written(prints.select("fp").mapInArrow(keyed, "key long, fp long"), "keys")
    shared = written(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    each = written(each.join(shared, "key"), "candidates")
    few = each.where(F.col("n") <= cold)
    a, b = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & near).select("a", "b")
    many = each.where(F.col("n") > cold).select("fp").distinct()
    around = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    around = written(many.select("fp", F.explode(around).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid")), "around")
    least = written(around.groupBy("mid").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("mid").alias("_mid"), "b"), "mids")
    stars = around.join(least, around["mid"] == least["_mid"]).where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def _placed(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``fp, least, root`` for each distinct fingerprint, and ``_root, least`` for each group: ``least`` is the least
    row (``no_id, doc_id, h``), one with an id where there is any."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    prints = written(marked.groupBy("fp").agg(F.min(row).alias("least")), "prints")
    roots = components(links(prints))
    placed = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = written(placed, "placed")
    return placed, written(placed.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("least")), "best")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every document."""
    marked = written(fingerprints(docs, shingle), "fingerprints")
    placed, best = _placed(marked)
    of_print = written(placed.join(best, placed["root"] == best["_root"]).select(F.col("fp").alias("_fp"), best["least"]["doc_id"].alias("component_id")), "of-print")
    out = marked.join(of_print, marked["fp"] == of_print["_fp"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


PRINTS, FAR, COLD = 3, 10, 16
#: Leaders of a gram and rounds of them before all that is left meets, and longs of a set's signature.
LEADERS, ROUNDS, SIGNED = 8, 3, 8


def word_prints(words: list[bytes]) -> list[int]:
    """``PRINTS`` fingerprints of a text's distinct words: the majority of their hashes' bits, and of mixtures of them."""
    if not words:
        return [0] * PRINTS
    h = np.array([xxhash.xxh64_intdigest(w, 42) for w in set(words)], np.uint64)
    out = []
    for i in range(PRINTS):
        mixed = h * np.uint64(2 * i * 0x9E3779B97F4A7C15 % 2**64 | 1)
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits((mixed * np.uint64(0xBF58476D1CE4E5B9)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out.append(int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(h), bitorder="little").view("<i8")[0]))
    return out


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """Sorted 32-bit hashes of a text's distinct shingles; fewer words than a shingle are one, no words none."""
    if not words:
        return np.empty(0, "<u4")
    grams = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    return np.unique(np.array([xxhash.xxh32_intdigest(b" ".join(g)) for g in grams], "<u4"))


def normal(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def shingle_sets(texts: DataFrame, asked: DataFrame, shingle: int) -> DataFrame:
    """``node, grams``: the shingle sets of those ``texts`` (``node, text``, one row a node) that are ``asked`` for
    (``_node``, distinct)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(normal(t.as_py()), shingle).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["node", "grams"])

    found = texts.join(asked, texts["node"] == asked["_node"], "left_semi").select("node", "text")
    return written(found.mapInArrow(sets, "node long, grams binary"), "grams")


def compared(pairs: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (``a, b``: nodes) whose sets (``node, grams``) are alike enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [alike(np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")) >= similarity for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    left, right = own.select(F.col("node").alias("_a"), F.col("grams").alias("x")), own.select(F.col("node").alias("_b"), F.col("grams").alias("y"))
    met = pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b")).select("a", "b", "x", "y")
    return written(met.mapInArrow(compare, "a long, b long"), "verified")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (``a, b``: nodes) whose texts (``node, text``, one row a node) are alike enough. Only texts in
    a pair are read, and become sets once each."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("_node")).distinct()
    return compared(pairs, shingle_sets(texts, asked, shingle), similarity)


def signature(grams: np.ndarray) -> np.ndarray:
    """``SIGNED`` longs: the parity of the number of grams at each bit. Signatures of two sets differ in no more bits than
    the sets differ in grams."""
    mixed = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    odd = np.bincount((mixed % np.uint64(64 * SIGNED)).astype(np.int64), minlength=64 * SIGNED) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def crowded_links(crowd: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``a, b``: verified links among the nodes of ``crowd`` (``_node``, distinct), as many as give the same components
    as all pairs that are alike enough.

    The grams of each set are put in one order, those that fewest nodes have first. Two sets that are alike enough share
    one of the first ``size - ceil(similarity * size) + 1``, and the first that they share leaves enough behind it in
    both. So nodes that share such a gram are candidates; those whose signatures differ too much are none. ``ROUNDS``
    times a gram's nodes meet ``LEADERS`` of them, which joins most of what belongs together and is linear. In the end
    all nodes of a gram meet that are not joined yet: every pair that is left, so nothing depends on the leaders."""

    def each_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(g.as_py(), "<u4") for g in batch.column(1)]
            size = np.array([len(s) for s in sets], np.int64)
            every = np.concatenate([*sets, np.empty(0, "<u4")]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), size)), pa.array(every), pa.array(np.repeat(size, size))], names=["node", "gram", "size"])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [signature(np.frombuffer(g.as_py(), "<u4")) for g in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.list_(pa.int64()))], names=["_signed", "bits"])

    own = shingle_sets(texts, crowd, shingle)
    every = written(own.mapInArrow(each_gram, "node long, gram long, size long"), "every")
    often = every.groupBy(F.col("gram").alias("_gram")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rare_first, of_node = W.partitionBy("node").orderBy("n", "gram"), W.partitionBy("node")
    at = F.col("size") - F.count(F.lit(1)).over(of_node) + F.row_number().over(rare_first) - 1  # grams of one node come first
    placed = every.join(often, every["gram"] == often["_gram"]).select("node", "gram", "size", at.alias("at"))
    placed = placed.where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9))
    marks = own.mapInArrow(signed, "_signed long, bits array<long>")
    first = written(placed.join(marks, placed["node"] == marks["_signed"]).select("node", "gram", "size", "at", "bits"), "first")

    names = ("node", "size", "at", "bits", "root")
    shared = F.ceil((F.col("size") + F.col("_size")) * (similarity / (1 + similarity)) - 1e-9)  # grams that both must have
    differ = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("_bits")[i])) for i in range(SIGNED)), F.lit(0))
    fits = (F.col("root") != F.col("_root")) & (F.least(F.col("size") - F.col("at"), F.col("_size") - F.col("_at")) >= shared)
    fits &= differ <= F.col("size") + F.col("_size") - 2 * shared
    pair = (F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b"))
    found, rows = None, first.withColumn("root", F.col("node"))
    for i in range(ROUNDS + 1):
        if found is not None:
            roots = components(found)
            rows = first.join(roots.select(F.col("node").alias("_of"), F.col("root").alias("_to")), F.col("node") == F.col("_of"), "left")
            rows = rows.select(*first.columns, F.coalesce("_to", "node").alias("root"))
        rows = written(rows, "rooted")
        most = rows.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("gram").alias("_gram"))
        most = most.agg(F.max(F.struct("n", "root"))["root"].alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        mixed = written(rows.join(most, rows["gram"] == most["_gram"]).select(*rows.columns, "most"), "mixed")
        if mixed.isEmpty():
            break
        if i < ROUNDS:
            order = F.xxhash64("node", F.lit(i))
            some = mixed.groupBy(F.col("gram").alias("_gram"), F.pmod(order, F.lit(LEADERS)).alias("_class")).agg(F.min(F.struct(order.alias("order"), *names)).alias("lead"))
            some = written(some.select("_gram", *(F.col(f"lead.{c}").alias(f"_{c}") for c in names)), "leaders")
            met = mixed.join(some, (F.col("gram") == F.col("_gram")) & fits).select(*pair)
        else:  # those of the commonest root do not meet each other
            others = mixed.select(F.col("gram").alias("_gram"), *(F.col(c).alias(f"_{c}") for c in names)).where(F.col("_root") != F.col("most"))
            met = mixed.join(others, (F.col("gram") == F.col("_gram")) & ((F.col("root") == F.col("most")) | (F.col("node") < F.col("_node"))) & fits).select(*pair)
        linked = compared(written(met.distinct(), "met"), own, similarity)
        found = linked if found is None else found.unionByName(linked)
    return found if found is not None else crowd.select(F.col("_node").alias("a"), F.col("_node").alias("b")).limit(0)


def similar_links(nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``a, b``: verified links between nodes (``node, prints``, a written table; ``texts``: ``node, text``)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            prints = batch.column(1).flatten().to_numpy().reshape(-1, PRINTS)
            for i in range(PRINTS):
                key, row = keys(prints[:, i].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key | i << 40), pa.array(node[row]), pa.array(prints[row, i])], names=["key", "node", "fp"])

    each = written(nodes.select("node", "prints").mapInArrow(keyed, "key long, node long, fp long"), "keys")
    shared = written(each.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    each = written(each.join(shared, each["key"] == shared["_key"]).select("key", "node", "fp", "n"), "candidates")
    few, crowd = each.where(F.col("n") <= COLD), each.where(F.col("n") > COLD).select(F.col("node").alias("_node")).distinct()
    a, b = few.select("key", F.col("node").alias("a"), F.col("fp").alias("x")), few.select(F.col("key").alias("_key"), F.col("node").alias("b"), F.col("fp").alias("y"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= FAR
    pairs = written(a.join(b, (F.col("key") == F.col("_key")) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct(), "pairs")
    return verified(pairs, texts, shingle, similarity).unionByName(crowded_links(written(crowd, "crowd"), texts, shingle, similarity))


def survivors(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id (and hash of its text, where rows repeat
    an id). Rows without an id have no group of their own to stand for unless none in the group has one; then one of
    them stays. Texts whose lower-cased words are the same in the same order are one node (a 64-bit hash); nodes link
    where the Jaccard similarity of their sets of ``shingle`` words is at least ``similarity``.

    Near copies differ in few words but in many shingles, so candidates come from ``PRINTS`` fingerprints of the distinct
    words, by the same Golay keys, and are verified on the texts. Where more than ``COLD`` nodes share a key, they are
    not paired by it: all nodes of such keys are linked by the grams they share (``crowded_links``), which finds the
    components of every pair of them that is alike enough, with no limit on keys, partners or group sizes.

    Defined results for odd input: null, empty and blank texts are one group; null ids as said; an empty table gives no
    rows; all columns are returned as they came, whatever their names."""

    def marks(text: str) -> tuple[int, list[int]]:
        words = normal(text)
        return xxhash.xxh64_intdigest(b" ".join(words)), word_prints(words)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [marks(t.as_py()) for t in batch.column(1)]  # a text's words at a time
            node = np.array([g[0] for g in got], np.uint64).view(np.int64)
            prints = pa.array([g[1] for g in got], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node), prints], names=["doc_id", "h", "node", "prints"])

    with temporary(docs.sparkSession):
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_hash().alias("h"))
        marked = written(rows.mapInArrow(mark, "doc_id long, h long, node long, prints array<long>"), "marked")
        row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
        nodes = written(marked.groupBy("node").agg(F.min(F.struct(row.alias("least"), "prints")).alias("first")).select("node", F.col("first.least").alias("least"), F.col("first.prints").alias("prints")), "nodes")
        places = nodes.select("node", F.col("least.doc_id").alias("_id"), F.col("least.h").alias("_h"))
        texts = written(rows.join(places, (rows["h"] == places["_h"]) & rows["doc_id"].eqNullSafe(places["_id"])).dropDuplicates(["node"]).select("node", "text"), "texts")
        roots = components(similar_links(nodes, texts, shingle, similarity))
        placed = nodes.join(roots, nodes["node"] == roots["node"], "left").select(F.coalesce(roots["root"], nodes["node"]).alias("_root"), "least")
        best = placed.groupBy("_root").agg(F.min("least").alias("least"))
        stay = written(best.select(F.col("least.doc_id").alias("_stay"), F.col("least.h").alias("_text")), "stay", keep=True)
    hashed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), text_hash().alias("_hash"))
    kept = hashed.join(stay, (hashed["_hash"] == stay["_text"]) & hashed["_doc"].eqNullSafe(stay["_stay"]), "left_semi")
    return kept.dropDuplicates(["_doc", "_hash"]).select("_row.*")
