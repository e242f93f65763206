"""Mixing sources to target weights by a time-varying curriculum.

Each source has a schedule: its relative weight at the start and at the end of training, linear between them. Scaled so
that its integral over training time is the source's target, the schedule is that source's demand for words at a
time. A source's documents, in an order fixed by a hash of their ids, lie one after another on the source's line of
words; a second and third pass over the source follow where the target is larger than the source. The training
position of a document's copy is the time at which the source's cumulative demand reaches the copy's middle: the
inverse of the integrated schedule. Copies whose middle lies beyond the target are not taken. Rows sorted by position
are the training order.

All of it is DataFrame code. The place on a source's line is a prefix sum in two levels: sums by (source, slice of the
hash), prefix sums over the slices, and prefix sums inside a slice, so that a source that holds most rows is spread
over all tasks.

Defined results for odd input: a null text has size 0; a null source is a source of its own, ordered last; a null id
hashes as the empty string; rows that repeat are separate rows (each has its own place); empty tables give empty
results; columns of the input with the names used here are not read, so they can't clash. A document of size 0 takes 0
words whatever its copies. A source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomlog.llm.common import temporary, written

MAX_EPOCHS = 3
#: Relative weight of a source at the end of training against the start: later sources are phased in.
RAMP = (1.0, 1.5, 2.0)


def words(text: Column) -> Column:
    """How many maximal runs of characters other than ASCII white space a text has; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size`` to ``source, source_size, weight, target``.

    Water filling in closed form: with every source capped at ``MAX_EPOCHS`` times its size, the capped ones are those
    with the smallest cap for their weight. For each number of capped sources there is one level; the right one is the
    first at which no further source exceeds its cap. The table has one row for each source.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    ranked = ranked.withColumn("cap", (F.col("source_size") * MAX_EPOCHS).cast("double"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    from_here = by_ratio.rowsBetween(0, W.unboundedFollowing)
    all_rows = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(from_here)
    ranked = ranked.withColumn("level", F.when(F.col("cap") / F.col("weight") >= level, level))
    ranked = ranked.withColumn("level", F.first("level", ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap"))
    return ranked.select("source", "source_size", "weight", target.cast("double").alias("target"))


def position(share: Column, start: Column, end: Column) -> Column:
    """Time in [0, 1] at which a source with weight linear from ``start`` to ``end`` has met ``share`` of its demand."""
    mean = (start + end) / 2
    slope = end - start
    root = F.sqrt(start * start + 2 * slope * mean * share)
    return F.when(slope == 0, share).otherwise((root - start) / slope)


def plan(docs: DataFrame, slices: int = 4096, carry: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``text``, ``source`` and ``doc_id`` to one row a document: ``doc_id, size, source, source_size,
    target, copies, taken, positions`` (an array of times, one for each copy) and the columns ``carry``. ``slices``: a power of 16, the cuts of
    each source; about rows / slices of a source are together in one task.

    What whole documents leave open at the end of a source's target (up to half the document that lies across it) is
    then made up by small documents: of those of at most a quarter of the gap, in the same order, as many get a copy
    more, or less, as fill it."""
    digits = {16: 1, 256: 2, 4096: 3, 65536: 4}[slices]
    empty = F.md5(F.lit(""))  # what null ids hash to: their slice is cut by their texts' hashes
    cut = F.when(F.col("h") < empty, "0").when(F.col("h") > empty, "2").otherwise(F.concat(F.lit("1"), F.substring("h2", 1, digits)))
    rows = written(docs.select(
        *carry, "doc_id", "source", words(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"), F.md5(F.coalesce("text", F.lit(""))).alias("h2"),
    ).withColumn("slice", F.concat(F.substring("h", 1, digits), cut)), "sizes")
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    rows = _with(on_line(rows, "size", "before"), goal, ["source_size", "target", "weight"])
    rows = rows.withColumn("middle", F.col("before") + F.col("size") / 2.0)
    left = (F.col("target") - F.col("middle")) / F.col("source_size")
    copies = F.when((F.col("source_size") == 0) | (left <= 0), 0).otherwise(F.least(F.ceil(left), F.lit(MAX_EPOCHS)))
    rows = written(rows.withColumn("whole", copies.cast("int")), "copies")
    gaps = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("whole"))).alias("gap"))
    rows = _with(rows, gaps, ["gap"])
    small = (F.col("size") * 4 <= F.abs("gap")) & F.when(F.col("gap") > 0, F.col("whole") < MAX_EPOCHS).otherwise(F.col("whole") > 0)
    rows = on_line(rows.withColumn("filler", F.when(small, F.col("size")).otherwise(0)), "filler", "filled")
    more = small & (F.col("filled") + F.col("size") / 2.0 <= F.abs("gap"))
    rows = rows.withColumn("copies", (F.col("whole") + F.when(more, F.signum("gap")).otherwise(0)).cast("int"))
    end = F.element_at(F.array(*map(F.lit, RAMP)), F.col("weight").cast("int"))
    share = lambda k: F.least((F.col("middle") + (k - 1) * F.col("source_size")) / F.col("target"), F.lit(1.0))
    places = F.transform(F.sequence(F.lit(1), F.col("copies")), lambda k: position(share(k), F.lit(1.0), end))
    return rows.select(
        *carry, "doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
        F.when(F.col("copies") > 0, places).otherwise(F.array().cast("array<double>")).alias("positions"),
    )


def _with(rows: DataFrame, by_source: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with columns of a table that has one row for each source."""
    g = by_source.select(F.col("source").alias("_s"), *names)
    return rows.join(g, rows["source"].eqNullSafe(g["_s"])).drop("_s")


def on_line(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows before it on its source's line."""
    in_order = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("source", "slice").agg(F.sum(value).alias("_sum"))
    bases = sums.select(F.col("source").alias("_s"), F.col("slice").alias("_slice"), F.coalesce(F.sum("_sum").over(in_order), F.lit(0)).alias("_base"))
    inside = W.partitionBy("source", "slice").orderBy("h", "doc_id", "h2").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_inner", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    rows = rows.join(bases, rows["source"].eqNullSafe(bases["_s"]) & (rows["slice"] == bases["_slice"]))
    return rows.withColumn(name, F.col("_base") + F.col("_inner")).drop("_s", "_slice", "_base", "_inner")


def training_order(planned: DataFrame) -> DataFrame:
    """``doc_id, epoch, position``: a row for each copy, range-sorted by training position."""
    each = planned.select("doc_id", F.posexplode("positions").alias("epoch", "position"))
    return each.orderBy("position", "doc_id", "epoch")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the contract, range-sorted by the document's first training position (documents not taken last)."""
    first = F.try_element_at("positions", F.lit(1))
    return plan(docs).orderBy(first.asc_nulls_last(), "doc_id").select("doc_id", "size", "source_size", "target", "taken")


def apply(docs: DataFrame) -> DataFrame:
    """``docs`` repeated as the plan says, with the same columns, range-sorted by training position: a row for each copy
    at its own time. Rows are numbered in a written table first, so that each finds its own plan, whatever its id."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("row")), "rows")
    with temporary(docs.sparkSession):
        planned = plan(rows.select("key", "row.doc_id", "row.source", "row.text"), carry=("key",))
        copies = written(planned.select(F.col("key").alias("_key"), F.posexplode("positions").alias("epoch", "position")), "copies", keep=True)
    return rows.join(copies, rows["key"] == copies["_key"]).orderBy("position", "key", "epoch").select("row.*")
