"""Mixing sources to target weights by Pareto order sampling (operator 6).

Column functions, joins and aggregations only. Each source has a target number
of words; its rate is target / size. Every document of the source is taken
``floor(rate)`` whole times. The rest of the target is sampled once over: a
document's inclusion probability is the fraction p of the rate, its rank is
its random odds over its inclusion odds, (u / (1 - u)) / (p / (1 - p)), and
the documents of smallest rank are taken up to the point where the words taken
come nearest to the target. u is fixed by the doc_id, so reruns agree.

The point is found without ordering a source in one task: ranks are cut into
``2**BUCKET_BITS`` slices of u; the words of the slices, summed by source, show
the slice that holds the point, and only that slice is ordered by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serpframe.llm.tables import written

WEIGHTS = (5, 2, 1)
BUCKET_BITS = 12
BROADCAST_SOURCES = 10_000  # rows of the source table that are sent to all executors


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target: by weight, at most ``most`` times the source's size.

    ``sizes``: one row per document (source, size). Sources weigh ``weights``
    in turn, by code point, null last. With the level L, a target is
    min(most * size, L * weight); L follows from the order of the sources'
    most * size / weight. The table has one row per source; it is ordered in
    one task, so sources are expected in thousands at most.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight.cast("long")).withColumn("cap", most * F.col("source_size"))
    order = everything.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    by = by.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    by = by.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                       / F.sum("weight").over(onward))
    # the first source that the level does not fill sets it for itself and all after it
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    level = F.first(open_, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return by.withColumn("at", level).select(
        "source", "source_size",
        F.when(F.col("at").isNull(), F.col("cap").cast("double"))
        .otherwise(F.least(F.col("cap").cast("double"), F.col("at") * F.col("weight"))).alias("target"))


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1), fixed by the doc_id: 52 bits of its MD5."""
    text = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def plan(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5) -> DataFrame:
    """One row per source: source, source_size, target, whole, p, cut_cell, stop.

    ``sizes``: one row per document (source, size, u).
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    want = targets(sizes, weights, share).withColumn("whole", F.floor(rate)).withColumn("p", rate - F.floor(rate)) \
        .withColumn("need", F.col("target") - F.floor(rate) * F.col("source_size"))
    want = written(want, "targets")
    ranked = sizes.join(want.where("p > 0").withColumnRenamed("source", "to"), F.col("source").eqNullSafe(F.col("to"))) \
        .select("source", "size", "need", _cell().alias("cell"), _rank().alias("rank"))

    cells = ranked.groupBy("source", "cell", "need").agg(F.sum("size").alias("words"))
    along = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cut = cells.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0))) \
        .where("before < need and before + words >= need") \
        .select(F.col("source").alias("to"), F.col("cell").alias("cut_cell"), "before")
    edge = ranked.join(cut, F.col("source").eqNullSafe(F.col("to")) & (F.col("cell") == F.col("cut_cell")))
    step = Window.partitionBy("source").orderBy("rank")  # rows of equal rank share their sum
    edge = edge.withColumn("upto", F.col("before") + F.sum("size").over(step))
    # the last point below the target and the first at or above it, whichever is nearer
    under = F.col("upto") < F.col("need")
    near = edge.groupBy("source", "need", "cut_cell", "before").agg(
        F.max(F.when(under, F.col("rank"))).alias("low"), F.max(F.when(under, F.col("upto"))).alias("low_to"),
        F.min(F.when(~under, F.col("rank"))).alias("high"), F.min(F.when(~under, F.col("upto"))).alias("high_to"))
    low_gap = F.col("need") - F.coalesce("low_to", "before")
    stop = F.when(F.col("high_to") - F.col("need") < low_gap, F.col("high")).otherwise(F.coalesce("low", F.lit(-1.0)))
    near = near.select(F.col("source").alias("to"), "cut_cell", stop.alias("stop"))
    return want.join(near, F.col("source").eqNullSafe(F.col("to")), "left").drop("to", "need")


def _cell() -> Column:
    return F.floor(F.col("u") * (1 << BUCKET_BITS)).cast("int")  # rank grows with u within a source


def _rank() -> Column:
    return F.when(F.col("p") > 0, F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p"))))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``docs`` with size, source_size, target, copies and taken.

    ``keep``: the columns of ``docs`` to pass on (all unless given). They are
    written once with each row's size, so texts are counted once.

    ``copies`` is how often the mix takes the document (0, 1 or 2), ``taken``
    = copies * size. Null and empty texts have size 0. Null is a source of its
    own. Rows that tie in rank (rows that repeat a doc_id in a source) are
    taken together or not at all; of two equally near points the earlier one
    is used. Other columns pass through, but for those named like the new
    ones; an empty table gives no rows.
    """
    names = [c for c in (keep or docs.columns) if c not in ("size", "source_size", "target", "copies", "taken")]
    data = written(docs.select(*[F.col(c).alias(f"in_{c}") for c in names], F.col("source").cast("string").alias("source"),
                               word_count(F.col("text")).alias("size"), uniform(F.col("doc_id")).alias("u")), "sized")
    by = plan(data.select("source", "size", "u"), weights, share).select(F.col("source").alias("mix_source"), "source_size", "target", "whole",
                                            "p", "cut_cell", "stop")
    out = data.join(F.broadcast(by) if by.count() <= BROADCAST_SOURCES else by,
                    F.col("source").eqNullSafe(F.col("mix_source")), "left")
    extra = F.when(F.col("p") <= 0, F.lit(0)) \
        .when(F.col("cut_cell").isNull() | (_cell() < F.col("cut_cell")), F.lit(1)) \
        .when((_cell() == F.col("cut_cell")) & (_rank() <= F.col("stop")), F.lit(1)).otherwise(F.lit(0))
    out = out.withColumn("copies", (F.col("whole") + extra).cast("int"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).select(
        *[F.col(f"in_{c}").alias(c) for c in names], "size", "source_size", "target", "copies", "taken")
