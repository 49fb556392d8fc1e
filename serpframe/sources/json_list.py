"""One JSON list of any size as a table of its elements, read by many tasks.

The file is read in fragments between commas, which Spark's text source splits
by byte ranges like lines. Whether a comma ends an element depends on
everything before it: on being inside a string, and on the depth of brackets.
Both are sums along the file. A fragment flips the string state if it holds an
odd number of quotes; what it adds to the depth is known for either state. So
each split is summed up for both states it may be entered with, the few rows
of a file's splits are followed in order, and every fragment then knows its
state. Fragments of one element are joined again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _depth(text: Column) -> Column:
    """Brackets opened less brackets closed."""
    n = F.length(text)
    return (n - F.length(F.translate(text, "[{", ""))) - (n - F.length(F.translate(text, "]}", "")))


def read_json_elements(spark: SparkSession, path: str) -> DataFrame:
    """``input_row_id`` (file, split, row) and ``element``, the JSON text of each element, nested ones whole.

    Every file under ``path`` must be one JSON list in UTF-8. A file that does
    not start with a list or ends inside one is an error. An empty list has no
    elements; whether an element is valid JSON is for the reader of its text.
    """
    f = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"), F.col("value"))
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # an escape never spans a comma
    pieces = F.split(bare, '"', -1)
    side = lambda k: F.array_join(F.filter("_pieces", lambda x, i: i % 2 == k), "")
    f = f.withColumn("_pieces", pieces).select(
        "file", "split", "row", "value", (F.size("_pieces") - 1).cast("bigint").alias("quotes"),
        _depth(side(0)).alias("plain"), _depth(side(1)).alias("inner"))
    along = Window.partitionBy("file", "split").orderBy("row")
    before, upto = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, 0)
    # a fragment's depth if its split is entered outside a string, and inside one
    odd = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    f = f.withColumn("odd", odd).withColumn("q", F.sum("quotes").over(upto)) \
        .withColumn("d0", F.when(F.col("odd") == 0, F.col("plain")).otherwise(F.col("inner"))) \
        .withColumn("d1", F.when(F.col("odd") == 0, F.col("inner")).otherwise(F.col("plain"))) \
        .withColumn("d0", F.sum("d0").over(upto)).withColumn("d1", F.sum("d1").over(upto)) \
        .drop("odd", "quotes", "plain", "inner")
    splits = f.groupBy("file", "split").agg(F.max_by(F.struct("q", "d0", "d1"), F.col("row")).alias("s")).select("file", "split", "s.*")
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("in_q", F.coalesce(F.sum("q").over(earlier), F.lit(0)) % 2)
    own = F.when(F.col("in_q") == 0, F.col("d0")).otherwise(F.col("d1"))
    splits = splits.withColumn("own", own).select(
        F.col("file").alias("_f"), F.col("split").alias("_s"), "in_q",
        F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("in_d"))
    same = (F.col("file") == F.col("_f")) & (F.col("split") == F.col("_s"))
    f = f.join(splits, same).withColumn("depth", F.col("in_d") + F.when(F.col("in_q") == 0, F.col("d0")).otherwise(F.col("d1"))) \
        .withColumn("open", (F.col("in_q") + F.col("q")) % 2).drop("_f", "_s", "q", "d0", "d1", "in_q", "in_d")
    ends = (F.col("open") == 0) & (F.col("depth") == 1)
    f = f.withColumn("ends", ends.cast("bigint"))
    per = f.groupBy("file", "split").agg(F.sum("ends").alias("n"), F.max("row").alias("end"))
    per = per.select(F.col("file").alias("_f"), F.col("split").alias("_s"),
                     F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"),
                     F.when(F.lead("split").over(Window.partitionBy("file").orderBy("split")).isNull(), F.col("end")).alias("end"))
    f = f.join(per, same).withColumn("closes", F.coalesce(F.col("row") == F.col("end"), F.lit(False)))
    number = F.col("ahead") + F.coalesce(F.sum("ends").over(before), F.lit(0))
    joined = f.withColumn("number", number).groupBy("file", "number").agg(
        F.min(F.struct("split", "row")).alias("first"), F.max_by(F.struct("open", "depth", "closes"), F.struct("split", "row")).alias("last"),
        F.array_sort(F.collect_list(F.struct("split", "row", "value"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), ",")
    first, final = F.col("number") == 0, F.col("last.closes")
    sound = (~first | text.rlike(r"^\s*\[")) & (~final | ((F.col("last.open") == 0) & (F.col("last.depth") == 0) & text.rlike(r"\]\s*$")))
    body = F.when(first, F.regexp_replace("text", r"^\s*\[", "")).otherwise(F.col("text"))
    body = F.when(final, F.regexp_replace(body, r"\]\s*$", "")).otherwise(body)
    broken = F.raise_error(F.concat(F.lit("not one JSON list: "), F.col("file")))
    out = joined.withColumn("text", F.when(sound, text).otherwise(broken.cast("string"))).withColumn("element", F.trim(body, F.lit(" \t\r\n")))
    only = first & final & (F.col("element") == "")  # an empty list
    return out.where(~only).select(F.struct(F.col("file"), F.col("first.split").alias("split"), F.col("first.row").alias("row"))
                                   .alias("input_row_id"), "element")
