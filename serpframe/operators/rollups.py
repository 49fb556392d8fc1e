"""Totals on several levels in one scan, and distinct counts that can be merged."""

from __future__ import annotations

import os
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_KEYS = ("logger", "action", "status", "level")
LOG_SETS = (LOG_KEYS, ("logger", "level"), ("action", "status"), ("level",), ())


def log_rollup_sets(logs: DataFrame, sets: Sequence[Sequence[str]] = LOG_SETS, keys: Sequence[str] = LOG_KEYS) -> DataFrame:
    """Log lines and items per grouping set of ``keys``, in one scan.

    ``grouping_id`` has a bit for each key, the first key the highest, set
    where the row is a total over it: so a null key (bit 0) and a total over
    the key (bit 1) differ. Sets and keys with equal rows are not joined.
    """
    return logs.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in keys]) \
        .agg(F.grouping_id().cast("bigint").alias("grouping_id"), F.count(F.lit(1)).alias("n"),
             F.sum("items_count").cast("bigint").alias("items"))


def usage_cube(requests: DataFrame, ts: str = "ts", ok: str = "ok", key: str = "request_key") -> DataFrame:
    """Requests by day and outcome with all totals: (day, ok), (day), (ok), ().

    ``grouping_id``: 2 a total over days, 1 a total over outcomes, 3 both.
    """
    days = requests.select(F.to_date(ts).alias("day"), ok)
    return days.cube("day", ok).agg(F.grouping_id().cast("bigint").alias("grouping_id"), F.count(F.lit(1)).alias("n"))


class DailySketches:
    """Distinct values per day as sketches that can be merged over any range of days.

    Each batch of rows adds one row a day with two sketches, a few KB each,
    in a folder of its own: HyperLogLog for unions, theta for what two ranges
    have in common. Rows are read once, when they are added; a batch that is
    added again replaces itself. The relative standard error of ``distinct``
    is 1.04 / sqrt(2**lg_k), 1.6 % for 12; the size is bound by ``lg_k``, not by the data.
    Null values are not counted; rows without a time are left out.
    """

    SCHEMA = "day date, n long, hll binary, theta binary"

    def __init__(self, spark: SparkSession, path: str, lg_k: int = 12):
        self.spark, self.path, self.lg_k = spark, path, int(lg_k)

    @property
    def relative_error(self) -> float:
        return 1.04 / 2 ** (self.lg_k / 2)

    def add(self, batch: int, rows: DataFrame, value: str, ts: str = "ts") -> None:
        days = rows.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(
            F.count(value).alias("n"), F.hll_sketch_agg(F.col(value), self.lg_k).alias("hll"),
            F.theta_sketch_agg(F.col(value), self.lg_k).alias("theta"))
        days.write.mode("overwrite").parquet(os.path.join(self.path, f"batch={int(batch)}"))

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA + ", batch long").parquet(self.path)

    def _within(self, first: str, last: str) -> DataFrame:
        return self.rows().where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))

    def distinct(self, ranges: Sequence[tuple[str, str]]) -> DataFrame:
        """first_day, last_day, n and the estimate of distinct values for each range of days, both ends included."""
        asked = self.spark.createDataFrame([(a, b) for a, b in ranges], "first_day string, last_day string") \
            .select(F.col("first_day").cast("date"), F.col("last_day").cast("date"))
        # a handful of ranges against a row a day and batch
        met = F.broadcast(asked).join(self.rows(), F.col("day").between(F.col("first_day"), F.col("last_day")), "left")
        return met.groupBy("first_day", "last_day").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
            F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("hll")), F.lit(0)).alias("distinct"))

    def in_both(self, one: tuple[str, str], other: tuple[str, str]) -> DataFrame:
        """One row: the estimate of the values that occur in both ranges of days."""
        a = self._within(*one).agg(F.theta_union_agg("theta", self.lg_k).alias("s"))
        b = self._within(*other).agg(F.theta_union_agg("theta", self.lg_k).alias("s"))
        return a.unionByName(b).agg(F.theta_sketch_estimate(F.theta_intersection_agg("s")).alias("in_both"))
