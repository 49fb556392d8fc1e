"""Landed responses and the structured log as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serpframe.schemas import LOG_EVENT, RESPONSE_RECORD


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Landed response pages (JSON Lines, explicit schema). ``fetched_at``
    falls back to the file's modification time, as a cache file's age does."""
    return stamped(spark.read.schema(RESPONSE_RECORD).json(path))


def stamped(responses: DataFrame) -> DataFrame:
    """A missing ``fetched_at`` becomes the modification time of the file (batch or stream)."""
    return responses.withColumn("fetched_at",
                                F.coalesce(F.col("fetched_at"), F.col("_metadata.file_modification_time")))


def response_pages(responses: DataFrame) -> DataFrame:
    """One row per landed page with its items and reported total."""
    return responses.select("request_key", "term", "page", "fetched_at",
                            F.col("body.items").alias("items"),
                            F.col("body.searchInformation.totalResults").alias("total_results"),
                            F.coalesce(F.size("body.items"), F.lit(0)).cast("bigint").alias("n_items"))


def read_log_events(spark: SparkSession, path: str) -> DataFrame:
    """Structured log lines (one JSON object per line).

    The known keys are typed. Any other key goes, with its JSON type and all
    that is nested in it, into the variant object ``extra`` (null when there
    is none); a key that stands twice keeps its last value. A line that is no JSON object, blank lines aside, is kept
    whole in ``broken``, with every other column null, so lines are counted
    and never lost.
    """
    line = spark.read.text(path).where(F.trim("value") != "").select(
        "value", F.from_json("value", LOG_EVENT).alias("e"), F.from_json("value", "map<string,variant>").alias("m"),
        (F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT")).alias("whole"))
    ok = F.coalesce(F.col("whole"), F.lit(False))
    rest = F.map_filter("m", lambda k, v: ~k.isin(*LOG_EVENT.fieldNames()))
    known = [F.when(ok, F.col(f"e.{f}")).alias(f) for f in LOG_EVENT.fieldNames()]
    return line.select(*known, F.when(ok & (F.size(rest) > 0), F.to_variant_object(rest)).alias("extra"),
                       F.when(~ok, F.col("value")).alias("broken"))


def extra_fields(logs: DataFrame) -> DataFrame:
    """One row for each top-level key of ``extra`` in each line: the line's columns, ``key``, ``kind`` and ``value``.

    ``kind`` is the JSON type (BIGINT, DECIMAL, DOUBLE, STRING, BOOLEAN, ARRAY,
    OBJECT, VOID for null); ``value`` stays a variant, to be read with
    ``variant_get`` and a path. Lines without extras give no rows.
    """
    rows = logs.where(F.col("extra").isNotNull())
    spread = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("extra").outer()))
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    return spread.select(*[c for c in logs.columns if c != "extra"], "key", kind.alias("kind"), "value")
