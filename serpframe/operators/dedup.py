"""First-wins dedup of queries (with audit trail) and of results.

"First row per key" is an aggregation (``min`` / ``min_by``) rather than a
``row_number`` window: the aggregation combines map-side, so a key that
holds a large share of all rows never lands whole in one task. Where every
row must come back with a flag, the per-key winners (one row per key) are
joined back; AQE broadcasts them when small and splits skewed partitions
when not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serpframe.functions import text as T
from serpframe.operators.compose import drop_blank_queries
from serpframe.options import SearchOptions


def annotate_queries(df: DataFrame, options: SearchOptions, col: str = "original_input") -> DataFrame:
    """Add ``final_query`` (what is sent) and the dedup hash.

    The dedup key gets one cleaning pass and the sent query too; the
    sub-query step cleans again.
    """
    sites = list(options.profile_sites)
    final = T.apply_site_filters(T.clean_query(F.col(col)), sites)
    return (df.withColumn("final_query", final)
              .withColumn("normalized_query_hash",
                          T.query_hash(T.collapse_ws(F.lower(F.col("final_query"))))))


def dedup_queries(df: DataFrame, options: SearchOptions, col: str = "original_input",
                  id_col: str = "input_row_id") -> DataFrame:
    """First row per normalized query, in input order; the raw text goes on."""
    a = annotate_queries(drop_blank_queries(df, col), options, col)
    cols = [id_col, col, "final_query", "normalized_query_hash"]
    if options.allow_duplicates:
        return a.select(*cols)
    w = F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(id_col)).alias("w")
    return a.groupBy("normalized_query_hash").agg(w).select("w.*")


def query_audit(df: DataFrame, options: SearchOptions, now: Column | None = None,
                col: str = "original_input", id_col: str = "input_row_id") -> DataFrame:
    """One audit row per non-blank input with a ``deduplicated`` flag."""
    ts = now if now is not None else F.current_timestamp()
    a = annotate_queries(drop_blank_queries(df, col), options, col)
    if options.allow_duplicates:
        flagged = a.withColumn("deduplicated", F.lit(False))
    else:
        firsts = a.groupBy("normalized_query_hash").agg(F.min(id_col).alias("_first_id"))
        # no hash is null here; a plain equality would have each one computed again, where the table is read, to test that
        flagged = (a.join(firsts.withColumnRenamed("normalized_query_hash", "_hash"), F.col("normalized_query_hash").eqNullSafe(F.col("_hash")))
                    .withColumn("deduplicated", F.col(id_col) != F.col("_first_id")))
    return flagged.select(id_col, F.col(col).alias("original_input"), "final_query",
                          "normalized_query_hash", ts.alias("timestamp"), "deduplicated")


def query_dedup_stats(df: DataFrame, options: SearchOptions, col: str = "original_input",
                      id_col: str = "input_row_id") -> DataFrame:
    """Parsed (all input rows), unique (sent) and skipped (duplicate) counts, one row."""
    blank = F.col(col).isNull() | (T.strip(F.col(col)) == "")
    parsed = F.coalesce(F.sum("_n"), F.lit(0)).alias("parsed")
    if options.allow_duplicates:
        return df.select(blank.alias("_blank")).groupBy("_blank").agg(F.count(F.lit(1)).alias("_n")).agg(
            parsed, F.coalesce(F.sum(F.when(~F.col("_blank"), F.col("_n"))), F.lit(0)).alias("unique"),
            F.lit(0).cast("bigint").alias("skipped"))
    # blank inputs share the null hash; every other hash is one query sent
    a = annotate_queries(df, options, col).select(
        F.when(~blank, F.col("normalized_query_hash")).alias("_hash"))
    per = a.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    sent = F.count("_hash")
    kept = F.coalesce(F.sum(F.when(F.col("_hash").isNotNull(), F.col("_n"))), F.lit(0))
    return per.agg(parsed, sent.alias("unique"), (kept - sent).alias("skipped"))


def result_key(title: Column, url: Column, page: Column, term: Column) -> tuple[Column, Column]:
    """(title, url), or (page, term) when both are empty."""
    empty = (title == "") & (url == "")
    return (F.when(empty, page.cast("string")).otherwise(title),
            F.when(empty, F.coalesce(term, F.lit(""))).otherwise(url))


def dedup_results(df: DataFrame, keyword_col: str = "input_row_id",
                  order_cols=("sub_idx", "page", "idx")) -> DataFrame:
    """Per keyword, first result per (title, url) across its sub-queries and pages.

    Expects ``title``, ``url``, ``page`` and ``term`` columns (strings, with
    missing values as ``''``). No dedup across keywords.
    """
    k1, k2 = result_key(F.col("title"), F.col("url"), F.col("page"), F.col("term"))
    keyed = df.withColumn("_k1", k1).withColumn("_k2", k2)
    order = F.struct(*[F.col(c) for c in order_cols])
    payload = F.struct(*[F.col(c) for c in df.columns])
    return (keyed.groupBy(keyword_col, "_k1", "_k2")
            .agg(F.min_by(payload, order).alias("_r"))
            .select("_r.*"))
