"""Browsing results: text filter, pages, limits and a query preview."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serpframe.operators.ordered import in_order, total_order, written
from serpframe.options import SearchOptions


def filter_results(df: DataFrame, text: str | None, cols: Sequence[str] = ("query", "title", "url")) -> DataFrame:
    """Case-insensitive substring in any of ``cols``; blank keeps all."""
    q = (text or "").lower()
    if not q:
        return df
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False))
    return df.filter(cond)


def ranged_pages(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` in sorted ranges, written once, for ``page_of``: keep it to turn many pages.

    ``df`` is gone over twice, to sample the ranges and to sort; write one that is dear to compute first (``written``).
    """
    return in_order(df, total_order(df, order), "pages")


def page_of(ranged: DataFrame, page: int, per_page: int = 100) -> DataFrame:
    """Rows of one page (1-based) of ``ranged_pages``, in order; reads the ranges that hold them only."""
    skip = (max(1, int(page)) - 1) * per_page
    sizes = ranged.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, held = 0, F.lit(False)
    for r in sizes:  # a row for each range
        lo, hi = max(skip, before) - before, min(skip + per_page, before + r["n"]) - before
        if lo < hi:
            held = held | F.col("_at").between((r["part"] << 33) + lo, (r["part"] << 33) + hi - 1)
        before += r["n"]
    return ranged.where(held).orderBy("_at").drop("_at", "_chunk")


def page_results(df: DataFrame, page: int, per_page: int = 100, order: Sequence[str] = ()) -> DataFrame:
    """Rows of one page (1-based) in ``order``, which must name a column; the slice is the feature.

    Rows that tie in ``order`` are ordered by their other columns, so the pages
    together are the table, each row once. A first page is a top-k. For a
    page further on, the rows are computed and written once, ranged into sorted
    partitions and written again; the partitions are counted and only those that hold rows of the page
    are read on, so no task orders the rows of all pages before it. To turn
    many pages, keep ``ranged_pages`` and take ``page_of`` it.
    """
    page = max(1, int(page))
    if page <= 10:
        return df.orderBy(*total_order(df, order)).offset((page - 1) * per_page).limit(per_page)
    return page_of(ranged_pages(written(df, "rows"), order), page, per_page)


def total_pages(df: DataFrame, per_page: int = 100) -> DataFrame:
    """One row: max(1, ceil(rows / per_page))."""
    return df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / per_page)).cast("bigint").alias("total_pages"))


def limit_results(df: DataFrame, limit: int | None, order: Sequence[str] = ()) -> DataFrame:
    """First ``limit`` rows in ``order``; None or 0 keeps all; negative is an error."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    ordered = df.orderBy(*order) if order else df
    return ordered.limit(limit) if limit else ordered


def result_counts(df: DataFrame, limit: int | None) -> DataFrame:
    """One row: total_results, and returned_results under ``limit`` (None or 0 returns all)."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    total = df.agg(F.count(F.lit(1)).alias("total_results"))
    back = F.least(F.col("total_results"), F.lit(limit)) if limit else F.col("total_results")
    return total.withColumn("returned_results", back.cast("bigint"))


def preview_queries(df: DataFrame, options: SearchOptions, n: int = 5, col: str = "original_input",
                    id_col: str = "input_row_id") -> DataFrame:
    """First ``n`` queries with the site filters the UI would add.

    The UI rule differs from the sent query's: every filter counts (no
    ``site:`` check) and an empty domain is skipped.
    """
    sites = [s for s in options.profile_sites if s is not None]
    q = F.col(col)
    first = df.orderBy(id_col).limit(n)
    if not sites:
        return first.select(id_col, q.alias("preview"))
    domains = [s.split(":")[1] if ":" in s else None for s in sites]
    present = F.lit(False)
    for d in domains:
        if d:
            present = present | F.lower(q).contains(d)
    suffix = " (" + " OR ".join(sites) + ")"
    blank = q.isNull() | (F.trim(q) == "")
    return first.select(id_col, F.when(blank | present, q).otherwise(F.concat(q, F.lit(suffix))).alias("preview"))
