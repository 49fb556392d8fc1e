"""Response pages to search results: item positions, paging stop, mapping,
quota errors and the per-keyword result list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serpframe.functions.numbers import int_text
from serpframe.functions.snippets import best_snippet
from serpframe.functions.truthy import _col, first_str
from serpframe.options import SearchOptions
from serpframe.schemas import ERROR_BODY

# Error detail types read from quota errors (fixed values).
ERROR_INFO_TYPE = "type.googleapis.com/google.rpc.ErrorInfo"
HELP_TYPE = "type.googleapis.com/google.rpc.Help"
QUOTA_FIELDS = ("quota_limit", "quota_limit_value", "quota_metric", "quota_unit", "service", "consumer")


def explode_items(pages: DataFrame, per_page: int = 10, items_col: str = "items") -> DataFrame:
    """One row per result: ``idx`` from 1 within the page and
    ``position = (page - 1) * per_page + idx``."""
    keep = [c for c in pages.columns if c != items_col]
    return (pages.select(*keep, F.posexplode(items_col).alias("_i", "item"))
            .withColumn("idx", (F.col("_i") + 1).cast("int"))
            .withColumn("position", ((F.col("page") - 1) * per_page + F.col("idx")).cast("bigint"))
            .drop("_i"))


def map_item(item, position) -> Column:
    """Response item to a result: missing text becomes ``''``, the first
    metatag map is kept, the best snippet is chosen."""
    it = _col(item)
    metas = it["pagemap"]["metatags"]
    first_meta = F.when(F.size(metas) > 0, F.try_element_at(metas, F.lit(1)))
    meta = F.coalesce(first_meta, F.create_map().cast("map<string,string>"))
    og = F.try_element_at(meta, F.lit("og:description"))
    tw = F.try_element_at(meta, F.lit("twitter:description"))
    snippet = first_str(it["snippet"], it["htmlSnippet"], F.lit(""))
    return F.struct(
        _col(position).cast("bigint").alias("position"),
        F.coalesce(F.nullif(it["title"], F.lit("")), F.lit("")).alias("title"),
        F.coalesce(F.nullif(it["link"], F.lit("")), F.lit("")).alias("url"),
        F.coalesce(F.nullif(it["displayLink"], F.lit("")), F.lit("")).alias("displayedUrl"),
        best_snippet(snippet, og, tw).alias("snippet"),
        F.coalesce(it["pagemap"]["sitelinkssearchbox"], F.array().cast("array<map<string,string>>")).alias("siteLinks"),
        F.when(F.size(meta) > 0, meta).alias("metatags"),
    )


def map_items(items: DataFrame) -> DataFrame:
    """``explode_items`` output to mapped results with top-level title and url."""
    return (items.withColumn("result", map_item("item", "position")).drop("item")
            .withColumn("title", F.col("result.title")).withColumn("url", F.col("result.url")))


def page_cutoff(pages: DataFrame, key: str = "term", n_col: str = "n_items",
                total_col: str = "total_results") -> DataFrame:
    """Keep pages up to and including the first one that is empty or brings
    the items so far to the reported total.

    A missing total counts as ``"0"`` (paging stops after page 1); a total
    that is not an integer never stops paging. The window runs over pages of
    one search, which ``max_pages`` bounds, not over its items.
    """
    w = Window.partitionBy(key).orderBy("page")
    total = int_text(F.coalesce(F.col(total_col), F.lit("0")))
    so_far = F.sum(n_col).over(w.rowsBetween(Window.unboundedPreceding, 0))
    stop = (F.col(n_col) == 0) | (total.isNotNull() & (so_far >= total))
    earlier = F.max(F.col("_stop").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (pages.withColumn("_stop", stop)
            .withColumn("_earlier", F.coalesce(earlier, F.lit(0)))
            .filter(F.col("_earlier") == 0)
            .drop("_stop", "_earlier"))


def paging_summary(pages: DataFrame, key: str = "term", n_col: str = "n_items") -> DataFrame:
    """Pages and results per search."""
    return pages.groupBy(key).agg(F.count(F.lit(1)).alias("pages"), F.sum(n_col).alias("results"))


def supported_only(df: DataFrame, options: SearchOptions) -> DataFrame:
    """Nothing is fetched unless organic results alone are asked for; the
    constant predicate folds to an empty relation when false."""
    return df.filter(F.lit(options.supported))


def parse_quota_errors(df: DataFrame, status_col: str = "http_status", body_col: str = "body") -> DataFrame:
    """Read quota errors out of HTTP error bodies.

    A quota error is HTTP 403/429 with code 429, status RESOURCE_EXHAUSTED and
    some reason ``rateLimitExceeded``. Quota fields come from the first
    ErrorInfo detail, help links from every Help detail. Malformed bodies
    parse to null and are not quota errors.
    """
    keep = [c for c in df.columns if c != body_col]
    parsed = F.transform(F.array(F.col(body_col)), lambda b: F.from_json(b, ERROR_BODY, {"mode": "PERMISSIVE"})["error"])
    # the generator keeps the optimizer from copying the parse into each use
    df = df.select(*keep, F.explode(parsed).alias("_e"))
    err = F.col("_e")
    is_quota = (F.col(status_col).isin(403, 429) & (err["code"] == 429)
                & (err["status"] == "RESOURCE_EXHAUSTED")
                & F.exists(F.coalesce(err["errors"], F.array()), lambda e: e["reason"] == "rateLimitExceeded"))
    details = F.coalesce(err["details"], F.array())
    info = F.try_element_at(F.filter(details, lambda d: d["@type"] == ERROR_INFO_TYPE), F.lit(1))["metadata"]
    links = F.flatten(F.transform(F.filter(details, lambda d: d["@type"] == HELP_TYPE),
                                  lambda d: F.transform(F.coalesce(d["links"], F.array()), lambda x: x["url"])))
    out = df.select(*keep, F.coalesce(is_quota, F.lit(False)).alias("is_quota_error"), "_e",
                    info.alias("_m"), links.alias("_links"))
    q = F.col("is_quota_error")
    return out.select(
        *keep, "is_quota_error",
        F.when(q, F.col("_e.code")).alias("error_code"),
        F.when(q, F.col("_e.message")).alias("error_message"),
        *[F.when(q, F.try_element_at(F.col("_m"), F.lit(k))).alias(k) for k in QUOTA_FIELDS],
        F.when(q, F.col("_links")).alias("help_links"))


def collect_keyword_results(results: DataFrame, keyword_col: str = "input_row_id",
                            order_cols=("sub_idx", "page", "idx")) -> DataFrame:
    """All results of every keyword in input order: keyword, sub-query, page, item."""
    return results.orderBy(keyword_col, *order_cols)
