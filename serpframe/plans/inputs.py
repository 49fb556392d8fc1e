"""Nested inputs built from the fixture views: landed response pages and raw
producer records. Fixture shaping only; the operators run on the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from serpframe.schemas import RAW_AD, RAW_ORGANIC, RAW_PAA, RAW_RECORD, RESPONSE_ITEM


def struct_of(dtype: StructType, **values) -> Column:
    """A struct of ``dtype``; fields not given are typed nulls."""
    return F.struct(*[(values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name)
                      for f in dtype.fields])


def landed_pages(items: DataFrame, fetched_at: Column) -> DataFrame:
    """Group the one-row-per-result item view into response pages.

    Each group is one page of one search, so it holds at most ``per_page``
    items; ``total_results`` is constant per search.
    """
    meta = F.map_filter(F.create_map(F.lit("og:description"), F.col("og_description"),
                                     F.lit("twitter:description"), F.col("twitter_description")),
                        lambda k, v: v.isNotNull())
    item = struct_of(RESPONSE_ITEM,
                     title=F.col("title"), link=F.col("link"), snippet=F.col("snippet"),
                     displayLink=F.regexp_extract("link", r"^https?://([^/]+)", 1),
                     pagemap=F.struct(F.array(meta).alias("metatags"),
                                      F.lit(None).cast("array<map<string,string>>").alias("sitelinkssearchbox")))
    return (items.groupBy("term", "page")
            .agg(F.array_sort(F.collect_list(F.struct(F.col("idx"), item.alias("item"))),
                              lambda a, b: F.when(a["idx"] < b["idx"], -1).when(a["idx"] > b["idx"], 1)
                              .otherwise(0)).alias("_items"),
                 F.first("total_results").alias("total_results"))
            .select("term", F.col("page").cast("bigint").alias("page"), fetched_at.alias("fetched_at"),
                    "total_results", F.transform("_items", lambda x: x["item"]).alias("items"),
                    F.size("_items").cast("bigint").alias("n_items")))


def raw_records(flat: DataFrame) -> DataFrame:
    """Raw producer records (aliases at every level) from ``v_raw_flat``."""
    c = F.col
    org = struct_of(RAW_ORGANIC, position=c("position"), title=c("title"), resultTitle=c("result_title"),
                    url=c("url"), link=c("link"), resultUrl=c("result_url"), snippet=c("snippet"),
                    description=c("description"),
                    metatags=F.when(c("og").isNotNull(), F.create_map(F.lit("og:description"), c("og"))))
    paa = struct_of(RAW_PAA, question=c("paa_question"), answer=c("paa_answer"), url=c("paa_url"))
    ad = struct_of(RAW_AD, position=c("ad_position"), title=c("ad_title"), url=c("ad_url"), link=c("ad_link"),
                   advertiser=c("ad_advertiser"), source=c("ad_source"), description=c("ad_description"),
                   snippet=c("ad_snippet"))
    raw = struct_of(
        RAW_RECORD,
        searchQuery=F.struct(c("sq_term").alias("term"), c("sq_page").alias("page")),
        query=c("query"), searchTerm=c("search_term"),
        organicResults=F.when(c("in_organic"), F.array(org)),
        searchResults=F.when(~c("in_organic"), F.array(org)),
        peopleAlsoAsk=F.when(c("paa_in_main"), F.array(paa)),
        paa=F.when(~c("paa_in_main"), F.array(paa)),
        relatedSearches=F.when(c("rs_item").isNotNull(), F.array(c("rs_item"))),
        relatedQueries=F.when(c("rq_item").isNotNull(), F.array(c("rq_item"), F.lit(""))),
        ads=F.when(c("ad_in_main"), F.array(ad)),
        paidResults=F.when(~c("ad_in_main"), F.array(ad)),
        aiOverview=c("ai_main"), ai_overview=c("ai_alt"))
    return flat.select("doc_id", raw.alias("raw"))


def mapped_to_raw(result: Column, term: Column, page: Column) -> Column:
    """A search-item result as a one-result raw record (how the scraper hands
    results on)."""
    r = result
    org = struct_of(RAW_ORGANIC, position=r["position"].cast("string"), title=r["title"], url=r["url"],
                    displayedUrl=r["displayedUrl"], snippet=r["snippet"], siteLinks=r["siteLinks"],
                    metatags=r["metatags"])
    return struct_of(RAW_RECORD, searchQuery=F.struct(term.alias("term"), page.cast("string").alias("page")),
                     searchResults=F.array(org))
