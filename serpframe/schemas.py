"""Explicit schemas for landed responses, raw records and unified records."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, IntegerType, LongType, MapType, StringType,
                               StructField, StructType, TimestampType)

S = StringType()
L = LongType()
SMAP = MapType(S, S)


def _struct(*names, t=S) -> StructType:
    return StructType([StructField(n, t) for n in names])


# One item of a search API response page.
RESPONSE_ITEM = StructType([
    StructField("title", S), StructField("link", S), StructField("snippet", S),
    StructField("htmlSnippet", S), StructField("displayLink", S),
    StructField("pagemap", StructType([
        StructField("metatags", ArrayType(SMAP)),
        StructField("sitelinkssearchbox", ArrayType(SMAP)),
    ])),
])

# A response body as landed (one JSON object per request).
RESPONSE_BODY = StructType([
    StructField("items", ArrayType(RESPONSE_ITEM)),
    StructField("searchInformation", _struct("totalResults")),
])

# A landed response with the request it answers.
RESPONSE_RECORD = StructType([
    StructField("request_key", S),
    StructField("term", S),
    StructField("page", L),
    StructField("fetched_at", TimestampType()),
    StructField("body", RESPONSE_BODY),
])

# A search result as mapped from a response item.
MAPPED_RESULT = StructType([
    StructField("position", L), StructField("title", S), StructField("url", S),
    StructField("displayedUrl", S), StructField("snippet", S),
    StructField("siteLinks", ArrayType(SMAP)), StructField("metatags", SMAP),
])

# A result of any producer: every alias a producer may use.
RAW_ORGANIC = StructType([
    StructField("position", S), StructField("rank", S),
    StructField("title", S), StructField("resultTitle", S),
    StructField("url", S), StructField("link", S), StructField("resultUrl", S),
    StructField("displayedUrl", S), StructField("visibleUrl", S),
    StructField("snippet", S), StructField("description", S), StructField("resultSnippet", S),
    # ``sitelinks`` is the same column as ``siteLinks`` under Spark's
    # case-insensitive field resolution, so only one spelling is declared.
    StructField("siteLinks", ArrayType(SMAP)),
    StructField("metatags", SMAP), StructField("meta", SMAP),
    StructField("connectionsText", S), StructField("connections_text", S),
    StructField("connectionsCount", L), StructField("connections_count", L),
])
RAW_PAA = _struct("question", "answer", "url")
RAW_AD = _struct("position", "title", "url", "link", "advertiser", "source", "description", "snippet")

# A raw record (one page or one result of one search), with field aliases.
RAW_RECORD = StructType([
    StructField("searchQuery", _struct("term", "page")),
    StructField("query", S), StructField("searchTerm", S), StructField("page", S),
    StructField("organicResults", ArrayType(RAW_ORGANIC)),
    StructField("searchResults", ArrayType(RAW_ORGANIC)),
    StructField("peopleAlsoAsk", ArrayType(RAW_PAA)), StructField("paa", ArrayType(RAW_PAA)),
    StructField("relatedSearches", ArrayType(S)), StructField("relatedQueries", ArrayType(S)),
    StructField("ads", ArrayType(RAW_AD)), StructField("paidResults", ArrayType(RAW_AD)),
    StructField("aiOverview", S), StructField("ai_overview", S),
    StructField("fetchedAt", S), StructField("createdAt", S),
])

# The unified record every producer is brought to.
UNIFIED_ORGANIC = StructType([
    StructField("position", L), StructField("title", S), StructField("url", S),
    StructField("displayedUrl", S), StructField("snippet", S),
    StructField("siteLinks", ArrayType(SMAP)), StructField("metatags", SMAP),
    StructField("connectionsText", S), StructField("connectionsCount", L),
])
UNIFIED_PAA = RAW_PAA
UNIFIED_AD = StructType([
    StructField("position", L), StructField("title", S), StructField("url", S),
    StructField("advertiser", S), StructField("snippet", S),
])
UNIFIED_RECORD = StructType([
    StructField("searchQuery", StructType([StructField("term", S), StructField("page", L)])),
    StructField("organicResults", ArrayType(UNIFIED_ORGANIC)),
    StructField("peopleAlsoAsk", ArrayType(UNIFIED_PAA)),
    StructField("relatedSearches", ArrayType(S)),
    StructField("ads", ArrayType(UNIFIED_AD)),
    StructField("aiOverview", S),
])

# Error body of a failed request.
ERROR_BODY = StructType([StructField("error", StructType([
    StructField("code", IntegerType()), StructField("status", S), StructField("message", S),
    StructField("errors", ArrayType(_struct("reason"))),
    StructField("details", ArrayType(StructType([
        StructField("@type", S), StructField("metadata", SMAP),
        StructField("links", ArrayType(_struct("url"))),
    ]))),
]))])

# Structured log line: seven fixed keys and the context keys (fixed values);
# any other key goes to ``extra``.
LOG_EVENT = StructType([
    StructField("timestamp", S), StructField("level", S), StructField("logger", S),
    StructField("module", S), StructField("function", S), StructField("line", L),
    StructField("message", S), StructField("query_id", S), StructField("keyword", S),
    StructField("action", S), StructField("status", S),
    StructField("page", L), StructField("items_count", L), StructField("start_index", L),
    StructField("results_per_page", L), StructField("max_pages", L), StructField("pages", L),
    StructField("total_results", S), StructField("requested_max_pages", L),
])

AUDIT_ROW = StructType([
    StructField("input_row_id", L), StructField("original_input", S), StructField("final_query", S),
    StructField("normalized_query_hash", S), StructField("timestamp", TimestampType()),
    StructField("deduplicated", BooleanType()),
])
