"""Raw records of any producer to the unified record.

Every rule is a column expression over the raw struct (``transform`` over
result arrays), so the whole normalizer is one projection. Nothing can
throw: number parsing uses ``try_cast`` behind a syntax check, so a bad
field gives null instead of failing the record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serpframe.functions.followers import extract_followers
from serpframe.functions.numbers import coerce_int
from serpframe.functions.snippets import pick_longer, replace_snippet
from serpframe.functions.text import strip
from serpframe.functions.truthy import _col, first_nonempty, first_number_text, first_str
from serpframe.schemas import RAW_AD, RAW_ORGANIC, RAW_PAA

_EMPTY_MAP = "map<string,string>"

# JSON texts that stand for a falsy value (fixed values).
FALSY_JSON = ("", "{}", "[]", "null", '""', "0", "false")


def normalize_search_query(raw) -> Column:
    """term: searchQuery.term, query, searchTerm. page: coerced, 0 or bad -> 1."""
    r = _col(raw)
    sq = r["searchQuery"]
    term = first_str(sq["term"], r["query"], r["searchTerm"])
    page = F.coalesce(F.nullif(coerce_int(first_number_text(sq["page"], r["page"], F.lit("1"))), F.lit(0)), F.lit(1))
    return F.struct(term.alias("term"), page.cast("bigint").alias("page"))


def _empty(dtype) -> Column:
    return F.array().cast(f"array<{dtype.simpleString()}>")


def _with(x: Column, names: list[str], **new) -> Column:
    """The struct ``x`` (fields ``names``) with fields added."""
    return F.struct(*[x[n].alias(n) for n in names], *[c.alias(k) for k, c in new.items()])


def normalize_organic(raw) -> Column:
    """Raw results to unified results: aliases, best snippet, followers.

    Staged ``transform`` passes keep each intermediate value a struct field,
    so nothing is recomputed inside the lambdas (no common-subexpression
    elimination happens there).
    """
    r = _col(raw)
    recs = first_nonempty(r["organicResults"], r["searchResults"], _empty(RAW_ORGANIC))
    a_names = ["position", "title", "url", "displayedUrl", "snippet0", "siteLinks", "meta"]
    a = F.transform(recs, lambda o: F.struct(
        coerce_int(first_number_text(o["position"], o["rank"])).alias("position"),
        first_str(o["title"], o["resultTitle"]).alias("title"),
        first_str(o["url"], o["link"], o["resultUrl"]).alias("url"),
        first_str(o["displayedUrl"], o["visibleUrl"]).alias("displayedUrl"),
        first_str(o["snippet"], o["description"], o["resultSnippet"]).alias("snippet0"),
        first_nonempty(o["siteLinks"], F.array().cast("array<map<string,string>>")).alias("siteLinks"),
        first_nonempty(o["metatags"], o["meta"], F.create_map().cast(_EMPTY_MAP)).alias("meta")))
    b = F.transform(a, lambda x: _with(x, a_names,
                                       og=F.nullif(strip(F.try_element_at(x["meta"], F.lit("og:description"))), F.lit("")),
                                       tw=F.nullif(strip(F.try_element_at(x["meta"], F.lit("twitter:description"))),
                                                   F.lit(""))))
    b_names = a_names + ["og", "tw"]
    c = F.transform(b, lambda x: _with(x, a_names, best=pick_longer(x["og"], x["tw"])))
    c_names = a_names + ["best"]
    d = F.transform(c, lambda x: _with(x, c_names, snippet=replace_snippet(x["snippet0"], x["best"]),
                                       linkedin=F.coalesce(F.lower(x["url"]).contains("linkedin.com"), F.lit(False))))
    e = F.transform(d, lambda x: _with(x, c_names + ["snippet", "linkedin"],
                                       fb=F.when(x["linkedin"], extract_followers(x["best"]))))
    return F.transform(e, lambda x: _finish(x))


def _finish(x: Column) -> Column:
    info = F.when(x["linkedin"], F.coalesce(x["fb"], extract_followers(F.nullif(x["snippet"], F.lit("")))))
    return F.struct(
        x["position"].alias("position"), x["title"].alias("title"), x["url"].alias("url"),
        x["displayedUrl"].alias("displayedUrl"), x["snippet"].alias("snippet"), x["siteLinks"].alias("siteLinks"),
        F.when(F.size(x["meta"]) > 0, x["meta"]).alias("metatags"),
        info["followersText"].alias("connectionsText"), info["followersCount"].alias("connectionsCount"))


def follower_counts(raw) -> Column:
    """Audience text and count per organic result (linkedin URLs only)."""
    return F.transform(normalize_organic(raw),
                       lambda o: F.struct(o["url"].alias("url"), o["connectionsText"].alias("connections_text"),
                                          o["connectionsCount"].alias("connections_count")))


def normalize_paa(raw) -> Column:
    r = _col(raw)
    recs = first_nonempty(r["peopleAlsoAsk"], r["paa"], _empty(RAW_PAA))
    return F.transform(recs, lambda p: F.struct(p["question"].alias("question"), p["answer"].alias("answer"),
                                                p["url"].alias("url")))


def normalize_related(raw) -> Column:
    r = _col(raw)
    return first_nonempty(r["relatedSearches"], r["relatedQueries"], F.array().cast("array<string>"))


def normalize_ads(raw) -> Column:
    r = _col(raw)
    recs = first_nonempty(r["ads"], r["paidResults"], _empty(RAW_AD))
    return F.transform(recs, lambda a: F.struct(
        coerce_int(a["position"]).alias("position"), a["title"].alias("title"),
        first_str(a["url"], a["link"]).alias("url"),
        first_str(a["advertiser"], a["source"]).alias("advertiser"),
        first_str(a["description"], a["snippet"]).alias("snippet")))


def json_truthy(c) -> Column:
    """Null for missing JSON and for JSON texts of falsy values."""
    x = _col(c)
    return F.when(~F.trim(x).isin(*FALSY_JSON), x)


def normalize_ai_overview(raw) -> Column:
    r = _col(raw)
    return F.coalesce(json_truthy(r["aiOverview"]), json_truthy(r["ai_overview"]))


def typed_ai_overview(raw) -> Column:
    """The AI overview as a VARIANT, which keeps the type of all that is nested in it; null for broken JSON."""
    return F.try_parse_json(normalize_ai_overview(raw))


def normalize_record(raw) -> Column:
    """The unified record of one raw record."""
    return F.struct(
        normalize_search_query(raw).alias("searchQuery"),
        normalize_organic(raw).alias("organicResults"),
        normalize_paa(raw).alias("peopleAlsoAsk"),
        normalize_related(raw).alias("relatedSearches"),
        normalize_ads(raw).alias("ads"),
        normalize_ai_overview(raw).alias("aiOverview"),
    )


def normalize_items(df: DataFrame, raw_col: str = "raw", out_col: str = "record") -> DataFrame:
    """Replace the raw record column by the unified record; other columns stay."""
    return df.withColumn(out_col, normalize_record(raw_col)).drop(raw_col) if raw_col != out_col \
        else df.withColumn(out_col, normalize_record(raw_col))
