"""Platform names to ``site:`` filters: the platform dimension, name
normalization and validation, conversion, suggestions and list processing.

The dimension has 57 fixed rows, so every rule that consults it is a
column expression built from the constants (a ``CASE`` chain or a constant
array filtered per row): no join, no shuffle, and the constant's size does
not grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serpframe.functions.text import strip
from serpframe.functions.truthy import _col, let

# ---------------------------------------------------------------- fixed values
# Platform key -> site filter, in lookup order (the first containing key wins).
PLATFORM_SITES = [
    ("linkedin", "site:linkedin.com/in"),
    ("linkedin vietnam", "site:vn.linkedin.com/in"),
    ("facebook", "site:facebook.com"),
    ("twitter", "site:twitter.com"),
    ("instagram", "site:instagram.com"),
    ("tiktok", "site:tiktok.com"),
    ("snapchat", "site:snapchat.com"),
    ("pinterest", "site:pinterest.com"),
    ("tumblr", "site:tumblr.com"),
    ("discord", "site:discord.com"),
    ("telegram", "site:t.me"),
    ("whatsapp", "site:wa.me"),
    ("github", "site:github.com"),
    ("stack overflow", "site:stackoverflow.com"),
    ("dev.to", "site:dev.to"),
    ("hackernews", "site:news.ycombinator.com"),
    ("reddit", "site:reddit.com"),
    ("youtube", "site:youtube.com"),
    ("vimeo", "site:vimeo.com"),
    ("twitch", "site:twitch.tv"),
    ("medium", "site:medium.com"),
    ("flickr", "site:flickr.com"),
    ("behance", "site:behance.net"),
    ("dribbble", "site:dribbble.com"),
    ("crunchbase", "site:crunchbase.com"),
    ("angellist", "site:angel.co"),
    ("producthunt", "site:producthunt.com"),
    ("kickstarter", "site:kickstarter.com"),
    ("indiegogo", "site:indiegogo.com"),
    ("patreon", "site:patreon.com"),
    ("quora", "site:quora.com"),
    ("slideshare", "site:slideshare.net"),
    ("scribd", "site:scribd.com"),
    ("issuu", "site:issuu.com"),
    ("academia", "site:academia.edu"),
    ("researchgate", "site:researchgate.net"),
    ("orcid", "site:orcid.org"),
    ("scholar", "site:scholar.google.com"),
    ("arxiv", "site:arxiv.org"),
    ("pubmed", "site:pubmed.ncbi.nlm.nih.gov"),
    ("ieee", "site:ieee.org"),
    ("acm", "site:dl.acm.org"),
    ("springer", "site:link.springer.com"),
    ("elsevier", "site:sciencedirect.com"),
    ("wiley", "site:onlinelibrary.wiley.com"),
    ("nature", "site:nature.com"),
    ("science", "site:science.org"),
    ("cell", "site:cell.com"),
    ("plos", "site:journals.plos.org"),
    ("bmc", "site:bmc.com"),
    ("frontiers", "site:frontiersin.org"),
    ("mdpi", "site:mdpi.com"),
    ("hindawi", "site:hindawi.com"),
    ("cogent", "site:cogentoa.com"),
    ("sage", "site:journals.sagepub.com"),
    ("taylor", "site:tandfonline.com"),
    ("emerald", "site:emerald.com"),
]
# Validation messages.
MSG_EMPTY = "Platform name cannot be empty"
MSG_CHARS = "Platform name contains invalid characters"
MSG_LONG = "Platform name is too long"
# ------------------------------------------------------------------------------


def display_name(key: str) -> str:
    """Display name as the UI shows it: Python title case (``dev.to`` -> ``Dev.To``)."""
    return key.title()


def platforms(spark: SparkSession) -> DataFrame:
    """The platform dimension: ordinal, key, display name, site filter, domain."""
    rows = [(i, k, display_name(k), s, s.replace("site:", "")) for i, (k, s) in enumerate(PLATFORM_SITES)]
    return spark.createDataFrame(rows, "ordinal int, key string, name string, site_filter string, domain string")


def normalize_platform(c) -> Column:
    """Lower, trim, strip ``www.``, ``http://``, ``https://``, ``site:`` once
    each in that order, trailing slashes, then a final profile path part."""
    s = F.lower(strip(_col(c)))
    for prefix in ("www.", "http://", "https://", "site:"):
        s = F.regexp_replace(s, "^" + prefix.replace(".", r"\."), "")
    s = F.regexp_replace(s, "/+$", "")
    s = F.regexp_replace(s, "/(in|profile|user|u)/?$", "")
    return F.coalesce(s, F.lit(""))


def validate_platform(c) -> Column:
    """``struct(valid, error)``: blank, bad characters or over 100 characters."""
    raw = _col(c)
    blank = raw.isNull() | (strip(raw) == "")

    def body(n):
        bad = ~n.rlike(r"(?U)^[a-zA-Z0-9\s.\-_/]+$")
        return F.when(blank, F.lit(MSG_EMPTY)).when(bad, F.lit(MSG_CHARS)).when(F.length(n) > 100, F.lit(MSG_LONG))
    err = let(normalize_platform(raw), body)
    return let(err, lambda e: F.struct(e.isNull().alias("valid"), e.alias("error")))


def platform_to_site(c) -> Column:
    """A platform name to a ``site:`` filter.

    ``site:`` input is kept as is; an exact key; else the first key (in
    dimension order) that contains the name or is contained in it; else a
    dotted name becomes ``site:<name>`` (``/in`` added for linkedin); a bare
    word becomes ``site:<word>.com``; anything else ``site:<name>``.
    """
    raw = _col(c)
    exact_map = F.create_map(*[F.lit(x) for kv in PLATFORM_SITES for x in kv])

    def body(n):
        loose = F.try_element_at(F.filter(_dimension_array(), lambda p: p["key"].contains(n) | n.contains(p["key"])),
                                 F.lit(1))["site_filter"]
        dotted = F.concat(F.lit("site:"), n,
                          F.when(n.contains("linkedin") & ~n.endswith("/in"), F.lit("/in")).otherwise(F.lit("")))
        fallback = (F.when(n.contains("."), dotted)
                    .when(~n.contains(" "), F.concat(F.lit("site:"), n, F.lit(".com")))
                    .otherwise(F.concat(F.lit("site:"), n)))
        return F.coalesce(F.try_element_at(exact_map, n), loose, fallback)
    return (F.when(raw.isNull() | (raw == ""), F.lit(""))
            .when(F.lower(raw).startswith("site:"), raw)
            .otherwise(let(normalize_platform(raw), body)))


def _dimension_array() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(k).alias("key"),
                              F.lit(display_name(k)).alias("name"), F.lit(s).alias("site_filter"),
                              F.lit(s.replace("site:", "")).alias("domain"))
                     for i, (k, s) in enumerate(PLATFORM_SITES)])


def suggest_platforms(df: DataFrame, name_col: str, limit: int = 10, id_col: str | None = None) -> DataFrame:
    """Up to ``limit`` platforms per input whose key contains the name or is
    contained in it, ordered: name inside the key first, then shorter
    display names, then dimension order. Blank input gives none."""
    raw = F.col(name_col)

    def body(n):
        hits = F.filter(_dimension_array(), lambda p: p["key"].contains(n) | n.contains(p["key"]))
        keyed = F.transform(hits, lambda p: F.struct(
            F.when(F.lower(p["name"]).contains(n), 0).otherwise(1).alias("f"),
            F.length(p["name"]).alias("l"), p.alias("p")))
        ordered = F.array_sort(keyed, lambda a, b: (
            F.when(a["f"] != b["f"], a["f"] - b["f"]).when(a["l"] != b["l"], a["l"] - b["l"])
            .otherwise(a["p"]["ordinal"] - b["p"]["ordinal"])))
        return F.slice(ordered, 1, limit)
    top = F.when(raw.isNull() | (raw == ""), F.array()).otherwise(let(normalize_platform(raw), body))
    keep = [id_col] if id_col else []
    return (df.select(*keep, raw.alias("query"), F.posexplode(top).alias("rank", "s"))
            .select(*keep, "query", (F.col("rank") + 1).alias("rank"), F.col("s.p.name").alias("name"),
                    F.col("s.p.domain").alias("domain"), F.col("s.p.site_filter").alias("site_filter")))


def process_platforms(df: DataFrame, name_col: str, id_col: str) -> DataFrame:
    """Distinct non-empty site filters of a list of names, with the first
    input row that produced each (order the result by it for first-seen
    order). A map-side-combined aggregation, so repeats cost nothing."""
    site = platform_to_site(F.col(name_col))
    return (df.filter(F.col(name_col).isNotNull() & (F.col(name_col) != ""))
            .select(F.col(id_col), site.alias("site_filter"))
            .filter(F.col("site_filter") != "")
            .groupBy("site_filter").agg(F.min(id_col).alias("first_input_id")))
