"""Records to the five flat export tables.

The flatteners accept unified records and raw producer records alike: an
alias that a record type lacks is read as null. Each table is one
``explode`` plus a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from serpframe.functions.followers import infer_followers
from serpframe.functions.numbers import coerce_int
from serpframe.functions.truthy import first_nonempty, first_num, first_str
from serpframe.operators.normalize import json_truthy

COMMON = ("query", "page", "fetched_at")


def _field(c: Column, dtype: StructType, name: str) -> Column:
    return c[name] if name in dtype.fieldNames() else F.lit(None)


def _as_int(c: Column, dtype: DataType | None) -> Column:
    return coerce_int(c) if isinstance(dtype, StringType) else c.cast("bigint")


def _ftype(dtype: StructType, name: str):
    return dtype[name].dataType if name in dtype.fieldNames() else None


def flatten_common(df: DataFrame, record_col: str = "record", now: Column | None = None) -> list[Column]:
    """query, page and fetched_at of a record, as select expressions.

    ``fetched_at`` comes from a ``fetched_at`` column, then the record's
    fetchedAt / createdAt, then ``now``.
    """
    rt: StructType = df.schema[record_col].dataType
    r = F.col(record_col)
    sq = _field(r, rt, "searchQuery")
    sqt = _ftype(rt, "searchQuery")
    sq_term = sq["term"] if sqt is not None else F.lit(None)
    sq_page = _as_int(sq["page"], sqt["page"].dataType) if sqt is not None else F.lit(None)
    term = first_str(sq_term, _field(r, rt, "query"), _field(r, rt, "searchTerm"), F.lit(""))
    page = first_num(sq_page, _as_int(_field(r, rt, "page"), _ftype(rt, "page")), F.lit(1).cast("bigint"))
    ts = now if now is not None else F.current_timestamp()
    stamps = []
    if "fetched_at" in df.columns:
        stamps.append(F.col("fetched_at").cast("timestamp"))
    for n in ("fetchedAt", "createdAt"):
        if n in rt.fieldNames():
            stamps.append(F.nullif(r[n], F.lit("")).try_cast("timestamp"))
    return [term.alias("query"), page.cast("bigint").alias("page"), F.coalesce(*stamps, ts).alias("fetched_at")]


def _list(df: DataFrame, record_col: str, *names: str) -> tuple[Column, StructType | None]:
    rt: StructType = df.schema[record_col].dataType
    r = F.col(record_col)
    present = [n for n in names if n in rt.fieldNames()]
    if not present:
        return F.array(), None
    etype = rt[present[0]].dataType.elementType
    return first_nonempty(*[r[n] for n in present], F.array().cast(ArrayType(etype))), etype


def flatten_organic(df: DataFrame, record_col: str = "record", now: Column | None = None) -> DataFrame:
    """One row per organic result. Audience text and count come from the
    record; when both are missing they are inferred from all its strings."""
    arr, et = _list(df, record_col, "organicResults", "searchResults")
    common = flatten_common(df, record_col, now)
    x = df.select(*common, F.explode(arr).alias("r"))
    r = F.col("r")
    texts = [r[n] for n in ("connectionsText", "connections_text") if n in et.fieldNames()]
    counts = [r[n] for n in ("connectionsCount", "connections_count") if n in et.fieldNames()]
    text = first_str(*texts) if texts else F.lit(None).cast("string")
    count = first_num(*counts) if counts else F.lit(None).cast("bigint")
    inferred = infer_followers(r, et)
    # one column for both, so that the search runs once a row
    audience = F.when(text.isNull() & count.isNull(), inferred).otherwise(F.struct(text.alias("text"), count.alias("count")))
    pos = first_num(_as_int(_field(r, et, "position"), _ftype(et, "position")),
                    _as_int(_field(r, et, "rank"), _ftype(et, "rank")))
    return x.withColumn("a", audience).select(
        *COMMON,
        pos.alias("position"),
        first_str(_field(r, et, "title"), _field(r, et, "resultTitle"), F.lit("")).alias("title"),
        first_str(_field(r, et, "url"), _field(r, et, "link"), F.lit("")).alias("url"),
        first_str(_field(r, et, "displayedUrl"), _field(r, et, "visibleUrl"), F.lit("")).alias("displayed_url"),
        first_str(_field(r, et, "snippet"), _field(r, et, "description"), F.lit("")).alias("snippet"),
        F.col("a.text").alias("connections_text"),
        F.col("a.count").alias("connections_count"),
    )


def flatten_paa(df: DataFrame, record_col: str = "record", now: Column | None = None) -> DataFrame:
    arr, et = _list(df, record_col, "peopleAlsoAsk", "paa")
    x = df.select(*flatten_common(df, record_col, now), F.explode(arr).alias("p"))
    p = F.col("p")
    return x.select(*COMMON, *[F.coalesce(F.nullif(p[n], F.lit("")), F.lit("")).alias(n)
                              for n in ("question", "answer", "url")])


def flatten_related(df: DataFrame, record_col: str = "record", now: Column | None = None) -> DataFrame:
    """Related queries: relatedQueries before relatedSearches.

    An element may be a text or an object with a ``query``: a struct, or the
    JSON text of an object (how a text column holds it).
    """
    arr, et = _list(df, record_col, "relatedQueries", "relatedSearches")
    x = df.select(*flatten_common(df, record_col, now), F.explode(arr).alias("q"))
    q = F.col("q")
    if isinstance(et, StructType):
        text = _field(q, et, "query").cast("string")
    else:
        text = F.when(F.trim(q).startswith("{") & (F.schema_of_variant(F.try_parse_json(q)).startswith("OBJECT")),
                      F.get_json_object(q, "$.query")).otherwise(q)
    return x.select(*COMMON, F.coalesce(F.nullif(text, F.lit("")), F.lit("")).alias("related_query"))


def flatten_paid(df: DataFrame, record_col: str = "record", now: Column | None = None) -> DataFrame:
    arr, et = _list(df, record_col, "ads", "paidResults")
    x = df.select(*flatten_common(df, record_col, now), F.explode(arr).alias("a"))
    a = F.col("a")
    return x.select(
        *COMMON,
        F.nullif(_as_int(_field(a, et, "position"), _ftype(et, "position")), F.lit(0)).alias("position"),
        first_str(_field(a, et, "title"), F.lit("")).alias("title"),
        first_str(_field(a, et, "url"), _field(a, et, "link"), F.lit("")).alias("url"),
        first_str(_field(a, et, "advertiser"), _field(a, et, "source"), F.lit("")).alias("advertiser"),
        first_str(_field(a, et, "description"), _field(a, et, "snippet"), F.lit("")).alias("snippet"))


def flatten_ai_overview(df: DataFrame, record_col: str = "record", now: Column | None = None) -> DataFrame:
    """The AI overview as JSON text; records without one give no row."""
    return (df.select(*flatten_common(df, record_col, now), _ai_overview(df, record_col).alias("content_json"))
            .filter(F.col("content_json").isNotNull()))


def _ai_overview(df: DataFrame, record_col: str) -> Column:
    rt: StructType = df.schema[record_col].dataType
    r = F.col(record_col)
    return F.coalesce(*[json_truthy(r[n]) for n in ("aiOverview", "ai_overview") if n in rt.fieldNames()],
                      F.lit(None).cast("string"))


def result_sizes(df: DataFrame, record_col: str = "record") -> DataFrame:
    """Rows that each record gives in each of the five tables, one column per kind; one scan, no explode."""
    def size(*names):
        arr, _ = _list(df, record_col, *names)
        return F.greatest(F.coalesce(F.size(arr), F.lit(0)), F.lit(0))
    return df.select(size("organicResults", "searchResults").alias("organic"),
                     size("peopleAlsoAsk", "paa").alias("people_also_ask"),
                     size("relatedQueries", "relatedSearches").alias("related"),
                     size("ads", "paidResults").alias("paid"),
                     _ai_overview(df, record_col).isNotNull().cast("int").alias("ai_overview"))
