"""Checked queries for results: items, paging, mapping, normalization,
followers and the flat tables (2.E, 2.F, 2.G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from serpframe.functions import followers as FO
from serpframe.functions import numbers as N
from serpframe.functions import snippets as SN
from serpframe.functions import sql as sql_functions
from serpframe.operators import dedup, flatten, normalize, results
from serpframe.plans import duck as D
from serpframe.plans.fixtures import view, with_views
from serpframe.plans.inputs import landed_pages, mapped_to_raw, raw_records
from serpframe.plans.registry import NOW, OPTS, SITES, now_col, register
from serpframe.session import scratch_path

PER_PAGE = 10

# ------------------------------------------------------------------ shared plans


def _pages(spark, sf):
    return landed_pages(view(spark, sf, "v_items"), now_col())


def _mapped(spark, sf):
    return results.map_items(results.explode_items(_pages(spark, sf), PER_PAGE))


def _deduped(spark, sf):
    return dedup.dedup_results(_mapped(spark, sf), keyword_col="term", order_cols=("page", "idx"))


def _records(df):
    """Scraper hand-off: one raw record per result, with its fetch time."""
    return df.select("term", "page", "idx", "fetched_at",
                     mapped_to_raw(F.col("result"), F.col("term"), F.col("page")).alias("raw"))


def _raw(spark, sf):
    return raw_records(view(spark, sf, "v_raw_flat"))


# DuckDB: mapped results of v_items (position, best snippet, dedup keys).
_M = f"""m0 as (select doc_id, term, cast(page as bigint) as page, idx, cast((page - 1) * {PER_PAGE} + idx as bigint) as position,
    coalesce(title, '') as title, coalesce(link, '') as url,
    coalesce(regexp_extract(link, '^https?://([^/]+)', 1), '') as displayed_url,
    coalesce(nullif(snippet, ''), '') as snippet0, og_description as og, twitter_description as tw, total_results
  from v_items),
m1 as (select *, {D.pick_longer('og', 'tw')} as best from m0),
m as (select *, case when best is not null and (contains(snippet0, '...') or length(best) > length(snippet0))
    then best else snippet0 end as snippet,
  case when title = '' and url = '' then cast(page as varchar) else title end as k1,
  case when title = '' and url = '' then term else url end as k2 from m1),
md as (select * from (select *, row_number() over (partition by term, k1, k2 order by page, idx) as rn from m) where rn = 1)"""


def _m(sql: str) -> str:
    return with_views(f", {_M}\n{sql}", "v_items")


# ------------------------------------------------------------------ 2.E

@register("explode_items", _m(
    "select term, page, idx, position, title, url as link from m"))
def q_explode_items(spark, sf):
    x = results.explode_items(_pages(spark, sf), PER_PAGE)
    return x.select("term", "page", "idx", "position", F.col("item.title").alias("title"),
                    F.col("item.link").alias("link"))


@register("map_item", _m(
    "select term, page, idx, position, title, url, displayed_url, snippet, "
    "(og is not null or tw is not null) as has_metatags from m"))
def q_map_item(spark, sf):
    m = _mapped(spark, sf)
    return m.select("term", "page", "idx", "position", "title", "url",
                    F.col("result.displayedUrl").alias("displayed_url"), F.col("result.snippet").alias("snippet"),
                    F.col("result.metatags").isNotNull().alias("has_metatags"))


@register("best_snippet", with_views(
    f"""select doc_id, case when best is not null and (contains(s, '...') or length(best) > length(s)) then best else s end as snippet
from (select doc_id, coalesce(nullif(snippet, ''), '') as s, {D.pick_longer('og_description', 'twitter_description')} as best
      from v_items)""", "v_items"))
def q_best_snippet(spark, sf):
    v = view(spark, sf, "v_items")
    s = F.coalesce(F.nullif(F.col("snippet"), F.lit("")), F.lit(""))
    return v.select("doc_id", SN.best_snippet(s, "og_description", "twitter_description").alias("snippet"))


_PAGES_SQL = """p as (select term, cast(page as bigint) as page, count(*) as n_items, any_value(total_results) as total_results
  from v_items group by term, page),
c as (select *, sum(n_items) over (partition by term order by page rows between unbounded preceding and current row) as so_far
  from p),
s as (select *, (n_items = 0 or (tot is not null and so_far >= tot)) as stop
  from (select *, {tot} as tot from c)),
k as (select *, coalesce(max(cast(stop as integer)) over (partition by term order by page
  rows between unbounded preceding and 1 preceding), 0) as earlier from s)""".format(
    tot=D.int_text("coalesce(total_results, '0')"))


@register("page_cutoff", with_views(f", {_PAGES_SQL}\nselect term, page, n_items from k where earlier = 0", "v_items")
          )
def q_page_cutoff(spark, sf):
    return results.page_cutoff(_pages(spark, sf)).select("term", "page", "n_items")


@register("paging_summary", with_views(
    f", {_PAGES_SQL}\nselect term, count(*) as pages, sum(n_items) as results from k where earlier = 0 group by term",
    "v_items"))
def q_paging_summary(spark, sf):
    return results.paging_summary(results.page_cutoff(_pages(spark, sf)))


@register("dedup_results", _m("select term, page, idx, title, url from md"))
def q_dedup_results(spark, sf):
    return _deduped(spark, sf).select("term", "page", "idx", "title", "url")


@register("collect_keyword_results", _m("select term, page, idx, position, title, url, snippet from md"))
def q_collect_keyword_results(spark, sf):
    d = _deduped(spark, sf).select("term", "page", "idx", "position", "title", "url",
                                   F.col("result.snippet").alias("snippet"))
    return results.collect_keyword_results(d, keyword_col="term", order_cols=("page", "idx"))


@register("supported_only", with_views("select doc_id, term from v_items", "v_items"))
def q_supported_only(spark, sf):
    return results.supported_only(view(spark, sf, "v_items").select("doc_id", "term"), OPTS)


_ERR_SHAPE = ('{"error": {"code": "INTEGER", "status": "VARCHAR", "message": "VARCHAR", '
              '"errors": [{"reason": "VARCHAR"}], '
              '"details": [{"@type": "VARCHAR", "metadata": "MAP(VARCHAR, VARCHAR)", "links": [{"url": "VARCHAR"}]}]}}')


@register("parse_quota_errors", with_views(
    f"""select event_id, http_status, is_q as is_quota_error,
  case when is_q then e.error.code end as error_code,
  case when is_q then e.error.message end as error_message,
  {', '.join(f"case when is_q then info['{k}'] end as {k}" for k in results.QUOTA_FIELDS)},
  case when is_q then flatten(list_transform(list_filter(coalesce(e.error.details, []), lambda d: d['@type'] = '{results.HELP_TYPE}'),
    lambda d: list_transform(coalesce(d.links, []), lambda l: l.url))) end as help_links
from (select *, coalesce(http_status in (403, 429) and e.error.code = 429 and e.error.status = 'RESOURCE_EXHAUSTED'
        and len(list_filter(coalesce(e.error.errors, []), lambda x: x.reason = 'rateLimitExceeded')) > 0, false) as is_q,
      list_filter(coalesce(e.error.details, []), lambda d: d['@type'] = '{results.ERROR_INFO_TYPE}')[1].metadata as info
  from (select event_id, http_status, case when json_valid(body) then from_json(body, '{_ERR_SHAPE}') end as e
        from v_error_bodies))""", "v_error_bodies"))
def q_parse_quota_errors(spark, sf):
    return results.parse_quota_errors(view(spark, sf, "v_error_bodies"))


# ------------------------------------------------------------------ 2.F

_RAW_TERM = "coalesce(nullif(sq_term, ''), nullif(query, ''), search_term)"
_PAGE_TEXT = "coalesce(nullif(sq_page, ''), '1')"
_RAW_PAGE = f"coalesce(nullif({D.coerce_int(_PAGE_TEXT)}, 0), 1)"


@register("normalize_search_query", with_views(
    f"select doc_id, {_RAW_TERM} as term, {_RAW_PAGE} as page from v_raw_flat", "v_raw_flat"))
def q_normalize_search_query(spark, sf):
    r = _raw(spark, sf)
    return r.select("doc_id", normalize.normalize_search_query("raw").alias("sq")).select("doc_id", "sq.term", "sq.page")


@register("coerce_int", with_views(
    f"select doc_id, {D.coerce_int('position')} as position_int, {D.coerce_int('sq_page')} as page_int from v_raw",
    "v_raw"))
def q_coerce_int(spark, sf):
    v = view(spark, sf, "v_raw")
    return v.select("doc_id", N.coerce_int("position").alias("position_int"), N.coerce_int("sq_page").alias("page_int"))


@register("is_truncated", with_views(
    f"select doc_id, {D.is_truncated('snippet')} as snippet_truncated, {D.is_truncated('og_description')} as og_truncated "
    "from v_items", "v_items"))
def q_is_truncated(spark, sf):
    v = view(spark, sf, "v_items")
    return v.select("doc_id", SN.is_truncated("snippet").alias("snippet_truncated"),
                    SN.is_truncated("og_description").alias("og_truncated"))


@register("pick_longer", with_views(
    f"select doc_id, {D.pick_longer('og_description', 'twitter_description')} as best from v_items", "v_items"))
def q_pick_longer(spark, sf):
    v = view(spark, sf, "v_items")
    return v.select("doc_id", SN.pick_longer("og_description", "twitter_description").alias("best"))


_F5 = f"""select doc_id, {D.coerce_int("position")} as position,
  coalesce(nullif(title, ''), result_title) as title, url2 as url, cast(null as varchar) as displayed_url,
  case when best is not null and ({D.is_truncated('s0')} or length(best) > length(coalesce(s0, ''))) then best else s0 end as snippet,
  og is not null as has_metatags, cast(null as varchar) as connections_text, cast(null as bigint) as connections_count
from (select *, coalesce(nullif(url, ''), nullif(link, ''), result_url) as url2,
        coalesce(nullif(snippet, ''), description) as s0, nullif({D.strip('og')}, '') as best from v_raw_flat)"""


@register("normalize_organic", with_views(_F5, "v_raw_flat"))
def q_normalize_organic(spark, sf):
    r = _raw(spark, sf)
    x = r.select("doc_id", F.explode(normalize.normalize_organic("raw")).alias("o"))
    return x.select("doc_id", "o.position", "o.title", "o.url", F.col("o.displayedUrl").alias("displayed_url"),
                    "o.snippet", F.col("o.metatags").isNotNull().alias("has_metatags"),
                    F.col("o.connectionsText").alias("connections_text"),
                    F.col("o.connectionsCount").alias("connections_count"))


@register("extract_followers", with_views(
    f"select doc_id, f.followersText as followers_text, f.followersCount as followers_count "
    f"from (select doc_id, {D.extract_followers('snippet')} as f from v_items)", "v_items"))
def q_extract_followers(spark, sf):
    v = view(spark, sf, "v_items")
    return v.select("doc_id", FO.extract_followers("snippet").alias("f")) \
            .select("doc_id", F.col("f.followersText").alias("followers_text"),
                    F.col("f.followersCount").alias("followers_count"))


_F7 = f"""select term, page, idx, nullif(url, '') as url, f.followersText as connections_text, f.followersCount as connections_count
from (select *, case when contains(lower(url), 'linkedin.com') then
        coalesce({D.extract_followers('best')}, {D.extract_followers("nullif(s2, '')")}) end as f
      from (select *, case when best is not null and ({D.is_truncated('s1')} or length(best) > length(coalesce(s1, '')))
              then best else s1 end as s2
            from (select *, nullif(snippet, '') as s1 from m)))"""


@register("follower_counts", _m(_F7))
def q_follower_counts(spark, sf):
    recs = _records(_mapped(spark, sf))
    x = recs.select("term", "page", "idx", F.explode(normalize.follower_counts("raw")).alias("o"))
    return x.select("term", "page", "idx", "o.url", "o.connections_text", "o.connections_count")


@register("normalize_paa", with_views(
    "select doc_id, paa_question as question, paa_answer as answer, paa_url as url from v_raw_flat", "v_raw_flat"))
def q_normalize_paa(spark, sf):
    r = _raw(spark, sf)
    return r.select("doc_id", F.explode(normalize.normalize_paa("raw")).alias("p")).select("doc_id", "p.*")


_REL = ("case when rs_item is not null then [rs_item] when rq_item is not null then [rq_item, ''] "
        "else []::varchar[] end")


@register("normalize_related", with_views(
    f"select doc_id, cast(unnest(range(0, len(l))) as integer) as pos, unnest(l) as related "
    f"from (select doc_id, {_REL} as l from v_raw_flat)", "v_raw_flat"))
def q_normalize_related(spark, sf):
    r = _raw(spark, sf)
    return r.select("doc_id", F.posexplode(normalize.normalize_related("raw")).alias("pos", "related"))


_ADS = f"""{D.coerce_int('ad_position')} as position, ad_title as title, coalesce(nullif(ad_url, ''), ad_link) as url,
  coalesce(nullif(ad_advertiser, ''), ad_source) as advertiser, coalesce(nullif(ad_description, ''), ad_snippet) as snippet"""


@register("normalize_ads", with_views(f"select doc_id, {_ADS} from v_raw_flat", "v_raw_flat"))
def q_normalize_ads(spark, sf):
    r = _raw(spark, sf)
    return r.select("doc_id", F.explode(normalize.normalize_ads("raw")).alias("a")).select("doc_id", "a.*")


def _truthy(x):
    falsy = ", ".join(D.q(v) for v in normalize.FALSY_JSON)
    return f"(case when trim({x}) not in ({falsy}) then {x} end)"


@register("normalize_ai_overview", with_views(
    f"select doc_id, coalesce({_truthy('ai_main')}, {_truthy('ai_alt')}) as ai_overview from v_raw_flat", "v_raw_flat"))
def q_normalize_ai_overview(spark, sf):
    r = _raw(spark, sf)
    return r.select("doc_id", normalize.normalize_ai_overview("raw").alias("ai_overview"))


@register("typed_ai_overview", with_views(
    f"""select doc_id, case when json_type(v) = 'OBJECT' then 'OBJECT' when json_type(v) = 'ARRAY' then 'ARRAY' end as kind,
  json_extract_string(v, '$.text') as text, cast(json_extract(v, '$.alt') as bigint) as alt
from (select doc_id, coalesce({_truthy('ai_main')}, {_truthy('ai_alt')}) as v from v_raw_flat)""", "v_raw_flat"))
def q_typed_ai_overview(spark, sf):
    """The overview as a variant: written, read back, and read by path and type."""
    typed = _raw(spark, sf).select("doc_id", normalize.typed_ai_overview("raw").alias("v"))
    path = scratch_path(spark, "ai-overview")
    typed.write.parquet(path)
    v = spark.read.schema(typed.schema).parquet(path)
    return v.select("doc_id", F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0).alias("kind"),
                    F.try_variant_get("v", "$.text", "string").alias("text"), F.try_variant_get("v", "$.alt", "bigint").alias("alt"))


# ------------------------------------------------------------------ SQL functions (2.L)

def _sql(spark, df, expression):
    """``expression`` over the temporary SQL functions."""
    sql_functions.register(spark)
    return df.select("id", F.expr(expression).alias("out"))


@register("sql_clean_query", with_views(f"select input_row_id as id, {D.clean_query('original_input')} as out from v_queries", "v_queries"))
def q_sql_clean_query(spark, sf):
    return _sql(spark, view(spark, sf, "v_queries").withColumnRenamed("input_row_id", "id"), "clean_query(original_input)")


@register("sql_normalize_query", with_views(
    f"select input_row_id as id, {D.normalize_query('original_input', SITES)} as out from v_queries", "v_queries"))
def q_sql_normalize_query(spark, sf):
    sites = ", ".join(f"'{s}'" for s in SITES)
    return _sql(spark, view(spark, sf, "v_queries").withColumnRenamed("input_row_id", "id"), f"normalize_query(original_input, array({sites}))")


@register("sql_extract_followers", with_views(
    f"select id, f.followersText || '|' || f.followersCount as out from (select doc_id as id, {D.extract_followers('snippet')} as f from v_items)",
    "v_items"))
def q_sql_extract_followers(spark, sf):
    items = view(spark, sf, "v_items").select(F.col("doc_id").alias("id"), "snippet")
    out = _sql(spark, items, "extract_followers(snippet)")
    return out.select("id", F.concat("out.followersText", F.lit("|"), F.col("out.followersCount").cast("string")).alias("out"))


@register("sql_parse_human_number", with_views(
    f"select doc_id as id, {D.parse_human_number('position', "substr('kMb', cast(doc_id % 4 as int) + 1, 1)")} as out from v_raw", "v_raw"))
def q_sql_parse_human_number(spark, sf):
    raw = view(spark, sf, "v_raw").select(F.col("doc_id").alias("id"), "position")
    return _sql(spark, raw, "parse_human_number(position, substr('kMb', cast(id % 4 as int) + 1, 1))")


# ------------------------------------------------------------------ 2.G and the web path

def _g2_sql(src: str, text_expr: str, count_expr: str, missing: str, cands: list[str]) -> str:
    inf = D.infer_followers(cands)
    return f"""select term as query, page, timestamp '{NOW}' as fetched_at, nullif(position, 0) as position,
  title, url, displayed_url, coalesce(nullif(snip, ''), '') as snippet,
  case when {missing} then i.text else {text_expr} end as connections_text,
  case when {missing} then i.count else {count_expr} end as connections_count
from (select *, {inf} as i from {src})"""


_CANDS = ["snip", "title", "displayed_url", "title", "url", "displayed_url", "snip", "og", "tw"]


@register("flatten_organic", _m(_g2_sql("(select *, snippet as snip from md)", "null", "null", "true", _CANDS)))
def q_flatten_organic(spark, sf):
    """Flagship (command-line path): unique results per term, best snippet,
    audience counts inferred at export."""
    d = _deduped(spark, sf)
    rec = d.select("fetched_at", F.struct(F.struct("term", "page").alias("searchQuery"),
                                          F.array("result").alias("searchResults")).alias("record"))
    return flatten.flatten_organic(rec, "record", now_col())


_WEB = f"""(select *, case when contains(lower(url), 'linkedin.com') then
        coalesce({D.extract_followers('best')}, {D.extract_followers("nullif(snip, '')")}) end as f
  from (select *, case when best is not null and ({D.is_truncated('s1')} or length(best) > length(coalesce(s1, '')))
          then best else s1 end as snip
        from (select *, nullif(snippet, '') as s1 from md)))"""


@register("normalize_items", _m(_g2_sql(
    _WEB, "f.followersText", "f.followersCount",
    "(f.followersText is null and f.followersCount is null)", _CANDS)))
def q_normalize_items(spark, sf):
    """Web path: deduplicated results normalized to unified records, then flattened."""
    recs = _records(_deduped(spark, sf))
    return flatten.flatten_organic(normalize.normalize_items(recs, "raw", "record"), "record", now_col())


@register("flatten_common", with_views(
    f"select doc_id, coalesce(nullif(sq_term, ''), nullif(query, ''), nullif(search_term, ''), '') as query, "
    f"coalesce(nullif({D.coerce_int('sq_page')}, 0), 1) as page, timestamp '{NOW}' as fetched_at from v_raw_flat",
    "v_raw_flat"))
def q_flatten_common(spark, sf):
    r = _raw(spark, sf)
    return r.select("doc_id", *flatten.flatten_common(r, "raw", now_col()))


_G_COMMON = (f"coalesce(nullif(sq_term, ''), nullif(query, ''), nullif(search_term, ''), '') as query, "
             f"coalesce(nullif({D.coerce_int('sq_page')}, 0), 1) as page, timestamp '{NOW}' as fetched_at")


@register("flatten_paa", with_views(
    f"select {_G_COMMON}, coalesce(nullif(paa_question, ''), '') as question, coalesce(nullif(paa_answer, ''), '') as answer, "
    f"coalesce(nullif(paa_url, ''), '') as url from v_raw_flat", "v_raw_flat"))
def q_flatten_paa(spark, sf):
    return flatten.flatten_paa(_raw(spark, sf), "raw", now_col())


@register("flatten_related", with_views(
    f"select query, page, fetched_at, coalesce(nullif(unnest(l), ''), '') as related_query from "
    f"(select {_G_COMMON}, case when rq_item is not null then [rq_item, ''] when rs_item is not null then [rs_item] "
    f"else []::varchar[] end as l from v_raw_flat)", "v_raw_flat"))
def q_flatten_related(spark, sf):
    return flatten.flatten_related(_raw(spark, sf), "raw", now_col())


@register("flatten_paid", with_views(
    f"select {_G_COMMON}, nullif({D.coerce_int('ad_position')}, 0) as position, coalesce(nullif(ad_title, ''), '') as title, "
    f"coalesce(nullif(ad_url, ''), nullif(ad_link, ''), '') as url, "
    f"coalesce(nullif(ad_advertiser, ''), nullif(ad_source, ''), '') as advertiser, "
    f"coalesce(nullif(ad_description, ''), nullif(ad_snippet, ''), '') as snippet from v_raw_flat", "v_raw_flat"))
def q_flatten_paid(spark, sf):
    return flatten.flatten_paid(_raw(spark, sf), "raw", now_col())


@register("flatten_ai_overview", with_views(
    f"select * from (select {_G_COMMON}, coalesce({_truthy('ai_main')}, {_truthy('ai_alt')}) as content_json "
    f"from v_raw_flat) where content_json is not null", "v_raw_flat"))
def q_flatten_ai_overview(spark, sf):
    return flatten.flatten_ai_overview(_raw(spark, sf), "raw", now_col())


@register("infer_followers", _m(
    f"select term, page, idx, i.text as followers_text, i.count as followers_count "
    f"from (select *, {D.infer_followers(_CANDS)} as i from (select *, snippet as snip from m))"))
def q_infer_followers(spark, sf):
    m = _mapped(spark, sf)
    from serpframe.schemas import MAPPED_RESULT
    return m.select("term", "page", "idx", FO.infer_followers("result", MAPPED_RESULT).alias("i")) \
            .select("term", "page", "idx", F.col("i.text").alias("followers_text"),
                    F.col("i.count").alias("followers_count"))


_G8_RE = r"(\d[\d.,]*)\s*([KkMmBb]?)\+?\s+(?:" + "|".join(FO.EXPORT_WORDS) + ")$"


@register("parse_human_number", with_views(
    f"select doc_id, {D.parse_human_number(f'regexp_extract(snippet, {D.q(_G8_RE)}, 1)', f'regexp_extract(snippet, {D.q(_G8_RE)}, 2)')}"
    f" as audience from v_items", "v_items"))
def q_parse_human_number(spark, sf):
    v = view(spark, sf, "v_items")  # texts without a count give null
    return v.select("doc_id", FO.parse_human_number(F.regexp_extract("snippet", _G8_RE, 1),
                                                    F.regexp_extract("snippet", _G8_RE, 2)).alias("audience"))
