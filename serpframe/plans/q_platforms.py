"""Checked queries for platforms (2.D) and browsing (2.J)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from serpframe.operators import browse
from serpframe.operators import platforms as P
from serpframe.operators.ordered import written
from serpframe.plans import duck as D
from serpframe.plans.fixtures import view, with_views
from serpframe.plans.q_results import _M, _CANDS, _g2_sql, q_flatten_organic
from serpframe.plans.registry import OPTS, register


def _inputs(spark, sf):
    return view(spark, sf, "v_platform_inputs")


def _d_norm(x: str) -> str:
    s = f"lower({D.strip(x)})"
    for p in ("www.", "http://", "https://", "site:"):
        s = f"(case when starts_with({s}, {D.q(p)}) then substr({s}, {len(p) + 1}) else {s} end)"
    s = f"regexp_replace({s}, '/+$', '')"
    s = f"regexp_replace({s}, '/(in|profile|user|u)/?$', '')"
    return f"coalesce({s}, '')"


def _d_site(x: str) -> str:
    n = "n"
    exact = " ".join(f"when {n} = {D.q(k)} then {D.q(s)}" for k, s in P.PLATFORM_SITES)
    loose = " ".join(f"when contains({D.q(k)}, {n}) or contains({n}, {D.q(k)}) then {D.q(s)}" for k, s in P.PLATFORM_SITES)
    return (f"(case when {x} is null or {x} = '' then '' when starts_with(lower({x}), 'site:') then {x} "
            f"{exact} {loose} when contains({n}, '.') then 'site:' || {n} || "
            f"(case when contains({n}, 'linkedin') and not ends_with({n}, '/in') then '/in' else '' end) "
            f"when not contains({n}, ' ') then 'site:' || {n} || '.com' else 'site:' || {n} end)")


_NORM = f"select page_id, platform_name, {_d_norm('platform_name')} as n from v_platform_inputs"


@register("normalize_platform", with_views(f"select page_id, n as normalized from ({_NORM})", "v_platform_inputs"))
def q_normalize_platform(spark, sf):
    return _inputs(spark, sf).select("page_id", P.normalize_platform("platform_name").alias("normalized"))


@register("validate_platform", with_views(
    f"""select page_id, error is null as valid, error from (select page_id,
  case when platform_name is null or {D.strip('platform_name')} = '' then {D.q(P.MSG_EMPTY)}
       when not regexp_full_match(n, '[a-zA-Z0-9\\s.\\-_/]+') then {D.q(P.MSG_CHARS)}
       when length(n) > 100 then {D.q(P.MSG_LONG)} end as error from ({_NORM}))""", "v_platform_inputs"))
def q_validate_platform(spark, sf):
    return _inputs(spark, sf).select("page_id", P.validate_platform("platform_name").alias("v")) \
        .select("page_id", "v.valid", "v.error")


@register("platform_to_site", with_views(
    f"select page_id, {_d_site('platform_name')} as site_filter from ({_NORM})", "v_platform_inputs"))
def q_platform_to_site(spark, sf):
    return _inputs(spark, sf).select("page_id", P.platform_to_site("platform_name").alias("site_filter"))


_DIM = "(values " + ", ".join(
    f"({i}, {D.q(k)}, {D.q(P.display_name(k))}, {D.q(s)}, {D.q(s.replace('site:', ''))})"
    for i, (k, s) in enumerate(P.PLATFORM_SITES)) + ") dim(ordinal, key, name, site_filter, domain)"


@register("suggest_platforms", with_views(
    f"""select page_id, query, rank, name, domain, site_filter from (
  select page_id, platform_name as query, name, domain, site_filter,
    row_number() over (partition by page_id order by case when contains(lower(name), n) then 0 else 1 end,
                       length(name), ordinal) as rank
  from ({_NORM}) i join {_DIM} on contains(key, n) or contains(n, key)
  where platform_name is not null and platform_name <> '') where rank <= 10""", "v_platform_inputs"))
def q_suggest_platforms(spark, sf):
    return P.suggest_platforms(_inputs(spark, sf), "platform_name", limit=10, id_col="page_id")


@register("process_platforms", with_views(
    f"""select site_filter, min(page_id) as first_input_id from (
  select page_id, {_d_site('platform_name')} as site_filter from ({_NORM})
  where platform_name is not null and platform_name <> '') where site_filter <> '' group by site_filter""",
    "v_platform_inputs"))
def q_process_platforms(spark, sf):
    return P.process_platforms(_inputs(spark, sf), "platform_name", "page_id")


# ------------------------------------------------------------------ 2.J over the flagship rows

_ORGANIC_SQL = _g2_sql("(select *, snippet as snip from md)", "null", "null", "true", _CANDS)


def _organic_view(sql_tail: str) -> str:
    return with_views(f", {_M}, organic as ({_ORGANIC_SQL})\n{sql_tail}", "v_items")


@register("filter_results", _organic_view(
    "select * from organic where contains(lower(query), 'linkedin') or contains(lower(title), 'linkedin') "
    "or contains(lower(url), 'linkedin')"))
def q_filter_results(spark, sf):
    return browse.filter_results(q_flatten_organic(spark, sf), "LinkedIn")


@register("page_results", _organic_view("select * from organic order by query, page, position limit 100 offset 100"))
def q_page_results(spark, sf):
    return browse.page_results(q_flatten_organic(spark, sf), 2, 100, ("query", "page", "position"))


@register("page_results_deep", _organic_view("select * from organic order by query, page, position limit 10 offset 500"))
def q_page_results_deep(spark, sf):
    """A page far behind, by ranges instead of one ordered slice."""
    return browse.page_results(q_flatten_organic(spark, sf), 51, 10, ("query", "page", "position"))


_TIE_PAGES = (1, 10, 11, 12)


def _ties_sql() -> str:
    order = "query nulls first, page nulls first, position nulls first, fetched_at nulls first, title nulls first, url nulls first, " \
        "displayed_url nulls first, snippet nulls first, connections_text nulls first, connections_count nulls first"
    return (f"select page as result_page, position, url, connections_count, cast((rn - 1) // 7 + 1 as bigint) as turned "
            f"from (select *, row_number() over (order by {order}) as rn from organic) "
            f"where (rn - 1) // 7 + 1 in {_TIE_PAGES}")


@register("page_results_ties", _organic_view(_ties_sql()))
def q_page_results_ties(spark, sf):
    """Pages in an order with many ties, before and after the change to ranges at page 10."""
    rows = q_flatten_organic(spark, sf)
    cols = [F.col("page").alias("result_page"), "position", "url", "connections_count"]
    rows = rows.select("query", "page", "position", *[c for c in rows.columns if c not in ("query", "page", "position")])
    rows = written(rows, "rows")
    kept = browse.ranged_pages(rows, ("query",))
    turn = lambda n: browse.page_results(rows, n, 7, ("query",)) if n <= 10 else browse.page_of(kept, n, 7)
    pages = [turn(n).select(*cols, F.lit(n).cast("bigint").alias("turned")) for n in _TIE_PAGES]
    return reduce(lambda a, b: a.unionByName(b), pages)


@register("total_pages", _organic_view(
    "select cast(greatest(1, ceil(count(*) / 100.0)) as bigint) as total_pages from organic"))
def q_total_pages(spark, sf):
    return browse.total_pages(q_flatten_organic(spark, sf), 100)


@register("result_counts", _organic_view(
    "select count(*) as total_results, cast(least(count(*), 50) as bigint) as returned_results from organic"))
def q_result_counts(spark, sf):
    return browse.result_counts(q_flatten_organic(spark, sf), 50)


@register("limit_results", _organic_view("select * from organic order by query, position limit 50"))
def q_limit_results(spark, sf):
    return browse.limit_results(q_flatten_organic(spark, sf), 50, ("query", "position"))


def _preview_sql() -> str:
    sites = list(OPTS.profile_sites)
    doms = [s.split(":")[1] if ":" in s else None for s in sites]
    cond = " or ".join(f"contains(lower(original_input), {D.q(d)})" for d in doms if d) or "false"
    suffix = " (" + " OR ".join(sites) + ")"
    return (f"select input_row_id, case when original_input is null or trim(original_input) = '' or {cond} "
            f"then original_input else original_input || {D.q(suffix)} end as preview "
            f"from v_queries order by input_row_id limit 5")


@register("preview_queries", with_views(_preview_sql(), "v_queries"))
def q_preview_queries(spark, sf):
    return browse.preview_queries(view(spark, sf, "v_queries"), OPTS, 5)
