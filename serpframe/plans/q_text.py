"""Checked queries for query text, composition and query dedup (2.B, 2.C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from serpframe.functions import text as T
from serpframe.operators import compose, dedup
from serpframe.plans import duck as D
from serpframe.plans.fixtures import view, with_views
from serpframe.plans.registry import NOW, OPTS, SITES, now_col, register


# ------------------------------------------------------------------ 2.B text

@register("compose_queries", with_views(
    f"""select input_row_id, {D.strip(f"(ensure || {D.role_expression(D.tokenize_roles('roles'))})")} as original_input
from (select input_row_id, {D.ensure_quoted('cells[1]')} as ensure, cells[2:] as roles
      from (select input_row_id, list_filter([{D.strip('anchor')}, {D.strip('role_1')}, {D.strip('role_2')}],
              lambda x: x is not null and x <> '') as cells from v_query_rows) where len(cells) > 0)""",
    "v_query_rows"))
def q_compose_queries(spark, sf):
    return compose.compose_queries(view(spark, sf, "v_query_rows"))


@register("tokenize_roles", with_views(
    f"select input_row_id, {D.tokenize_roles('[role_1, role_2]')} as roles from v_query_rows", "v_query_rows"))
def q_tokenize_roles(spark, sf):
    v = view(spark, sf, "v_query_rows")
    return v.select("input_row_id", T.tokenize_roles(F.array("role_1", "role_2")).alias("roles"))


@register("ensure_quoted", with_views(
    f"select input_row_id, {D.ensure_quoted('anchor')} as anchor_q, {D.ensure_quoted('role_2')} as role_q "
    "from v_query_rows", "v_query_rows"))
def q_ensure_quoted(spark, sf):
    v = view(spark, sf, "v_query_rows")
    return v.select("input_row_id", T.ensure_quoted("anchor").alias("anchor_q"),
                    T.ensure_quoted("role_2").alias("role_q"))


@register("role_expression", with_views(
    f"select input_row_id, {D.role_expression(D.tokenize_roles('[role_1, role_2]'))} as role_expr "
    "from v_query_rows", "v_query_rows"))
def q_role_expression(spark, sf):
    v = view(spark, sf, "v_query_rows")
    return v.select("input_row_id",
                    T.role_expression(T.tokenize_roles(F.array("role_1", "role_2"))).alias("role_expr"))


@register("clean_operators", with_views(
    f"select input_row_id, {D.clean_operators('original_input')} as cleaned from v_queries", "v_queries"))
def q_clean_operators(spark, sf):
    v = view(spark, sf, "v_queries")
    return v.select("input_row_id", T.clean_operators("original_input").alias("cleaned"))


@register("drop_empty_parens", with_views(
    f"select input_row_id, {D.drop_empty_parens(D.clean_operators('original_input'))} as cleaned from v_queries",
    "v_queries"))
def q_drop_empty_parens(spark, sf):
    v = view(spark, sf, "v_queries")
    return v.select("input_row_id", T.drop_empty_parens(T.clean_operators("original_input")).alias("cleaned"))


@register("balance_parens", with_views(
    f"select input_row_id, {D.balance_parens(D.clean_operators('original_input'))} as cleaned from v_queries",
    "v_queries"))
def q_balance_parens(spark, sf):
    v = view(spark, sf, "v_queries")
    return v.select("input_row_id", T.balance_parens(T.clean_operators("original_input")).alias("cleaned"))


@register("clean_query", with_views(
    f"select input_row_id, {D.clean_query('original_input')} as cleaned from v_queries", "v_queries"))
def q_clean_query(spark, sf):
    v = view(spark, sf, "v_queries")
    return v.select("input_row_id", T.clean_query("original_input").alias("cleaned"))


@register("apply_site_filters", with_views(
    f"select input_row_id, {D.apply_site_filters('c', SITES)} as with_sites "
    f"from (select input_row_id, {D.clean_query('original_input')} as c from v_queries)", "v_queries"))
def q_apply_site_filters(spark, sf):
    v = view(spark, sf, "v_queries")
    return v.select("input_row_id", T.apply_site_filters(T.clean_query("original_input"), SITES).alias("with_sites"))


@register("site_suffix", with_views(
    f"select input_row_id, case when fq = c then '' else {D.strip('substr(fq, length(c) + 1)')} end as suffix "
    f"from (select input_row_id, c, {D.apply_site_filters("c", SITES)} as fq "
    f"from (select input_row_id, {D.clean_query('original_input')} as c from v_queries))", "v_queries"))
def q_site_suffix(spark, sf):
    v = view(spark, sf, "v_queries")
    return v.select("input_row_id", T.site_suffix(T.clean_query("original_input"), SITES).alias("suffix"))


@register("normalize_query", with_views(
    f"select input_row_id, {D.normalize_query('original_input', SITES)} as normalized from v_queries",
    "v_queries"))
def q_normalize_query(spark, sf):
    v = view(spark, sf, "v_queries")
    return v.select("input_row_id", T.normalize_query("original_input", SITES).alias("normalized"))


@register("query_hash", with_views(
    f"select input_row_id, sha256({D.normalize_query('original_input', SITES)}) as query_hash from v_queries",
    "v_queries"))
def q_query_hash(spark, sf):
    v = view(spark, sf, "v_queries")
    return v.select("input_row_id", T.query_hash(T.normalize_query("original_input", SITES)).alias("query_hash"))


@register("needs_split", with_views(
    f"select input_row_id, length(c) > 256 or len({D.tokens('c')}) > 14 as needs_split "
    f"from (select input_row_id, {D.clean_query('original_input')} as c from v_queries)", "v_queries"))
def q_needs_split(spark, sf):
    v = view(spark, sf, "v_queries")
    return v.select("input_row_id", T.needs_split(T.clean_query("original_input")).alias("needs_split"))


def _duck_split(toks: str) -> str:
    n = f"len({toks})"
    chunks = f"greatest(3, least(6, cast(ceil({n} / 8.0) as integer)))"
    size = f"cast(ceil({n} / {chunks}) as integer)"
    # chunk k (1-based) starts at token (k - 1) * size + 1
    return (f"case when {n} = 0 then []::varchar[] else list_transform(range(0, {n}, {size}), "
            f"lambda st: array_to_string({toks}[st + 1 : st + {size}], ' ')) end")


@register("split_query", with_views(
    f"""select input_row_id, cast(generate_subscripts(parts, 1) - 1 as integer) as chunk_idx, unnest(parts) as chunk
from (select input_row_id, {_duck_split(D.tokens(D.clean_query('original_input')))} as parts from v_queries)""",
    "v_queries"))
def q_split_query(spark, sf):
    v = view(spark, sf, "v_queries")
    return v.select("input_row_id", F.posexplode(T.split_query(T.clean_query("original_input")))
                    .alias("chunk_idx", "chunk"))


FINAL_SUBQUERIES_SQL = f"""select input_row_id, final_query, cast(sub_idx as integer) as sub_idx, {D.apply_site_filters(D.clean_query('p'), SITES)} as sub_query
from (select input_row_id, final_query, unnest(range(0, len(parts))) as sub_idx, unnest(parts) as p
      from (select input_row_id, final_query,
              case when length(final_query) > 256 or len({D.tokens('final_query')}) > 14
                   then {_duck_split(D.tokens('final_query'))} else [final_query] end as parts
            from (select input_row_id, {D.apply_site_filters(D.clean_query('original_input'), SITES)} as final_query
                  from v_queries)))"""


@register("final_subqueries", with_views(FINAL_SUBQUERIES_SQL, "v_queries"))
def q_final_subqueries(spark, sf):
    return compose.final_subqueries(view(spark, sf, "v_queries"), OPTS)


@register("drop_blank_queries", with_views(
    f"select input_row_id, role_1 as original_input from v_query_rows "
    f"where role_1 is not null and {D.strip('role_1')} <> ''", "v_query_rows"))
def q_drop_blank_queries(spark, sf):
    v = view(spark, sf, "v_query_rows").select("input_row_id", F.col("role_1").alias("original_input"))
    return compose.drop_blank_queries(v)


# ------------------------------------------------------------------ 2.C dedup

_DUCK_ANNOT = (f"select input_row_id, original_input, {D.apply_site_filters(D.clean_query('original_input'), SITES)}"
               f" as final_query from v_queries where original_input is not null and {D.strip('original_input')} <> ''")
_DUCK_AUDIT = f"""select input_row_id, original_input, final_query, sha256({D.collapse('lower(final_query)')}) as normalized_query_hash
from ({_DUCK_ANNOT})"""


@register("dedup_queries", with_views(
    f"""select input_row_id, original_input, final_query, normalized_query_hash from (
  select *, row_number() over (partition by normalized_query_hash order by input_row_id) as rn from ({_DUCK_AUDIT}))
where rn = 1""", "v_queries"))
def q_dedup_queries(spark, sf):
    return dedup.dedup_queries(view(spark, sf, "v_queries"), OPTS)


@register("query_audit", with_views(
    f"""select input_row_id, original_input, final_query, normalized_query_hash, timestamp '{NOW}' as timestamp,
  input_row_id > min(input_row_id) over (partition by normalized_query_hash) as deduplicated
from ({_DUCK_AUDIT})""", "v_queries"))
def q_query_audit(spark, sf):
    return dedup.query_audit(view(spark, sf, "v_queries"), OPTS, now_col())


@register("query_dedup_stats", with_views(
    f"""select (select count(*) from v_queries) as parsed,
  count(distinct normalized_query_hash) as "unique",
  count(*) - count(distinct normalized_query_hash) as skipped
from ({_DUCK_AUDIT})""", "v_queries"))
def q_query_dedup_stats(spark, sf):
    return dedup.query_dedup_stats(view(spark, sf, "v_queries"), OPTS)
