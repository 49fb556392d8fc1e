"""Checked queries for requests, cache and quota (2.E) and usage, jobs and
summaries (2.I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from serpframe.operators import admission, compose, dedup, flatten, metrics, requests, rollups, spans
from serpframe.options import SearchOptions
from serpframe.plans import duck as D
from serpframe.plans.fixtures import view, with_views
from serpframe.plans.inputs import raw_records
from serpframe.plans.q_results import _M, _deduped
from serpframe.plans.q_text import _DUCK_AUDIT, FINAL_SUBQUERIES_SQL
from serpframe.plans.registry import NOW, OPTS, SITES, now_col, register
from serpframe.session import scratch_path

TTL = 86400
# The cache is looked at late on the last day of the event log.
CACHE_NOW = "2024-01-30 12:00:00"
QUOTA = 100
REQ_OPTS = SearchOptions(profile_sites=SITES, split_long_queries=True, max_pages=3, results_per_page=10,
                         engine_id="cx0", country_code="VN", language_code="vi", apply_locale_hints=True)

_PLAN_SQL = f"""select input_row_id, final_query, sub_idx, sub_query as q, cast(page as bigint) as page,
  cast(10 as bigint) as num, cast((page - 1) * 10 + 1 as bigint) as start,
  'lang_vi' as lr, 'vn' as gl, 'cx0' as cx
from ({FINAL_SUBQUERIES_SQL}), range(1, 4) t(page)"""


def _plan(spark, sf):
    subs = compose.final_subqueries(view(spark, sf, "v_queries"), REQ_OPTS)
    return requests.plan_requests(subs, REQ_OPTS)


@register("plan_requests", with_views(_PLAN_SQL, "v_queries"))
def q_plan_requests(spark, sf):
    return _plan(spark, sf)


@register("request_key", with_views(
    f"""select input_row_id, sub_idx, page,
  sha256('{{"cx": "' || cx || '", "gl": "' || gl || '", "lr": "' || lr || '", "num": ' || num || ', "q": ' || to_json(q)
    || ', "start": ' || start || '}}') as request_key
from ({_PLAN_SQL})""", "v_queries"))
def q_request_key(spark, sf):
    p = _plan(spark, sf)
    return p.select("input_row_id", "sub_idx", "page", requests.request_key(p).alias("request_key"))


def _log(spark, sf):
    return view(spark, sf, "v_requests")


def _responses(spark, sf):
    return _log(spark, sf).filter("ok = 1").select("request_key", F.col("ts").alias("fetched_at"))


def _cache_now():
    return F.lit(CACHE_NOW).cast("timestamp")


def _req_keys(spark, sf):
    return _log(spark, sf).select("request_key").distinct()


_LIVE = f"""live as (select request_key, fetched_at, age_s from (
    select request_key, fetched_at,
      cast(floor(epoch(timestamp '{CACHE_NOW}')) - floor(epoch(fetched_at)) as bigint) as age_s
    from (select request_key, max(ts) as fetched_at from v_requests
          where ok = 1 group by request_key))
  where age_s <= {TTL})"""


@register("cache_lookup", with_views(f", {_LIVE}\nselect request_key, fetched_at, age_s from live", "v_requests"))
def q_cache_lookup(spark, sf):
    return requests.cache_lookup(_req_keys(spark, sf), _responses(spark, sf), TTL, _cache_now())


@register("cache_misses", with_views(
    f", {_LIVE}\nselect distinct request_key from v_requests where request_key not in (select request_key from live)",
    "v_requests"))
def q_cache_misses(spark, sf):
    return requests.cache_misses(_req_keys(spark, sf), _responses(spark, sf), TTL, _cache_now())


@register("cache_lookup_asof", with_views(
    f"""select request_id, case when served then fetched_at end as fetched_at, case when served then response_id end as response_id,
  case when served then age end as age_s, served
from (select *, coalesce(age <= {TTL}, false) as served from (
  select q.request_id, s.ts as fetched_at, s.response_id,
    cast(floor(epoch(q.ts)) - floor(epoch(s.ts)) as bigint) as age
  from v_requests q asof left join (
    select request_key, ts, max(request_id) as response_id from v_requests where ok = 1 and request_id % 3 = 0 group by all) s
  on q.request_key = s.request_key and q.ts >= s.ts))""", "v_requests"))
def q_cache_lookup_asof(spark, sf):
    """Every request of the log against the responses that a third of it brought."""
    log = _log(spark, sf)
    kept = log.where("ok = 1 and request_id % 3 = 0").select("request_key", F.col("ts").alias("fetched_at"),
                                                             F.col("request_id").alias("response_id"))
    return requests.cache_lookup_asof(log, kept, TTL, payload=["response_id"]) \
        .select("request_id", "fetched_at", "response_id", "age_s", "served")


@register("ttl_refetch_filter", with_views(
    f""", secs as (select distinct request_key, cast(floor(epoch(ts)) as bigint) as sec from v_requests),
chain(request_key, sec) as (
  select request_key, min(sec) from secs group by request_key
  union all
  select c.request_key, (select min(s.sec) from secs s where s.request_key = c.request_key and s.sec > c.sec + {TTL})
  from chain c where c.sec is not null)
select request_id, ts, request_key, ok from (
  select v.*, row_number() over (partition by v.request_key, cast(floor(epoch(v.ts)) as bigint)
                                 order by v.ts, v.request_id) as rn
  from v_requests v join chain c on v.request_key = c.request_key and cast(floor(epoch(v.ts)) as bigint) = c.sec)
where rn = 1""", "v_requests", recursive=True))
def q_ttl_refetch_filter(spark, sf):
    return requests.ttl_refetch_filter(_log(spark, sf), "request_key", "ts", TTL, tiebreak="request_id")


# ------------------------------------------------------------------ 2.I

def _day_text(df):
    """Days as ISO text, so both engines hand back the same value type."""
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_USAGE = (f"select strftime(day, '%Y-%m-%d') as day, used, cast({QUOTA} as bigint) as quota, cast(greatest(0, {QUOTA} - used) as bigint) as remaining "
          f"from (select cast(ts as date) as day, count(*) filter (where ok = 1) as used from v_requests group by 1)")


@register("daily_usage", with_views(_USAGE, "v_requests"))
def q_daily_usage(spark, sf):
    return _day_text(metrics.daily_usage(_log(spark, sf), QUOTA))


@register("quota_gate", with_views(
    f"select request_id, ts, request_key, ok, strftime(cast(ts as date), '%Y-%m-%d') as day, "
    f"coalesce(sum(ok) over (partition by cast(ts as date) order by ts, request_id "
    f"rows between unbounded preceding and 1 preceding), 0) < {QUOTA} as accepted from v_requests",
    "v_requests"))
def q_quota_gate(spark, sf):
    return _day_text(metrics.quota_gate(_log(spark, sf), QUOTA))


@register("quota_gate_units", with_views(
    f""", r as (select *, cast(ts as date) as d, coalesce(units, 1) as n,
    row_number() over (partition by cast(ts as date) order by ts, request_id) as rn from v_unit_requests),
g(d, rn, before, used) as (
  select d, 0, 0::bigint, 0::bigint from (select distinct d from r)
  union all
  select r.d, r.rn, g.used, g.used + case when r.ok = 1 and r.n > 0 and g.used + r.n <= {QUOTA} then r.n else 0 end
  from g join r on r.d = g.d and r.rn = g.rn + 1)
select request_id, strftime(g.d, '%Y-%m-%d') as day, units, before as used_before,
  n < 0 or before + n <= {QUOTA} as accepted
from g join r on r.d = g.d and r.rn = g.rn""", "v_unit_requests", recursive=True))
def q_quota_gate_units(spark, sf):
    """Requests of several units: a refused one leaves room for a smaller one."""
    return _day_text(admission.quota_admission(view(spark, sf, "v_unit_requests"), QUOTA)) \
        .select("request_id", "day", "units", "used_before", "accepted")


@register("usage_cube", with_views(
    "select strftime(day, '%Y-%m-%d') as day, ok, cast(grouping(day, ok) as bigint) as grouping_id, count(*) as n "
    "from (select cast(ts as date) as day, ok from v_requests) group by cube (day, ok)", "v_requests"))
def q_usage_cube(spark, sf):
    return _day_text(rollups.usage_cube(_log(spark, sf)))


_SKETCH_RANGES = (("2024-01-01", "2024-01-07"), ("2024-01-05", "2024-01-20"), ("2024-01-01", "2024-01-31"), ("2025-01-01", "2025-01-02"))


@register("daily_sketches", with_views(
    " union all ".join(
        f"select '{a}' as first_day, '{b}' as last_day, count(*) as n, true as within "
        f"from v_requests where cast(ts as date) between date '{a}' and date '{b}'" for a, b in _SKETCH_RANGES)
    + f" union all select 'both', 'both', 0, true", "v_requests"))
def q_daily_sketches(spark, sf):
    """Distinct requests of ranges of days from merged daily sketches; ``within``: four standard errors of the exact count.

    The log comes in two batches, the second of them twice.
    """
    log = _log(spark, sf)
    kept = rollups.DailySketches(spark, scratch_path(spark, "sketches"))
    for batch, part in ((1, log.where("request_id % 2 = 0")), (2, log.where("request_id % 2 = 1")), (2, log.where("request_id % 2 = 1"))):
        kept.add(batch, part, "request_id")
    day = F.to_date("ts")
    in_range = lambda a, b: day.between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    exact = log.agg(*[F.count_distinct(F.when(in_range(a, b), F.col("request_id"))).alias(f"c{k}") for k, (a, b) in enumerate(_SKETCH_RANGES)],
                    F.count_distinct(F.when(in_range("2024-01-05", "2024-01-07"), F.col("request_id"))).alias("both"))
    exact = exact.select(F.explode(F.array(*[F.struct(F.lit(a).alias("first_day"), F.lit(b).alias("last_day"), F.col(f"c{k}").alias("exact"))
                                             for k, (a, b) in enumerate(_SKETCH_RANGES)],
                                           F.struct(F.lit("both").alias("first_day"), F.lit("both").alias("last_day"),
                                                    F.col("both").alias("exact")))).alias("x")).select("x.*")
    ranges = kept.distinct(_SKETCH_RANGES).select(F.date_format("first_day", "yyyy-MM-dd").alias("first_day"),
                                                  F.date_format("last_day", "yyyy-MM-dd").alias("last_day"), "n", "distinct")
    # ids that both of the first two ranges hold; its error is that of the larger of them
    both = kept.in_both(*_SKETCH_RANGES[:2]).select(F.lit("both").alias("first_day"), F.lit("both").alias("last_day"),
                                                    F.lit(0).cast("bigint").alias("n"), F.col("in_both").cast("bigint").alias("distinct"))
    near = F.abs(F.col("distinct") - F.col("exact")) <= F.lit(4 * kept.relative_error) * F.greatest("exact", F.lit(1)) \
        * F.when(F.col("first_day") == "both", 6).otherwise(1)
    return ranges.unionByName(both).join(F.broadcast(exact), ["first_day", "last_day"]).select("first_day", "last_day", "n", near.alias("within"))


_SPANS = """spans as (
  select job_id, min(ts) as start_at, max(ts) + interval 600 seconds as end_at, count(*) as errors from (
    select *, sum(new) over (partition by job_id order by ts, event_id) as session from (
      select *, case when lag(ts) over (partition by job_id order by ts, event_id) >= ts - interval 600 seconds then 0 else 1 end as new
      from v_job_events where outcome = 'quota_error'))
  group by job_id, session)"""


@register("quota_spans", with_views(f", {_SPANS} select * from spans", "v_job_events"))
def q_quota_spans(spark, sf):
    return spans.quota_spans(view(spark, sf, "v_job_events"), 600)


@register("events_in_incidents", with_views(
    f""", {_SPANS}, wide as (
  select job_id as incident_job, start_at, case when job_id % 40 = 1 then end_at + interval 9 days else end_at end as end_at from spans)
select event_id, incident_job, start_at from v_job_events join wide on ts between start_at and end_at""", "v_job_events"))
def q_events_in_incidents(spark, sf):
    """All events during each quota incident, of any job; some incidents last for days."""
    events = view(spark, sf, "v_job_events")
    far = F.when(F.col("job_id") % 40 == 1, F.expr("end_at + interval 9 days")).otherwise(F.col("end_at"))
    wide = spans.quota_spans(events, 600).select(F.col("job_id").alias("incident_job"), "start_at", far.alias("end_at"))
    return spans.points_in_spans(events.select("event_id", "ts"), wide).select("event_id", "incident_job", "start_at")


@register("usage_level", with_views(
    f"""select *, case when percent >= 90 then 'danger' when percent >= 70 then 'warn' else 'ok' end as level,
  used >= quota as limit_reached
from (select *, cast(least(100, greatest(0, floor(used * 100.0 / greatest(quota, 1) + 0.5))) as bigint) as percent
      from ({_USAGE}))""", "v_requests"))
def q_usage_level(spark, sf):
    return metrics.usage_level(_day_text(metrics.daily_usage(_log(spark, sf), QUOTA)))


_JOB = """select job_id, status, cast(floor(completed_keywords * 100 / greatest(total_keywords, 1)) as bigint) as progress,
  total_keywords, completed_keywords, results_count, created_at,
  case status when 'failed' then aborted when 'completed' then last_updated end as completed_at, last_updated
from (select *, case when aborted is not null then 'failed' when begun = 0 then 'pending'
        when completed_keywords >= uniq then 'completed' else 'running' end as status
      from (select job_id, max(total_keywords) as total_keywords,
        count(*) filter (where outcome in ('done', 'failed', 'quota_error')) as completed_keywords,
        coalesce(sum(n_results) filter (where outcome = 'done'), 0) as results_count,
        count(*) filter (where outcome not in ('duplicate', 'queued', 'aborted')) as uniq,
        count(*) filter (where outcome <> 'queued') as begun,
        max(ts) filter (where outcome = 'aborted') as aborted,
        min(ts) as created_at, max(ts) as last_updated
      from v_job_events group by job_id))"""


def _jobs(spark, sf):
    return metrics.job_status(view(spark, sf, "v_job_events"))


@register("job_status", with_views(_JOB, "v_job_events"))
def q_job_status(spark, sf):
    return _jobs(spark, sf)


@register("job_speed", with_views(
    f"""select job_id, event_id, ts, before as completed_before,
  round(case when before > 0 and el > 0 then before / el * 60 end, 6) as processing_speed,
  case when before > 0 and el > 0 then cast(floor((uniq - before) / (before / el * 60) * 60) as bigint) end
    as eta_seconds
from (select e.job_id, event_id, ts, uniq, epoch(ts) - epoch(st) as el,
        count(*) over (partition by e.job_id order by ts, event_id rows between unbounded preceding and 1 preceding) as before
      from (select * from v_job_events where outcome not in ('duplicate', 'queued', 'aborted')) e
      join (select job_id, min(ts) as st, count(*) filter (where outcome not in ('duplicate', 'aborted')) as uniq
            from v_job_events where outcome <> 'queued' group by job_id) j on e.job_id = j.job_id)""", "v_job_events"))
def q_job_speed(spark, sf):
    return metrics.job_speed(view(spark, sf, "v_job_events")) \
        .withColumn("processing_speed", F.round("processing_speed", 6))


@register("list_jobs", with_views(
    f"select job_id, status, progress, total_keywords, completed_keywords, results_count, created_at, completed_at "
    f"from ({_JOB})", "v_job_events"))
def q_list_jobs(spark, sf):
    return metrics.list_jobs(_jobs(spark, sf))


def _stage_sql() -> str:
    L = metrics.STAGE_LABELS
    return f"""select job_id, stage, case stage when 'fetching' then 'Scraping keywords… ' || coalesce(completed_keywords, 0)
    || '/' || coalesce(total_keywords, 0) {' '.join(f"when '{k}' then {D.q(v)}" for k, v in L.items() if k != 'fetching')}
    else '' end as label
from (select *, case when status = 'pending' then 'pending'
    when status = 'running' and coalesce(progress, 0) < 5 then 'preparing'
    when status = 'running' and coalesce(progress, 0) < 15 then 'starting'
    when status = 'running' and coalesce(progress, 0) < 90 then 'fetching'
    when status = 'running' then 'finalizing' when status = 'completed' then 'completed'
    when status = 'failed' then 'failed' else '' end as stage from ({_JOB}))"""


@register("job_stage", with_views(_stage_sql(), "v_job_events"))
def q_job_stage(spark, sf):
    return metrics.job_stage(_jobs(spark, sf))


@register("quota_incidents", with_views(
    """select j.job_id, coalesce(q.n, 0) > 0 as quota_exceeded, q.event_id as affected_event_id, q.ts as occurred_at
from (select distinct job_id from v_job_events) j
left join (select job_id, event_id, ts, n from (
    select job_id, event_id, ts, count(*) over (partition by job_id) as n,
      row_number() over (partition by job_id order by ts desc, event_id desc) as rn
    from v_job_events where outcome = 'quota_error') where rn = 1) q on j.job_id = q.job_id""", "v_job_events"))
def q_quota_incidents(spark, sf):
    return metrics.quota_incidents(view(spark, sf, "v_job_events"))


@register("result_kind_counts", with_views(
    """select kind, count(*) as n from (
  select 'organic' as kind from v_raw_flat
  union all select 'people_also_ask' from v_raw_flat
  union all select 'related' from (select unnest(case when rq_item is not null then [rq_item, '']
      when rs_item is not null then [rs_item] else []::varchar[] end) from v_raw_flat)
  union all select 'paid' from v_raw_flat
  union all select 'ai_overview' from v_raw_flat where coalesce(case when trim(ai_main) not in ('', '{}', '[]', 'null', '""', '0', 'false') then ai_main end,
      case when trim(ai_alt) not in ('', '{}', '[]', 'null', '""', '0', 'false') then ai_alt end) is not null)
group by kind""", "v_raw_flat"))
def q_result_kind_counts(spark, sf):
    raw = raw_records(view(spark, sf, "v_raw_flat"))
    return metrics.result_kind_counts(flatten.result_sizes(raw, "raw"))


@register("run_summary", with_views(
    f""", {_M}
select (select count(distinct normalized_query_hash) from ({_DUCK_AUDIT})) as sent,
  (select count(*) from md) as items, (select count(*) from md) as organic_rows""", "v_queries", "v_items"))
def q_run_summary(spark, sf):
    queries = dedup.annotate_queries(compose.drop_blank_queries(view(spark, sf, "v_queries")), OPTS)
    return metrics.run_summary(queries, _deduped(spark, sf))
