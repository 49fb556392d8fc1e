"""Checked queries for sources (2.A), sinks (2.H), the log rollup (I10) and
the streaming forms (2.K). Each writes data Spark derives from the driver
tables to a fresh folder under the shared checkpoint folder, then reads or
streams it back through the operator."""

from __future__ import annotations

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from serpframe.operators import compose, dedup, flatten, metrics, results, rollups
from serpframe.plans import duck as D
from serpframe.plans.fixtures import view, with_views
from serpframe.plans.inputs import landed_pages, raw_records
from serpframe.plans.q_ops import TTL, _JOB, QUOTA
from serpframe.plans.q_results import _CANDS, _M, _WEB, _deduped, _g2_sql
from serpframe.plans.q_text import _DUCK_AUDIT
from serpframe.plans.registry import OPTS, ORACLES, now_col, register
from serpframe.session import scratch_path
from serpframe.sinks import audit_log
from serpframe.sinks import writers as W
from serpframe.sources import queries as SQ
from serpframe.sources import responses as SR
from serpframe.sources.json_list import read_json_elements
from serpframe.streaming import streams as K

def _composed(cells: str, src: str) -> str:
    """Oracle: the non-blank cells of each row composed into one query."""
    return f"""select {D.strip(f"(ensure || {D.role_expression(D.tokenize_roles('roles'))})")} as original_input
from (select {D.ensure_quoted('cells[1]')} as ensure, cells[2:] as roles
      from (select list_filter([{cells}], lambda x: x is not null and x <> '') as cells from {src}) where len(cells) > 0)"""


@register("read_queries_csv", with_views(
    _composed(f"{D.strip('anchor')}, {D.strip('role_1')}", "v_csv_rows"), "v_csv_rows"))
def q_read_queries_csv(spark, sf):
    """Cells to compose, under headers with a dot and with a name the reader uses itself."""
    path = scratch_path(spark, "queries-csv")
    rows = view(spark, sf, "v_csv_rows").select("anchor", "role_1", F.lit("10").alias("max_pages"))
    W.write_csv(rows.toDF("the.anchor", "input_row_id", "Max_Pages"), path)
    return SQ.read_queries_csv(spark, path).select("original_input")


@register("read_queries_csv_ready", with_views(f"select {D.strip('anchor')} as original_input from v_csv_rows", "v_csv_rows"))
def q_read_queries_csv_ready(spark, sf):
    """A column of ready queries."""
    path = scratch_path(spark, "queries-csv")
    W.write_csv(view(spark, sf, "v_csv_rows").select("role_1", "anchor").toDF("other", " Query "), path)
    return SQ.read_queries_csv(spark, path).select("original_input")


@register("read_queries_text", with_views(
    f"select {D.strip('original_input')} as original_input from v_queries where {D.strip('original_input')} <> ''",
    "v_queries"))
def q_read_queries_text(spark, sf):
    path = scratch_path(spark, "queries-txt")
    view(spark, sf, "v_queries").select("original_input").write.text(path)
    return SQ.read_queries_text(spark, path).select("original_input")


_ELEMENT = f"""case p_partkey % 3 when 0 then {D.ensure_quoted('p_name')} when 1 then {D.ensure_quoted("('{curly} ' || p_name)")}
  else {D.strip(f"({D.ensure_quoted('p_name')} || {D.role_expression(D.tokenize_roles('[p_type]'))})")} end"""
_ELEMENTS = with_views(f"select {_ELEMENT} as original_input from v_json_rows", "v_json_rows")


#: Rows of a JSON document at most.
DOCUMENT_ROWS = 1000


def _grouped(spark, sf):
    """Elements (``els``) and names of each JSON document, and whether it is the ``first`` of its ``doc``.

    The view deals the rows into ten; each of them goes on in further
    documents, so that their number and not their size grows with the table.
    """
    rows = view(spark, sf, "v_json_rows")
    slices = rows.withColumn("slice", F.floor(F.col("p_partkey") / (10 * DOCUMENT_ROWS)))
    lowest = slices.groupBy("doc").agg(F.min("slice").alias("lowest")).withColumnRenamed("doc", "of")
    docs = slices.groupBy("doc", "slice").agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("element"), ", "), F.lit("]")).alias("els"),
        F.collect_list("p_name").alias("names"))
    return docs.join(F.broadcast(lowest), F.col("doc").eqNullSafe(F.col("of"))) \
        .select("els", "names", F.col("slice").eqNullSafe(F.col("lowest")).alias("first"))


def _documents(spark, sf, name, text):
    """JSON documents, one file each, from ``text`` over grouped elements and names."""
    path = scratch_path(spark, name)
    _grouped(spark, sf).select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return SQ.read_queries_json(spark, path).select("original_input")


@register("read_queries_json", _ELEMENTS)
def q_read_queries_json(spark, sf):
    """JSON Lines of texts and objects."""
    path = scratch_path(spark, "queries-jsonl")
    view(spark, sf, "v_json_rows").select("element").write.text(path)
    return SQ.read_queries_json(spark, path, lines=True).select("original_input")


@register("read_queries_json_list", _ELEMENTS)
def q_read_queries_json_list(spark, sf):
    return _documents(spark, sf, "json-list", F.col("els"))


@register("read_queries_json_split", _ELEMENTS)
def q_read_queries_json_split(spark, sf):
    """The lists again, by the reader that cuts files at element borders."""
    path = scratch_path(spark, "json-split")
    _grouped(spark, sf).select(F.col("els").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return SQ.read_queries_json_list(spark, path).select("original_input")


@register("read_json_elements", with_views(
    """select '["a, ' || p_name || ' \\" ] {", {"k": [' || element || ', [1, ""]]}]' as element from v_json_rows""", "v_json_rows"))
def q_read_json_elements(spark, sf):
    """Nested elements with commas, quotes and brackets inside strings."""
    path = scratch_path(spark, "json-nested")
    rows = view(spark, sf, "v_json_rows").withColumn("slice", F.floor(F.col("p_partkey") / DOCUMENT_ROWS))
    nested = F.concat(F.lit('["a, '), "p_name", F.lit(' \\" ] {", {"k": ['), "element", F.lit(', [1, ""]]}]'))
    rows.groupBy("slice").agg(F.concat(F.lit(" [\n"), F.array_join(F.collect_list(nested), "\n,"), F.lit("]\n")).alias("value")) \
        .select("value").write.option("maxRecordsPerFile", 1).text(path)
    return read_json_elements(spark, path).select("element")


@register("read_queries_json_keyed", _ELEMENTS)
def q_read_queries_json_keyed(spark, sf):
    return _documents(spark, sf, "json-keyed", F.concat(
        F.lit('{"other": ["x"], "queries": "no list", "terms": '), F.col("els"), F.lit("}")))


@register("read_queries_json_spread", with_views(
    f"select {D.ensure_quoted('p_name')} as original_input from v_json_rows "
    f"union all select {D.ensure_quoted(D.q('{last} one'))} from (select distinct doc from v_json_rows)", "v_json_rows"))
def q_read_queries_json_spread(spark, sf):
    """An object of lists and texts; its number and its object are no queries."""
    return _documents(spark, sf, "json-spread", F.concat(
        F.lit('{"limit": 10, "meta": {"k": "v"}, "names": '), F.to_json("names"),
        F.when(F.col("first"), ', "q": "{last} one"}').otherwise("}")))


@register("read_queries", with_views(
    f"select {D.strip('original_input')} as original_input from v_queries where {D.strip('original_input')} <> ''",
    "v_queries"))
def q_read_queries(spark, sf):
    path = scratch_path(spark, "queries") + ".txt"
    view(spark, sf, "v_queries").select("original_input").write.text(path)
    return SQ.read_queries(spark, path).select("original_input")


def _landed(spark, sf):
    """Write the item view as landed response records (JSON Lines)."""
    path = scratch_path(spark, "responses")
    pages = landed_pages(view(spark, sf, "v_items"), now_col())
    pages.select(F.sha2(F.concat_ws("|", "term", F.col("page").cast("string")), 256).alias("request_key"),
                 "term", "page", "fetched_at",
                 F.struct(F.col("items"), F.struct(F.col("total_results").alias("totalResults"))
                          .alias("searchInformation")).alias("body")).write.json(path)
    return path


@register("read_responses", with_views(
    """select term, cast(page as bigint) as page, count(*) as n_items,
  md5(string_agg(concat(title, '|', link, '|', snippet, '|', og_description, '|', twitter_description), '#' order by idx)) as body
from v_items group by term, page""", "v_items"))
def q_read_responses(spark, sf):
    pages = SR.response_pages(SR.read_responses(spark, _landed(spark, sf)))

    def meta(i, name):
        return F.coalesce(F.try_element_at(i["pagemap"]["metatags"][0], F.lit(name)), F.lit(""))
    text = F.array_join(F.transform("items", lambda i: F.concat_ws(
        "|", i["title"], i["link"], i["snippet"], meta(i, "og:description"), meta(i, "twitter:description"))), "#")
    return pages.select("term", "page", "n_items", F.md5(text).alias("body"))


_LOGS = """select 'app' as logger, outcome as action,
  case outcome when 'done' then 'success' when 'duplicate' then 'skipped' else 'fail' end as status,
  case outcome when 'done' then 'INFO' when 'duplicate' then 'INFO' else 'WARNING' end as level,
  cast(job_id as varchar) as query_id, n_results as items_count, event_id,
  case when event_id % 6 = 0 then event_id / 4.0 end as ratio
  from v_job_events where event_id % 50 <> 7"""


def _logs(spark, sf):
    """The job events as log lines with nested extras; every fiftieth line is cut short."""
    path = scratch_path(spark, "logs")
    o = F.col("outcome")
    detail = F.struct((F.col("event_id") / 4.0).cast("decimal(20,2)").alias("ratio"), F.array(o, F.lit("x,y")).alias("tags"),
                      (F.col("event_id") % 2 == 0).alias("even"))
    line = F.to_json(F.struct(
        F.lit("app").alias("logger"), o.alias("action"),
        F.when(o == "done", "success").when(o == "duplicate", "skipped").otherwise("fail").alias("status"),
        F.when(o.isin("done", "duplicate"), "INFO").otherwise("WARNING").alias("level"),
        F.col("job_id").cast("string").alias("query_id"), F.col("n_results").alias("items_count"),
        "event_id", F.when(F.col("event_id") % 6 == 0, detail).alias("detail")))
    view(spark, sf, "v_job_events").select(F.when(F.col("event_id") % 50 == 7, F.substring(line, 1, 27)).otherwise(line).alias("value")) \
        .write.text(path)
    return SR.read_log_events(spark, path)


@register("read_log_events", with_views(
    f"""select query_id, action, items_count, event_id, cast(ratio as double) as ratio, null as broken from ({_LOGS})
union all select null, null, null, null, null, '{{"logger":"app","action":"' || substr(outcome, 1, 1)
from v_job_events where event_id % 50 = 7""", "v_job_events"))
def q_read_log_events(spark, sf):
    """Known keys typed, other keys by path and type from ``extra``, broken lines kept."""
    return _logs(spark, sf).select("query_id", "action", "items_count",
                                   F.try_variant_get("extra", "$.event_id", "bigint").alias("event_id"),
                                   F.try_variant_get("extra", "$.detail.ratio", "double").alias("ratio"), "broken")


@register("log_extras", with_views(
    """select event_id, key, kind, second_tag, even from (
  select event_id, 'event_id' as key, 'BIGINT' as kind, null as second_tag, null as even from v_job_events
  union all
  select event_id, 'detail', 'OBJECT', 'x,y', event_id % 2 = 0 from v_job_events where event_id % 6 = 0)
where event_id % 50 <> 7""", "v_job_events"))
def q_log_extras(spark, sf):
    """The extras of each line by key, with their JSON types and what is nested in them."""
    logs = _logs(spark, sf)
    spread = SR.extra_fields(logs.withColumn("event_id", F.try_variant_get("extra", "$.event_id", "bigint")))
    return spread.select("event_id", "key", "kind", F.try_variant_get("value", "$.tags[1]", "string").alias("second_tag"),
                         F.try_variant_get("value", "$.even", "boolean").alias("even"))


@register("log_quality", with_views(
    "select count(*) as lines, count(*) filter (event_id % 50 = 7) as broken, count(*) filter (event_id % 50 <> 7) as with_extra "
    "from v_job_events", "v_job_events"))
def q_log_quality(spark, sf):
    return metrics.log_quality(_logs(spark, sf))


@register("log_rollup", with_views(
    f"select logger, action, status, level, count(*) as n from ({_LOGS}) group by all", "v_job_events"))
def q_log_rollup(spark, sf):
    return metrics.log_rollup(_logs(spark, sf))


# Some statuses are missing here, so a null key and a total over the key stand side by side.
_SET_LOGS = f"select logger, action, nullif(status, 'skipped') as status, level, items_count from ({_LOGS})"


@register("log_rollup_sets", with_views(
    f"""select logger, action, status, level, cast(grouping(logger, action, status, level) as bigint) as grouping_id,
  count(*) as n, cast(sum(items_count) as bigint) as items from ({_SET_LOGS})
group by grouping sets ((logger, action, status, level), (logger, level), (action, status), (level), ())""", "v_job_events"))
def q_log_rollup_sets(spark, sf):
    logs = _logs(spark, sf).where("broken is null").withColumn("status", F.nullif("status", F.lit("skipped")))
    return rollups.log_rollup_sets(logs)


# ------------------------------------------------------------------ sinks: write, read back

def _organic(spark, sf):
    d = _deduped(spark, sf)
    rec = d.select("fetched_at", F.struct(F.struct("term", "page").alias("searchQuery"),
                                          F.array("result").alias("searchResults")).alias("record"))
    return flatten.flatten_organic(rec, "record", now_col())


# what is written must come back whole: the oracle is that of the table itself
_ORGANIC = ORACLES["flatten_organic"]


@register("write_json", _ORGANIC)
def q_write_json(spark, sf):
    df = _organic(spark, sf)
    path = W.write_json(df, scratch_path(spark, "organic-json"))
    return spark.read.schema(df.schema).json(path)


@register("write_csv", _ORGANIC)
def q_write_csv(spark, sf):
    df = _organic(spark, sf)
    path = W.write_csv(df, scratch_path(spark, "organic-csv"))
    back = spark.read.schema(df.schema).options(header=True, multiLine=True, **W.CSV_DIALECT).csv(path)
    # CSV has no null text
    return back.fillna("", ["query", "title", "url", "displayed_url", "snippet"])


@register("export", _ORGANIC)
def q_export(spark, sf):
    path = W.export(_organic(spark, sf), scratch_path(spark, "export") + ".parquet")
    return spark.read.parquet(path)


_TABLES = {"organic_results": ("title", "url", "snippet"), "people_also_ask": ("question", "answer", "url"),
           "related_queries": ("related_query",), "paid_results": ("title", "url", "advertiser", "snippet"),
           "ai_overview": ("content_json",)}


def _tables_sql() -> str:
    organic = ("select coalesce(nullif(title, ''), result_title, '') as title, coalesce(nullif(url, ''), link, '') as url, "
               "coalesce(nullif(snippet, ''), description, '') as snippet from v_raw_flat")
    bodies = {"organic_results": organic, **{name: _body(key) for name, key in (
        ("people_also_ask", "flatten_paa"), ("related_queries", "flatten_related"), ("paid_results", "flatten_paid"),
        ("ai_overview", "flatten_ai_overview"))}}
    parts = []
    for name, cols in _TABLES.items():
        text = " || '|' || ".join(cols)
        parts.append(f"select '{name}' as table_name, count(*) as n, "
                     f"cast(sum(cast(('0x' || substr(md5({text}), 1, 8)) as bigint)) as bigint) as content from ({bodies[name]})")
    return with_views(" union all ".join(parts), "v_raw_flat")


def _body(key: str) -> str:
    """An oracle over v_raw_flat without its leading views."""
    return ORACLES[key].removeprefix(with_views("", "v_raw_flat"))


def _content(spark, root, names):
    """Rows and a sum over the content of each table under ``root``."""
    out = None
    for name in names:
        text = F.md5(F.concat_ws("|", *_TABLES[name]))
        part = spark.read.parquet(os.path.join(root, name)).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint")).alias("content")) \
            .select(F.lit(name).alias("table_name"), "n", "content")
        out = part if out is None else out.unionByName(part)
    return out


@register("write_result_tables", _tables_sql())
def q_write_result_tables(spark, sf):
    raw = raw_records(view(spark, sf, "v_raw_flat"))
    tables = {"organic_results": flatten.flatten_organic(raw, "raw", now_col()),
              "people_also_ask": flatten.flatten_paa(raw, "raw", now_col()),
              "related_queries": flatten.flatten_related(raw, "raw", now_col()),
              "paid_results": flatten.flatten_paid(raw, "raw", now_col()),
              "ai_overview": flatten.flatten_ai_overview(raw, "raw", now_col())}
    root = scratch_path(spark, "tables")
    return _content(spark, root, W.write_result_tables(tables, root))


@register("write_results", _tables_sql())
def q_write_results(spark, sf):
    """The tables out of a snapshot that is written first."""
    raw = raw_records(view(spark, sf, "v_raw_flat"))
    root = scratch_path(spark, "results")
    return _content(spark, root, W.write_results(raw, root, "raw", now_col()))


@register("write_query_audit", with_views(
    f"""select a.*, t.run from (select input_row_id, original_input, final_query, normalized_query_hash,
  input_row_id > min(input_row_id) over (partition by normalized_query_hash) as deduplicated from ({_DUCK_AUDIT})) a,
  range(1, 3) t(run)""", "v_queries"))
def q_write_query_audit(spark, sf):
    """Two runs append to one log."""
    path = scratch_path(spark, "audit")
    audit = dedup.query_audit(view(spark, sf, "v_queries"), OPTS, now_col())
    for _ in range(2):
        W.write_query_audit(audit, path)
    back = spark.read.schema(audit.schema).json(path)
    run = F.row_number().over(Window.partitionBy("input_row_id").orderBy("timestamp"))
    return back.select("input_row_id", "original_input", "final_query", "normalized_query_hash", "deduplicated",
                       run.cast("bigint").alias("run"))


@register("append_audit", with_views(
    f"""select a.*, t.batch from (select input_row_id, original_input, final_query, normalized_query_hash,
  input_row_id > min(input_row_id) over (partition by normalized_query_hash) as deduplicated from ({_DUCK_AUDIT})) a,
  (values ('run-1'), ('run-2')) t(batch)""", "v_queries"))
def q_append_audit(spark, sf):
    """Two batches; the second is run again, and a third is written but never committed."""
    path = scratch_path(spark, "audit-log")
    audit = dedup.query_audit(view(spark, sf, "v_queries"), OPTS, now_col())
    for batch in ("run-1", "run-2", "run-2"):
        audit_log.append_audit(audit, path, batch)
    audit_log.stage_audit(audit, path, "run-3")
    return audit_log.read_audit(spark, path, audit.schema).drop("timestamp")


@register("write_unified_snapshot", with_views(
    f""", {_M}
select position, nullif(title, '') as title, nullif(url, '') as url, snip as snippet
from {_WEB}""", "v_items"))
def q_write_unified_snapshot(spark, sf):
    from serpframe.operators import normalize
    from serpframe.plans.q_results import _records
    recs = normalize.normalize_items(_records(_deduped(spark, sf)), "raw", "record")
    path = W.write_unified_snapshot(recs, scratch_path(spark, "snapshot"))
    return spark.read.parquet(path).select(F.explode("record.organicResults").alias("o")) \
        .select("o.position", "o.title", "o.url", "o.snippet")


# ------------------------------------------------------------------ streaming, run to completion

def _run(query_df, spark, name, keys=()):
    """Run a streaming query with availableNow and read back what it wrote:
    in append mode, or with ``keys`` in update mode, merged by key."""
    out = scratch_path(spark, f"{name}-out")
    _go(query_df, out, scratch_path(spark, f"{name}-ckpt"), keys)
    return K.merged(spark, out, keys) if keys else spark.read.parquet(out)


def _go(query_df, out, checkpoint, keys=()):
    w = query_df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    w = w.foreachBatch(K.merge_sink(out)).outputMode("update") if keys else w.format("parquet").option("path", out).outputMode("append")
    w.start().awaitTermination()


def _in_slices(spark, df, ts, cuts, name, stream, out):
    """Write ``df`` in slices of time and run the query over each, from the same checkpoint every time."""
    src, checkpoint = scratch_path(spark, f"{name}-src"), scratch_path(spark, f"{name}-ckpt")
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = df.where((F.lit(True) if lo is None else F.col(ts) >= lo) & (F.lit(True) if hi is None else F.col(ts) < hi))
        part.write.mode("append").parquet(src)
        _go(stream(spark.readStream.schema(df.schema).parquet(src)), out, checkpoint)


@register("stream_organic", with_views(
    f", {_M}\n" + _g2_sql("(select *, snippet as snip from m)", "null", "null", "true", _CANDS), "v_items"))
def q_stream_organic(spark, sf):
    src = _landed(spark, sf)
    return _run(K.stream_organic(spark, src), spark, "stream-organic")


@register("stream_dedup_queries", with_views(
    f"select distinct normalized_query_hash from ({_DUCK_AUDIT})", "v_queries"))
def q_stream_dedup_queries(spark, sf):
    src = scratch_path(spark, "stream-queries")
    q = compose.drop_blank_queries(view(spark, sf, "v_queries"))
    q.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("input_row_id"))).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    out = _run(K.stream_dedup_queries(stream, OPTS, "ts", "30 days"), spark, "stream-dedup")
    return out.select("normalized_query_hash")


def _stream_src(spark, sf, name, view_name):
    src = scratch_path(spark, name)
    view(spark, sf, view_name).write.parquet(src)
    return spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)


@register("stream_daily_usage", with_views(
    f"select strftime(cast(ts as date), '%Y-%m-%d') as day, count(*) filter (where ok = 1) as used, "
    f"cast({QUOTA} as bigint) as quota, cast(greatest(0, {QUOTA} - count(*) filter (where ok = 1)) as bigint) as remaining "
    f"from v_requests group by 1", "v_requests"))
def q_stream_daily_usage(spark, sf):
    stream = _stream_src(spark, sf, "stream-requests", "v_requests")
    return _run(K.stream_daily_usage(stream, QUOTA), spark, "stream-usage", ["day"])


@register("stream_ttl_refetch", ORACLES["ttl_refetch_filter"])  # that of its batch twin
def q_stream_ttl_refetch(spark, sf):
    """The log in two slices of time, the query started anew from its checkpoint for the second."""
    out = scratch_path(spark, "stream-ttl-out")
    with K.rocksdb_state(spark):
        _in_slices(spark, view(spark, sf, "v_requests"), "ts", ["2024-01-15"], "stream-ttl",
                   lambda log: K.stream_ttl_refetch(log, "request_key", "ts", TTL, "request_id", columns=["ok"]), out)
    return spark.read.parquet(out)


def _closed(df, ts):
    """A row long after all others, so that the watermark passes them; without a partner it is never sent."""
    end = df.agg(F.max_by(F.struct(*df.columns), F.col(ts)).alias("r")).select("r.*")
    return df.unionByName(end.withColumn(ts, F.col(ts) + F.expr("interval 30 days"))
                          .withColumn("request_key", F.lit(-1).cast(df.schema["request_key"].dataType)))


def _cache_streams(spark, sf):
    log = view(spark, sf, "v_requests")
    kept = log.where("ok = 1 and request_id % 3 = 0").select("request_key", F.col("ts").alias("fetched_at"),
                                                             F.col("request_id").alias("response_id"))
    streams = []
    for df, ts, name in ((log, "ts", "asked"), (kept, "fetched_at", "stored")):
        src = scratch_path(spark, f"stream-{name}")
        _closed(df, ts).write.parquet(src)
        streams.append(spark.readStream.schema(df.schema).parquet(src))
    return streams


@register("stream_cache_lookup", ORACLES["cache_lookup_asof"])  # that of its batch twin
def q_stream_cache_lookup(spark, sf):
    asked, stored = _cache_streams(spark, sf)
    out = _run(K.stream_cache_lookup(asked, stored, TTL, payload=["response_id"]), spark, "stream-cache")
    return out.select("request_id", "fetched_at", "response_id", "age_s", "served")


@register("stream_cache_misses", with_views(
    f"""select request_id from v_requests q where not exists (
  select 1 from v_requests s where s.ok = 1 and s.request_id % 3 = 0 and s.request_key = q.request_key and s.ts <= q.ts
    and floor(epoch(q.ts)) - floor(epoch(s.ts)) <= {TTL})""", "v_requests"))
def q_stream_cache_misses(spark, sf):
    asked, stored = _cache_streams(spark, sf)
    return _run(K.stream_cache_misses(asked, stored, TTL), spark, "stream-misses").select("request_id")


@register("stream_job_status", with_views(_JOB, "v_job_events"))
def q_stream_job_status(spark, sf):
    stream = _stream_src(spark, sf, "stream-jobs", "v_job_events")
    days = _run(K.stream_job_progress(stream), spark, "stream-jobs", ["job_id", "day"])
    return metrics.job_status_of(days)


