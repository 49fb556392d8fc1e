"""Input views over the driver tables, one SQL text for Spark and DuckDB.

The driver tables hold no search data, so these views shape them into
queries, result items, raw records, request logs, error bodies, job events
and platform names. The same text is registered in Spark and inlined as a
CTE in the DuckDB oracle, so a check compares operators, not inputs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "v_queries": """
select p_partkey + 1 as input_row_id,
 case p_partkey % 8
  when 0 then p_name
  when 1 then concat('(OR ', p_name, ') AND')
  when 2 then concat(p_name, ' OR OR ', p_type)
  when 3 then concat('((', p_name, ' ', p_brand)
  when 4 then concat(p_name, '))')
  when 5 then concat('  ', upper(p_name), '   () ')
  when 6 then concat(p_name, ' ( ( ) )')
  else concat(repeat(concat(p_name, ' '), 9), p_brand) end as original_input
from part""",
    "v_query_rows": """
select p_partkey + 1 as input_row_id, p_name as anchor,
 case p_partkey % 5
  when 0 then p_type when 1 then concat(p_type, ' OR ', lower(p_type), ' OR buyer')
  when 2 then concat('lead buyer; ', p_type) when 3 then concat('sales or ', p_type) else '  ' end as role_1,
 case p_partkey % 3 when 0 then p_brand when 1 then cast(null as varchar(20)) else '"quoted role"' end as role_2,
 cast(10 as int) as max_pages
from part""",
    # Cells with quotes, commas and line breaks.
    "v_csv_rows": """
select p_partkey, case p_partkey % 4
  when 0 then concat('"', p_name, '" (a OR b), c') when 1 then concat(p_name, chr(10), p_type)
  when 2 then concat('say "', p_name, '"') else p_name end as anchor,
 case p_partkey % 3 when 0 then concat('lead, "', p_brand, '"') when 1 then concat(p_type, ' or ', p_brand)
  else cast(null as varchar(20)) end as role_1
from part""",
    # Elements of JSON lists: texts, one of them with a brace in front, and objects.
    "v_json_rows": """
select p_partkey, p_partkey % 10 as doc, p_name, p_type, case p_partkey % 3
  when 0 then concat('"', p_name, '"') when 1 then concat('"{curly} ', p_name, '"')
  else concat('{"anchor":"', p_name, '","max_pages":3,"role":"', p_type, '","none":null}') end as element
from part""",
    # A search is a run of 200 documents, a page 10 of them; every text is whole.
    "v_items": """
select doc_id, concat('term ', cast(n as varchar(20))) as term, cast(floor(r / 10) as int) + 1 as page,
 cast(r % 10 as int) + 1 as idx,
 case doc_id % 11 when 0 then '' else concat('About ', h) end as title,
 case when doc_id % 11 = 0 then ''
      when length(text) % 4 = 0 then concat('https://www.LinkedIn.com/in/', h)
      else concat('https://example.org/', h) end as link,
 concat(text, case doc_id % 2 when 0 then '...' else '' end,
   case doc_id % 7 when 0 then concat(' ', cast((doc_id * 37) % 5000 as varchar(20)), ' followers')
     when 1 then ' 1,234 followers' when 2 then ' 2.5K connections' when 3 then ' 500+ connections'
     when 4 then ' 1.234 seguidores' when 5 then ' followers 500+' when 6 then ' Connections: 2,5K + connections 7 M+'
     else '' end) as snippet,
 case doc_id % 3 when 0 then text else null end as og_description,
 case doc_id % 5 when 0 then concat(text, ' and more') else null end as twitter_description,
 case n % 3 when 1 then '0' when 2 then 'n/a' else '175' end as total_results
from (select doc_id, text, md5(text) as h, cast(floor(doc_id / 200) as bigint) as n, doc_id % 200 as r from documents) d""",
    "v_raw": """
select doc_id,
 case doc_id % 3 when 0 then source else '' end as sq_term,
 case doc_id % 3 when 1 then source else null end as query,
 case doc_id % 3 when 2 then source else null end as search_term,
 case doc_id % 6 when 0 then '3.7' when 1 then ' 2 ' when 2 then 'abc' when 3 then '' when 4 then '0' else null end as sq_page,
 case doc_id % 3 when 0 then concat('https://a.example/', md5(text)) else '' end as url,
 case doc_id % 3 when 1 then concat('https://b.example/', md5(text)) else null end as link,
 case doc_id % 3 when 2 then concat('https://c.example/', md5(text)) else null end as result_url,
 case doc_id % 2 when 0 then text else null end as snippet,
 case doc_id % 2 when 1 then text else null end as description,
 case doc_id % 4 when 0 then '1' when 1 then 'nan' when 2 then '-2.9' else '1e2' end as position
from documents""",
    "v_raw_flat": """
select doc_id, sq_term, query, search_term, sq_page, url, link, result_url, snippet, description, position,
 doc_id % 4 < 2 as in_organic,
 case when doc_id % 5 = 0 then null else concat('t', cast(doc_id as varchar(20))) end as title,
 concat('rt', cast(doc_id as varchar(20))) as result_title,
 case when doc_id % 3 = 0 then concat(coalesce(snippet, description), ' and more.') else null end as og,
 doc_id % 2 = 0 as paa_in_main,
 concat('q', cast(doc_id as varchar(20)), '?') as paa_question, description as paa_answer, link as paa_url,
 case when doc_id % 3 = 0 then concat('r', cast(doc_id as varchar(20))) else null end as rs_item,
 case when doc_id % 2 = 0 then concat('rq', cast(doc_id as varchar(20))) else null end as rq_item,
 doc_id % 4 = 0 as ad_in_main,
 case doc_id % 4 when 3 then null else position end as ad_position,
 concat('ad', cast(doc_id as varchar(20))) as ad_title, url as ad_url, link as ad_link,
 case doc_id % 3 when 0 then '' else 'adv' end as ad_advertiser, 'src' as ad_source,
 description as ad_description, snippet as ad_snippet,
 case doc_id % 5 when 1 then concat('{"text":"', cast(doc_id as varchar(20)), '"}') when 3 then '{}' else null end as ai_main,
 case doc_id % 5 when 2 then concat('{"alt":', cast(doc_id as varchar(20)), '}') when 3 then '[1]' else null end as ai_alt
from v_raw""",
    "v_requests": """
select event_id as request_id, ts, user_id as request_key,
 case when event_type = 'error' then 0 else 1 end as ok
from events""",
    # Requests of several units, some of none, of less than none, or of an unknown number.
    "v_unit_requests": """
select event_id as request_id, ts, case when event_type = 'error' then 0 else 1 end as ok,
 cast(case event_id % 13 when 0 then 0 when 1 then -1 when 2 then null when 3 then 37 when 4 then 90
  else event_id % 7 + 1 end as bigint) as units
from events""",
    "v_error_bodies": """
select event_id, case event_id % 5 when 3 then 500 when 2 then 403 else 429 end as http_status,
 case event_id % 5
  when 4 then '{broken'
  when 1 then '{"error":{"code":429,"status":"RESOURCE_EXHAUSTED","message":"no reason","errors":[]}}'
  else concat('{"error":{"code":', case event_id % 5 when 2 then '403' else '429' end,
   ',"status":"RESOURCE_EXHAUSTED","message":"m', cast(event_id as varchar(20)),
   '","errors":[{"reason":"rateLimitExceeded"}],"details":[{"@type":"type.googleapis.com/google.rpc.ErrorInfo","metadata":{"quota_limit_value":"',
   cast(100 + event_id % 7 as varchar(20)),
   '","quota_metric":"queries"}},{"@type":"type.googleapis.com/google.rpc.Help","links":[{"url":"https://help.example/1"}]}]}}') end as body
from events""",
    # Some jobs are only queued so far, some end on an error of the job itself.
    "v_job_events": """
select e.user_id as job_id, event_id, ts,
 case when e.user_id % 17 = 3 then 'queued' when e.user_id % 13 = 5 and event_id % 40 = 0 then 'aborted'
  else case event_type when 'error' then 'failed' when 'signup' then 'duplicate' when 'purchase' then 'quota_error'
   else 'done' end end as outcome,
 cast(floor(value) as bigint) as n_results, t.total_keywords
from events e join (select user_id, count(*) as total_keywords from events group by user_id) t on e.user_id = t.user_id""",
    "v_platform_inputs": """
select page_id, case page_id % 7
  when 0 then regexp_extract(url, '^https?://([^/]+)', 1)
  when 1 then url
  when 2 then concat('site:', regexp_extract(url, '^https?://([^/]+)', 1))
  when 3 then case page_id % 4 when 0 then 'GitHub' when 1 then ' LinkedIn Vietnam ' when 2 then 'Stack' else 'x.com' end
  when 4 then case page_id % 2 when 0 then 'www.' else 'https://www.linkedin.co.uk/in/' end
  when 5 then case page_id % 2 when 0 then '' else 'my forum' end
  else case page_id % 2 when 0 then 'bad!name' else 'macmillan.com/user' end end as platform_name
from pages""",
}


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register the driver's parquet tables as temp views, for ad-hoc SQL.

    ``events.ts`` is stored without a time zone; it is cast once to a
    timestamp of the session zone. The library's sessions are in UTC.
    """
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "part":
        df = spread(df)
    return df.withColumn("ts", df["ts"].cast("timestamp")) if name == "events" else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores: a file of few bytes is read by one or two tasks, however long its rows take."""
    tasks = 3 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(tasks, df.rdd.getNumPartitions()))


DEPENDS = {"v_raw_flat": ("v_raw",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame over the tables of ``sf_dir``.

    The tables are bound as arguments of the SQL text, so no temp view of the
    caller is replaced.
    """
    sql = VIEWS[name]
    bound = {dep: view(spark, sf_dir, dep) for dep in DEPENDS.get(name, ())}
    bound |= {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\bfrom {t}\b", sql)}
    for t in bound:
        sql = re.sub(rf"\bfrom {t}\b", f"from {{{t}}}", sql)
    return spark.sql(_escape(sql, bound), **bound)


def _escape(sql: str, names) -> str:
    """Double the braces that are not one of ``{name}``."""
    parts = re.split("(" + "|".join(r"\{%s\}" % n for n in names) + ")", sql)
    return "".join(p if k % 2 else p.replace("{", "{{").replace("}", "}}") for k, p in enumerate(parts))


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """Prefix an oracle query with the fixture views it reads, as CTEs."""
    full = []
    for n in names:
        for dep in DEPENDS.get(n, ()):
            if dep not in full:
                full.append(dep)
        if n not in full:
            full.append(n)
    names = tuple(full)
    ctes = ",\n".join(f"{n} as ({VIEWS[n]}\n)" for n in names)
    return f"with {'recursive ' if recursive else ''}{ctes}\n{sql}"
