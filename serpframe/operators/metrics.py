"""Usage against a daily quota, job progress and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Outcomes of a processed keyword that count as completed (fixed values):
# a failed keyword and one that hit a quota error count too.
COMPLETED_OUTCOMES = ("done", "failed", "quota_error")
# Stage labels of a job by status and progress (fixed values).
STAGE_LABELS = {
    "pending": "Queueing job…",
    "preparing": "Preparing environment… (pulling image, starting container)",
    "starting": "Starting crawler…",
    "fetching": "Scraping keywords… {completed}/{total}",
    "finalizing": "Finalizing results…",
    "completed": "Completed",
    "failed": "Failed",
}


def daily_usage(requests: DataFrame, quota: int, ts: str = "ts", ok: str = "ok") -> DataFrame:
    """Per day: used (successful real requests), quota, remaining >= 0."""
    used = F.count_if(F.col(ok) == 1)
    return (requests.groupBy(F.to_date(ts).alias("day"))
            .agg(used.alias("used"))
            .select("day", "used", F.lit(quota).cast("bigint").alias("quota"),
                    F.greatest(F.lit(0), F.lit(quota) - F.col("used")).cast("bigint").alias("remaining")))


def quota_gate(requests: DataFrame, quota: int, ts: str = "ts", id_col: str = "request_id",
               ok: str = "ok") -> DataFrame:
    """Every request with ``accepted``. Only successful requests use up the
    day's quota, and the test comes before the call: a request passes while
    fewer than ``quota`` requests of its day have succeeded before it (by
    time, then id).

    The last request that passes is the day's ``quota``-th success. It is
    found by ``row_number() <= quota`` over the successes, which Spark plans
    as a partial top-k per day before the shuffle, and joined back as one row
    per day; nothing is joined by request.
    """
    w = Window.partitionBy("_day").orderBy(F.col(ts), F.col(id_col))
    day = requests.withColumn("_day", F.to_date(ts))
    if quota < 1:
        return day.select(*requests.columns, F.col("_day").alias("day"), F.lit(False).alias("accepted"))
    here = F.struct(F.col(ts).alias("ts"), F.col(id_col).alias("id"))
    last = (day.filter(F.col(ok) == 1).select("_day", ts, id_col).withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= quota).filter(F.col("_rn") == quota)
            .select(F.col("_day").alias("_d"), here.alias("_last")))
    passed = F.col("_last").isNull() | (here <= F.col("_last"))
    return (day.join(last, F.col("_day") == F.col("_d"), "left")
            .select(*requests.columns, F.col("_day").alias("day"), passed.alias("accepted")))


def usage_level(usage: DataFrame) -> DataFrame:
    """Percent used (JS rounding, clamped 0-100), warn/danger level, limit flag."""
    pct = F.floor(F.col("used") * 100.0 / F.greatest(F.col("quota"), F.lit(1)) + 0.5)
    pct = F.least(F.lit(100), F.greatest(F.lit(0), pct)).cast("bigint")
    level = F.when(pct >= 90, "danger").when(pct >= 70, "warn").otherwise("ok")
    return usage.select("*", pct.alias("percent"), level.alias("level"),
                        (F.col("used") >= F.col("quota")).alias("limit_reached"))


def job_status(events: DataFrame) -> DataFrame:
    """Per job: totals, progress = trunc(100 * completed / total), status.

    An ``aborted`` event is an error of the job itself: the job has failed and
    ended there. A job of which nothing but ``queued`` events are known is
    pending. The total counts every input keyword, duplicates and blanks
    included, so progress of a job with duplicates ends below 100.
    """
    return job_status_of(job_counts(events))


def job_counts(events: DataFrame, *by) -> DataFrame:
    """What the status of a job is made of, per job (and ``by``); such rows of a job may be added up."""
    o = F.col("outcome")
    return events.groupBy("job_id", *by).agg(
        F.max("total_keywords").alias("total_keywords"),
        F.count_if(o.isin(*COMPLETED_OUTCOMES)).alias("completed"),
        F.coalesce(F.sum(F.when(o == "done", F.col("n_results"))), F.lit(0)).alias("results"),
        F.count_if(~o.isin("duplicate", "queued", "aborted")).alias("unique"),
        F.count_if(o != "queued").alias("begun"),
        F.max(F.when(o == "aborted", F.col("ts"))).alias("aborted_at"),
        F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def job_status_of(counts: DataFrame) -> DataFrame:
    """The status of each job from its ``job_counts`` rows."""
    agg = counts.groupBy("job_id").agg(
        F.max("total_keywords").alias("total_keywords"), F.sum("completed").alias("completed_keywords"),
        F.sum("results").alias("results_count"), F.sum("unique").alias("_unique"), F.sum("begun").alias("_begun"),
        F.max("aborted_at").alias("_aborted"), F.min("first_at").alias("created_at"), F.max("last_at").alias("last_updated"))
    status = (F.when(F.col("_aborted").isNotNull(), "failed").when(F.col("_begun") == 0, "pending")
              .when(F.col("completed_keywords") >= F.col("_unique"), "completed").otherwise("running"))
    progress = F.floor(F.col("completed_keywords") * 100 / F.greatest(F.col("total_keywords"), F.lit(1)))
    ended = F.when(status == "failed", F.col("_aborted")).when(status == "completed", F.col("last_updated"))
    return agg.select(
        "job_id", status.alias("status"), progress.cast("bigint").alias("progress"), "total_keywords",
        "completed_keywords", "results_count", "created_at", ended.alias("completed_at"), "last_updated")


def job_speed(events: DataFrame, bucket_seconds: int = 60) -> DataFrame:
    """At each keyword of a job: keywords per minute so far and the ETA.

    speed = completed / elapsed * 60; eta = trunc(remaining / speed * 60),
    where remaining counts the job's unique keywords not yet completed.

    Counts per (job, time bucket) carry all that is needed of a job, its start
    and its number of keywords included; one window over them and one inside
    each bucket give the rest, so a hot job is not sorted in one task.
    """
    o = F.col("outcome")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    x = events.filter(o != "queued").withColumn("_b", F.floor(micros / (bucket_seconds * 1000000)).cast("bigint")) \
        .withColumn("_done", o.isin(*COMPLETED_OUTCOMES).cast("int"))
    buckets = x.groupBy("job_id", "_b").agg(
        F.sum("_done").alias("_n"), F.min("ts").alias("_first"),
        F.count_if(~o.isin("duplicate", "aborted")).alias("_u"))
    job = Window.partitionBy("job_id")
    before = job.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("job_id", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                             F.min("_first").over(job).alias("_start"), F.sum("_u").over(job).alias("_unique"))
    inside = Window.partitionBy("job_id", "_b").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_loc", F.coalesce(F.sum("_done").over(inside), F.lit(0))) \
        .filter(~o.isin("duplicate", "aborted")).join(buckets, ["job_id", "_b"]) \
        .withColumn("_before", (F.col("_off") + F.col("_loc")).cast("bigint"))
    elapsed = (micros - F.unix_micros(F.col("_start").cast("timestamp"))) / 1e6
    speed = F.when((F.col("_before") > 0) & (elapsed > 0), F.col("_before") / elapsed * 60)
    eta = F.when(speed > 0, F.floor((F.col("_unique") - F.col("_before")) / speed * 60)).cast("bigint")
    return x.select("job_id", "event_id", "ts", F.col("_before").alias("completed_before"),
                    speed.alias("processing_speed"), eta.alias("eta_seconds"))


def list_jobs(status: DataFrame) -> DataFrame:
    """The eight-column job listing."""
    return status.select("job_id", "status", "progress", "total_keywords", "completed_keywords",
                         "results_count", "created_at", "completed_at")


def job_stage(status: DataFrame) -> DataFrame:
    """Stage code and label from status and progress."""
    p = F.coalesce(F.col("progress"), F.lit(0))
    s = F.col("status")
    code = (F.when(s == "pending", "pending")
            .when((s == "running") & (p < 5), "preparing")
            .when((s == "running") & (p < 15), "starting")
            .when((s == "running") & (p < 90), "fetching")
            .when(s == "running", "finalizing")
            .when(s == "completed", "completed")
            .when(s == "failed", "failed")
            .otherwise(""))
    fetching = F.concat(F.lit("Scraping keywords… "), F.coalesce(F.col("completed_keywords"), F.lit(0)).cast("string"),
                        F.lit("/"), F.coalesce(F.col("total_keywords"), F.lit(0)).cast("string"))
    label = F.lit("")
    for k, v in STAGE_LABELS.items():
        label = F.when(code == k, fetching if k == "fetching" else F.lit(v)).otherwise(label)
    return status.select("job_id", code.alias("stage"), label.alias("label"))


def quota_incidents(events: DataFrame) -> DataFrame:
    """Per job: whether a quota error happened, and the keyword and time of the latest."""
    q = F.col("outcome") == "quota_error"
    return events.groupBy("job_id").agg(
        F.count_if(q).alias("_n"),
        F.max_by(F.when(q, F.col("event_id")), F.when(q, F.struct("ts", "event_id"))).alias("affected_event_id"),
        F.max(F.when(q, F.col("ts"))).alias("occurred_at")
    ).select("job_id", (F.col("_n") > 0).alias("quota_exceeded"), "affected_event_id", "occurred_at")


def result_kind_counts(sizes: DataFrame) -> DataFrame:
    """Rows per result kind, from one column of row counts per kind; kinds without rows are left out."""
    sums = sizes.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in sizes.columns])
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("n")) for c in sizes.columns])
    return sums.select(F.explode(kinds).alias("k")).select("k.*").filter("n > 0")


def run_summary(queries: DataFrame, results: DataFrame, hash_col: str = "normalized_query_hash") -> DataFrame:
    """One row: queries sent, items received, organic rows exported.

    Sent are the distinct hashes of ``queries``. Each of the ``results`` is
    one item and is exported as one organic row, so they are counted once.
    """
    z, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    u = (queries.select(hash_col).distinct().select(one.alias("sent"), z.alias("items"))
         .unionByName(results.select(z.alias("sent"), one.alias("items"))))
    return u.agg(*[F.coalesce(F.sum(c), z).alias(c) for c in ("sent", "items")]) \
            .withColumn("organic_rows", F.col("items"))


def log_rollup(logs: DataFrame) -> DataFrame:
    """Log lines per logger, action, status and level; missing context is ``-``. Broken lines are left out."""
    dash = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-")).alias(c)
            for c in ("logger", "action", "status", "level")]
    whole = logs.where(F.col("broken").isNull()) if "broken" in logs.columns else logs
    return whole.select(*dash).groupBy("logger", "action", "status", "level").agg(F.count(F.lit(1)).alias("n"))


def log_quality(logs: DataFrame) -> DataFrame:
    """One row: lines, those that are broken, and those with keys beyond the known ones."""
    return logs.agg(F.count(F.lit(1)).alias("lines"), F.count("broken").alias("broken"), F.count("extra").alias("with_extra"))
