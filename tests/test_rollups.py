"""Spans, grouping sets, sketches, log extras and the audit log on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from serpframe.operators import metrics, rollups, spans
from serpframe.sinks import audit_log
from serpframe.sources import responses as SR


def at(c):
    return F.timestamp_seconds(F.col(c))


def test_points_meet_spans_once_at_every_length(spark):
    rng = random.Random(5)
    starts = [(i, rng.choice(["x", "y", None]), rng.randrange(100_000)) for i in range(150)]
    long = [0, 1, 59, 60, 61, 900, 5_000, 80_000, 3_000_000, 10**9, -5]
    rows = [(i, k, s, s + rng.choice(long)) for i, k, s in starts] + [(150, "x", None, 5), (151, "x", 5, None)]
    held = spark.createDataFrame(rows, "span int, k string, s long, e long").withColumn("start_at", at("s")).withColumn("end_at", at("e"))
    asked = [(i, rng.choice(["x", "y", None]), rng.choice([None, rng.randrange(120_000), rows[i % 150][2]])) for i in range(300)]
    points = spark.createDataFrame(asked, "point int, k string, t long").withColumn("ts", at("t"))
    got = spans.points_in_spans(points.drop("k"), held.drop("k"), bucket_seconds=60)
    want = sorted((i, j) for i, _, t in asked for j, _, s, e in rows
                  if t is not None and s is not None and e is not None and s <= t <= e)
    assert sorted((r.point, r.span) for r in got.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    keyed = spans.points_in_spans(points, held, on=["k"], bucket_seconds=60)
    want = sorted((i, j) for i, a, t in asked for j, b, s, e in rows
                  if t is not None and s is not None and e is not None and s <= t <= e and a is not None and a == b)
    assert sorted((r.point, r.span) for r in keyed.collect()) == want
    assert spans.points_in_spans(points.drop("k"), held.drop("k").limit(0)).count() == 0
    assert spans.points_in_spans(points.limit(0).drop("k"), held.drop("k")).count() == 0


def test_a_long_span_goes_to_few_buckets(spark):
    held = spark.createDataFrame([(1, 0, 10**9)], "span int, s long, e long").withColumn("start_at", at("s")).withColumn("end_at", at("e"))
    points = spark.createDataFrame([(1, 5)], "point int, t long").withColumn("ts", at("t"))
    plan = spans.points_in_spans(points, held, bucket_seconds=60)
    assert plan.count() == 1
    # 32 years in buckets of a minute would be 16 million
    level = next(k for k in range(spans.LEVELS) if 10**9 // (60 * spans.FANOUT**k) <= spans.FANOUT)
    assert level < spans.LEVELS - 1


def _crowd(spark, n_points, n_spans):
    """Points of five minutes, and spans of a day that hold most of them."""
    held = spark.range(n_spans).select(F.col("id").alias("span"), (F.col("id") * 7919 % 300 + 50_000).alias("s")) \
        .select("span", at("s").alias("start_at"), F.timestamp_seconds(F.col("s") + 86_400).alias("end_at"))
    points = spark.range(n_points).select((F.col("id") * 1_000_003).alias("point"), (F.col("id") * 104_729 % 300 + 50_000).alias("t")) \
        .select("point", at("t").alias("ts"))
    return points, held


def test_many_points_meet_many_spans_once(spark):
    n, m = 2 * spans.TILE + 3, spans.TILE + 5
    points, held = _crowd(spark, n, m)
    held = held.unionByName(spark.range(m).select((F.col("id") + m).alias("span"), F.timestamp_seconds(F.col("id") % 300 + 50_000).alias("start_at"))
                            .withColumn("end_at", F.col("start_at") + F.expr("interval 20 seconds")))
    ends = [(i, i * 7919 % 300, i * 7919 % 300 + 86_400) for i in range(m)] + [(i + m, i % 300, i % 300 + 20) for i in range(m)]
    got = spans.points_in_spans(points, held)
    assert got.columns == ["point", "ts", "span", "start_at", "end_at"]
    assert sorted((r.point, r.span) for r in got.collect()) == sorted(
        (p * 1_000_003, j) for p in range(n) for j, s, e in ends if s <= p * 104_729 % 300 <= e)


def test_written_pairs_take_a_part_of_a_byte(spark, tmp_path):
    # points in the order of their pairs, each with all of its spans, took more the more spans there were
    points, held = _crowd(spark, 600, 6_000)
    got = spans.points_in_spans(points, held).select("point", "span", "start_at")
    got.write.parquet(str(tmp_path / "pairs"))
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert size < 0.4 * spark.read.parquet(str(tmp_path / "pairs")).count()


def test_pairs_are_dealt_evenly_to_many_tasks(spark):
    # the session would join up partitions of few bytes, and a bucket in few parts would be much of a task
    points = spark.range(20_000).select(F.col("id").alias("point"), F.timestamp_seconds(F.col("id") * 13).alias("ts"))
    held = spark.range(200).select(F.col("id").alias("span"), F.timestamp_seconds(F.col("id") * 800).alias("start_at"),
                                   F.timestamp_seconds(F.col("id") * 800 + 86_400).alias("end_at"))
    tasks = [r["count"] for r in spans.points_in_spans(points, held).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == sum((i * 800 + 86_400) // 13 - (i * 800 - 1) // 13 for i in range(200))
    assert max(tasks) < sum(tasks) / 8


def test_incidents_close_after_the_gap(spark):
    rows = [("a", s, "quota_error") for s in (0, 100, 599, 1300, 5000)] + [("b", 50, "quota_error"), ("a", 2000, "done"), ("a", None, "quota_error")]
    df = spark.createDataFrame(rows, "job_id string, s long, outcome string").withColumn("ts", at("s"))
    got = sorted((r.job_id, r.start_at.timestamp(), r.end_at.timestamp(), r.errors) for r in spans.quota_spans(df, 600).collect())
    assert got == [("a", 0, 1199, 3), ("a", 1300, 1900, 1), ("a", 5000, 5600, 1), ("b", 50, 650, 1)]


def test_a_null_key_is_not_a_total(spark):
    logs = spark.createDataFrame([("l", None, "ok", "INFO", 2), ("l", "a", "ok", "INFO", None), ("l", None, None, "INFO", 3)],
                                 "logger string, action string, status string, level string, items_count long")
    got = {(r.action, r.status, r.grouping_id): (r.n, r.items) for r in rollups.log_rollup_sets(logs, [("action", "status"), ()]).collect()}
    assert got == {(None, "ok", 9): (1, 2), ("a", "ok", 9): (1, None), (None, None, 9): (1, 3), (None, None, 15): (3, 5)}
    assert rollups.log_rollup_sets(logs.limit(0), [("action",), ()]).where("grouping_id < 15").count() == 0


def test_sketches_hold_their_error_and_their_batches(spark, tmp_path):
    rows = spark.range(40_000).withColumn("s", F.floor(F.col("id") / 10_000) * 86400) \
        .select((F.col("id") % 25_000).cast("string").alias("h"), at("s").alias("ts"))
    kept = rollups.DailySketches(spark, str(tmp_path / "s"), lg_k=12)
    kept.add(1, rows.where("h < '5'"), "h")
    kept.add(2, spark.createDataFrame([(None, None), ("x", None)], "h string, s long").withColumn("ts", at("s")), "h")
    kept.add(1, rows, "h")  # again
    got = {str(r.first_day)[-2:]: (r.n, r.distinct) for r in
           kept.distinct([("1970-01-01", "1970-01-01"), ("1970-01-02", "1970-01-04"), ("1999-01-09", "1999-01-10")]).collect()}
    assert got["01"][0] == 10_000 and abs(got["01"][1] - 10_000) < 4 * kept.relative_error * 10_000
    assert got["02"][0] == 30_000 and abs(got["02"][1] - 25_000) < 4 * kept.relative_error * 25_000
    assert got["09"] == (0, 0)
    # days 1 and 4: ids 5,000 to 9,999 of day 1 are those of day 4 modulo 25,000
    both = kept.in_both(("1970-01-01", "1970-01-01"), ("1970-01-04", "1970-01-04")).collect()[0].in_both
    assert abs(both - 5_000) < 8 * kept.relative_error * 10_000


def test_log_extras_keep_their_types_and_broken_lines_stay(spark, tmp_path):
    lines = ['{"level":"INFO","page":3,"n":12,"f":1.5,"on":true,"none":null,"in":{"deep":["a",{"b":7}]},"s":"12"}',
             '{"level":"INFO"}', '{"level":', "[1]", '"text"', "", "   ", '{}', '{"level":"X","page":"no number"}']
    (tmp_path / "app.log").write_text("\n".join(lines) + "\n")
    logs = SR.read_log_events(spark, str(tmp_path)).cache()
    assert sorted(r.broken for r in logs.where("broken is not null").collect()) == ['"text"', "[1]", '{"level":']
    assert logs.count() == 7
    one = logs.where("page = 3").select(
        *[F.try_variant_get("extra", p, t).alias(n) for n, p, t in (
            ("n", "$.n", "bigint"), ("f", "$.f", "double"), ("on", "$.on", "boolean"), ("b", "$.in.deep[1].b", "bigint"),
            ("s", "$.s", "string"))]).collect()
    assert [tuple(r) for r in one] == [(12, 1.5, True, 7, "12")]
    kinds = {r.key: r.kind for r in SR.extra_fields(logs).collect()}
    assert kinds == {"n": "BIGINT", "f": "DECIMAL", "on": "BOOLEAN", "none": "VOID", "in": "OBJECT", "s": "STRING"}
    assert tuple(metrics.log_quality(logs).collect()[0]) == (7, 3, 1)
    assert sum(r.n for r in metrics.log_rollup(logs).collect()) == 4


def audit(spark, ids):
    return spark.createDataFrame([(i, f"q{i}") for i in ids], "input_row_id long, original_input string")


def test_audit_batches_count_once(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = audit(spark, []).schema
    assert audit_log.append_audit(audit(spark, [1, 2]), path, "a")
    assert not audit_log.append_audit(audit(spark, [1, 2]), path, "a")
    audit_log.stage_audit(audit(spark, [9]), path, "b")  # a run that died before its commit
    assert audit_log.append_audit(audit(spark, [3]), path, "b")
    # two writers of one batch: the first to commit counts
    first, second = (audit_log.stage_audit(audit(spark, [i]), path, "c") for i in (4, 5))
    assert audit_log.commit_audit(spark, path, "c", second)
    assert not audit_log.commit_audit(spark, path, "c", first)
    assert audit_log.append_audit(audit(spark, []), path, "empty")
    rows = audit_log.read_audit(spark, path, schema)
    assert sorted((r.batch, r.input_row_id) for r in rows.collect()) == [("a", 1), ("a", 2), ("b", 3), ("c", 5)]
    for bad in ("", "a/b", ".x", "a b"):
        with pytest.raises(ValueError):
            audit_log.append_audit(audit(spark, [1]), path, bad)


def test_audit_log_before_its_first_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    audit_log.commit_audit(spark, path, "x", "none")
    assert audit_log.read_audit(spark, path).count() == 0
