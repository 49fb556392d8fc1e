"""Streaming forms with state: several micro-batches, a restart, and state that goes."""

import random

from pyspark.sql import functions as F

from serpframe.operators import requests
from serpframe.streaming import streams as K

LOG = "request_id long, request_key string, t long"


def stamp(df, name="ts"):
    return df.withColumn(name, F.timestamp_seconds("t"))


def run(query, out, checkpoint):
    q = query.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint) \
        .outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q.recentProgress


def test_refetch_over_micro_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(11)
    rows = sorted(((i, rng.choice(["hot", "hot", "a", "b"]), rng.randrange(60_000)) for i in range(900)), key=lambda r: (r[2], r[0]))
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    df = stamp(spark.createDataFrame(rows, LOG))
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    with K.rocksdb_state(spark):
        for lo in range(0, 60_000, 12_000):  # the query starts anew for each slice of time
            df.where(F.col("t").between(lo, lo + 11_999)).coalesce(1).write.mode("append").parquet(src)
            log = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
            progress = run(K.stream_ttl_refetch(log, "request_key", "ts", 500, "request_id", delay="10 minutes"), out, ckpt)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == was
    want = {r.request_id for r in requests.ttl_refetch_filter(df, "request_key", "ts", 500, "request_id").collect()}
    got = spark.read.parquet(out)
    assert got.columns == ["request_key", "ts", "request_id"]
    assert {r.request_id for r in got.collect()} == want and got.count() == len(want)
    assert progress  # the last run saw rows


def test_state_of_silent_keys_goes(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    slices = [[(i, f"k{i}", 1000 + i) for i in range(50)], [(60, "late", 100_000)], [(61, "late", 200_000)]]
    with K.rocksdb_state(spark):
        for rows in slices:
            df = stamp(spark.createDataFrame(rows, LOG))
            df.coalesce(1).write.mode("append").parquet(src)
            progress = run(K.stream_ttl_refetch(spark.readStream.schema(df.schema).parquet(src), "request_key", "ts", 60,
                                                "request_id", delay="1 minute"), out, ckpt)
    ids = {r.request_id for r in spark.read.parquet(out).collect()}
    assert ids == set(range(50)) | {60, 61}
    # fifty keys have been forgotten by their timers; a key keeps its value, its timer and the timer's index
    assert progress[-1].stateOperators[0].numRowsTotal <= 6


def test_cache_lookup_on_streams_equals_the_batch_form_and_drops_its_state(spark, tmp_path):
    rng = random.Random(12)
    asked = [(i, rng.choice(["hot", "a", "b", None]), rng.randrange(50_000)) for i in range(500)]
    held = [(i, rng.choice(["hot", "a", "c"]), rng.randrange(50_000)) for i in range(120)]
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    left = stamp(spark.createDataFrame(asked, LOG))
    right = stamp(spark.createDataFrame(held, "body long, request_key string, t long"), "fetched_at").drop("t")
    peak = 0
    for lo in (0, 10_000, 20_000, 30_000, 40_000, 400_000):
        end = spark.createDataFrame([(-1, "end", 400_000)], LOG)
        part = left if lo < 400_000 else stamp(end)
        part.where(F.col("t").between(lo, lo + 9_999)).coalesce(1).write.mode("append").parquet(str(tmp_path / "asked"))
        part = right if lo < 400_000 else stamp(end.withColumnRenamed("request_id", "body"), "fetched_at").drop("t")
        part.where(F.unix_timestamp("fetched_at").between(lo, lo + 9_999)).coalesce(1).write.mode("append").parquet(str(tmp_path / "held"))
        a = spark.readStream.schema(left.schema).parquet(str(tmp_path / "asked"))
        h = spark.readStream.schema(right.schema).parquet(str(tmp_path / "held"))
        progress = run(K.stream_cache_lookup(a, h, 700, payload=["body"], delay="10 minutes"), out, ckpt)
        peak = max([peak, *(sum(s.numRowsTotal for s in p.stateOperators) for p in progress)])
    batch = requests.cache_lookup_asof(left, right, 700, payload=["body"]).where("request_key is not null")
    cols = ["request_id", "served", "age_s", "fetched_at"]
    rows = lambda df: sorted(str(tuple(r)) for r in df.select(cols).collect())
    assert rows(spark.read.parquet(out)) == rows(batch)
    left_over = sum(s.numRowsTotal for s in progress[-1].stateOperators)
    assert peak > 100 and left_over <= 6  # what is left are the closing rows
