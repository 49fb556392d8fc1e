"""Streaming forms of the batch operators (Structured Streaming).

The batch operators are column expressions and aggregations, so most carry
over unchanged; dedup and the TTL refetch rule keep per-key state.
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from serpframe.operators import flatten, metrics, results
from serpframe.operators.dedup import annotate_queries
from serpframe.options import SearchOptions
from serpframe.schemas import RESPONSE_RECORD
from serpframe.sources.responses import response_pages, stamped


def stream_organic(spark: SparkSession, responses_dir: str, per_page: int = 10,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Landed response files as they arrive -> flat organic rows (stateless)."""
    reader = spark.readStream.schema(RESPONSE_RECORD)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    pages = response_pages(stamped(reader.json(responses_dir)))
    items = results.map_items(results.explode_items(pages, per_page))
    rec = items.select("fetched_at", F.struct(F.struct("term", "page").alias("searchQuery"),
                                              F.array("result").alias("searchResults")).alias("record"))
    return flatten.flatten_organic(rec, "record")


def stream_dedup_queries(queries: DataFrame, options: SearchOptions, ts_col: str, delay: str) -> DataFrame:
    """First arrival per normalized query within the watermark delay.

    Arrival order replaces input order; state per hash expires with the
    watermark, so it stays bounded on an unbounded stream.
    """
    return (annotate_queries(queries, options)
            .withWatermark(ts_col, delay)
            .dropDuplicatesWithinWatermark(["normalized_query_hash"]))


def stream_daily_usage(requests: DataFrame, quota: int, delay: str = "1 day",
                       ts: str = "ts", ok: str = "ok") -> DataFrame:
    """Per-day usage on a stream, for update mode and ``merge_sink``.

    A day's count is sent again whenever it changes. Rows later than the
    watermark are dropped and the state of a day goes when it is past.
    """
    return (requests.withWatermark(ts, delay)
            .groupBy(F.window(ts, "1 day").alias("w"))
            .agg(F.count_if(F.col(ok) == 1).alias("used"))
            .select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "used",
                    F.lit(quota).cast("bigint").alias("quota"),
                    F.greatest(F.lit(0), F.lit(quota) - F.col("used")).cast("bigint").alias("remaining")))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streaming queries started inside keep their state in RocksDB, as ``stream_ttl_refetch`` needs.

    State then lives off the heap and on disk, and a checkpoint takes what
    changed only. The session's own setting is put back.
    """
    was = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, was)


class _Refetch(StatefulProcessor):
    """Per key the second of the last fetch, and a timer that forgets it when its TTL is past."""

    def __init__(self, ttl: int, ts: str, tiebreak: str):
        self.ttl, self.ts, self.tiebreak = ttl, ts, tiebreak

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_fetch", "sec long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        pdf = pd.concat(list(rows), ignore_index=True).sort_values([self.ts, self.tiebreak], kind="stable")
        secs = np.floor(pdf[self.ts].to_numpy("datetime64[us]").astype("int64") / 1e6).astype("int64")
        keep = []
        i = 0 if last is None else int(np.searchsorted(secs, last + self.ttl, side="right"))
        while i < len(secs):  # one step per fetch
            keep.append(i)
            last = int(secs[i])
            i = int(np.searchsorted(secs, last + self.ttl, side="right"))
        if keep:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            self.last.update((last,))
            # past this time every request is a fetch, with or without the state
            self.handle.registerTimer((last + self.ttl + 1) * 1000)
        yield pdf.iloc[keep]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_ttl_refetch(requests: DataFrame, key: str, ts: str, ttl_seconds: int, tiebreak: str,
                       delay: str = "1 day", columns: Sequence[str] = ()) -> DataFrame:
    """Requests that cause a fetch, with the last fetch second kept as state per key.

    A ``transformWithState`` operator: start the query inside
    ``rocksdb_state``. The state of a key goes by an event-time timer when the
    watermark passes the end of its TTL. ``key``, ``ts``, ``tiebreak`` and
    ``columns`` go through Python and come back, no other column. A task
    holds the rows that one key has in one micro-batch; bound them by the
    trigger (``maxFilesPerTrigger``). Rows of one micro-batch are taken by
    time; across micro-batches the order of arrival holds.
    """
    rows = requests.select(*dict.fromkeys([key, ts, tiebreak, *columns]))
    return rows.withWatermark(ts, delay).groupBy(key).transformWithStateInPandas(
        _Refetch(int(ttl_seconds), ts, tiebreak), outputStructType=rows.schema, outputMode="append", timeMode="EventTime")


def stream_cache_lookup(requests: DataFrame, responses: DataFrame, ttl_seconds: int, key: str = "request_key",
                        ts: str = "ts", fetched: str = "fetched_at", payload: Sequence[str] = (),
                        delay: str = "1 hour") -> DataFrame:
    """Every request of a stream with the response that the cache held when it was made, for append mode.

    The streaming form of ``requests.cache_lookup_asof``, with the same
    columns: ``fetched`` and ``payload``, ``age_s`` and ``served``. A
    stream-stream outer join with watermarks of ``delay`` on both sides and
    the TTL as its time bound, then the latest response of each request. A
    request is sent when the watermark has passed it, hit or miss, as no
    earlier response can arrive any more; a response's state goes when its
    TTL is past. Rows without key or time are left out. ``requests`` must
    have an id or else repeated rows are one, and types that can be grouped.
    """
    asked = requests.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, delay)
    stored = responses.where(F.col(key).isNotNull()) \
        .select(F.col(key).alias("_key"), F.col(fetched).alias("_at"), *[F.col(c).alias(f"_{c}") for c in payload]) \
        .withWatermark("_at", delay)
    age = F.floor(F.unix_micros(ts) / 1000000) - F.floor(F.unix_micros("_at") / 1000000)
    # whole seconds: a second more in the time bound, the exact age beside it
    near = F.expr(f"_at <= `{ts}` and _at > `{ts}` - interval {int(ttl_seconds) + 1} seconds") & (age <= ttl_seconds)
    both = asked.join(stored, (F.col(key) == F.col("_key")) & near, "left_outer")
    held = F.struct("_at", *[F.col(f"_{c}") for c in payload])
    # ts, which has the watermark, is one of the grouped columns
    last = both.groupBy(*requests.columns).agg(F.max(F.when(F.col("_at").isNotNull(), held)).alias("_held"))
    got = F.col("_held._at")
    found = F.floor(F.unix_micros(ts) / 1000000) - F.floor(F.unix_micros(got) / 1000000)
    return last.select(*requests.columns, got.alias(fetched), *[F.col(f"_held._{c}").alias(c) for c in payload],
                       found.cast("bigint").alias("age_s"), F.col("_held").isNotNull().alias("served"))


def stream_cache_misses(requests: DataFrame, responses: DataFrame, ttl_seconds: int, key: str = "request_key",
                        ts: str = "ts", fetched: str = "fetched_at", delay: str = "1 hour") -> DataFrame:
    """Requests of a stream that the cache could not serve, sent when the watermark has passed them."""
    out = stream_cache_lookup(requests, responses, ttl_seconds, key, ts, fetched, (), delay)
    return out.where(~F.col("served")).select(*requests.columns)


def stream_job_progress(job_events: DataFrame, delay: str = "1 day", ts: str = "ts") -> DataFrame:
    """Counts per job and day on a stream, for update mode and ``merge_sink``.

    State is kept by day and goes when the watermark has passed it, so jobs
    that have ended are forgotten; ``metrics.job_status_of`` adds a job's days.
    """
    return metrics.job_counts(job_events.withWatermark(ts, delay), F.window(ts, "1 day").alias("w")) \
        .withColumn("day", F.date_format(F.col("w.start"), "yyyy-MM-dd")).drop("w")


def merge_sink(path: str):
    """A ``foreachBatch`` function for update mode: each micro-batch replaces
    its own folder, so one that is run again changes nothing."""
    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return sink


def merged(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The latest row of each key that ``merge_sink`` has written."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("epoch")).alias("r")).select(*keys, "r.*")
