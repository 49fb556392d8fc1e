"""Page requests, request keys, the response cache with TTL, and the
refetch rule over a request log."""

from __future__ import annotations

from typing import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serpframe.operators.ordered import CHUNK_ROWS, in_order, orderable
from serpframe.options import SearchOptions


def plan_requests(df: DataFrame, options: SearchOptions, query_col: str = "sub_query") -> DataFrame:
    """One row per sub-query and page with the request parameters.

    ``start = (page - 1) * num + 1``; ``num`` is clamped to 1..10 and pages
    are at least one. Locale hints are added only when asked for.
    """
    per, pages = options.per_page, options.pages
    lr = (F.lit("lang_" + options.language_code.lower())
          if options.apply_locale_hints and options.language_code else F.lit(None).cast("string"))
    gl = (F.lit(options.country_code.lower())
          if options.apply_locale_hints and options.country_code else F.lit(None).cast("string"))
    cx = F.lit(options.engine_id).cast("string") if options.engine_id else F.lit(None).cast("string")
    keep = [c for c in df.columns if c != query_col]
    return (df.select(*keep, F.col(query_col).alias("q"),
                      F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("page"))
            .select(*keep, "q", F.col("page").cast("bigint").alias("page"),
                    F.lit(per).cast("bigint").alias("num"),
                    ((F.col("page") - 1) * per + 1).cast("bigint").alias("start"),
                    lr.alias("lr"), gl.alias("gl"), cx.alias("cx")))


def _json_string(c: Column) -> Column:
    """A JSON string literal of ``c`` (quotes and escapes, non-ASCII kept)."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def request_key(df: DataFrame) -> Column:
    """SHA-256 of the sorted-key JSON of the request parameters.

    Same text as Python's ``json.dumps(params, sort_keys=True,
    ensure_ascii=False)``: keys in order, ``", "`` and ``": "`` separators,
    parameters that are null left out. The credential is not a parameter
    here, so rotating it keeps the cache.
    """
    fields = [("cx", True), ("gl", True), ("lr", True), ("num", False), ("q", True), ("start", False)]
    parts = []
    for name, is_text in fields:
        if name not in df.columns:
            continue
        v = F.col(name)
        val = _json_string(v) if is_text else v.cast("string")
        parts.append(F.when(v.isNotNull(), F.concat(F.lit(f'"{name}": '), val)))
    body = F.concat_ws(", ", *parts)
    return F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256)


def _epoch_s(c: Column) -> Column:
    """Whole seconds since the epoch, truncated like Python's ``int(time)``."""
    return F.floor(F.unix_micros(c.cast("timestamp")) / 1000000).cast("bigint")


def live_responses(responses: DataFrame, ttl_seconds: int, now: Column,
                   key: str = "request_key", ts: str = "fetched_at",
                   payload: Sequence[str] = ()) -> DataFrame:
    """Latest stored response per key, kept when ``now - fetched <= ttl``
    in whole seconds; one stamped after ``now`` has a negative age and is
    served. Aggregates map-side, so hot keys stay cheap."""
    pay = [F.max_by(F.col(p), F.col(ts)).alias(p) for p in payload]
    latest = responses.groupBy(key).agg(F.max(ts).alias(ts), *pay)
    age = _epoch_s(now) - _epoch_s(F.col(ts))
    return latest.withColumn("age_s", age).filter(F.col("age_s") <= ttl_seconds)


def cache_lookup(requests: DataFrame, responses: DataFrame, ttl_seconds: int, now: Column,
                 key: str = "request_key", ts: str = "fetched_at", payload: Sequence[str] = ()) -> DataFrame:
    """Requests answered from the cache, with the response they get."""
    return requests.join(live_responses(responses, ttl_seconds, now, key, ts, payload), key)


def cache_misses(requests: DataFrame, responses: DataFrame, ttl_seconds: int, now: Column,
                 key: str = "request_key", ts: str = "fetched_at") -> DataFrame:
    """Requests with no live response: these are sent."""
    return requests.join(live_responses(responses, ttl_seconds, now, key, ts).select(key), key, "left_anti")


def cache_lookup_asof(requests: DataFrame, responses: DataFrame, ttl_seconds: int, key: str = "request_key",
                      ts: str = "ts", fetched: str = "fetched_at", payload: Sequence[str] = (),
                      chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every request with the response that the cache held when it was made.

    That is the last response of its key fetched at or before the request's own
    time. Columns ``fetched`` and ``payload`` come from it, ``age_s`` is the
    age in whole seconds, ``served`` whether that is within the TTL; else the
    new columns are null and the request is a miss. A request without key or
    time is a miss; of responses fetched at one time the greatest payload
    counts.

    Requests and responses are one table in the order of key and time, cut
    into chunks. In a chunk the last response is carried forward by a window;
    what a chunk is entered with is carried over one row a key and chunk. So a
    key with a third of all rows is many groups, and nothing is joined by key
    alone.
    """
    held = F.struct(F.col(fetched).alias("at"), *[F.col(c) for c in payload])
    stored = responses.where(F.col(key).isNotNull() & F.col(fetched).isNotNull()) \
        .select(F.col(key).alias("_key"), F.col(fetched).alias("_ts"), F.lit(0).alias("_kind"), held.alias("_held"))
    asked = requests.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.lit(1).alias("_kind"),
                            F.struct(*requests.columns).alias("_row"))
    both = asked.unionByName(stored, allowMissingColumns=True)
    last = F.col("_held") if orderable(both.schema["_held"].dataType) else F.to_json("_held")
    line = in_order(both, ["_key", "_ts", "_kind", last], "asof", chunk_rows)
    inside = Window.partitionBy("_key", "_chunk").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = line.groupBy("_key", "_chunk").agg(F.expr("max_by(_held, _at) filter (where _kind = 0)").alias("_left")) \
        .select("_key", "_chunk", F.last("_left", ignorenulls=True).over(before).alias("_entered")) \
        .where("_key is not null and _entered is not null")
    found = line.withColumn("_held", F.last("_held", ignorenulls=True).over(inside)).where("_kind = 1") \
        .join(carried, ["_key", "_chunk"], "left").withColumn("_held", F.coalesce("_held", "_entered"))
    age = _epoch_s(F.col("_ts")) - _epoch_s(F.col("_held.at"))
    served = F.coalesce(age <= ttl_seconds, F.lit(False))
    given = lambda c, name: F.when(served, c).alias(name)
    return found.select("_row.*", given(F.col("_held.at"), fetched), *[given(F.col(f"_held.{c}"), c) for c in payload],
                        given(age, "age_s"), served.alias("served"))


# A chunk of a key's time line spans this many TTLs, so it holds this many
# fetches at most; a task goes through all its chunks at once.
CHUNK_TTLS = 64
#: Rows of whole chunks that a task works on together.
TOGETHER = 1 << 19


def _whole_chunks(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole chunks out of batches sorted by chunk, with the number of each row's chunk."""
    held: list[pa.RecordBatch] = []

    def numbered(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        new = np.zeros(t.num_rows, bool)
        for c in (key, "_chunk"):
            col = t.column(c).combine_chunks()
            new[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
        return t, np.cumsum(new)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < TOGETHER:
            continue
        t, group = numbered(pa.Table.from_batches(held))
        cut = int(np.searchsorted(group, group[-1]))  # the last chunk may go on
        if cut:
            yield t.slice(0, cut), group[:cut]
        held = t.slice(cut).to_batches()
    if held and sum(b.num_rows for b in held):
        yield numbered(pa.Table.from_batches(held))


def _next_fetch(group: np.ndarray, secs: np.ndarray, ttl: int) -> np.ndarray:
    """Row of the fetch after each row's, in its chunk; itself where there is none."""
    low = secs.min()
    line = group * (int(secs.max() - low) + ttl + 2) + (secs - low)
    after = np.searchsorted(line, line + ttl, side="right")
    here = np.arange(len(secs))
    inside = np.minimum(after, len(secs) - 1)
    return np.where((after < len(secs)) & (group[inside] == group), inside, here)


def _chunk_entries(ttl: int, span: int, key: str):
    """Where the scan can enter each chunk, and the last fetch it then makes there.

    The fetch before lies ahead of the chunk, so the scan enters within the
    chunk's first ``ttl`` seconds or at the first second after them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in _whole_chunks(batches, key):
            secs, chunk = t.column("_sec").to_numpy(), t.column("_chunk").to_numpy()
            last = _next_fetch(group, secs, ttl)
            while True:  # pointer jumping: log2(fetches) rounds
                far = last[last]
                if (far == last).all():
                    break
                last = far
            early = secs <= chunk * span + ttl
            early[1:] |= (group[1:] == group[:-1]) & early[:-1]
            early[0] = True
            early[1:] |= group[1:] != group[:-1]
            at = np.flatnonzero(early)
            yield from t.take(at).append_column("_last", pa.array(secs[last[at]])).to_batches()
    return run


def _link_chunks(ttl: int, key: str):
    """Follow the scan over the chunks of one key: the second it enters each."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_sec", kind="stable")
        chunk, secs, last = (pdf[c].to_numpy() for c in ("_chunk", "_sec", "_last"))
        keep, i = [], 0
        while i < len(secs):
            keep.append(i)
            after = int(np.searchsorted(secs, last[i] + ttl, side="right"))
            i = max(after, int(np.searchsorted(chunk, chunk[i], side="right")))
        return pd.DataFrame({key: pdf[key].iloc[0], "_chunk": chunk[keep], "_sec": secs[keep]})
    return fn


def _chunk_fetches(ttl: int, key: str):
    """All fetch seconds of each chunk from its row marked ``_in`` on; chunks without one have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in _whole_chunks(batches, key):
            secs = t.column("_sec").to_numpy()
            following = _next_fetch(group, secs, ttl)
            at = np.flatnonzero(t.column("_in").to_numpy())
            found = [at]
            while len(at):  # a step for each fetch of a chunk, all chunks at once
                at, was = following[at], at
                at = at[at != was]
                found.append(at)
            yield from t.take(np.concatenate(found)).select([key, "_sec"]).to_batches()
    return run


def ttl_refetch_filter(df: DataFrame, key: str, ts: str, ttl_seconds: int,
                       tiebreak: str | None = None) -> DataFrame:
    """Rows of a request log that cause a fetch under a cache with TTL.

    Age runs from the last *fetch*, not the last request, because only a
    fetch rewrites the cached file; a running ``lag`` would be wrong.

    Only the distinct (key, second) pairs take part in the scan. A key's time
    line is cut into chunks of ``CHUNK_TTLS`` TTLs, so a key with a huge share
    of the rows is many groups. A key with one chunk is entered at its first second.
    Of the others, each chunk says where the scan leaves it for
    every second at which it can enter, and those few rows are followed over the
    chunks of a key. The chunks then list their fetches, all that a task holds
    at once. The log's rows are joined to the fetch seconds at the end; the
    first row of each counts.
    """
    ttl = int(ttl_seconds)
    span = max(1, CHUNK_TTLS * max(ttl, 1))
    kt = df.schema[key].dataType.simpleString()
    rows = df.withColumn("_sec", _epoch_s(F.col(ts))).filter(F.col(key).isNotNull() & F.col("_sec").isNotNull())
    secs = rows.select(key, "_sec").distinct() \
        .withColumn("_chunk", F.floor(F.col("_sec") / span).cast("bigint"))
    keys = secs.groupBy(key).agg(F.min("_sec").alias("_first"), F.min("_chunk").alias("_lo"), F.max("_chunk").alias("_hi"))
    by = [key, "_chunk", "_sec"]
    many = secs.join(keys.where("_lo < _hi").select(key), key, "left_semi").select(by)
    entries = many.repartition(key, "_chunk").sortWithinPartitions(*by).mapInArrow(
        _chunk_entries(ttl, span, key), f"`{key}` {kt}, _chunk bigint, _sec bigint, _last bigint")
    entered = entries.groupBy(key).applyInPandas(_link_chunks(ttl, key), f"`{key}` {kt}, _chunk bigint, _sec bigint") \
        .unionByName(keys.where("_lo = _hi").select(key, F.col("_lo").alias("_chunk"), F.col("_first").alias("_sec")))
    marked = secs.select(*by, F.lit(0).alias("_in")).unionByName(entered.select(*by, F.lit(1).alias("_in"))) \
        .groupBy(*by).agg(F.max("_in").alias("_in"))
    fetches = marked.repartition(key, "_chunk").sortWithinPartitions(*by).mapInArrow(
        _chunk_fetches(ttl, key), f"`{key}` {kt}, _sec bigint")
    order = [F.col(ts)] + ([F.col(tiebreak)] if tiebreak else [])
    payload = F.struct(*[F.col(c) for c in df.columns])
    return rows.join(fetches, [key, "_sec"]).groupBy(key, "_sec") \
        .agg(F.min_by(payload, F.struct(*order)).alias("_r")).select("_r.*")
