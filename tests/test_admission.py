"""Quota admission of several units and the cache as of the time of a request, against plain loops."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from serpframe.operators import admission, requests


def loop(rows, quota):
    """rows (id, day, second, ok, units) -> id: (used before, accepted)."""
    used, out = {}, {}
    for i, day, sec, ok, n in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        n = 1 if n is None else n
        u = used.get(day, 0)
        passed = n < 0 or u + n <= quota
        out[i] = (u, passed)
        if passed and ok == 1 and n > 0:
            used[day] = u + n
    return out


def frame(spark, rows):
    t = F.timestamp_seconds(F.lit(1704067200) + F.col("day") * 86400 + F.col("sec"))
    return spark.createDataFrame(rows, "request_id int, day int, sec int, ok int, units long").withColumn("ts", t).drop("day", "sec")


@pytest.mark.parametrize("quota", [0, 1, 10, 37])
def test_admission_equals_a_loop_over_the_day(spark, quota):
    rng = random.Random(quota)
    # nearly all rows on one day, many at one time
    rows = [(i, 0 if i % 9 else i % 4, rng.randrange(40), rng.choice([0, 1, 1, None]),
             rng.choice([None, -1, 0, 1, 1, 2, 3, 5, 9, 40])) for i in range(700)]
    out = admission.quota_admission(frame(spark, rows), quota, chunk_rows=16)
    got = {r.request_id: (r.used_before, r.accepted) for r in out.collect()}
    assert got == loop(rows, quota)
    assert out.columns == ["request_id", "ok", "units", "ts", "used_before", "accepted", "day"]


def test_admission_of_nothing_and_of_rows_without_a_time(spark):
    assert admission.quota_admission(frame(spark, []), 5).count() == 0
    rows = frame(spark, [(1, 0, 0, 1, 3), (2, 0, 0, 1, 3), (3, 0, 0, 1, 2)]).withColumn("ts", F.lit(None).cast("timestamp"))
    got = {r.request_id: (r.accepted, r.day) for r in admission.quota_admission(rows, 5).collect()}
    assert got == {1: (True, None), 2: (False, None), 3: (True, None)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-2, 15), max_size=30), st.lists(st.integers(-2, 15), max_size=30), st.integers(0, 20))
def test_maps_and_their_composition(first, second, quota):
    def walk(used, units):
        for n in units:
            if n > 0 and used + n <= quota:
                used += n
        return used
    f, g = (admission.chunk_map(np.array(x, np.int64), quota) for x in (first, second))
    both = admission.then(f, g, quota)
    for used in range(quota + 1):
        assert admission.leave(f, used) == walk(used, first)
        assert admission.leave(both, used) == walk(used, first + second)
    assert len(both[0]) <= quota + 1


def test_cache_as_of_the_request(spark):
    rng = random.Random(4)
    asked = [(i, rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, *range(300)])) for i in range(600)]
    held = [(i, rng.choice(["hot", "a", "c", None]), rng.randrange(-20, 300)) for i in range(90)] + [(90, "hot", None)]
    at = lambda c: F.timestamp_seconds(F.col(c))
    left = spark.createDataFrame(asked, "request_id int, request_key string, t int").withColumn("ts", at("t"))
    right = spark.createDataFrame(held, "body int, request_key string, f int").withColumn("fetched_at", at("f")) \
        .withColumn("tags", F.create_map(F.lit("n"), F.col("body")))
    out = requests.cache_lookup_asof(left, right, 25, payload=["body", "f", "tags"], chunk_rows=16).collect()
    got = {r.request_id: (r.served, r.f, r.age_s) for r in out}
    assert len(out) == len(asked)
    for i, key, t in asked:
        seen = [f for _, k, f in held if k is not None and k == key and f is not None and t is not None and f <= t]
        last = max(seen, default=None)
        served = last is not None and t - last <= 25
        assert got[i] == (served, last if served else None, t - last if served else None)
    assert all((r.body is None) == (not r.served) and (not r.served or r.tags["n"] == r.body) for r in out)


def test_cache_as_of_against_no_responses(spark):
    left = spark.createDataFrame([(1, "a")], "request_id int, request_key string").withColumn("ts", F.timestamp_seconds(F.lit(5)))
    none = spark.createDataFrame([], "request_key string, fetched_at timestamp")
    assert [r.served for r in requests.cache_lookup_asof(left, none, 10).collect()] == [False]
    assert requests.cache_lookup_asof(left.limit(0), none, 10).count() == 0
