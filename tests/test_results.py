import pytest
from pyspark.sql import functions as F

from serpframe.functions import followers as FO
from serpframe.operators import browse, dedup, flatten, metrics, requests, results


def test_page_cutoff_missing_total_keeps_page_one(spark):
    pages = spark.createDataFrame([("t", 1, 10, None), ("t", 2, 10, None), ("u", 1, 10, "n/a"), ("u", 2, 10, "n/a"),
                                   ("v", 1, 10, "15"), ("v", 2, 10, "15"), ("v", 3, 10, "15"),
                                   ("w", 1, 10, "99"), ("w", 2, 0, "99"), ("w", 3, 10, "99")],
                                  "term string, page int, n_items int, total_results string")
    kept = {(r.term, r.page) for r in results.page_cutoff(pages).collect()}
    assert kept == {("t", 1), ("u", 1), ("u", 2), ("v", 1), ("v", 2), ("w", 1), ("w", 2)}


def _results_df(spark):
    return spark.createDataFrame(
        [(1, 0, 1, 1, "A", "u1", "t"), (1, 0, 1, 2, "A", "u1", "t"), (1, 1, 1, 1, "", "", "t"),
         (1, 1, 1, 2, "", "", "t"), (1, 1, 2, 1, "", "", "t"), (2, 0, 1, 1, "A", "u1", "t")],
        "input_row_id int, sub_idx int, page int, idx int, title string, url string, term string")


def test_dedup_results_per_keyword_and_idempotent(spark):
    df = _results_df(spark)
    once = dedup.dedup_results(df)
    got = sorted((r.input_row_id, r.sub_idx, r.page, r.idx) for r in once.collect())
    assert got == [(1, 0, 1, 1), (1, 1, 1, 1), (1, 1, 2, 1), (2, 0, 1, 1)]
    twice = sorted(tuple(r) for r in dedup.dedup_results(once).collect())
    assert twice == sorted(tuple(r) for r in once.collect())


def test_query_dedup_independent_of_partitioning(spark):
    from serpframe.options import SearchOptions
    rows = [(i, f"Q{i % 7}  (") for i in range(1, 200)]
    base = spark.createDataFrame(rows, "input_row_id long, original_input string")
    outs = []
    for n in (1, 7, 31):
        d = dedup.dedup_queries(base.repartition(n), SearchOptions())
        outs.append(sorted(r.input_row_id for r in d.collect()))
    assert outs[0] == outs[1] == outs[2] == list(range(1, 8))


def test_ttl_refetch_anchors_on_fetches(spark):
    # ttl 10 s: fetch at 0; 5 and 10 are hits; 11 fetches; 15 hit; 22 fetches
    rows = [(i, k, t) for i, (k, t) in enumerate([("a", 0), ("a", 5), ("a", 10), ("a", 11), ("a", 15), ("a", 22),
                                                   ("b", 3), ("b", 3)])]
    df = spark.createDataFrame(rows, "id int, key string, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = sorted((r.key, r.t) for r in requests.ttl_refetch_filter(df, "key", "ts", 10, "id").collect())
    assert got == [("a", 0), ("a", 11), ("a", 22), ("b", 3)]


def test_quota_gate_counts_successes_only(spark):
    # day 1: failures at 1 and 2 use up nothing; the third success is at 5; day 2 never gets there
    ok = [1, 0, 0, 1, 0, 1, 1, 0, 1] + [1, 0, 0, 1]
    rows = [(i, f"2024-01-0{1 + i // 9} 00:00:{i:02d}", k) for i, k in enumerate(ok)]
    df = spark.createDataFrame(rows, "request_id int, t string, ok int").withColumn("ts", F.to_timestamp("t"))
    got = {r.request_id: r.accepted for r in metrics.quota_gate(df, 3).collect()}
    assert [i for i, a in got.items() if not a] == [6, 7, 8]
    assert not any(r.accepted for r in metrics.quota_gate(df, 0).collect())


def test_job_status_of_pending_failed_and_running_jobs(spark):
    rows = [("p", "queued", 1), ("p", "queued", 2), ("f", "done", 1), ("f", "aborted", 2), ("f", "queued", 3),
            ("c", "done", 1), ("c", "duplicate", 2), ("c", "quota_error", 3), ("r", "done", 1), ("r", "other", 2)]
    df = spark.createDataFrame([(i, j, o, t, 1, 4) for i, (j, o, t) in enumerate(rows)],
                               "event_id int, job_id string, outcome string, t long, n_results long, total_keywords long") \
        .withColumn("ts", F.timestamp_seconds("t"))
    s = metrics.job_status(df)
    got = {r.job_id: r.status for r in s.collect()}
    assert got == {"p": "pending", "f": "failed", "c": "completed", "r": "running"}
    assert {r.job_id: r.stage for r in metrics.job_stage(s).collect()} == \
        {"p": "pending", "f": "failed", "c": "completed", "r": "fetching"}
    ended = {r.job_id: r.completed_at for r in s.collect()}
    assert ended["p"] is None and ended["r"] is None and ended["f"].second == 2 and ended["c"].second == 3


def test_ttl_refetch_of_a_hot_key_over_many_chunks(spark):
    """One key with 90 % of the rows, its time line cut into many chunks."""
    rng = __import__("random").Random(5)
    rows = [("hot" if rng.random() < 0.9 else f"k{rng.randrange(9)}", rng.randrange(60_000)) for _ in range(4000)]
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "id int, key string, t long") \
        .withColumn("ts", F.timestamp_seconds("t"))
    for ttl in (0, 7, 50):
        want = []
        for k in {k for k, _ in rows}:
            last = None
            for t, i in sorted((t, i) for i, (kk, t) in enumerate(rows) if kk == k):
                if last is None or t - last > ttl:
                    want.append((k, t, i))
                    last = t
        got = requests.ttl_refetch_filter(df, "key", "ts", ttl, "id")
        assert sorted((r.key, r.t, r.id) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():  # nothing but keys and seconds goes through Python
        if "FlatMap" in line:
            assert "id#" not in line and "ts#" not in line


def test_quota_errors(spark):
    body = ('{"error":{"code":429,"status":"RESOURCE_EXHAUSTED","errors":[{"reason":"rateLimitExceeded"}],'
            '"details":[{"@type":"type.googleapis.com/google.rpc.ErrorInfo","metadata":{"quota_limit_value":"100"}},'
            '{"@type":"type.googleapis.com/google.rpc.Help","links":[{"url":"u1"},{"url":"u2"}]}]}}')
    df = spark.createDataFrame([(1, 429, body), (2, 500, body), (3, 429, "{broken")],
                               "id int, http_status int, body string")
    got = {r.id: r for r in results.parse_quota_errors(df).collect()}
    assert got[1].is_quota_error and got[1].quota_limit_value == "100" and got[1].help_links == ["u1", "u2"]
    assert not got[2].is_quota_error and not got[3].is_quota_error


def test_all_pages_together_are_the_table(spark):
    from serpframe.operators import browse
    rows = [(i % 3, None if i % 11 == 0 else f"t{i % 7}", {"k": str(i)}, [i % 2]) for i in range(130)]
    rows += rows[:20]  # equal rows too
    df = spark.createDataFrame(rows, "a int, t string, m map<string,string>, l array<int>")
    kept = browse.ranged_pages(df, ("a",))
    by_page, by_range = [], []
    for n in range(1, 17):
        if n in (1, 9, 10, 11, 12):
            by_page.append((n, [str(r) for r in browse.page_results(df, n, 10, ("a",)).collect()]))
        by_range.append([str(r) for r in browse.page_of(kept, n, 10).collect()])
    assert sorted(x for p in by_range for x in p) == sorted(str(r) for r in df.collect())
    assert all(got == by_range[n - 1] for n, got in by_page)
    with pytest.raises(ValueError):
        browse.page_results(df, 1, 10)


def refetched(rows, ttl):
    """(id, key, second) of the rows that fetch, by a plain loop."""
    last, out = {}, []
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if k is not None and t is not None and (k not in last or t - last[k] > ttl):
            last[k] = t
            out.append((i, k, t))
    return sorted(out)


@pytest.mark.parametrize("ttl", [0, 1, 3, 50])
def test_ttl_refetch_equals_a_loop(spark, ttl):
    import random
    rng = random.Random(ttl)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", "far", None]), rng.randrange(2000)) for i in range(3000)]
    rows += [(5000 + i, "far", 10**9 + 7 * i) for i in range(40)] + [(6000, "late", 10**12 // 1000), (6001, "hot", None)]
    df = spark.createDataFrame(rows, "id int, key string, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = sorted((r.id, r.key, r.t) for r in requests.ttl_refetch_filter(df, "key", "ts", ttl, "id").collect())
    assert got == refetched([r for r in rows if r[2] is not None], ttl)


def test_chunks_that_go_over_batches(monkeypatch):
    import numpy as np
    import pyarrow as pa
    monkeypatch.setattr(requests, "TOGETHER", 7)
    rng = np.random.default_rng(3)
    rows = sorted({(int(k), int(t) // 640, int(t)) for k, t in zip(rng.integers(0, 4, 600), rng.integers(0, 4000, 600))})
    table = pa.table({"k": [r[0] for r in rows], "_chunk": [r[1] for r in rows], "_sec": [r[2] for r in rows]})
    first = [i == 0 or r[:2] != rows[i - 1][:2] for i, r in enumerate(rows)]
    table = table.append_column("_in", pa.array([int(x) for x in first], pa.int32()))
    for size in (1, 5, 1000):
        got = pa.Table.from_batches(requests._chunk_fetches(10, "k")(iter(table.to_batches(max_chunksize=size))))
        want = []
        for i, (k, c, t) in enumerate(rows):
            if first[i] or t - want[-1][1] > 10:
                want.append((k, t))
        assert sorted(zip(got["k"].to_pylist(), got["_sec"].to_pylist())) == sorted(want)


def test_export_reader_searches_a_text_once_a_pattern(spark):
    """The word-first pattern stands twice for the match and twice for what is taken out of it, not for each use."""
    rec = spark.createDataFrame([(([("t 500+ connections", "u")],),)],
                                "record struct<searchResults: array<struct<snippet: string, url: string>>>")
    plan = flatten.flatten_organic(rec)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(FO.EXPORT_PATTERNS[2][0]) == 3  # search, number, unit


def test_export_reader_is_the_plain_one(spark):
    """First text, first pattern: the same as all patterns tried one after the other over the whole text."""
    texts = ["1,234 followers", "followers 500+ and 7 connections", "relations 5", "relationship 5", "5 relationships", "x5followers",
             "2.5K connections", "1 234\u00a0567\u00a0K +  Followers!", "ng\u01b0\u1eddi  theo d\u00f5i 12", "12 k\u1ebft n\u1ed1i", "7 \u212a followers",
             "\u0663 followers", "\u0e1c\u0e39\u0e49\u0e15\u0e34\u0e14\u0e15\u0e32\u0e21 9", "\u5173\u6ce8\u8005 3", "3\u5173\u6ce8\u8005x", "FOLLOWER\u017f 8", "no number followers",
             "8 nothing", "followers: 5", "followers\n5", "1.2.3 follower 4 connection", "", None, "abonn\u00e9s 1 2 345 b", "12+ followersx 3 connections"]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(texts, texts[5:] + texts[:5]))], "k int, snippet string, title string")
    rec = F.struct("snippet", "title")

    def plain(t):
        out = F.lit(None)
        for pat, gnum, gsuf in reversed(FO.EXPORT_PATTERNS):
            suf = F.regexp_extract(t, pat, gsuf) if gsuf else F.lit("")
            hit = F.struct(F.trim(F.regexp_extract(t, pat, 0)).alias("text"),
                           FO.parse_human_number(F.regexp_extract(t, pat, gnum), suf).alias("count"))
            out = F.when(t.rlike(pat), hit).otherwise(out)
        return out
    dtype = df.select(rec.alias("r")).schema["r"].dataType
    both = df.select("k", FO.infer_followers(rec, dtype).alias("i"), F.coalesce(plain(F.col("snippet")), plain(F.col("title"))).alias("p")).collect()
    assert [(r.k, r.i) for r in both] == [(r.k, r.p) for r in both]
    assert sum(r.i is not None for r in both) > 15


def test_far_page_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    rows = spark.range(0, 500, numPartitions=4).mapInArrow(count, "id long")
    assert [r.id for r in browse.page_results(rows, 20, 10, ("id",)).collect()] == list(range(190, 200))
    assert seen.value == 500
