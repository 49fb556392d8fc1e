"""What the plans of the registered text queries hold, and how often a table is read."""

import pytest

from serpframe.plans import catalog

SF = "/root/testdata/sf0.001"
TEXT = ["compose_queries", "tokenize_roles", "ensure_quoted", "role_expression", "clean_operators", "drop_empty_parens",
        "balance_parens", "clean_query", "apply_site_filters", "site_suffix", "normalize_query", "query_hash",
        "needs_split", "split_query", "final_subqueries", "drop_blank_queries", "dedup_queries", "query_audit",
        "query_dedup_stats", "normalize_platform", "validate_platform", "platform_to_site", "suggest_platforms",
        "process_platforms", "plan_requests", "request_key", "cache_lookup", "cache_misses", "explode_items",
        "page_cutoff", "paging_summary", "map_item", "best_snippet", "dedup_results", "supported_only",
        "parse_quota_errors", "normalize_search_query", "coerce_int", "is_truncated", "pick_longer",
        "normalize_organic", "extract_followers", "normalize_items", "flatten_common", "flatten_organic",
        "flatten_paa", "flatten_related", "flatten_paid", "flatten_ai_overview", "infer_followers",
        "parse_human_number", "daily_usage", "quota_gate", "usage_level", "job_status", "job_speed", "list_jobs",
        "job_stage", "quota_incidents", "result_kind_counts", "run_summary", "filter_results", "page_results",
        "limit_results", "preview_queries"]
ONE_SCAN = ["query_dedup_stats", "result_kind_counts", "parse_quota_errors", "explode_items", "flatten_organic",
            "clean_query", "normalize_items", "daily_usage"]


def plan(spark, key):
    return catalog.QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", TEXT)
def test_no_python_and_no_cross_join(spark, key):
    text = plan(spark, key)
    for word in ("EvalPython", "InPandas", "MapInArrow", "CartesianProduct"):
        assert word not in text
    if key != "suggest_platforms":  # matches parts of names against the fixed platform table
        assert "NestedLoop" not in text


@pytest.mark.parametrize("key", ONE_SCAN)
def test_one_scan(spark, key):
    assert plan(spark, key).count("FileScan parquet") == 1


def test_quota_errors_are_parsed_once(spark):
    assert plan(spark, "parse_quota_errors").count("from_json") == 1


@pytest.mark.parametrize("name", ["v_queries", "v_query_rows"])
def test_query_texts_are_dealt_to_all_cores(spark, name):
    """One small file, but more tasks than cores."""
    from serpframe.plans.fixtures import view
    assert view(spark, SF, name).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_audit_hashes_a_query_once_a_side(spark):
    """Once for the first row of each hash and once for the rows; not again to see that it is not null."""
    from serpframe.operators import dedup
    from serpframe.options import SearchOptions
    df = spark.createDataFrame([(1, "a b"), (2, "A  b"), (3, " "), (4, None), (5, "c")], "input_row_id int, original_input string")
    out = dedup.query_audit(df, SearchOptions())
    assert out._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 2
    assert {(r.input_row_id, r.deduplicated) for r in out.collect()} == {(1, False), (2, True), (5, False)}
