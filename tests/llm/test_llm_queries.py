"""Registered queries against their oracles, and the pipeline stage by stage."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from llm_helpers import EDGE, make, words  # noqa: F401

import corpus_pipeline
from serpframe.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_one_query_per_operator():
    assert [k.split("_")[0] for k in Q.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(Q.ORACLES) <= set(Q.QUERIES)


@pytest.mark.parametrize("key", sorted(Q.ORACLES))
def test_query_matches_oracle(spark, duck, key):
    got = Q.QUERIES[key](spark, SF).toPandas()
    want = duck.execute(Q.ORACLES[key]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)

    def rows(df):  # a column of whole numbers with nulls is one of floats on one side
        plain = lambda x: None if pd.isna(x) else float(x) if isinstance(x, (int, float, np.number)) else x
        return sorted(str([plain(x) for x in r]) for r in df[cols].astype(object).values.tolist())

    assert rows(got) == rows(want)


@pytest.mark.parametrize("key", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_query_runs_over_the_whole_table(spark, key):
    df = Q.QUERIES[key](spark, SF)
    n = spark.read.parquet(f"{SF}/{'embeddings' if key.startswith('op4_') else 'documents'}.parquet").count()
    per_row = key.split("_")[0] in ("op4", "op5", "op7", "op8", "op13")
    assert df.count() == n if per_row else df.count() > 0


def test_pipeline_stages_take_effect(spark, tmp_path, words):  # noqa: F811
    items = [(1, words(40, 500)), (2, words(30, 501))]
    rows = [(i, words(60 + i % 9, i), "en" if i % 2 else None, f"s{i % 4}") for i in range(120)]
    rows += [(200 + i, rows[i][1] + " end", "en", "s0") for i in range(10)]  # near copies of 0 to 9
    rows += [(300, words(20, 7) + " " + items[0][1] + " " + words(9, 8), "en", "s1"), (301, "12 34", "en", "s1"),
             (302, words(50, 900) + " mail a.b@c.de now", "en", "s2")]
    rows += [(i, t, "en", None) for i, t in EDGE]
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    docs = make(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        if name != "mixing":
            assert at.schema.simpleString() == spark.createDataFrame([], ddl).schema.simpleString()
        kept[name] = at.collect()
    ids = {k: {r.doc_id for r in v} for k, v in kept.items()}
    assert not ids["language_id"] & {900, 901, 902, 301} and set(range(120)) <= ids["language_id"]
    assert all(r.lang for r in kept["language_id"])
    assert not ids["near_dedup"] & set(range(200, 210)) and set(range(120)) <= ids["near_dedup"]
    assert ids["near_dedup"] - ids["decontamination"] == {300}
    assert next(r.text for r in kept["pii"] if r.doc_id == 302).endswith("mail [EMAIL] now")
    assert all(r.copies in (1, 2) for r in kept["mixing"])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.copies) for r in whole) == sorted((str(r.doc_id), r.copies) for r in kept["mixing"])


def test_pipeline_on_empty_tables(spark, tmp_path):
    make(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_passes_clashing_columns_on(spark, words, tmp_path):  # noqa: F811
    names = ["score", "accepted", "lang_pred", "is_contaminated", "clean_text", "copies_of", "row", "component_id", "kept"]
    docs = make(spark, [(i, words(40, i)) for i in range(60)]).select("doc_id", "text", "lang", "source", "n_chars")
    for k, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(k))
    spark.createDataFrame([(1, words(30, 900))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
    rows = at.collect()
    assert len(rows) == 60 and all([r[n] for n in names] == list(range(len(names))) for r in rows)
    last = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path))
    assert set(docs.columns) <= set(last.columns)
