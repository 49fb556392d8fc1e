"""Sources and sinks against files of other programs, and their edge cases."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from serpframe.sinks import writers as W
from serpframe.sources import queries as SQ
from serpframe.sources import responses as SR


def texts(df):
    return [r.original_input for r in df.orderBy("input_row_id").collect()]


def test_csv_made_by_pandas(spark, tmp_path):
    queries = ['""sales lead"" (a OR b)', 'line one\nline two', 'a, b and "c"', "plain", "NA", "", "N/A"]
    pd.DataFrame({"n": range(7), " Query ": queries}).to_csv(tmp_path / "q.csv", index=False)
    assert texts(SQ.read_queries_csv(spark, str(tmp_path / "q.csv"))) == queries[:4]
    pd.DataFrame({"a.b": ["x y", "NULL"], "input_row_id": ["r1; r2", "z"], "max_pages": [3, 4]}) \
        .to_csv(tmp_path / "m.csv", index=False)
    assert texts(SQ.read_queries_csv(spark, str(tmp_path / "m.csv"))) == ['"x y" (r1 OR r2)', "z"]


def test_csv_without_line_breaks_splits(spark, tmp_path):
    pd.DataFrame({"anchor": [f"q {i}, x" for i in range(400)], "role": ["a"] * 400}).to_csv(tmp_path / "q.csv", index=False)
    names = {"spark.sql.files.maxPartitionBytes": "500", "spark.sql.files.openCostInBytes": "1"}
    was = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        whole, split = (SQ.read_queries(spark, str(tmp_path / "q.csv"), multi_line=m) for m in (True, False))
        assert texts(split) == texts(whole) == [f'"q {i}, x" (a)' for i in range(400)]
        assert split.rdd.getNumPartitions() > 5 and whole.rdd.getNumPartitions() == 1
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_csv_for_pandas(spark, tmp_path):
    rows = [(1, 'say "b", then c', " kept "), (2, "two\nlines", None), (3, "\\", "x")]
    W.write_csv(spark.createDataFrame(rows, "n int, title string, t string").coalesce(1), str(tmp_path / "o"))
    part = next(p for p in os.listdir(tmp_path / "o") if p.endswith(".csv"))
    back = pd.read_csv(tmp_path / "o" / part, keep_default_na=False)
    assert back.title.tolist() == [r[1] for r in rows]
    assert back.t.tolist() == [" kept ", "", "x"]


@pytest.mark.parametrize("doc,want", [
    (["{curly} query", "b", 3, None, " "], ['"{curly} query"', "b", "3"]),
    ([{"anchor": "z z", "max_pages": 2, "b": None, "a": "role"}, "x"], ['"z z" (role)', "x"]),
    ({"data": ["late"], "terms": "no list", "queries": [{"k": "v"}, "[x"]}, ["v", "[x"]),
    ({"limit": 10, "extra": ["a"], "meta": {"k": "v"}, "q": " [b "}, ["a", "[b"]),
    ([], []), ({}, []),
])
def test_json_documents(spark, tmp_path, doc, want):
    (tmp_path / "d.json").write_text(json.dumps(doc))
    assert texts(SQ.read_queries(spark, str(tmp_path / "d.json"))) == want


@pytest.mark.parametrize("text", ["3", '"one"', "{broken"])
def test_json_documents_of_other_shapes_are_errors(spark, tmp_path, text):
    (tmp_path / "d.json").write_text(text)
    with pytest.raises(Exception, match="queries document"):
        SQ.read_queries(spark, str(tmp_path / "d.json")).collect()


def test_json_lines(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('"{x"\n\n{"b": "two words", "a": "r"}\n7\nnull\n')
    assert texts(SQ.read_queries(spark, str(tmp_path / "d.jsonl"))) == ["{x", '"two words" (r)', "7"]
    (tmp_path / "bad.jsonl").write_text('"x"\n{broken\n')
    with pytest.raises(Exception, match="not a JSON line"):
        SQ.read_queries(spark, str(tmp_path / "bad.jsonl")).collect()


def test_dispatch_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        SQ.read_queries(spark, str(tmp_path / "none.txt"))
    (tmp_path / "q.xls").write_text("x")
    with pytest.raises(ValueError, match=".xls"):
        SQ.read_queries(spark, str(tmp_path / "q.xls"))
    with pytest.raises(ValueError, match="xml"):
        W.export(spark.range(1), str(tmp_path / "o.xml"))


@pytest.mark.parametrize("fmt", ["json", "csv", "parquet"])
def test_export_formats(spark, tmp_path, fmt):
    path = W.export(spark.createDataFrame([(1, "a,b"), (2, 'c"')], "n int, s string"), str(tmp_path / f"o.{fmt}"))
    back = spark.read.format(fmt).options(header=True, escape='"').load(path)
    assert sorted(r.s for r in back.collect()) == ["a,b", 'c"']


def test_empty_result_tables_leave_no_folder(spark, tmp_path):
    some, none = spark.range(2), spark.range(0)
    got = W.write_result_tables({"organic_results": none, "people_also_ask": none, "ai_overview": some}, str(tmp_path))
    assert got == ["organic_results", "ai_overview"]
    assert sorted(os.listdir(tmp_path)) == ["ai_overview", "organic_results"]


def test_log_lines_keep_other_keys(spark, tmp_path):
    (tmp_path / "log").write_text('{"action": "a", "page": 2, "total_results": "n/a", "mine": {"k": 1}}\n{"action": "b"}\n')
    got = SR.read_log_events(spark, str(tmp_path / "log")).orderBy("action").collect()
    assert got[0].page == 2 and got[0].total_results == "n/a" and got[0].extra.toPython() == {"mine": {"k": 1}}
    assert got[1].extra is None


def test_scratch_needs_a_shared_folder_off_local_mode():
    from serpframe import session

    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "yarn"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Cluster())
    assert F


def test_json_documents_grow_in_number_and_not_in_size(spark):
    from serpframe.plans import q_io
    sf = "/root/testdata/sf0.1"
    docs = q_io._grouped(spark, sf).selectExpr("size(names) as n", "first").collect()
    assert sum(d.n for d in docs) == spark.read.parquet(f"{sf}/part.parquet").count() == 20_000
    assert max(d.n for d in docs) <= q_io.DOCUMENT_ROWS and len(docs) == 20
    assert sum(d.first for d in docs) == 10
    for q, n in ((q_io.q_read_queries_json_list, 20_000), (q_io.q_read_queries_json_spread, 20_010)):
        assert q(spark, sf).count() == n
