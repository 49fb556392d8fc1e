"""JSON lists that are cut at byte ranges hold the same elements as ``json`` reads."""

import json
import random

import pytest

from serpframe.sources import queries as SQ
from serpframe.sources.json_list import read_json_elements

ALPHABET = ['a', ',', '"', '\\', '[', ']', '{', '}', 'é', '\n', ' ', ' ', '\\"', ',,']


def value(rng, depth=0):
    kind = rng.random()
    text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(12)))
    if depth < 3 and kind < 0.25:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    if depth < 3 and kind < 0.5:
        return {text + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}
    return rng.choice([text, rng.randrange(-9, 99), 1.5, True, None])


@pytest.fixture()
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "301", "spark.sql.files.openCostInBytes": "1",
             "spark.sql.files.minPartitionNum": "1"}
    was = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_any_list_over_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(8)
    want = {}
    for n, (size, indent, ascii_) in enumerate([(300, None, True), (120, 2, False), (1, 1, True), (40, None, False)]):
        want[n] = [value(rng) for _ in range(size)]
        (tmp_path / f"{n}.json").write_text(json.dumps(want[n], indent=indent, ensure_ascii=ascii_), encoding="utf-8")
    rows = read_json_elements(spark, str(tmp_path)).orderBy("input_row_id")
    got = {}
    for r in rows.collect():
        got.setdefault(int(r.input_row_id.file.rsplit("/", 1)[1][0]), []).append(json.loads(r.element))
    assert got == want
    # the largest file alone is read by many tasks
    assert spark.read.option("lineSep", ",").text(str(tmp_path / "0.json")).rdd.getNumPartitions() > 5


def test_queries_equal_those_of_the_whole_document(spark, tmp_path, small_splits):
    rng = random.Random(3)
    doc = [rng.choice([f"query, {i}", {"anchor": f"a{i}", "role": "x, [y]", "max_pages": 2}, None, i, "", ' "q" ']) for i in range(200)]
    (tmp_path / "q.json").write_text(json.dumps(doc))
    texts = lambda df: [r.original_input for r in df.orderBy("input_row_id").collect()]
    assert texts(SQ.read_queries_json_list(spark, str(tmp_path))) == texts(SQ.read_queries_json(spark, str(tmp_path)))


@pytest.mark.parametrize("text", ["[]", " [ \n] ", "[ ]"])
def test_empty_lists(spark, tmp_path, text):
    (tmp_path / "e.json").write_text(text)
    assert read_json_elements(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("text", ['{"a": [1, 2]}', "[1, 2", '["a, b', "[1], 2]x", "3", "[1, [2]"])
def test_other_documents_are_errors(spark, tmp_path, text):
    (tmp_path / "b.json").write_text(text)
    with pytest.raises(Exception, match="not one JSON list"):
        read_json_elements(spark, str(tmp_path)).collect()


def test_broken_elements_are_errors(spark, tmp_path):
    (tmp_path / "b.json").write_text("[1, nope, 2]")
    with pytest.raises(Exception, match="not a JSON element"):
        SQ.read_queries_json_list(spark, str(tmp_path)).collect()
