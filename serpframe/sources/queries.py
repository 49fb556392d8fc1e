"""Query sources: CSV, JSON (document or JSON Lines), plain text, dispatch.

Every reader returns ``input_row_id, original_input STRING``. The row id is a
struct (file, split, row) that orders rows as they stand in the input: "first
row wins" rules need its order only, so nothing is ranked or numbered.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serpframe.functions import text as T
from serpframe.operators.compose import compose_queries, merge_columns
from serpframe.sources.json_list import read_json_elements

# ---------------------------------------------------------------- fixed values
# Texts pandas reads as missing by default (its documented ``na_values``).
PANDAS_NA = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Object keys whose list holds the queries, in lookup order.
JSON_LIST_KEYS = ["keywords", "queries", "terms", "data"]
# Column names that hold ready queries.
QUERY_COLUMNS = ["query", "queries"]
# ------------------------------------------------------------------------------


def _order():
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                    F.monotonically_increasing_id().alias("row"))


def with_input_order(df: DataFrame) -> DataFrame:
    """Add ``input_row_id`` from the scan itself: file path, start of the file
    split, and a number that grows along the split."""
    return df.withColumn("input_row_id", _order())


def read_queries_text(spark: SparkSession, path: str) -> DataFrame:
    """One query per line, trimmed; blank lines dropped."""
    df = with_input_order(spark.read.text(path))
    return (df.select("input_row_id", T.strip("value").alias("original_input"))
            .filter(F.col("original_input") != ""))


def read_queries_csv(spark: SparkSession, path: str, na_values=None, multi_line: bool = True) -> DataFrame:
    """CSV with a header: quotes doubled inside quoted cells. Cells may span
    lines, which makes a file one task; with ``multi_line=False`` a file is
    read by as many tasks as it has splits, and a line break ends the row. A ``query``/``queries`` column (first in order, matched trimmed and
    case-insensitive) holds ready queries; otherwise the cells of each row are
    composed into one query. Header names are free: dots, and names the
    reader uses itself, do no harm."""
    na = PANDAS_NA if na_values is None else list(na_values)
    raw = spark.read.options(header=True, inferSchema=False, quote='"', escape='"', multiLine=multi_line).csv(path)
    names = raw.columns
    quoted = [F.col("`" + n.replace("`", "``") + "`") for n in names]
    at = next((k for k, n in enumerate(names) if n.strip().lower() in QUERY_COLUMNS), None)
    used = [at] if at is not None else [k for k, n in enumerate(names) if n in set(merge_columns(names))]
    cells = raw.select(_order().alias("input_row_id"),
                       *[F.when(~quoted[k].isin(*na), quoted[k]).alias(f"cell_{k}") for k in used])
    if at is not None:
        return (cells.select("input_row_id", T.strip(F.col(f"cell_{at}")).alias("original_input"))
                .filter(F.coalesce(F.col("original_input"), F.lit("")) != ""))
    if not used:
        return cells.select("input_row_id", F.lit(None).cast("string").alias("original_input")).limit(0)
    return compose_queries(cells, [f"cell_{k}" for k in used])


def _compose_map(m):
    """Compose a query from a JSON object's values (override keys left out)."""
    from serpframe.operators.compose import OVERRIDE_COLUMNS
    kept = F.filter(F.map_entries(m), lambda e: ~F.lower(T.strip(e["key"])).isin(*OVERRIDE_COLUMNS)
                    & e["value"].isNotNull() & (T.strip(e["value"]) != ""))
    cells = F.transform(kept, lambda e: T.strip(e["value"]))
    return F.when(F.size(cells) > 0,
                  T.compose_query(F.try_element_at(cells, F.lit(1)),
                                  F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))))


def _kind(v):
    """OBJECT, ARRAY, STRING ... of a VARIANT; types only, as its objects are sorted by key."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _element(kind, text):
    """A list element: an object is composed, a null gives nothing, anything else is one query."""
    return F.when(kind == "OBJECT", _compose_map(F.from_json(text, "map<string,string>"))) \
            .when((kind != "VOID") & (T.strip(text) != ""), T.strip(T.ensure_quoted(text)))


def _elements(text):
    """The elements of a JSON list as (kind, text)."""
    kinds = F.transform(F.from_json(text, "array<variant>"), _kind)
    return F.transform(F.arrays_zip(kinds.alias("kind"), F.from_json(text, "array<string>").alias("text")),
                       lambda e: F.struct(e["kind"].alias("kind"), e["text"].alias("text")))


def _from_text(df, value: str, what: str):
    """Queries from rows whose column ``value`` is the text of one JSON value."""
    v = F.try_parse_json(F.col(value))
    kind = F.when(T.strip(value) == "", "VOID").when(v.isNull(), F.raise_error(
        F.concat(F.lit(f"not {what}: "), F.substring(value, 1, 80)))).otherwise(_kind(v))
    text = F.when(kind == "OBJECT", F.col(value)).otherwise(F.try_variant_get(v, "$", "string"))
    return (df.select("input_row_id", kind.alias("kind"), text.alias("text"))
            .select("input_row_id", _element(F.col("kind"), F.col("text")).alias("original_input"))
            .filter(F.col("original_input").isNotNull()))


def read_queries_json_list(spark: SparkSession, path: str) -> DataFrame:
    """Queries from JSON lists of any size, each file one list: the first shape
    of ``read_queries_json``, with the same rows, but a file is read by as many
    tasks as it has splits. Other shapes and broken JSON are errors."""
    return _from_text(read_json_elements(spark, path), "element", "a JSON element")


def read_queries_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Queries from JSON.

    A document may be a list (of scalars or objects), an object with the
    first of ``keywords, queries, terms, data`` that holds a list, or an
    object of other lists and strings (all their values in order; values of
    other types are passed over). Anything else, and broken JSON, is an error.
    A whole document is one value, so large inputs should be JSON Lines
    (``lines=True``: one scalar or object per line) or go through
    ``read_queries_json_list``, which split. JSON nulls are dropped.
    """
    if lines:
        df = with_input_order(spark.read.text(path))
        return _from_text(df, "value", "a JSON line")
    docs = with_input_order(spark.read.option("wholetext", True).text(path))
    doc = F.col("value")
    docs = docs.select("input_row_id", "value", _kind(F.try_parse_json(doc)).alias("kind"),
                       F.from_json(doc, "map<string,variant>").alias("types"),
                       F.from_json(doc, "map<string,string>").alias("texts"))
    key = F.get(F.filter(F.array(*[F.lit(k) for k in JSON_LIST_KEYS]),
                         lambda k: F.coalesce(_kind(F.try_element_at(F.col("types"), k)) == "ARRAY", F.lit(False))), 0)
    one = lambda t: F.array(F.struct(F.lit("STRING").alias("kind"), t.alias("text")))
    # objects inside such lists are taken as their JSON text
    spread = F.flatten(F.transform(F.map_entries("texts"), lambda e: F.when(
        _kind(F.try_element_at(F.col("types"), e["key"])) == "ARRAY", F.transform(_elements(e["value"]), lambda x: F.struct(
            F.when(x["kind"] == "VOID", x["kind"]).otherwise(F.lit("STRING")).alias("kind"), x["text"].alias("text"))))
        .when(_kind(F.try_element_at(F.col("types"), e["key"])) == "STRING", one(e["value"]))
        .otherwise(F.array().cast("array<struct<kind:string,text:string>>"))))
    items = F.when(F.col("kind") == "ARRAY", _elements(doc)) \
        .when((F.col("kind") == "OBJECT") & key.isNotNull(), _elements(F.try_element_at(F.col("texts"), key))) \
        .when(F.col("kind") == "OBJECT", spread)
    checked = F.when(items.isNull(), F.raise_error(F.lit(
        "a queries document must be a JSON list, or an object that holds lists or strings"))).otherwise(items)
    listed = docs.select("input_row_id", F.posexplode(checked).alias("pos", "e"))
    place = F.struct("input_row_id.file", "input_row_id.split", F.col("pos").cast("bigint").alias("row"))
    return listed.select(place.alias("input_row_id"), _element(F.col("e.kind"), F.col("e.text")).alias("original_input")) \
        .filter(F.col("original_input").isNotNull())


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_queries(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Dispatch on the file extension; a missing file or an unknown extension is an error. ``multi_line`` is for CSV."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no queries file at {path}")
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext == ".json":
        return read_queries_json(spark, path)
    if ext in (".jsonl", ".ndjson"):
        return read_queries_json(spark, path, lines=True)
    if ext == ".csv":
        return read_queries_csv(spark, path, multi_line=multi_line)
    if ext == ".txt":
        return read_queries_text(spark, path)
    raise ValueError(f"cannot read queries from {ext or path!r}: expected .json, .jsonl, .csv or .txt")
