import pytest

from conftest import one
from serpframe.functions import followers as FO
from serpframe.functions import numbers as N
from serpframe.functions import snippets as SN


@pytest.mark.parametrize("raw,expected", [("3.9", 3), ("-3.9", -3), ("nan", None), ("", None), (" 2 ", 2),
                                          ("1e2", 100), ("abc", None), ("1_000", None)])
def test_coerce_int(spark, raw, expected):
    assert one(spark, N.coerce_int, raw) == expected


@pytest.mark.parametrize("text,count", [("1,234 followers", 1234), ("1,5K followers", 15000),
                                        ("500+ connections", 500), ("2.5K connections", 2500),
                                        ("Followers: 12", 12), ("nothing here", None)])
def test_normalizer_reader(spark, text, count):
    got = one(spark, FO.extract_followers, text)
    assert (got["followersCount"] if got else None) == count


def test_export_reader_reads_comma_as_decimal(spark):
    from pyspark.sql.types import StringType, StructField, StructType
    t = StructType([StructField("snippet", StringType())])
    df = spark.createDataFrame([("1,234 followers",)], "snippet string")
    got = df.select(FO.infer_followers(df.schema["snippet"] and __import__("pyspark.sql.functions", fromlist=["struct"])
                                       .struct("snippet"), t).alias("r")).collect()[0]["r"]
    assert got["text"] == "1,234 followers" and got["count"] == 1


@pytest.mark.parametrize("num,suf,expected", [("2.5", "", 2), ("1.5", "k", 1500), ("3.5", "", 4),
                                              ("1.234,5", "", 1), ("1 234", "", 1234)])
def test_parse_human_number_half_even(spark, num, suf, expected):
    df = spark.createDataFrame([(num, suf)], "n string, s string")
    assert df.select(FO.parse_human_number("n", "s").alias("r")).collect()[0]["r"] == expected


def test_best_snippet_tie_goes_to_og(spark):
    df = spark.createDataFrame([("short...", "abcd", "wxyz")], "s string, og string, tw string")
    assert df.select(SN.best_snippet("s", "og", "tw").alias("r")).collect()[0]["r"] == "abcd"


@pytest.mark.parametrize("text,expected", [("Done.", False), ("cut...", True), ("no end", True), ("   ", False),
                                           (None, False), ("ok…", False)])
def test_is_truncated(spark, text, expected):
    assert one(spark, SN.is_truncated, text) is expected
