"""SQL functions agree with the column functions."""

from pyspark.sql import functions as F

from serpframe.functions import followers as FO
from serpframe.functions import sql
from serpframe.functions import text as T

QUERIES = ["a (", "(OR AND OR x)", "OR", "  A   () ", "x ( ( ) )", "a))", "(OR a) AND", None, "", "b OR OR c AND", "((x y",
           "( ) " * 200, "(" * 300 + "q )" * 290, "see A.COM now", ") a ) (b) ("]
TEXTS = ["1,234 followers", "1,5K followers", "500+ connections", "2.5K connections", "Followers: 12", "nothing", None, "",
         "1.234 seguidores", "12 kết nối", "3m follower"]
NUMBERS = [("2.5", ""), ("1.5", "k"), ("3.5", None), ("1.234,5", ""), ("1 234", "M"), ("x", ""), (None, None), ("1,5", "B")]
SITES = ["site:a.com", "b.org", "site:c.net", None]


def test_sql_functions(spark):
    sql.register(spark)
    q = spark.createDataFrame([(x,) for x in QUERIES], "q string")
    sites = "array('site:a.com', 'b.org', 'site:c.net', null)"
    out = q.select(T.clean_query("q").alias("a"), F.expr("clean_query(q)").alias("b"),
                   T.normalize_query("q", SITES).alias("c"), F.expr(f"normalize_query(q, {sites})").alias("d"),
                   T.normalize_query("q", []).alias("e"), F.expr("normalize_query(q, null)").alias("f")).collect()
    assert [(r.a, r.c, r.e) for r in out] == [(r.b, r.d, r.f) for r in out]
    t = spark.createDataFrame([(x,) for x in TEXTS], "t string")
    out = t.select(FO.extract_followers("t").alias("a"), F.expr("extract_followers(t)").alias("b")).collect()
    assert [r.a for r in out] == [r.b for r in out]
    n = spark.createDataFrame(NUMBERS, "n string, u string")
    out = n.select(FO.parse_human_number("n", "u").alias("a"), F.expr("parse_human_number(n, u)").alias("b")).collect()
    assert [r.a for r in out] == [r.b for r in out]


def test_bodies_stay_in_the_jvm(spark):
    sql.register(spark)
    plan = spark.sql("select clean_query(cast(id as string)) from range(3)")._jdf.queryExecution().toString()
    assert "Python" not in plan
