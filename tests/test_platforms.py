import pytest

from conftest import one
from serpframe.operators import platforms as P


@pytest.mark.parametrize("raw,expected", [
    ("www.", "site:linkedin.com/in"),           # blank after prefixes is inside every key
    ("GitHub", "site:github.com"),
    ("site:Example.org", "site:Example.org"),   # kept as typed
    ("excellent.org", "site:cell.com"),         # substring match, as the rule says
    ("my forum", "site:my forum"),
    ("macmillan.com/user", "site:dl.acm.org"),  # "acm" is inside "macmillan.com"
    ("foo", "site:foo.com"),
    ("https://www.linkedin.co.uk/in/", "site:linkedin.com/in"),
    ("", ""),
])
def test_platform_to_site(spark, raw, expected):
    assert one(spark, P.platform_to_site, raw) == expected


def test_normalize_prefix_order(spark):
    # www. is checked before https://, so it survives behind it
    assert one(spark, P.normalize_platform, "https://www.x.com/") == "www.x.com"


def test_validate(spark):
    assert one(spark, P.validate_platform, "bad!name")["error"] == P.MSG_CHARS
    assert one(spark, P.validate_platform, "  ")["error"] == P.MSG_EMPTY
    assert one(spark, P.validate_platform, "x" * 101)["error"] == P.MSG_LONG
    assert one(spark, P.validate_platform, "dev.to")["valid"] is True


def test_dimension_and_titles(spark):
    dim = P.platforms(spark).collect()
    assert len(dim) == 57 and dim[14]["name"] == "Dev.To"


def test_suggestions_order(spark):
    df = spark.createDataFrame([(1, "link")], "id int, q string")
    rows = P.suggest_platforms(df, "q", 10, "id").orderBy("rank").collect()
    assert [r["name"] for r in rows] == ["Linkedin", "Linkedin Vietnam"]
