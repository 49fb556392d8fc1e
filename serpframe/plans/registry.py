"""Registry of checked queries: one Spark plan and one DuckDB oracle per operator.

Each query reads the driver tables of ``sf_dir`` through the fixture views
and runs one operator of the library over all of their rows. The oracle is
the same question in DuckDB SQL over the same views.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serpframe.options import SearchOptions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Options the checks run with. Two usable sites (one is a word that occurs in
# part names, so some queries already "contain" it), one without the
# ``site:`` prefix and one blank, which are ignored.
SITES = ("site:linkedin.com/in", "site:green", "github.com", "")
OPTS = SearchOptions(profile_sites=SITES, split_long_queries=True)
NOW = "2024-02-01 00:00:00"


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def now_col():
    return F.lit(NOW).cast("timestamp")
