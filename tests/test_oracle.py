"""Registered queries against their DuckDB oracles on the smallest tables."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from serpframe.plans import catalog
from serpframe.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"
KEYS = sorted(catalog.ORACLES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def _rows(pdf):
    import math
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        row = []
        for v in rec:
            if isinstance(v, np.ndarray):
                row.append(repr(v.tolist()))
            elif v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
                row.append(None)
            elif isinstance(v, float) and v.is_integer():
                row.append(int(v))
            elif type(v).__module__ == "numpy" and hasattr(v, "item"):
                item = v.item()
                row.append(int(item) if isinstance(item, float) and item.is_integer() else item)
            elif hasattr(v, "tolist"):
                row.append(repr(v.tolist()))
            else:
                row.append(v if not hasattr(v, "isoformat") else str(v)[:19])
        out.append(tuple(row))
    return cols, sorted(out, key=repr)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    got = _rows(E.queries()[key](spark, SF).toPandas())
    want = _rows(duck.execute(E.oracle_sql()[key]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_query_is_registered_with_known_oracle_state():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert len(catalog.QUERIES) >= 95


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "connections_count" in df.columns
