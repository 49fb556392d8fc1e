"""Sinks: JSON, CSV, the five result tables, export dispatch, audit log and
the nested snapshot. Every writer is a distributed ``df.write``; nothing is
gathered on the driver."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from typing import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from serpframe.operators import flatten
from serpframe.session import remove_folder

# ---------------------------------------------------------------- fixed values
RESULT_TABLES = ["organic_results", "people_also_ask", "related_queries", "paid_results", "ai_overview"]
EXPORT_NAME_PATTERN = "search_results_{job}_{timestamp}"
# ------------------------------------------------------------------------------


# Quotes doubled, blanks around cells kept: how other CSV readers expect it.
CSV_DIALECT = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON Lines, non-ASCII kept (UTF-8)."""
    df.write.mode(mode).json(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with a header, UTF-8 (Spark writes no byte-order mark); quotes are
    doubled inside quoted cells, so other CSV readers read it back."""
    df.write.mode(mode).options(header=True, **CSV_DIALECT).csv(path)
    return path


def write_result_tables(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet",
                        mode: str = "overwrite") -> list[str]:
    """The five flat tables under one root; organic always, the other four
    only when they have rows. Each table is computed once: it is written with
    its row count observed, and the folder of an empty one is removed. The
    tables are written side by side, so one's last tasks do not hold up the next."""
    def one(name: str) -> bool:
        df, out, rows = tables[name], os.path.join(path, name), Observation(name)
        df.observe(rows, F.count(F.lit(1)).alias("n")).write.mode(mode).format(fmt) \
            .options(header=True, **(CSV_DIALECT if fmt == "csv" else {})).save(out)
        if name == "organic_results" or rows.get["n"]:
            return True
        remove_folder(df.sparkSession, out)
        return False

    names = [n for n in RESULT_TABLES if tables.get(n) is not None]
    with ThreadPoolExecutor(max(1, len(names))) as pool:
        return [n for n, kept in zip(names, pool.map(one, names)) if kept]


def write_results(records: DataFrame, path: str, record_col: str = "record", now: Column | None = None,
                  fmt: str = "parquet", mode: str = "overwrite") -> list[str]:
    """The nested snapshot and the five flat tables of result records under one root.

    The records are computed once, for the snapshot ``records``; each table
    reads from it only the fields it needs. Returns the tables written.
    """
    root = write_unified_snapshot(records, os.path.join(path, "records"), mode)
    back = records.sparkSession.read.schema(records.schema).parquet(root)
    make = dict(zip(RESULT_TABLES, (flatten.flatten_organic, flatten.flatten_paa, flatten.flatten_related,
                                    flatten.flatten_paid, flatten.flatten_ai_overview)))
    return write_result_tables({n: f(back, record_col, now) for n, f in make.items()}, path, fmt, mode)


def export_name(job_id: str, ext: str, now: datetime | None = None) -> str:
    ts = (now or datetime.now()).strftime("%Y%m%d_%H%M%S")
    return EXPORT_NAME_PATTERN.format(job=job_id[:8], timestamp=ts) + "." + ext


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).parquet(path)
    return path


EXPORT_WRITERS = {"json": write_json, "csv": write_csv, "parquet": write_parquet}


def export(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite") -> str:
    """Write organic rows; the format comes from ``fmt`` or the path's extension."""
    wanted = (fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".")).lower()
    if wanted not in EXPORT_WRITERS:
        raise ValueError(f"cannot export as {wanted!r}; known formats: {', '.join(EXPORT_WRITERS)}")
    return EXPORT_WRITERS[wanted](df, path, mode)


def write_query_audit(audit: DataFrame, path: str) -> str:
    """Append audit rows (JSON Lines)."""
    audit.write.mode("append").json(path)
    return path


def write_unified_snapshot(records: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Nested unified records as Parquet, next to the flat tables."""
    records.write.mode(mode).parquet(path)
    return path
