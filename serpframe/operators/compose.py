"""Query composition, blank removal and the sub-queries actually sent."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serpframe.functions import text as T
from serpframe.options import SearchOptions

# Per-row override columns that never become part of a query (fixed values).
OVERRIDE_COLUMNS = ("uule", "results_per_page", "max_pages")


def merge_columns(columns: Sequence[str], exclude: Sequence[str] = ()) -> list[str]:
    """Columns that take part in a query, in order, without override columns."""
    return [c for c in columns
            if c not in exclude and str(c).strip().lower() not in OVERRIDE_COLUMNS]


def compose_queries(df: DataFrame, columns: Sequence[str] | None = None,
                    id_col: str = "input_row_id") -> DataFrame:
    """One query per row: first non-blank cell is the anchor, later ones are roles.

    Rows without any non-blank cell give no query.
    """
    cols = merge_columns(columns if columns is not None else df.columns, exclude=(id_col,))
    cells = F.filter(F.array(*[T.strip(F.col(c).cast("string")) for c in cols]),
                     lambda x: x.isNotNull() & (x != ""))
    return (df.select(F.col(id_col), cells.alias("_cells"))
            .filter(F.size("_cells") > 0)
            .select(id_col,
                    T.compose_query(F.try_element_at("_cells", F.lit(1)),
                                    F.slice("_cells", 2, F.greatest(F.size("_cells") - 1, F.lit(0))))
                    .alias("original_input")))


def drop_blank_queries(df: DataFrame, col: str = "original_input") -> DataFrame:
    """Remove null or blank inputs; row ids of the rest are kept."""
    return df.filter(F.col(col).isNotNull() & (T.strip(F.col(col)) != ""))


def final_subqueries(df: DataFrame, options: SearchOptions, col: str = "original_input",
                     id_col: str = "input_row_id") -> DataFrame:
    """One row per sub-query sent: clean, add sites, split when asked and long,
    then clean and add sites again on every part."""
    sites = list(options.profile_sites)
    final = T.apply_site_filters(T.clean_query(F.col(col)), sites)
    staged = df.select(F.col(id_col), final.alias("final_query"))
    if options.split_long_queries:
        parts = F.when(T.needs_split("final_query"), T.split_query("final_query")) \
                 .otherwise(F.array("final_query"))
    else:
        parts = F.array("final_query")
    return (staged.select(id_col, "final_query", F.posexplode(parts).alias("sub_idx", "_part"))
            .select(id_col, "final_query", "sub_idx",
                    T.apply_site_filters(T.clean_query("_part"), sites).alias("sub_query")))
