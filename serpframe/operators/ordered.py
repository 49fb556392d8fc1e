"""Rows in a total order, cut into chunks of bounded size.

Operators that carry something along an order (a running budget, the last
fetch of a key) work on chunks: what a chunk does to any value it may be
entered with is found for all chunks side by side, the few results are
followed in order, and the chunks are then gone through again with the value
they are entered with. So a day or a key with all rows is still many tasks.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from serpframe.session import scratch_path

#: Rows of a chunk, a power of two; a task of the operators above holds one.
CHUNK_ROWS = 1 << 16


def orderable(t: DataType) -> bool:
    """Whether Spark can order values of a type: not maps, not variants, nor what holds them."""
    if isinstance(t, StructType):
        return all(orderable(f.dataType) for f in t.fields)
    return orderable(t.elementType) if isinstance(t, ArrayType) else not isinstance(t, (MapType, VariantType))


def total_order(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """``order``, then all other columns, so that only rows that are equal in every column tie.

    Columns that Spark cannot order count by their JSON text.
    """
    if not order:
        raise ValueError("pages need an order")
    rest = [f for f in df.schema.fields if f.name not in order]
    name = lambda f: F.col(f"`{f.name}`")
    return [F.col(c) if isinstance(c, str) else c for c in order] \
        + [name(f) if orderable(f.dataType) else F.to_json(F.struct(name(f))) for f in rest]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back, for what goes over its rows several times."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, by: Sequence[Column | str], name: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` written in ranges sorted by ``by``, with ``_at``, which grows along the order, and ``_chunk``.

    The high bits of ``_at`` are the range, the low 33 bits the place in it; a
    chunk is ``chunk_rows`` neighbouring rows of one range. The ranges are
    sampled and differ between runs, so they are written and read back.
    """
    if chunk_rows < 1 or chunk_rows & (chunk_rows - 1):
        raise ValueError("chunk_rows must be a power of two")
    line = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()) \
        .withColumn("_chunk", F.shiftright("_at", chunk_rows.bit_length() - 1))
    path = scratch_path(df.sparkSession, name)
    line.write.parquet(path)
    return df.sparkSession.read.schema(line.schema).parquet(path)
