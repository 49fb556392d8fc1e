"""Written intermediate tables, and connected components over link tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from serpframe.session import scratch_path


#: Rows that a Python task holds at a time; texts are whole, so a batch of the usual 10,000 takes much memory.
BATCH_ROWS = 1000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_batches(df: DataFrame, fn: Callable, schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` in batches of ``BATCH_ROWS`` rows at most.

    Spark takes the size from the session when the plan runs, so the session's
    setting is lowered if it is larger. Results do not depend on it.
    """
    spark = df.sparkSession
    now = int(spark.conf.get(_ROWS_SETTING))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(_ROWS_SETTING, str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    This cuts lineage: a lost executor costs its running tasks only. The
    folder may go when the result that reads it has been stored.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of links ``(a, b)`` of longs: rows ``(id, component)``.

    Component is the smallest id reachable; ids without a link to another id
    are not returned. Alternating large-star and small-star rounds, each a few
    shuffles of the links, written to the shared folder; a chain of n ids
    takes about log2(n) rounds. Only a count and a hash sum reach the driver.
    Null ends are ignored; an empty table gives an empty table.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")) \
        .where("a is not null and b is not null and a <> b").distinct()
    links = written(links, "links")
    mark = None
    for _ in range(max_rounds):
        now = links.agg(F.count("*").alias("n"),
                        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now["n"] == 0 or tuple(now) == mark:
            break
        mark = tuple(now)
        links = written(_small_star(_large_star(links)), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("b").alias("id")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")) \
        .unionByName(roots.select("id", F.col("id").alias("component")))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    low = written(low, "lowest")  # apart from the join, whose hot ids can then be split
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    low = written(links.groupBy("a").agg(F.min("b").alias("m")), "lowest")
    moved = links.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def free_name(name: str, taken: list[str]) -> str:
    """``name``, or with underscores behind it if a column has it."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def named(name: str) -> Column:
    """The column of that name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def appended(df: DataFrame, column: str, fields: str, fn: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """``df`` with new columns that ``fn`` makes from Arrow batches of ``column``; no shuffle.

    ``fields`` is the DDL of the new columns; they take the place of columns
    of the same name. Columns may have any name.
    """
    new = StructType.fromDDL(fields)
    df = df.drop(*[n for n in new.names if n != column])
    old, at = df.schema.names, df.schema.names.index(column)
    plain = df.toDF(*[f"c{k}" for k in range(len(old))])
    out = StructType([*plain.schema.fields, *[StructField(f"n{k}", f.dataType) for k, f in enumerate(new.fields)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *fn(batch.column(at))], names=out.names)

    return map_batches(plain, run, out).toDF(*old, *new.names)
