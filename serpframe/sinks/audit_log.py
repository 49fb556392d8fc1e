"""An audit log that can be appended to again and again without doubling rows.

A batch is written into a folder of its own attempt. It counts from the moment
its manifest exists, a file named by the batch id that is created only if it
is not there. So a batch that is run again changes nothing, a half-written one
is never read, and of two writers of one batch the first to commit counts.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serpframe.schemas import AUDIT_ROW


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifest(path: str, batch: str) -> str:
    if not batch or any(not (c.isalnum() or c in "._-") for c in batch) or batch[0] in "._":
        raise ValueError(f"a batch id is made of letters, digits, dots, underscores and hyphens: {batch!r}")
    return os.path.join(path, "manifests", f"{batch}.json")


def is_committed(spark: SparkSession, path: str, batch: str) -> bool:
    p, fs = _file_system(spark, _manifest(path, batch))
    return fs.exists(p)


def stage_audit(audit: DataFrame, path: str, batch: str) -> str:
    """Write the rows of a batch where nothing reads them yet; the attempt's name."""
    _manifest(path, batch)
    attempt = uuid.uuid4().hex[:12]
    audit.write.json(os.path.join(path, "rows", f"batch={batch}", f"attempt={attempt}"))
    return attempt


def commit_audit(spark: SparkSession, path: str, batch: str, attempt: str) -> bool:
    """Make an attempt the batch's rows; False if the batch has some already."""
    p, fs = _file_system(spark, _manifest(path, batch))
    try:
        out = fs.create(p, False)
    except Exception as e:  # noqa: BLE001  a Java exception
        if fs.exists(p):
            return False
        raise e
    try:
        out.write(bytearray(json.dumps({"batch": batch, "attempt": attempt}), "utf-8"))
    finally:
        out.close()
    return True


def append_audit(audit: DataFrame, path: str, batch: str) -> bool:
    """Append the rows of a batch once; False, without computing them, if the batch is there."""
    spark = audit.sparkSession
    if is_committed(spark, path, batch):
        return False
    return commit_audit(spark, path, batch, stage_audit(audit, path, batch))


def read_audit(spark: SparkSession, path: str, schema=AUDIT_ROW) -> DataFrame:
    """The rows of all committed batches, with ``batch``.

    The rows are joined to the manifests on their folder names, so folders of
    other attempts are pruned and not read.
    """
    names = "batch string, attempt string"
    manifests = spark.read.schema(names).json(os.path.join(path, "manifests"))
    folder, fs = _file_system(spark, os.path.join(path, "rows"))
    if not fs.exists(folder):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("string"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    rows = spark.read.schema(f"{fields}, {names}").json(str(folder))
    return rows.join(manifests, ["batch", "attempt"]).select(*[f.name for f in schema], "batch")
