"""Token counts as a rollup that is maintained by signed changes (operator 1).

A rollup is a folder. Each batch of changes is turned into signed rows: an
insert adds a document, a delete takes away what the rollup holds of it, a
revision does both. ``rows/batch=<id>`` keeps the signed rows by document,
``totals/batch=<id>`` their sums by source, language and tokenizer version.
Sums are additive, so the totals are the sum over all batches. A commit
replaces its own batch folder and depends on earlier batches only: running it
again, after a failure or by mistake, changes nothing.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serpframe.llm import textblocks as tb
from serpframe.llm.tables import map_batches

ROWS = "doc_id long, source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long"
KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_bytes")


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level BPE vocabulary (ranks file) and the version its counts are kept under."""

    version: str = "byte_bpe_50k-1"
    path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = (r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def ranks(self) -> dict[bytes, int]:
        with open(self.path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def count_tokens(docs: DataFrame, tokenizer: Tokenizer, keep: tuple[str, ...]) -> DataFrame:
    """The ``keep`` columns of every row with n_tokens and n_bytes of its whole text.

    The ranks (below 1 MB) are read once by the driver and broadcast. Null
    counts as an empty text with 0 tokens.
    """
    import tiktoken

    sent = docs.sparkSession.sparkContext.broadcast(tokenizer.ranks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tiktoken.Encoding(
            tokenizer.version, pat_str=tokenizer.pattern, mergeable_ranks=sent.value, special_tokens={})
        for batch in batches:
            texts = batch.column("text")
            n = [len(enc.encode_ordinary(t)) for t in texts.fill_null("").to_pylist()]
            size = np.diff(tb.string_buffers(texts)[1])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(n, pa.int64()), pa.array(size)],
                                             names=[*keep, "n_tokens", "n_bytes"])

    data = docs.select(*keep, "text")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in data.schema if f.name != "text")
    return map_batches(data, run, f"{fields}, n_tokens long, n_bytes long")


class Rollup:
    """Totals by source, language and tokenizer version in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, tokenizer: Tokenizer):
        self.spark, self.path, self.tokenizer = spark, path, tokenizer

    def _read(self, part: str, schema: str) -> DataFrame:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, part))
        there = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root)
        schema += ", batch long"
        return self.spark.read.schema(schema).parquet(str(root)) if there else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        return self._read("rows", ROWS)

    def current(self, before: int | None = None) -> DataFrame:
        """What the rollup holds of each document, after the batches below ``before``."""
        rows = self.rows() if before is None else self.rows().where(F.col("batch") < before)
        return rows.groupBy("doc_id", *KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).where("n_docs > 0")

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Apply one batch: rows (doc_id, kind, source, lang, text).

        ``kind``: insert, revise (delete what is held, then insert) or delete
        (text not read; an id not held changes nothing). An insert of an id
        that is held is a revision. Rows that repeat a doc_id within a batch:
        equal rows count once, of different ones the first by kind, source,
        lang and token count. Rows with null doc_id or other kinds are left
        out. Null source and lang are groups of their own. A null or empty text
        is a document of no tokens; texts of any length are counted whole. Extra columns are
        ignored; an empty batch is committed empty.
        """
        change = changes.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("kind"), F.col("source"),
                                F.col("lang"), F.col("text")) \
            .where("doc_id is not null and kind in ('insert', 'revise', 'delete')")
        counted = count_tokens(
            change.withColumn("text", F.expr("if(kind = 'delete', null, text)")),
            self.tokenizer, ("doc_id", "kind", "source", "lang"))
        one = counted.groupBy("doc_id").agg(F.min(F.struct("kind", "source", "lang", "n_tokens", "n_bytes")).alias("c")) \
            .select("doc_id", "c.*")
        added = one.where("kind <> 'delete'").select(
            "doc_id", "source", "lang", F.lit(self.tokenizer.version).alias("tokenizer"),
            F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_bytes")
        held = self.current(batch)
        taken = held.join(change.select("doc_id"), "doc_id", "left_semi").select(
            "doc_id", *KEYS, *[(-F.col(c)).alias(c) for c in SUMS])
        self._replace("rows", batch, added.unionByName(taken))
        mine = self.rows().where(F.col("batch") == batch)
        self._replace("totals", batch, mine.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]))

    def _replace(self, part: str, batch: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(os.path.join(self.path, part, f"batch={int(batch)}"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_bytes over all batches; groups without documents are left out."""
        schema = ROWS.replace("doc_id long, ", "")
        return self._read("totals", schema).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).where("n_docs > 0")
