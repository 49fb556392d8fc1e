"""Corpus pipeline over ``documents``: each stage applies one operator of ``serpframe.llm``.

A stage gets what its predecessor kept and returns the columns of documents;
the last returns them with the copies that the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serpframe.llm import decontaminate, language_id, mixing, near_dups, pii
from serpframe.llm.tables import free_name, named, read_table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go; a null lang is filled in.

    Rejected are null and empty texts, texts without letters, and those that
    the model is too uncertain about. Repeated rows fare alike; other columns
    pass through, whatever their names.
    """
    lang, score, accepted = names = tuple(free_name(n, docs.columns) for n in ("lang_pred", "score", "accepted"))
    out = language_id.predict(docs, language_id.train(docs), names).where(accepted)
    return out.select(*[F.coalesce("lang", lang).alias(c) if c == "lang" else named(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the smallest doc_id; rows that repeat a doc_id go.

    Null and empty texts are in no group and stay; so do rows with null doc_id.
    """
    kept = near_dups.near_duplicates(docs, words=5, percent=80).where("kept and doc_id is not null").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns) \
        .unionByName(docs.where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a tenth of its words edited, go; null texts stay."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind in brackets; null texts stay null."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, copies and taken; null is a source."""
    return mixing.mix(docs).where("copies > 0")


STAGES = [("language_id", identify_language), ("near_dedup", near_dedup), ("decontamination", decontaminated),
          ("pii", redact), ("mixing", mix)]

# The language model and the trained redactor cannot be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
