"""A training corpus from raw documents: quality, exact and near duplicates, benchmark leaks, tokens.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and returns a DataFrame that is
written as Parquet and read again for the next one. All but the last return the columns of ``documents``.
A document is identified by ``doc_id``: rows that share one are kept or dropped together, and rows
without one are kept by the duplicate and leak stages. Null texts are empty texts. As a stage's rows are
written before the next one begins, each stage first deletes what earlier ones have left in the shared
folder.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pestle.llm import bpe, decontaminate, exact_dedup, near_dedup, quality
from pestle.llm.common import Owner, release, settled, table, written

#: Owns what the stages leave in the shared folder, so that no other query's tables are ever deleted.
OWN = Owner()


def stage(f):
    """``f`` with OWN's intermediate tables, after those of earlier stages have been deleted."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with OWN:
            release(spark)
            return f(spark, docs, sf_dir)

    return run


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` less the identifiers in ``dropped``; both are shuffled by them."""
    ids = dropped.select(F.col("doc_id").alias("__dropped")).filter("__dropped IS NOT NULL").distinct()
    return docs.join(ids, docs["doc_id"] == ids["__dropped"], "left_anti")


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the trusted texts' model is ordinary for their language."""
    return quality.accepted_rows(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))


@stage
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    found = settled(exact_dedup.exact_dedup(docs), "exact")
    kept = found.filter("kept").select("doc_id")
    return without(docs, found.filter("NOT kept").select("doc_id").join(kept, "doc_id", "left_anti"))


@stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (shingles of five words, similarity 0.8)."""
    found = settled(near_dedup.near_dedup(docs), "near")
    kept = found.filter("kept").select("doc_id")
    return without(docs, found.filter("NOT kept").select("doc_id").join(kept, "doc_id", "left_anti"))


@stage
def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0").select("doc_id")
    return without(docs, settled(found, "leaks"))


@stage
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` (binary, little-endian unsigned 32-bit integers), and ``decoded_chars``, the
    code points of the decoded text."""
    out = bpe.bpe_encode(docs)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.length("decoded").cast("long").alias("decoded_chars"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("minhash near-dedup", near_stage),
    ("benchmark decontamination", leak_stage),
    ("bpe encoding", token_stage),
]

#: The language model, the components and the encoder are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = written(apply(spark, docs, sf_dir), name.replace(" ", "_"), keep=True)
    return docs
