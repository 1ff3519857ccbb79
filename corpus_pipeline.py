"""The corpus pipeline: quality rules, line dedup, near duplicates, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared folder and
reads it back as the next stage's docs. All stages but the last return the columns of documents, with n_chars following text.

Defined cases: those of the operators; a stage given an empty table returns an empty one; rows with a null doc_id are never
taken for copies of each other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import line_dedup, ngram_join, packing, quality_rules, secret_scan
from rankweave.llm.common import SPACES, shared_dir, stored, table

#: Learned rules, hashes and tokens: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    n = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.withColumn("n_chars", n)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go."""
    return quality_rules.keep_good(docs, quality_rules.fit_rules(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold stay in the first of them only; a document left without a word goes."""
    out = line_dedup.dedup_lines(docs, min_docs=10, min_chars=1, keep_first=True)
    bare = F.btrim("text", F.lit(SPACES)) == ""
    out = out.where(~(bare & (F.col(out.columns[-1])["n_dropped"] > 0)))
    return _counted(out.select(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the least doc_id stays."""
    found = ngram_join.jaccard_components(docs)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    first = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(gone.join(first, "doc_id", "left_anti"), "doc_id", "left_anti")
    return named.dropDuplicates(["doc_id", "text"]).select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported secret is masked in the text."""
    return secret_scan.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("secret_scan", secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = shared_dir(spark, "pipeline")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"{root}/{name}")
    return docs
