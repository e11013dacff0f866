"""From raw documents to packed sequences: quality rules, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next one reads; all but the last keep the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import line_dedup, mixing, near_dup, packing, quality
from verdigris.llm.common import WORD, drop_written, free_name, table, written
from verdigris.llm.queries import WEIGHTS, domain_of, tokenizer_path

#: Words in a shingle and percent of shingles that near-duplicates share; percent of words that near lines share.
SHINGLE, SIMILAR, LINES = 5, 80, 80
#: Share of all tokens that the mixture takes, and its seed.
SHARE, SEED = 0.8, 20


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    kept = free_name(docs, "kept")
    return quality.quality_filter(docs).where(F.col(kept)).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line is near to; one that had words and keeps none goes."""
    out, removed = line_dedup.dedup_lines(docs, LINES), free_name(docs, "n_removed")
    out = out.where((F.col(removed) == 0) | F.col("text").rlike(WORD))
    return out.withColumn("n_chars", F.when(F.col(removed) == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dup.keep_representatives(docs, SHINGLE, SIMILAR)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, each at most once."""
    return mixing.mix(docs, domain_of(), WEIGHTS, share=SHARE, max_epochs=1, seed=SEED).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_dup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has no tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table goes when the next one is written, but for the one that the result reads.

    Rows that share a doc_id are documents of their own up to the near-duplicate stage, which keeps one for each id.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
            drop_written(before)
    return docs
