"""A corpus pipeline of five operators: filter, drop near copies, cut repeated passages, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a caller writes it as Parquet and
gives it to the next one as docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcohort.llm import bagmin, mixing, packing, quality, suffixes
from textcohort.llm._spark import Scratch
from textcohort.llm.queries import PROPORTIONS, domain

#: Nine tenths of the remaining tokens, once each; web and book sources near their own shares.
MIXTURE = mixing.Mixture(weights={("web",): 0.6, ("books",): 0.4, ("web", "en"): 6, ("books", "en"): 6, ("web", "en", "src0"): 10, ("web", "de", "src0"): 10, ("web", "fr", "src0"): 10, ("web", "es", "src0"): 10}, budget=0.9, max_epochs=1, seed=7)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned fences."""
    return quality.filter_quality(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class of near copies."""
    return bagmin.drop_near_copies(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document of smaller id has; n_chars follows the text."""
    return suffixes.drop_repeated_passages(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's share of the token budget."""
    return mixing.mix(docs, MIXTURE, domain(), extra=False)


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in windows of 1024 tokens, in the target proportions of their sources."""
    return packing.pack(docs, weights=PROPORTIONS)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mixing", source_mixing),
    ("token_packing", token_packing),
]

#: Bags of shingles, suffix arrays and tokenisation have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents, with each stage written and read again; a stage's input is deleted when it is done."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
