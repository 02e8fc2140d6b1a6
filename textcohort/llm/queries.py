"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagmin, chat, langid, lattice, licenses, mixing, quality, suffixes
from .packing import pack
from .tokens import count_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagmin.near_copies(table(spark, sf_dir, "documents"))


def op2_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.detect(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.sql("SELECT -1L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    return chat.digest(chat.format_chats(told.unionByName(added)))


#: Target proportions of the sources in each window: the largest one is held to 4 in 23.
PROPORTIONS = {"src0": 4.0} | {f"src{i}": 1.0 for i in range(1, 20)}


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), weights=PROPORTIONS)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def domain() -> Column:
    """The mixture's top level: two groups of sources, and all others."""
    number = F.try_to_number(F.regexp_extract("source", "^src([0-9]{1,6})$", 1), F.lit("999999"))
    return F.when(number < 10, "web").when(number >= 10, "books").otherwise("other")


MIXTURE = mixing.Mixture(
    weights={("web",): 0.6, ("books",): 0.35, ("other",): 0.05, ("web", "en"): 5, ("web", "de"): 2, ("web", "fr"): 2, ("web", "es"): 2, ("books", "en"): 3, ("web", "en", "src0"): 4},
    budget=0.7,
    max_epochs=2,
)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), MIXTURE, domain())
    return out.select("doc_id", "lang", "source", F.col("__epoch").alias("epoch"), F.col("__tokens").alias("n_tokens"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_lattice_dedup": op2_lattice_dedup,
    "op3_language_id": op3_language_id,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_license_scan": op9_license_scan,
    "op10_token_counts": op10_token_counts,
}
ORACLES = {"op2_lattice_dedup": lattice.oracle(), "op4_chat_formatting": chat.oracle(), "op6_quality_rules": quality.oracle(), "op9_license_scan": licenses.oracle()}
