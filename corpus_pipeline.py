"""The corpus pipeline: quality rules, language, near copies, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor
kept; all but the last return the columns of ``documents``. Packing has no SQL form,
so the pipeline is tested stage by stage against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm import language, packing, quality, simhash
from orderflow.llm.common import may_be_in

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule."""
    return quality.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; the dictionaries are learned from their own labels."""
    learned = language.fit(docs)
    return language.predict(docs.select(*COLUMNS), learned).where(~F.col("lang_rejected")).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 0.8 of their five-word shingles: that with the least doc_id, then the least hash of its text.

    Documents without a doc_id come after all others; of equal rows one stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h"))
    keyed = docs.select(*COLUMNS, order.alias("key"))
    found = simhash.similar_copies(keyed, "key")
    # Most documents are alone: only the others, with their texts, go through a join.
    marked = may_be_in(keyed, F.col("key"), found.where("not alone"), F.col("key"), "likely")
    least = found.where("key = component_id").select("key").distinct()
    others = marked.where("likely").join(least, "key", "left_semi").dropDuplicates(["key"])
    return marked.where("not likely").unionByName(others).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its sequence and place."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
