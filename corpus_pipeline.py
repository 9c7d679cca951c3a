"""The corpus pipeline: five stages over ``documents``.

Quality, near-duplicates, decontamination, mixing, token output. Each stage
works on all rows the one before it kept, and is written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklog.llm.common import BROADCAST_BYTES, new_path, read_table, staged, table_bytes
from blocklog.llm.decontaminate import find_contamination
from blocklog.llm.mixing import mix, with_domain
from blocklog.llm.near_dedup import one_of_each
from blocklog.llm.quality_knn import learnt, score_quality
from blocklog.llm.token_store import encode_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return score_quality(docs, learnt(spark, docs, sf_dir)).where("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least doc_id."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    items = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = staged(find_contamination(docs.select("doc_id", "text"), items).where("contaminated").select(F.col("doc_id").alias("d"), F.col("copy").alias("c")).distinct(), "contaminated")
    side = F.broadcast(found) if table_bytes(found) <= BROADCAST_BYTES // 8 else found
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_copy"))
    return rows.join(side, F.col("own_id").eqNullSafe(F.col("d")) & (F.col("own_copy") == F.col("c")), "left_anti").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of all tokens, shared evenly among domains, their languages and sources.

    A document that its leaf takes in two epochs stands twice.
    """
    return mix(with_domain(docs.select(F.struct("*").alias("whole"), "doc_id", "text", "lang", "source"))).select("whole.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token segments, and what is read back of each."""
    return encode_documents(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mixing),
    ("token output", tokens),
]

#: Cosine votes, SimHash components and a tokenizer's ids are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; each result is written as Parquet and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
