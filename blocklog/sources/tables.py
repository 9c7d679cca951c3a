"""Input tables, and the write logs derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.addressing import whole

#: Writes per batch of the placed log, blocks per segment of the raw log, writes per run.
BATCH, RAW_SEGMENT, RUN = 256, 64, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def writes(events: DataFrame) -> DataFrame:
    """A write log: (wseq, lba, tomb, payload). Errors are tombstones."""
    return events.select(F.col("event_id").alias("wseq"), F.col("user_id").alias("lba"), (F.col("event_type") == "error").alias("tomb"), F.col("value").alias("payload"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes(table(spark, sf_dir, "events"))


def raw_log(log: DataFrame) -> DataFrame:
    """Every write at its own address: hba is wseq."""
    return log.withColumns({"hba": F.col("wseq"), "seg": whole(F.col("wseq"), RAW_SEGMENT)})


def read_format(spark: SparkSession, path: str, kind: str, schema: str, **options) -> DataFrame:
    """Extension: a file source (parquet, orc, csv, json, text) with an explicit schema."""
    return spark.read.format(kind).options(**options).schema(schema).load(path)


def write_format(df: DataFrame, path: str, kind: str, partition_by: tuple[str, ...] = (), **options) -> None:
    """Extension: a file sink."""
    df.write.format(kind).options(**options).partitionBy(*partition_by).mode("overwrite").save(path)


def dense_rank_of(df: DataFrame, key: str, name: str = "rank", buckets: int = 4096) -> DataFrame:
    """Number rows by ``key`` from 0, without bringing them into one partition.

    Keys are cut into ``buckets`` ranges of equal width. Counts of whole buckets
    give each one its first number; rows are numbered inside their bucket. Equal
    keys are numbered in any order. Null keys come first.
    """
    span = df.agg(F.min(key).alias("low"), F.max(key).alias("high")).head()
    low, width = (span.low, (span.high - span.low) // buckets + 1) if span.low is not None else (0, 1)
    bucket: Column = F.coalesce(whole(F.col(key) - F.lit(low), width), F.lit(-1).cast("long"))
    rows = df.withColumn("_bucket", bucket)
    before = F.coalesce(F.sum("count").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = rows.groupBy("_bucket").count().select("_bucket", before.alias("_first"))  # at most ``buckets`` + 1 rows
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.col(key).asc_nulls_first()))
    return rows.withColumn("_in", inside).join(F.broadcast(firsts), "_bucket").withColumn(name, F.col("_first") + F.col("_in").cast("long") - 1).drop("_bucket", "_first", "_in")
