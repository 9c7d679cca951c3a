"""Queries that run a stream over the events table to its end."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Store
from ..sources.tables import event_log
from ..streaming.ingest import ingest, put_returning_old


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="blocklog-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def arrivals(spark: SparkSession, sf_dir: str, root: str, batches: int = 4) -> Iterator[DataFrame]:
    """The events in write order, in ``batches`` parts: a stream over a folder, once after each part has arrived.

    A query started on each with one checkpoint takes the part as one batch,
    however many files and tasks wrote it.
    """
    rows = event_log(spark, sf_dir)
    cut = (rows.agg(F.max("wseq").alias("m")).head().m or 0) // batches + 1
    for k in range(batches):
        part = rows.where(F.col("wseq").between(k * cut, (k + 1) * cut - 1)).withColumn("payload", F.col("payload").cast("string"))
        part.write.mode("append").parquet(f"{root}/in")
        yield spark.readStream.schema("wseq long, lba long, tomb boolean, payload string").parquet(f"{root}/in")


def ingest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rows of a store after the stream has been ingested."""
    root = folder(spark, "ingest")
    store = Store(spark, f"{root}/store")
    for stream in arrivals(spark, sf_dir, root):
        ingest(stream, store, f"{root}/checkpoint", compact_at=2).awaitTermination()
    return store.scan().select("lba", F.col("payload").cast("double").alias("payload"))


def put_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every write with the address it supersedes, from keyed state."""
    root = folder(spark, "put")
    for stream in arrivals(spark, sf_dir, root):
        put_returning_old(stream.select("lba", "wseq", F.col("wseq").alias("hba")), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema("lba long, wseq long, hba long, old_hba long").parquet(f"{root}/out/*").select("wseq", "lba", "hba", "old_hba")
