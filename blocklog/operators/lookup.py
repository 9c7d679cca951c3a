"""Lookups: newest wins, tiers, requests, and how reads coalesce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .log import latest


def newest(rows: DataFrame) -> DataFrame:
    """Greatest version per key; at one version a value wins over a tombstone."""
    rest = [c for c in rows.columns if c != "lba"]
    order = F.struct(F.col("version"), (~F.col("tomb")).alias("positive"))
    return rows.groupBy("lba").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("lba", *[F.col(f"_r.{c}").alias(c) for c in rest])


def tier_of(wseq: Column, total: Column) -> Column:
    """0 buffer, 1 mutable, 2 immutable, 3 stored: by how late a write is."""
    return F.when(wseq * 1000 >= total * 995, 0).when(wseq * 100 >= total * 98, 1).when(wseq * 10 >= total * 9, 2).otherwise(3)


def tiered(rows: DataFrame, tier: str = "tier") -> DataFrame:
    """First tier that knows a key answers, tombstones included; those are dropped after."""
    rest = [c for c in rows.columns if c != "lba"]
    order = F.struct(-F.col(tier), F.col("wseq"))
    found = rows.groupBy("lba").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("lba", *[F.col(f"_r.{c}").alias(c) for c in rest])
    return found.where(~F.col("tomb"))


def point(log: DataFrame, key: int) -> DataFrame:
    return latest(log.where(F.col("lba") == key))


def key_range(log: DataFrame, first: int, last: int) -> DataFrame:
    """Keys first to last, both included; the filter reaches the scan."""
    return latest(log.where(F.col("lba").between(first, last)))


def read_requests(requests: DataFrame, live: DataFrame) -> DataFrame:
    """Every request with its record; misses and tombstones have a null address."""
    found = live.where(~F.col("tomb")).select("lba", "hba", "payload")
    return requests.join(found, "lba", "left")


def small_read(blocks: DataFrame, offset: int, length: int) -> DataFrame:
    """A slice of each block's payload, from byte or character ``offset``."""
    return blocks.withColumn("slice", F.substring("payload", offset + 1, length))


def membership(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Requested keys the log has ever seen, tombstones included."""
    return requests.join(log.select("lba").distinct(), "lba", "left_semi")


def only_in_older(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Keys that no newer tier covers."""
    return older.join(newer.select("lba"), "lba", "left_anti")


def read_runs(live: DataFrame, parts: int = 64) -> DataFrame:
    """Islands of consecutive keys in request order whose addresses grow by one.

    Returns (first_lba, first_hba, n). Rows are cut into key ranges; islands are
    found inside a range, and those that touch across ranges are joined after.
    """
    span = live.agg(F.min("lba").alias("low"), F.max("lba").alias("high")).head()
    low, width = (span.low, (span.high - span.low) // parts + 1) if span.low is not None else (0, 1)
    rows = live.select("lba", "hba", F.floor((F.col("lba") - low) / width).alias("part"))
    by = Window.partitionBy("part").orderBy("lba")
    breaks = rows.withColumn("new", F.coalesce((F.col("hba") != F.lag("hba").over(by) + 1).cast("int"), F.lit(1)))
    runs = breaks.withColumn("run", F.sum("new").over(by)).groupBy("part", "run").agg(F.min("lba").alias("first_lba"), F.max("lba").alias("last_lba"), F.min("hba").alias("first_hba"), F.max("hba").alias("last_hba"), F.count("*").alias("n"))
    edge = Window.orderBy("part", "run")  # at most a few runs of each range stand at its edges
    ends = runs.groupBy("part").agg(F.min("run").alias("a"), F.max("run").alias("b"))
    edges = runs.join(F.broadcast(ends), "part").where((F.col("run") == F.col("a")) | (F.col("run") == F.col("b")))
    glued = edges.withColumn("new", F.coalesce(((F.col("first_hba") != F.lag("last_hba").over(edge) + 1) | (F.col("part") == F.lag("part").over(edge))).cast("int"), F.lit(1)))
    glued = glued.withColumn("g", F.sum("new").over(edge)).groupBy("g").agg(F.min("first_lba").alias("first_lba"), F.min("first_hba").alias("first_hba"), F.sum("n").alias("n")).drop("g")
    inner = runs.join(F.broadcast(ends), "part").where((F.col("run") != F.col("a")) & (F.col("run") != F.col("b"))).select("first_lba", "first_hba", "n")
    return inner.unionByName(glued)
