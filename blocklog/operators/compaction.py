"""Compaction: runs merged to runs, and the space that gets free."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .log import latest
from .lookup import newest
from .runs import chunks


def merge_runs(runs: list[DataFrame], bottom: bool = True) -> DataFrame:
    """Newest row of each key over all runs (lba, version, tomb, ...).

    Tombstones are dropped only if the output is the bottom level; above it they
    still hide older rows.
    """
    merged = newest(reduce(DataFrame.unionByName, runs))
    return merged.where(~F.col("tomb")) if bottom else merged


def cut_files(rows: DataFrame, records: int) -> DataFrame:
    """Sorted rows with the file they are written to."""
    return chunks(rows, "lba", records, "file_id")


def superseded(rows: DataFrame) -> DataFrame:
    """Rows that a later write of their key replaced."""
    top = rows.groupBy("lba").agg(F.max("wseq").alias("top"))
    return rows.join(top, "lba").where(F.col("wseq") < F.col("top")).drop("top")


def superseded_per_segment(rows: DataFrame) -> DataFrame:
    return superseded(rows).groupBy("seg").agg(F.count("*").alias("n_superseded"))


def reclaim(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Addresses to give back: superseded rows whose address still names their key.

    Keys whose newest row is a tombstone are left out: their blocks were freed
    when they moved. ``owners`` is the reverse index (hba, lba).
    """
    keep = latest(rows).where(~F.col("tomb")).select("lba")
    old = superseded(rows).join(keep, "lba", "left_semi")
    return old.join(owners, ["hba", "lba"], "left_semi").select("hba", "lba", "seg")
