"""Sorted runs: file statistics, leaves, sparse-index probes, levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.addressing import overlaps, whole
from ..schema import LEAF_RECORDS, LEVEL0_FILES, NODE_FANOUT
from ..sources.tables import RUN, dense_rank_of


def event_runs(log: DataFrame, run: int = RUN) -> DataFrame:
    """Runs of ``run`` writes each: newest write per key, version and file by time.

    The newest file is level 0, the others level 1.
    """
    rows = log.withColumn("file_id", whole(F.col("wseq"), run)).groupBy("file_id", "lba").agg(F.max_by(F.struct("wseq", "tomb", "payload"), "wseq").alias("r"))
    return rows.select("file_id", F.col("file_id").alias("version"), "lba", F.col("r.wseq").alias("wseq"), F.col("r.tomb").alias("tomb"), F.col("r.payload").alias("payload"))


def file_stats(runs: DataFrame, by: str = "file_id", key: str = "lba") -> DataFrame:
    return runs.groupBy(by).agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("nr_record"))


def with_levels(stats: DataFrame) -> DataFrame:
    """Level 0 for the newest file, else 1 (the catalogue is small: one row a file)."""
    top = stats.agg(F.max("file_id").alias("top"))
    return stats.crossJoin(F.broadcast(top)).withColumn("level", (F.col("file_id") != F.col("top")).cast("long")).drop("top")


def chunks(rows: DataFrame, key: str, size: int, name: str = "chunk") -> DataFrame:
    """Rows in key order cut into pieces of ``size``."""
    return dense_rank_of(rows, key, "_rank").withColumn(name, whole(F.col("_rank"), size)).drop("_rank")


def leaf_index(rows: DataFrame, key: str, size: int = LEAF_RECORDS) -> DataFrame:
    """(leaf, max_key, nr_record): the sparse index over sorted rows."""
    return chunks(rows.select(key), key, size, "leaf").groupBy("leaf").agg(F.max(key).alias("max_key"), F.count("*").alias("nr_record"))


def inner_nodes(index: DataFrame, leaves: int, fanout: int = NODE_FANOUT, levels: int | None = None) -> DataFrame:
    """(level, node, max_key, children) of the nodes above ``leaves`` leaves, level 1 first.

    A node's key is the greatest below it. Levels follow from leaf numbers, so
    all are made in one aggregation: up to the one root, which stands above a
    single leaf too, or no more than ``levels``.
    """
    depth, width = 1, -(-leaves // fanout)
    while width > 1 and depth != levels:
        depth, width = depth + 1, -(-width // fanout)
    step = F.explode(F.sequence(F.lit(1), F.lit(depth)))
    rows = index.withColumn("level", step).withColumn("node", F.floor(F.col("leaf") / F.pow(F.lit(fanout), "level")).cast("long"))
    below = F.floor(F.col("leaf") / F.pow(F.lit(fanout), F.col("level") - 1))
    return rows.groupBy("level", "node").agg(F.max("max_key").alias("max_key"), F.count_distinct(below).alias("children"))


def leaf_links(index: DataFrame) -> DataFrame:
    """Each leaf with its successor, by equality on leaf + 1."""
    after = index.select((F.col("leaf") - 1).alias("leaf"), F.col("leaf").alias("next_leaf"))
    return index.select("leaf").join(after, "leaf", "left")


def leaf_probe(probes: DataFrame, index: DataFrame, key: str = "k", width: int = 1024) -> DataFrame:
    """The leaf of each probe: the least max_key that is not below it.

    A leaf covers the keys after its predecessor's maximum up to its own. Both
    sides meet by key bins of ``width``; a leaf is in every bin it covers. Probes
    above all leaves have none and are left out.
    """
    before = index.select((F.col("leaf") + 1).alias("leaf"), F.col("max_key").alias("low"))
    cover = index.join(before, "leaf", "left")
    lowest = probes.agg(F.min(key).alias("m")).head().m
    low = F.coalesce("low", F.least(F.lit(lowest), F.col("max_key")) - 1)
    cover = cover.select("leaf", "max_key", low.alias("low")).withColumn("bin", F.explode(F.sequence(F.floor((F.col("low") + 1) / width), F.floor(F.col("max_key") / width))))
    at = probes.withColumn("bin", F.floor(F.col(key) / width))
    return at.join(cover, "bin").where((F.col(key) > F.col("low")) & (F.col(key) <= F.col("max_key"))).select(*probes.columns, "leaf", "max_key")


def locate_files(probes: DataFrame, stats: DataFrame, key: str = "k") -> DataFrame:
    """Files whose key range holds a probe; the catalogue is one row a file and is broadcast by Spark."""
    return probes.join(stats, F.col(key).between(F.col("first_key"), F.col("last_key"))).select(key, "file_id")


def prune(stats: DataFrame, first: int, last: int) -> DataFrame:
    """Files that may hold a key from first to last."""
    return stats.where((F.col("last_key") >= first) & (F.col("first_key") <= last))


def lower_bound(stats: DataFrame, key: int) -> DataFrame:
    """Among files that end at or after ``key``, the first in key order."""
    return stats.where(F.col("last_key") >= key).orderBy("first_key", "last_key", "file_id").limit(1)


def file_overlap(stats: DataFrame) -> DataFrame:
    """Unordered pairs of files with a common key; the catalogue is one row a file."""
    a = stats.select(F.col("file_id").alias("a"), F.col("first_key").alias("fa"), F.col("last_key").alias("la"))
    b = stats.select(F.col("file_id").alias("b"), F.col("first_key").alias("fb"), F.col("last_key").alias("lb"))
    return a.join(b, (F.col("a") < F.col("b")) & overlaps(F.col("fa"), F.col("la"), F.col("fb"), F.col("lb"))).select("a", "b")


def relative_files(demoted: DataFrame, below: DataFrame) -> DataFrame:
    """Files of the next level that meet the demoted files' bounds."""
    bounds = demoted.agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi"))
    return below.join(F.broadcast(bounds), overlaps(F.col("first_key"), F.col("last_key"), F.col("lo"), F.col("hi"))).drop("lo", "hi")


def demotion_pick(stats: DataFrame, level: int) -> DataFrame:
    """All files of level 0; of a lower level the first in key order."""
    own = stats.where(F.col("level") == level)
    return own if level == 0 else own.orderBy("first_key", "last_key", "file_id").limit(1)


def level_full(stats: DataFrame, capacity: int = LEVEL0_FILES) -> DataFrame:
    return stats.groupBy("level").agg(F.count("*").alias("files"), (F.count("*") >= capacity).alias("is_full"))


def trivial_move(demoted: DataFrame, below: DataFrame) -> DataFrame:
    """(n_demoted, n_relative, n_overlap, trivial): whether relabelling files is enough."""
    n = demoted.agg(F.count("*").alias("n_demoted"))
    relatives = relative_files(demoted, below).agg(F.count("*").alias("n_relative"))
    pairs = file_overlap(demoted).agg(F.count("*").alias("n_overlap"))
    return n.crossJoin(relatives).crossJoin(pairs).withColumn("trivial", (F.col("n_relative") == 0) & (F.col("n_overlap") == 0))
