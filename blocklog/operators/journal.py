"""The journal: typed records, blocks in a hash chain, checkpoints, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.addressing import whole
from .log import latest

#: Records of a journal block, of a commit, and of a checkpoint.
BLOCK_RECORDS, COMMIT_EVERY, CHECKPOINT_EVERY = 32, 100, 1000


def records(log: DataFrame) -> DataFrame:
    """One DATA_LOG record for each write; commits and checkpoints after fixed numbers of writes.

    (rec, kind, wseq, lba, hba, tomb), ordered by rec. A record's number follows
    from its write's, so no global numbering is needed.
    """
    extra = whole(F.col("wseq"), COMMIT_EVERY) + whole(F.col("wseq"), CHECKPOINT_EVERY)
    data = log.select((F.col("wseq") + extra).alias("rec"), F.lit("DATA_LOG").alias("kind"), "wseq", "lba", F.col("wseq").alias("hba"), "tomb")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("lba", "long"), ("hba", "long"), ("tomb", "boolean"))]
    after = log.where(F.col("wseq") % COMMIT_EVERY == COMMIT_EVERY - 1)
    commits = after.select((F.col("wseq") + extra + 1).alias("rec"), F.lit("DATA_COMMIT").alias("kind"), "wseq", *empty)
    packs = log.where(F.col("wseq") % CHECKPOINT_EVERY == CHECKPOINT_EVERY - 1)
    packs = packs.select((F.col("wseq") + extra + 2).alias("rec"), F.lit("CHECKPOINT_PACK").alias("kind"), "wseq", *empty)
    return data.unionByName(commits).unionByName(packs)


def blocks(journal: DataFrame) -> DataFrame:
    """Journal blocks with a digest each: (blk, n, mac)."""
    line = F.concat_ws("|", "rec", "kind", "wseq", F.coalesce(F.col("lba").cast("string"), F.lit("-")), F.coalesce(F.col("tomb").cast("string"), F.lit("-")))
    rows = journal.select(whole(F.col("rec"), BLOCK_RECORDS).alias("blk"), F.struct("rec", line.alias("line")).alias("r"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n")
    return rows.groupBy("blk").agg(F.count("*").alias("n"), F.sha2(joined, 256).alias("mac"))


def chained(blocks_: DataFrame) -> DataFrame:
    """Each block with its predecessor's mac, by equality on blk - 1."""
    before = blocks_.select((F.col("blk") + 1).alias("blk"), F.col("mac").alias("prev_mac"))
    return blocks_.join(before, "blk", "left")


def broken_links(stored: DataFrame) -> DataFrame:
    """Blocks whose stored prev_mac is not the mac that the block before has."""
    now = chained(stored.select("blk", "mac")).select("blk", F.col("prev_mac").alias("true_mac"))
    return stored.join(now, "blk").where(~F.col("prev_mac").eqNullSafe(F.col("true_mac"))).select("blk")


def load(journal: DataFrame, first: int, last: int) -> DataFrame:
    """Records of the blocks from first to last, both included; the filter is on rec."""
    return journal.where(F.col("rec").between(first * BLOCK_RECORDS, (last + 1) * BLOCK_RECORDS - 1)).withColumn("blk", whole(F.col("rec"), BLOCK_RECORDS))


def toggle(valid: DataFrame) -> DataFrame:
    """A checkpoint's field selectors, all flipped: every table's other copy is now the valid one."""
    return valid.withColumn("valid", ~F.col("valid"))


def checkpoint_choice(journal: DataFrame) -> DataFrame:
    """The newest checkpoint that a commit stands before: (rec, wseq)."""
    packs = journal.where("kind = 'CHECKPOINT_PACK'")
    last = journal.where("kind = 'DATA_COMMIT'").agg(F.max("wseq").alias("committed"))
    return packs.crossJoin(F.broadcast(last)).where(F.col("wseq") <= F.col("committed")).orderBy(F.desc("rec")).limit(1).select("rec", "wseq")


def replay(checkpoint: DataFrame, journal: DataFrame, chosen: DataFrame) -> DataFrame:
    """The mapping after the checkpoint's, with DATA_LOG records behind it folded in.

    ``checkpoint`` (lba, hba, tomb, wseq) is the mapping as of the chosen pack.
    """
    tail = journal.where("kind = 'DATA_LOG'").crossJoin(F.broadcast(chosen.select(F.col("wseq").alias("upto")))).where(F.col("wseq") > F.col("upto"))
    return latest(checkpoint.select("lba", "hba", "tomb", "wseq").unionByName(tail.select("lba", "hba", "tomb", "wseq")))


def as_of(log: DataFrame, chosen: DataFrame) -> DataFrame:
    """The mapping that a checkpoint holds."""
    old = log.crossJoin(F.broadcast(chosen.select(F.col("wseq").alias("upto")))).where(F.col("wseq") <= F.col("upto"))
    return latest(old.select("lba", F.col("wseq").alias("hba"), "tomb", "wseq"))


def recoverable(journal: DataFrame) -> DataFrame:
    """Whether records stand behind the newest checkpoint."""
    packs = F.max(F.when(F.col("kind") == "CHECKPOINT_PACK", F.col("rec")))
    return journal.agg((F.max("rec") > F.coalesce(packs, F.lit(-1))).alias("should_recover"))

