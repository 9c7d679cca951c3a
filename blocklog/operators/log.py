"""The append log: batches, last writer wins, slots in key order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addressing import whole


def latest(rows: DataFrame, key: str = "lba", order: str = "wseq") -> DataFrame:
    """The row of each key with the greatest ``order``.

    An aggregation with map-side combining, so hot keys cost no more than one
    row a task.
    """
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def place(log: DataFrame, batch: int) -> DataFrame:
    """Seal every ``batch`` writes: newest write per key, slots in key order.

    Returns (hba, lba, wseq, seg, tomb, payload); a batch is a segment of
    ``batch`` slots, filled from its start.
    """
    sealed = log.withColumn("seg", whole(F.col("wseq"), batch)).groupBy("seg", "lba")
    newest = sealed.agg(F.max_by(F.struct("wseq", "tomb", "payload"), "wseq").alias("r"))
    slot = F.row_number().over(Window.partitionBy("seg").orderBy("lba"))
    return newest.select((F.col("seg") * batch + slot - 1).alias("hba"), "lba", F.col("r.wseq").alias("wseq"), "seg", F.col("r.tomb").alias("tomb"), F.col("r.payload").alias("payload"))


def put_with_old(log: DataFrame, address: str = "hba") -> DataFrame:
    """Each write with the address it supersedes (null for a key's first)."""
    by = Window.partitionBy("lba").orderBy("wseq")
    return log.withColumn(f"old_{address}", F.lag(address).over(by))


def split_blocks(requests: DataFrame) -> DataFrame:
    """Multi-block writes (wseq, lba, n) as one row per block, in order."""
    spread = requests.select("*", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("_k", "off"))
    return spread.withColumn("lba", F.col("lba") + F.col("off")).drop("_k", "n")


def hole_fill(pending: DataFrame, live: DataFrame, per_segment: int, segments: DataFrame) -> DataFrame:
    """Pending rows (lba) dealt to free slots: fullest segment first, then the lowest slot.

    ``live`` has (seg, off) of occupied slots; ``segments`` (seg) those that may
    be filled. Segments take as many rows as they have holes, so ranks meet by
    segment ranges, and only slots that are filled are made. Pending rows beyond
    the last hole are returned with null seg, off and hba.
    """
    used = live.groupBy("seg").agg(F.count("*").alias("live"), F.collect_set("off").alias("offs"))
    open_ = segments.join(used, "seg", "left").select("seg", F.coalesce("live", F.lit(0)).alias("live"), F.coalesce("offs", F.array().cast("array<bigint>")).alias("offs")).where(F.col("live") < per_segment)
    order = Window.orderBy(F.desc("live"), "seg").rowsBetween(Window.unboundedPreceding, -1)  # one row for each open segment
    open_ = open_.withColumn("first", F.coalesce(F.sum(F.lit(per_segment) - F.col("live")).over(order), F.lit(0)))
    need = pending.count()
    open_ = open_.where(F.col("first") < need)
    slots = open_.select("seg", "first", F.posexplode(F.array_sort(F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(per_segment - 1).cast("long")), "offs"))).alias("k", "off"))
    slots = slots.select((F.col("first") + F.col("k")).alias("rank"), "seg", "off")
    from ..sources.tables import dense_rank_of

    return dense_rank_of(pending, "lba").join(slots, "rank", "left").select("lba", "seg", "off", (F.col("seg") * per_segment + F.col("off")).alias("hba"))
