"""Segments: reverse index, validity, bitmaps, allocation, garbage collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addressing import block_to_segment, offset_in_segment


def reverse_index(placed: DataFrame) -> DataFrame:
    """(hba, lba) of the key last placed at each address."""
    return placed.groupBy("hba").agg(F.max_by("lba", "wseq").alias("lba"))


def reset(owners: DataFrame, expected: DataFrame) -> DataFrame:
    """Clear addresses whose owner is the expected one; a null expectation clears any."""
    e = expected.select("hba", F.col("lba").alias("want"), F.lit(True).alias("asked"))
    hit = F.col("asked") & (F.col("want").isNull() | (F.col("want") == F.col("lba")))
    return owners.join(e, "hba", "left").select("hba", F.when(F.coalesce(hit, F.lit(False)), F.lit(None)).otherwise(F.col("lba")).alias("lba"))


def blank(n: int, value: object, spark) -> DataFrame:
    """A formatted array of ``n`` entries: (idx, value)."""
    return spark.range(n).select(F.col("id").alias("idx"), F.lit(value).alias("value"))


def set_entries(array: DataFrame, changes: DataFrame) -> DataFrame:
    """The array with entries replaced; changes out of bounds are no entries and vanish."""
    new = changes.select("idx", F.col("value").alias("new"), F.lit(True).alias("hit"))
    return array.join(new, "idx", "left").select("idx", F.when(F.col("hit"), F.col("new")).otherwise(F.col("value")).alias("value"))


def live_per_segment(live: DataFrame, segments: DataFrame) -> DataFrame:
    """(seg, nr_valid) of every segment, none left out."""
    counts = live.groupBy("seg").agg(F.count("*").alias("nr_valid"))
    return segments.join(counts, "seg", "left").withColumn("nr_valid", F.coalesce("nr_valid", F.lit(0).cast("long")))


def live_offsets(live: DataFrame, per_segment: int) -> DataFrame:
    """(seg, nr_valid, offsets): comma-joined slots in use, ascending."""
    at = live.select(block_to_segment(F.col("hba"), per_segment).alias("seg"), offset_in_segment(F.col("hba"), per_segment).alias("off"))
    return at.groupBy("seg").agg(F.count("*").alias("nr_valid"), F.array_join(F.array_sort(F.collect_set("off")).cast("array<string>"), ",").alias("offsets"))


def live_bitmap(live: DataFrame, per_segment: int) -> DataFrame:
    """(seg, bitmap): the same slots as bits; Spark's bit positions start at 1."""
    at = live.select(block_to_segment(F.col("hba"), per_segment).alias("seg"), offset_in_segment(F.col("hba"), per_segment).alias("off"))
    return at.groupBy("seg").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("off") + 1)).alias("bitmap"))


def bit_set(bitmap, bit):
    """Whether a bit of live_bitmap() is set."""
    byte = F.conv(F.hex(F.substring(bitmap, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (bit % 8).cast("int")) == 1


def victims(counts: DataFrame, per_segment: int, k: int | None = None) -> DataFrame:
    """Segments with some but not all blocks live, emptiest first, ties by number."""
    found = counts.where((F.col("nr_valid") > 0) & (F.col("nr_valid") < per_segment))
    return found.orderBy("nr_valid", "seg").limit(k) if k else found


def quota(candidates: DataFrame, target: int) -> DataFrame:
    """Victims in order while fewer than ``target`` blocks are moved before them.

    Victims of one size are summed first, so the order's running sum is over
    sizes, of which a segment allows few; only the last size is summed by row.
    """
    sizes = candidates.groupBy("nr_valid").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum(F.col("nr_valid") * F.col("m")).over(Window.orderBy("nr_valid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("nr_valid", before.alias("before")).where(F.col("before") < target)
    rows = candidates.join(F.broadcast(sizes), "nr_valid")
    rank = F.row_number().over(Window.partitionBy("nr_valid").orderBy("seg"))
    moved = F.col("before") + (rank - 1) * F.col("nr_valid")
    return rows.withColumn("moved_before", moved.cast("long")).where(F.col("moved_before") < target).select("seg", "nr_valid", "moved_before")


def relocate(blocks: DataFrame, chosen: DataFrame, owners: DataFrame, live: DataFrame, buffered: DataFrame) -> DataFrame:
    """Live blocks of the chosen segments, to be written again: (lba, hba, seg).

    The reverse index names a block's key, the mapping says whether the block is
    still its newest; keys a user write already holds in the buffer are left to
    that write.
    """
    mine = blocks.join(chosen.select("seg"), "seg", "left_semi").select("hba", "seg")
    named = mine.join(owners.where(F.col("lba").isNotNull()), "hba")
    now = named.join(live.where(~F.col("tomb")).select("lba", F.col("hba").alias("at")), "lba").where(F.col("at") == F.col("hba"))
    return now.join(buffered.select("lba"), "lba", "left_anti").select("lba", "hba", "seg")


def collect_pass(placed: DataFrame, chosen: DataFrame, moved: DataFrame, first_free: int, per_segment: int) -> DataFrame:
    """The placed log after a pass: chosen segments emptied, moved blocks in new slots.

    Moved blocks (lba, hba, seg) fill segments from ``first_free`` on in key
    order; they keep their wseq, so newer writes still win.
    """
    from ..sources.tables import dense_rank_of

    kept = placed.join(chosen.select("seg"), "seg", "left_anti").select("hba", "lba", "wseq", "seg", "tomb")
    rows = dense_rank_of(moved.select("lba", "hba"), "lba").join(placed.select("hba", "wseq", "tomb"), "hba")
    slot = F.col("rank") + first_free * per_segment
    return kept.unionByName(rows.select(slot.alias("hba"), "lba", "wseq", block_to_segment(slot, per_segment).alias("seg"), "tomb"))


def next_free(segments: DataFrame, cursor: int) -> DataFrame:
    """First free segment (seg, valid) at or after the cursor, else from the start."""
    return segments.where(~F.col("valid")).orderBy(F.col("seg") < cursor, "seg").limit(1).select("seg")


def logging_segment(counts: DataFrame, per_segment: int) -> DataFrame:
    """The fullest segment that still has a hole."""
    return counts.where(F.col("nr_valid") < per_segment).orderBy(F.desc("nr_valid"), "seg").limit(1)


def allocate(segments: DataFrame, cursor: int) -> DataFrame:
    """The validity table after next_free() was taken."""
    taken = next_free(segments, cursor).withColumn("hit", F.lit(True))
    return segments.join(F.broadcast(taken), "seg", "left").select("seg", (F.col("valid") | F.coalesce("hit", F.lit(False))).alias("valid"))


def valid_count(segments: DataFrame) -> DataFrame:
    return segments.agg(F.count_if("valid").alias("valid"), F.count("*").alias("total"))


def gc_needed(valid: int, total: int, reserve: int) -> bool:
    """Whether valid segments have eaten into the reserve; small devices have no reserve below zero."""
    return valid >= max(0, total - reserve)
