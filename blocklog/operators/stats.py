"""Operational counters and the leaf cache's behaviour."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addressing import whole
from ..schema import BLOCK_BYTES, LEAF_CACHE


def io_stats(events: DataFrame) -> DataFrame:
    """One row of counters: views are reads, errors are discards, all else is written."""
    kind = F.col("event_type")
    read, gone = kind == "view", kind == "error"
    return events.agg(
        F.count("*").alias("requests"),
        F.count_if(read).alias("reads"),
        F.count_if(~read & ~gone).alias("writes"),
        F.count_if(gone).alias("discards"),
        (F.count_if(read) * BLOCK_BYTES).alias("read_bytes"),
        (F.count_if(~read & ~gone) * BLOCK_BYTES).alias("write_bytes"),
        F.count_distinct("user_id").alias("keys"),
    )


def write_amplification(log: DataFrame, placed: DataFrame) -> DataFrame:
    """Placed rows per written row (below 1 where batches absorb overwrites)."""
    return log.agg(F.count("*").alias("written")).crossJoin(placed.agg(F.count("*").alias("placed"))).withColumn("ratio", F.round(F.col("placed") / F.col("written"), 6))


def lru_hits(accesses: DataFrame, capacity: int = LEAF_CACHE) -> DataFrame:
    """(stream, n_hits, n_misses) of a least-recently-used cache for each stream of (stream, seq, leaf).

    Order decides everything, so a stream is replayed serially; streams run in
    parallel. Rows come sorted, and a worker holds one cache, never a stream.
    """
    import pyarrow as pa

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import OrderedDict

        held: OrderedDict = OrderedDict()
        now, hits, misses = None, 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([hits], pa.int64()), pa.array([misses], pa.int64())], names=["stream", "n_hits", "n_misses"])

        for batch in batches:
            for stream, leaf in zip(batch.column("stream").to_pylist(), batch.column("leaf").to_pylist(), strict=True):
                if stream != now:
                    if now is not None:
                        yield row()
                    now, hits, misses = stream, 0, 0
                    held.clear()
                if leaf in held:
                    held.move_to_end(leaf)
                    hits += 1
                else:
                    misses += 1
                    held[leaf] = True
                    if len(held) > capacity:
                        held.popitem(last=False)
        if now is not None:
            yield row()

    rows = accesses.select("stream", "seq", "leaf").repartition("stream").sortWithinPartitions("stream", "seq")
    return rows.mapInArrow(replay, "stream long, n_hits long, n_misses long")


def lru_hits_whole(accesses: DataFrame, capacity: int = LEAF_CACHE, part: int = 65536) -> DataFrame:
    """(n_hits, n_misses) of one cache over all accesses (seq, leaf), never emptied.

    A cache holds the ``capacity`` leaves used last, so what it holds where a
    part of ``part`` sequence numbers starts follows from the last leaves of the
    parts before. Parts are replayed in parallel, each after the leaves that it
    finds; these are all different and never hit. One task reads at most
    ``capacity`` rows of each part to pass them on.
    """
    import pyarrow as pa

    def passed_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}  # leaf: seq, the one used last at the end
        now = None
        for batch in batches:
            for stream, seq, leaf in zip(*(batch.column(c).to_pylist() for c in ("stream", "seq", "leaf")), strict=True):
                if stream != now:
                    held = dict([*held.items()][-capacity:])
                    now = stream
                    yield pa.RecordBatch.from_arrays([pa.array([now] * len(held), pa.int64()), pa.array(held.values(), pa.int64()), pa.array(held.keys(), pa.int64())], names=["stream", "seq", "leaf"])
                held.pop(leaf, None)
                held[leaf] = seq

    seq = F.col("seq").cast("long")
    rows = accesses.select(whole(seq, part).cast("long").alias("stream"), seq.alias("seq"), F.col("leaf").cast("long").alias("leaf"))
    last = rows.groupBy("stream", "leaf").agg(F.max("seq").alias("seq"))
    by = Window.partitionBy("stream").orderBy(F.desc("seq"))
    last = last.withColumn("k", F.row_number().over(by)).where(F.col("k") <= capacity).select("stream", "seq", "leaf")
    found = last.repartition(1).sortWithinPartitions("stream", "seq").mapInArrow(passed_on, "stream long, seq long, leaf long")
    hits = lru_hits(rows.union(found), capacity).agg(F.coalesce(F.sum("n_hits"), F.lit(0)).alias("n_hits"))
    return hits.crossJoin(rows.agg(F.count("*").alias("n"))).select("n_hits", (F.col("n") - F.col("n_hits")).alias("n_misses"))
