"""Streams of writes: micro-batches into the store, and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import BLOCKS_PER_SEGMENT
from ..sources.store import Store


def write_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet folder as a stream of rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, store: Store, checkpoint: str, compact_at: int = 4, trigger: dict | None = None):
    """Append each micro-batch to the store; every ``compact_at`` batches it is compacted.

    A batch that is delivered again after a failure is recognised by its number,
    which the snapshot that shows the batch keeps in its counters. Compaction is a
    snapshot of its own: it changes no row that a reader sees.
    """

    def put(batch: DataFrame, number: int) -> None:
        done = store.snapshot.counters.get("next_batch", 0)
        if number < done:
            return
        store.append(batch, {"next_batch": number + 1 - done})
        if (number + 1) % compact_at == 0:
            store.compact()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def put_returning_old(stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None):
    """Stateful put: starts a query that writes (lba, wseq, hba, old_hba) for each write (lba, wseq, hba).

    ``old_hba`` is the address that a write supersedes, null for a key's first.
    The state of a key is its newest write. Writes of a key are ordered inside a
    micro-batch; a write no newer than the state is superseded at once. A null
    key is a key.

    Batch n is the folder ``out``/n, whole once it has its _SUCCESS file. The state
    that it starts from is the folder newest/n of the checkpoint, which stays
    until the next batch is done, so a batch delivered again writes the same
    rows again. State and writes of a batch meet by a shuffle on the key; each
    batch writes the state of all keys anew.
    """
    states = f"{checkpoint}/newest"
    # of writes of one number the state's is the newest, then the one at the greatest address
    newest = F.max(F.struct("wseq", ~F.col("live"), "hba"))
    before = Window.partitionBy("lba").orderBy("live", "wseq", F.desc("hba")).rowsBetween(Window.unboundedPreceding, -1)
    old = F.when(F.col("prev").isNull(), F.lit(None)).when(F.col("wseq") > F.col("prev.wseq"), F.col("prev.hba")).otherwise(F.col("hba"))

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("lba", F.col("wseq").cast("long").alias("wseq"), F.col("hba").cast("long").alias("hba"))
        both = rows.withColumn("live", F.lit(True))
        if number:
            both = both.unionByName(spark.read.schema(rows.schema).parquet(f"{states}/{number}").withColumn("live", F.lit(False)))
        done = both.withColumn("prev", newest.over(before)).where("live").select("lba", "wseq", "hba", old.alias("old_hba"))
        done.write.mode("overwrite").parquet(f"{out}/{number}")
        state = both.groupBy("lba").agg(newest.alias("r")).select("lba", "r.wseq", "r.hba")
        state.write.mode("overwrite").parquet(f"{states}/{number + 1}")
        past = spark._jvm.org.apache.hadoop.fs.Path(f"{states}/{number - 1}")
        past.getFileSystem(spark._jsc.hadoopConfiguration()).delete(past, True)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def seal_segments(log: DataFrame, stream: str = "stream", capacity: int = BLOCKS_PER_SEGMENT) -> DataFrame:
    """Exact segment sealing: (stream, wseq, lba, seg, flush) with a new segment at ``capacity`` distinct keys.

    Sequence decides where a segment ends, so each stream is replayed serially,
    streams in parallel; a worker holds the keys of one open segment.
    """
    import pyarrow as pa

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seg, held = None, 0, set()
        for batch in batches:
            streams, keys = batch.column("stream").to_pylist(), batch.column("lba").to_pylist()
            segs = []
            for s, k in zip(streams, keys, strict=True):
                if s != now:
                    now, seg, held = s, 0, set()
                if k not in held and len(held) == capacity:
                    seg, held = seg + 1, set()
                held.add(k)
                segs.append(seg)
            yield pa.RecordBatch.from_arrays([batch.column("stream"), batch.column("wseq"), batch.column("lba"), pa.array(segs, pa.int64())], names=["stream", "wseq", "lba", "seg"])

    rows = log.select(F.col(stream).alias("stream"), "wseq", "lba").repartition("stream").sortWithinPartitions("stream", "wseq")
    return rows.mapInArrow(replay, "stream long, wseq long, lba long, seg long")


def windowed_counts(stream: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Extension: counts per event-time window and type, late rows within the watermark included."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
