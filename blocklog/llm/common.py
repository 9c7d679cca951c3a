"""What the operators share: reading tables, shared storage, word rules."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables and broadcasts below this many bytes may go to every executor.
BROADCAST_BYTES = 64 << 20
#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset (tests, local mode) a temporary folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.blocklog.shared.dir", None)
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="blocklog-shared-")
            spark.conf.set("spark.blocklog.shared.dir", root)
            spark.sparkContext.setCheckpointDir(root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, sort: tuple[str, ...] = (), release: bool = False, options: dict | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors and computes df once.
    ``release`` deletes the shuffle files of df once it is written, rather than
    when the driver happens to collect its garbage; ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true" if release else before)
    try:
        (df.sortWithinPartitions(*sort) if sort else df).write.options(**options or {}).parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a frame made by staged() that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files under a frame, read from the storage listing only."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    total = 0
    for f in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(f)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Send texts to Python workers in batches of ``size`` bytes at most, for this session.

    The default of 64 MB is held several times over by each task, in the
    executor and in its worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("b"))
    if now <= 0 or now > size:
        spark.conf.set(key, f"{size}b")


def slices(batch, rows: int, size: int, column: str = "text"):
    """Slices of an Arrow batch, in order, of at most ``rows`` rows and about ``size`` bytes of a column.

    A longer text is a slice of its own, whole.
    """
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        n = int(np.clip(np.searchsorted(ends, before + size, "right") - at, 1, rows))
        yield batch.slice(at, n)
        at += n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker process."""
    import sys
    import types

    module = sys.modules.setdefault("blocklog_worker_cache", types.ModuleType("blocklog_worker_cache"))
    return module.__dict__.setdefault(name, {})


def token_hashes(texts, lower: bool = True):
    """White-space words of an Arrow string array, vectorised.

    Returns (words, codes, starts): distinct words as an Arrow array, each
    token's index into it, and each text's first token (one more at the end).
    A null text has no words. Lower-cases A-Z where asked.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    # a fresh array: ascii_lower misreads a slice whose cast keeps offsets from within the batch
    texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    bounds = np.asarray(lists.offsets).astype(np.int64)
    bounds = bounds - bounds[0]
    coded = flat.dictionary_encode()
    codes = np.asarray(coded.indices).astype(np.int64)
    words = coded.dictionary
    lengths = np.asarray(pc.binary_length(words)) if len(words) else np.zeros(0, np.int64)
    if len(words) and (lengths == 0).any():  # leading and trailing white space
        kept = (lengths > 0)[codes]
        before = np.concatenate([[0], np.cumsum(kept)])
        codes, bounds = codes[kept], before[bounds]
    return words, codes, bounds


def raw_words(words):
    """The words of an Arrow string array without nulls, one after the other, as bytes."""
    import numpy as np
    import pyarrow as pa

    words = words.cast(pa.large_binary())
    if not len(words):
        return
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1].tolist()
    data = data.to_pybytes() if data else b""
    for at, end in zip(ends, ends[1:], strict=False):
        yield data[at:end]
