"""Sealed blocks: encryption bound to addresses, verification, tamper evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crypto


def seal(blocks: DataFrame, secret: bytes, payload: str = "payload") -> DataFrame:
    """Blocks (hba, seg, wseq, payload) with ``sealed`` instead of the payload, and its ``mac``."""
    key = crypto.segment_key(secret, F.col("seg"))
    iv = crypto.block_iv(F.col("hba"), F.col("wseq"))
    sealed = crypto.gcm_encrypt(F.col(payload).cast("binary"), key, iv, F.col("hba"))
    return blocks.withColumn("sealed", sealed).withColumn("mac", crypto.gcm_tag(F.col("sealed"))).drop(payload)


def unseal(blocks: DataFrame, secret: bytes, payload: str = "payload") -> DataFrame:
    """The payload of each block and whether it is intact; damage is reported, never dropped."""
    key = crypto.segment_key(secret, F.col("seg"))
    data = crypto.gcm_decrypt(F.col("sealed"), key, F.col("hba"))
    return blocks.withColumn(payload, data).withColumn("ok", F.col(payload).isNotNull())


def flipped(sealed: Column, at: int) -> Column:
    """A binary with all bits of byte ``at`` (from 1) inverted."""
    byte = F.conv(F.hex(F.substring(sealed, at, 1)), 16, 10).cast("int")
    new = F.unhex(F.lpad(F.hex(F.lit(255) - byte), 2, "0"))
    return F.concat(F.substring(sealed, 1, at - 1), new, F.substring(sealed, F.lit(at + 1), F.length(sealed)))


def measurement(snapshot: DataFrame, key: str) -> DataFrame:
    """One digest over a snapshot: per-row digests combined in key order, in two levels.

    Rows are hashed in buckets of 4096 keys, buckets into the root, so no task
    holds more than a bucket.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(snapshot.columns)), {"ignoreNullFields": "false"}), 256)
    leaves = snapshot.select(F.floor(F.col(key) / 4096).alias("b"), F.struct(key, row.alias("d")).alias("r"))
    buckets = leaves.groupBy("b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["d"]), ""), 256).alias("d"))
    return buckets.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda r: r["d"]), ""), 256).alias("measurement"))
