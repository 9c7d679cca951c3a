"""SimHash near-duplicates through deletion variants of segments.

A 64-bit fingerprint is cut into so few segments that two fingerprints within
the distance differ by at most one bit in some segment. Each segment is
indexed with each of its bits deleted in turn; equal keys give candidates,
which are verified on the whole fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bound_batches, read_table, staged, table_bytes
from .components import roots

#: Rows of one key that are linked in one task; larger keys are cut into chunks.
CHUNK = 4096
#: A fingerprint is hot with over a HOT-th of all rows and over ``hot_rows`` rows, so there are HOT of them at most.
HOT = 10_000
#: Fingerprints per key that plan_masks() aims at.
PER_KEY = 32


def simhash(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included.

    Words are split at ASCII white space after lower-casing A-Z. Fewer words
    than ``shingle`` are one shingle; a null text or one without words has
    fingerprint zero. A bit is set if it is set in over half of the hashes.
    """
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    firsts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    firsts, ends = firsts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(firsts), 65536):
        h = np.array([hashed(joined[a:b], 42) for a, b in zip(firsts[at : at + 65536], ends[at : at + 65536], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(firsts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, key: str = "doc_id") -> DataFrame:
    """(key, fp) of every row; fp is the fingerprint's bits as a signed long."""
    import pyarrow as pa

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in stream:
            found = np.array([simhash(x.as_py(), shingle) for x in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found.view(np.int64))], names=[key, "fp"])

    bound_batches(docs.sparkSession)
    rows = docs.select(key, "text")
    return rows.mapInArrow(batches, rows.select(key, F.lit(0).cast("long").alias("fp")).schema)


def plan_masks(distance: int, count: int) -> list[list[int]]:
    """Segments as lists of bit positions, such that some differs by at most one bit.

    ``distance`` // 2 + 1 plain segments do that. Where ``count`` fingerprints
    would crowd their keys, segments are unions of smaller cuts instead: of
    distance - 1 + r cuts every r make a segment, which is longer for larger r.
    Every plan finds the same pairs.
    """

    def cut(n: int) -> list[list[int]]:
        bounds = [64 * i // n for i in range(n + 1)]
        return [list(range(a, b)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    plan = cut(distance // 2 + 1)
    for r in range(2, 5):
        if count <= PER_KEY << (min(map(len, plan)) - 1):
            break
        plan = [sorted(sum(group, [])) for group in combinations(cut(distance - 1 + r), r)]
    return plan


def forest(values, distance: int):
    """Edges of a spanning forest over values that are within the distance."""
    import numpy as np

    left = np.arange(len(values))
    edges: list = []
    while left.size:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            x = queue.pop()
            near = np.bitwise_count(values[left] ^ values[x]) <= distance
            if near.any():
                hits = left[near]
                edges.append(np.stack([np.full(len(hits), values[x]), values[hits]]))
                queue.extend(hits)
                left = left[~near]
    return np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.uint64)


def linked_runs(distance: int, chunk: int, stream: Iterator) -> Iterator:
    """Runs of equal ``h`` in sorted batches (h, fp) to links, or to rows that overflow.

    Yields (over, a, b): links of fingerprints a and b that connect what is
    connected inside each run; from runs of over ``chunk`` rows, rows h and fp.
    """
    import numpy as np
    import pyarrow as pa

    def out(kind: bool, a, b):
        a, b = np.ascontiguousarray(a), np.ascontiguousarray(b)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["over", "a", "b"])

    def settle(h, f):
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(h)]]))
        made = []
        short = (sizes > 1) & (sizes <= 4)
        for lag in range(1, 4):
            at = starts[short & (sizes > lag)]
            n = sizes[short & (sizes > lag)]
            for off in range(3):
                i = at[n > off + lag] + off
                near = np.bitwise_count(f[i] ^ f[i + lag]) <= distance
                made.append(np.stack([f[i][near], f[i + lag][near]]))
        for s, n in zip(starts[sizes > 4], sizes[sizes > 4], strict=True):
            made.append(forest(f[s : s + n], distance))
        pairs = np.concatenate(made, axis=1)
        pairs = np.unique(np.sort(pairs, axis=0), axis=1) if pairs.shape[1] else pairs
        return out(False, pairs[0], pairs[1])

    rest_h, rest_f, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
    for batch in stream:
        h = np.concatenate([rest_h, np.asarray(batch.column(0))])
        f = np.concatenate([rest_f, np.asarray(batch.column(1)).view(np.uint64)])
        if not len(h):
            continue
        if over is not None:
            same = h == over
            yield out(True, h[same], f[same].view(np.int64))
            h, f = h[~same], f[~same]
            if not len(h):
                rest_h, rest_f = h, f
                continue
            over = None
        last = np.searchsorted(h, h[-1]) if (h[1:] >= h[:-1]).all() else len(h) - np.argmax(h[::-1] != h[-1])
        runs, counts = np.unique(h[:last], return_counts=True)
        big = np.isin(h[:last], runs[counts > chunk])
        if big.any():
            yield out(True, h[:last][big], f[:last][big].view(np.int64))
        if last:
            yield settle(h[:last][~big], f[:last][~big]) if not big.all() else out(False, f[:0], f[:0])
        rest_h, rest_f = h[last:], f[last:]
        if len(rest_h) > chunk:
            over = rest_h[0]
            yield out(True, rest_h, rest_f.view(np.int64))
            rest_h, rest_f = rest_h[:0], rest_f[:0]
    if len(rest_h):
        yield settle(rest_h, rest_f)


def links(prints: DataFrame, distance: int = 4, masks: list[list[int]] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect all distinct ``fp`` within the distance.

    Inside a key only a spanning forest is made, never all pairs. Keys with
    over ``chunk`` rows are cut into chunks, and each two chunks are linked in
    a task of their own.
    """
    import pyarrow as pa

    masks = masks or plan_masks(distance, prints.count())
    keep = [sum(1 << b for b in segment if b != dropped) for segment in masks for dropped in segment]
    signed = [m - (1 << 64) if m >> 63 else m for m in keep]
    variant = F.explode(F.expr(f"array({', '.join(f'named_struct("v", {i}, "m", {m}L)' if m != -(1 << 63) else f'named_struct("v", {i}, "m", -9223372036854775807L - 1L)' for i, m in enumerate(signed))})")).alias("x")
    keys = prints.select("fp", variant).select(F.xxhash64("x.v", F.col("fp").bitwiseAND(F.col("x.m"))).alias("h"), "fp")

    def runs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from linked_runs(distance, chunk, stream)

    def pairs(table: pa.Table) -> pa.Table:
        import numpy as np

        made = forest(np.unique(np.asarray(table["fp"]).view(np.uint64)), distance).view(np.int64)
        return pa.table({"a": made[0], "b": made[1]})

    found = staged(keys.repartition("h").sortWithinPartitions("h").mapInArrow(runs, "over boolean, a long, b long"), "runs")
    over = found.where("over").select(F.col("a").alias("h"), F.col("b").alias("fp"))
    sizes = over.groupBy("h").agg(F.ceil(F.count("*") * 2 / F.lit(chunk)).alias("n"))
    cut = over.join(sizes, "h").withColumn("p", F.pmod(F.xxhash64("fp"), "n"))
    cut = cut.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).where((F.col("p") != F.col("q")) | (F.col("n") == 1))
    cut = cut.select("h", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "fp")
    crossed = cut.groupBy("h", "p", "q").applyInArrow(pairs, "a long, b long")
    return found.where("NOT over").select("a", "b").union(crossed)


def first_linked(docs: DataFrame, key: str, distance: int = 4, shingle: int = 4, masks: list[list[int]] | None = None, chunk: int = CHUNK, hot_rows: int = 1000) -> DataFrame:
    """(key, fp, first) for each row: the least ``key`` it is linked to, nulls left out.

    Equal fingerprints are one node, so groups of copies cost one row each;
    fingerprints of over ``hot_rows`` rows, HOT at most, get their component by
    broadcast.
    """
    rows = staged(fingerprints(docs, shingle, key), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")), "nodes")
    stars = staged(roots(links(nodes.select("fp"), distance, masks, chunk)), "stars")
    linked = nodes.join(stars, nodes["fp"] == stars["node"]).select("fp", "root", "least")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("found")), "root").select(F.col("fp").alias("f"), "found")
    named = nodes.join(named, nodes["fp"] == F.col("f"), "left").select("fp", F.coalesce("found", "least").alias("first"), "n")
    named = staged(named.withColumnRenamed("fp", "f"), "named")
    many = nodes.agg(F.sum("n").alias("n")).head().n or 0
    hot = F.broadcast(named.where(F.col("n") > max(hot_rows, many // HOT)))
    mine = rows.join(hot, rows["fp"] == F.col("f"))
    rest = rows.join(hot, rows["fp"] == F.col("f"), "left_anti").join(named, rows["fp"] == F.col("f"))
    return mine.select(key, "fp", "first").union(rest.select(key, "fp", "first"))


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, masks: list[list[int]] | None = None, chunk: int = CHUNK, hot_rows: int = 1000) -> DataFrame:
    """(doc_id, fp, component_id) for each row: the least doc_id it is linked to.

    Rows link if their fingerprints differ in at most ``distance`` bits. Texts
    without words (or null) have fingerprint zero and link like any other. Rows
    with null doc_id have a component, whose id is null only if no other row is
    in it. Repeated rows stay; an empty table gives no rows.
    """
    return first_linked(docs, "doc_id", distance, shingle, masks, chunk, hot_rows).withColumnRenamed("first", "component_id")


def one_of_each(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """The rows of ``docs`` with one row for each component: its least doc_id, null ids last.

    Rows are told apart by doc_id and hash of the text (null counts as empty),
    so neither null ids nor several texts under one id take other documents
    along. Of rows equal in both one stays, and only if it is its component's.
    Other columns may have any name and pass unchanged.
    """
    copy = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", copy.alias("copy")).alias("key"), "text")
    found = staged(first_linked(keyed, "key", distance, shingle).select(F.col("key.doc_id").alias("d"), F.col("key.copy").alias("c"), F.col("key").eqNullSafe(F.col("first")).alias("first")), "components")
    gone = staged(found.groupBy("d", "c").agg(F.min("first").alias("first"), F.count("*").alias("n")).where("NOT first OR n > 1"), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), copy.alias("own_copy"))
    own = F.col("own_id").eqNullSafe(F.col("d")) & (F.col("own_copy") == F.col("c"))
    ids = gone.where("NOT first").select("d", "c")
    side = F.broadcast(ids) if table_bytes(gone) <= BROADCAST_BYTES // 8 else ids
    kept = rows.join(side, own, "left_anti")
    twice = gone.where("first AND n > 1").select("d", "c")
    if not twice.head(1):
        return kept.select("row.*")
    again = kept.join(twice, own, "left_semi").dropDuplicates(["own_id", "own_copy"])
    return kept.join(twice, own, "left_anti").unionByName(again).select("row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
