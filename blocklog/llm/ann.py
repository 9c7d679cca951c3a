"""Approximate nearest neighbours with an adaptive dimension scan.

Vectors are dealt to inverted lists by nearest centroid and rotated by a random
orthogonal matrix, so that a partial distance over some dimensions estimates
the whole one. The lists store the rotated vectors in column blocks, beside the
originals. Inside a probed list distances grow column block by column block;
after each block a hypothesis test abandons the candidates whose whole
distance would exceed the bound with high confidence (ADSampling: Gao and Long,
SIGMOD 2023). Survivors are measured exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, staged

#: Rows of a list, and queries probing it, that meet in one task's group.
ROWS, QUERIES = 2048, 256
#: Dimensions of a stored column block, pairs whose exact distances are computed at once.
STEP, PAIRS = 16, 1 << 16
#: What is fitted on: at most so many vectors, lists, and queries for tuning.
SAMPLE, LISTS, TUNE = 20_000, 1024, 200
#: Bytes of the fitted sample, whatever the vectors' size; it is sent to every worker.
SAMPLE_BYTES = 32 << 20


@dataclass
class Space:
    """Rotation and centroids, and the bounded sample they were fitted on."""

    rotation: object
    centroids: object
    sample: object
    ids: object
    sizes: object = None
    probes: int = 1
    measured: dict = field(default_factory=dict)

    def squares(self, vectors):
        """Squared distances of vectors to all centroids."""
        return (vectors**2).sum(1)[:, None] + (self.centroids**2).sum(1)[None] - 2 * vectors @ self.centroids.T


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>): without null, zero, non-finite and odd-sized vectors.

    Rows without vec_id take no part either. The size that counts is the most
    common one, the larger of equally common ones.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head()
    return rows.where(F.size("v") == F.lit(size.n if size else 0))


def matrix(column):
    """An Arrow list column as a matrix of doubles."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def fit(rows: DataFrame, seed: int = 7, rounds: int = 8) -> Space:
    """Rotation and k-means centroids from at most SAMPLE vectors (SAMPLE_BYTES), taken by hash of vec_id."""
    import numpy as np

    total, first = rows.count(), rows.select(F.size("v").alias("n")).head()
    most = min(SAMPLE, SAMPLE_BYTES // (8 * first.n)) if first else SAMPLE
    found = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(most).toArrow()
    sample = matrix(found["v"].combine_chunks()) if found.num_rows else np.zeros((0, 1))
    rng = np.random.default_rng(seed)
    rotation, _ = np.linalg.qr(rng.standard_normal((sample.shape[1], sample.shape[1])))
    lists = max(1, min(LISTS, int(total**0.5), len(sample)))
    space = Space(rotation, sample[rng.permutation(len(sample))[:lists]].copy() if len(sample) else np.zeros((1, sample.shape[1])), sample, np.asarray(found["vec_id"].combine_chunks()) if found.num_rows else np.zeros(0, np.int64))
    for _ in range(rounds if len(sample) else 0):
        near = np.concatenate([space.squares(sample[a : a + 2000]).argmin(1) for a in range(0, len(sample), 2000)])
        for j in range(len(space.centroids)):
            if (near == j).any():
                space.centroids[j] = sample[near == j].mean(0)
    return space


def cut(vectors, step: int) -> list:
    """The columns of a matrix in blocks of ``step``, each lying together."""
    import numpy as np

    return [np.ascontiguousarray(vectors[:, at : at + step]) for at in range(0, vectors.shape[1], step)]


def assign(rows: DataFrame, space: Space, step: int = STEP) -> DataFrame:
    """Every row with the list of its nearest centroid, and rotated: (vec_id, v, list, r0, r1, ...).

    Each r column is a block of ``step`` dimensions of the rotated vector.
    """
    import pyarrow as pa

    sent = rows.sparkSession.sparkContext.broadcast(space)
    names = [f"r{n}" for n in range(-(-space.rotation.shape[1] // step))]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                v = matrix(part.column("v"))
                blocks = [pa.ListArray.from_arrays(pa.array(range(0, b.size + 1, b.shape[1]), pa.int32()), pa.array(b.ravel())) for b in cut(v @ sent.value.rotation, step)]
                near = sent.value.squares(v).argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype("int32")), *blocks], names=["vec_id", "v", "list", *names])

    return rows.mapInArrow(batches, ", ".join(["vec_id long", "v array<double>", "list int", *(f"{n} array<double>" for n in names)]))


def tune(index: DataFrame, space: Space, recall: float, k: int) -> int:
    """Lists to probe so that sampled queries find ``recall`` of their true neighbours.

    At most TUNE queries are held against all rows by brute force. Of 32 lists
    or fewer all are probed.
    """
    import numpy as np
    import pyarrow as pa

    lists, queries, ids = len(space.centroids), space.sample[:TUNE], space.ids[:TUNE]
    if lists <= 32 or not len(queries):
        return lists
    sent = index.sparkSession.sparkContext.broadcast((queries, ids))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = sent.value
        for batch in stream:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                v = matrix(part.column("v"))
                far = (q**2).sum(1)[:, None] + (v**2).sum(1)[None] - 2 * q @ v.T
                far[own[:, None] == np.asarray(part.column("vec_id"))[None]] = np.inf
                n = min(k, len(v))
                best = np.argpartition(far, n - 1, axis=1)[:, :n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(len(q)), n)), pa.array(np.take_along_axis(far, best, 1).ravel()), pa.array(np.asarray(part.column("list"))[best].ravel())], names=["q", "far", "list"]
                )

    found = index.select("vec_id", "v", "list").mapInArrow(batches, "q long, far double, list int").where("far < double('infinity')")
    best = Window.partitionBy("q").orderBy("far", "list")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("q", "list").collect()
    order = space.squares(queries).argsort(1).argsort(1)
    ranks = np.sort([order[r.q, r.list] for r in found])
    need = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else lists
    space.measured = {"queries": len(queries), "lists": lists, "probes": need}
    return min(lists, need + lists // 20)


def scan(queries, bounds, rows, rotated, own, ids, k: int, step: int, doubt: float):
    """The k nearest rows of each query inside one group: (query index, row index, distance).

    ``bounds`` are squared distances that a result has at most; ``rotated`` has
    queries and rows after rotation, as matrices or lists of their column blocks
    of ``step`` dimensions. Rows with a query's own id are no candidates.
    """
    import numpy as np

    q_blocks, r_blocks = (m if isinstance(m, list) else cut(m, step) for m in rotated)
    dims, seen = sum(b.shape[1] for b in r_blocks), r_blocks[0].shape[1]
    a, b = q_blocks[0], r_blocks[0]
    part = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T

    def limit(n: int):
        return 1.0 if n >= dims else (1 + doubt / n**0.5) ** 2 * n / dims

    i, j = np.nonzero((part <= bounds[:, None] * limit(seen) + 1e-9) & (own[:, None] != ids[None]))
    far = part[i, j]
    for a, b in zip(q_blocks[1:], r_blocks[1:], strict=True):
        seen += b.shape[1]
        far = far + ((a[i] - b[j]) ** 2).sum(1)
        alive = far <= bounds[i] * limit(seen) + 1e-9
        i, j, far = i[alive], j[alive], far[alive]
    exact = np.empty(len(i))
    for at in range(0, len(i), PAIRS):
        exact[at : at + PAIRS] = np.sqrt(((queries[i[at : at + PAIRS]] - rows[j[at : at + PAIRS]]) ** 2).sum(1))
    order = np.lexsort((ids[j], exact, i))
    i, j, exact = i[order], j[order], exact[order]
    starts = np.searchsorted(i, i)
    top = np.arange(len(i)) - starts < k
    return i[top], j[top], exact[top]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.97, step: int = STEP, doubt: float = 2.1) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query.

    ``vectors`` and ``queries`` have vec_id and embedding; queries are rows of
    vectors, and a row with the query's id is no candidate for it. The score is
    the Euclidean distance of the original vectors in doubles; ties go to the
    smaller vec_id. Vectors that are null, zero, of another size than most, or
    hold null or non-finite components take no part, nor do rows without vec_id.
    A repeated vec_id is one candidate, at its nearest vector; a repeated query is answered once, by its
    least vector. Fewer candidates than k give fewer results, empty
    tables none.

    The index is fitted on a bounded sample and holds every row; the number of
    lists probed is tuned for ``recall``. Groups in one task have about ROWS
    rows and QUERIES queries at most, whatever a list's size.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    rows = staged(usable(vectors), "vectors")
    space = fit(rows)
    index = staged(assign(rows, space, step), "lists")
    turned = [c for c in index.columns if c not in ("vec_id", "v", "list")]
    space.probes = tune(index, space, recall, k)
    space.sizes = np.zeros(len(space.centroids), np.int64)
    for r in index.groupBy("list").count().collect():  # one row for each list, LISTS at most
        space.sizes[r["list"]] = r["count"]
    sent = spark.sparkContext.broadcast(space)

    def probed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the lists it probes, and what the sample holds of them.

        The k nearest sampled rows of probed lists are results already; the
        farthest of them bounds the scan.
        """
        known = sent.value
        homes = np.concatenate([known.squares(known.sample[a : a + ROWS]).argmin(1) for a in range(0, len(known.sample) or 1, ROWS)])
        for batch in stream:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                v, own = matrix(part.column("v")), np.asarray(part.column("vec_id"))
                order = known.squares(v).argsort(1, kind="stable")
                enough = (known.sizes[order].cumsum(1) < 4 * k).sum(1) + 1  # lists until there are candidates to spare
                n = np.minimum(np.maximum(known.probes, enough), order.shape[1])
                far = (v**2).sum(1)[:, None] + (known.sample**2).sum(1)[None] - 2 * v @ known.sample.T
                out = order.argsort(1)[:, homes] >= n[:, None]
                far[out | (own[:, None] == known.ids[None])] = np.inf
                some = np.argpartition(far, min(k, far.shape[1]) - 1, axis=1)[:, :k]
                exact = np.sqrt(((v[:, None] - known.sample[some]) ** 2).sum(2))
                kept = np.isfinite(np.take_along_axis(far, some, 1))
                full = kept.sum(1) == k
                bound = np.where(full, exact.max(1) ** 2 * (1 + 1e-9) + 1e-12, np.inf)
                near = [[{"vec_id": int(known.ids[x]), "score": float(d)} for x, d, ok in zip(*r, strict=True) if ok] for r in zip(some, exact, kept, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("v"), pa.array(bound), pa.array([o[:m].tolist() for o, m in zip(order.astype(np.int32), n, strict=True)], pa.list_(pa.int32())), pa.array(near, pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))],
                    names=["query_id", "q", "bound", "lists", "near"],
                )

    def met(key, left: pa.Table, right: pa.Table) -> pa.Table:
        known = sent.value
        names = ["query_id", "vec_id", "score"]
        out = []
        if left.num_rows and right.num_rows:
            v, ids = matrix(left["v"].combine_chunks()), np.asarray(left["vec_id"].combine_chunks())
            r_blocks = [matrix(left[c].combine_chunks()) for c in turned]
            for at in range(0, right.num_rows, QUERIES):
                some = right.slice(at, QUERIES)
                q, own = matrix(some["q"].combine_chunks()), np.asarray(some["query_id"].combine_chunks())
                i, j, exact = scan(q, np.asarray(some["bound"].combine_chunks()), v, (cut(q @ known.rotation, step), r_blocks), own, ids, k, step, doubt)
                out.append(pa.table([pa.array(own[i]), pa.array(ids[j]), pa.array(exact)], names=names))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    sizes = index.groupBy("list").agg(F.ceil(F.count("*") / F.lit(ROWS)).cast("int").alias("blocks"))
    asked = usable_queries(queries, rows)
    asked = staged(asked.mapInArrow(probed, "query_id long, q array<double>, bound double, lists array<int>, near array<struct<vec_id: bigint, score: double>>"), "queries")
    near = asked.select("query_id", F.explode("near").alias("n")).select("query_id", "n.vec_id", "n.score")
    asked = asked.select("query_id", "q", "bound", F.explode("lists").alias("list"))
    chunks = asked.groupBy("list").agg(F.ceil(F.count("*") / F.lit(4 * QUERIES)).cast("int").alias("chunks"))
    plan = sizes.join(chunks, "list")  # one row for each list, LISTS at most
    left = index.join(F.broadcast(plan), "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))
    left = left.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("list", "block", F.col("chunk").cast("long").alias("chunk"), "vec_id", "v", *turned)
    right = asked.join(F.broadcast(plan), "list").withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", F.col("block").cast("long").alias("block"), "chunk", "query_id", "q", "bound")
    key = ["list", "block", "chunk"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(met, "query_id long, vec_id long, score double")
    found = found.union(near).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable_queries(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Queries as rows (vec_id, v) of the usable vectors, each vec_id once."""
    ids = queries.select("vec_id").where("vec_id IS NOT NULL").distinct()
    return rows.join(ids, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
