"""Quality by nearest-neighbour voting in a latent-semantic space.

Every whole text becomes weights of hashed words, of pairs of adjacent character
classes, and of how much its words repeat. They are weighted by tf-idf and
projected on the leading singular directions of a labelled sample. The sample's
vectors are broadcast; each document's cosine to all of them is computed in
blocks, and the nearest ones vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, raw_words, read_table, token_hashes

#: Rows whose terms are counted, and whose cosines are computed, at once.
BLOCK = 256
#: Hash buckets of words, character classes; the classes' pairs and three ratios are terms too.
WORDS, CLASSES = 4096, 32
TERMS = WORDS + CLASSES * CLASSES + 3
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def class_table():
    """The class of each byte: white space, letters by kind, digits, signs, others."""
    import numpy as np

    table = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b in (9, 10, 11, 12, 13):
            table[b] = 1
        elif c in "aeiou":
            table[b] = 2
        elif c == "h":
            table[b] = 3
        elif "a" <= c <= "z":
            table[b] = 4
        elif "A" <= c <= "Z":
            table[b] = 5
        elif "0" <= c <= "9":
            table[b] = 6
        elif b >= 128:
            table[b] = 7
        elif c in SIGNS:
            table[b] = 9 + SIGNS.index(c) % (CLASSES - 9)
        elif c != " ":
            table[b] = 8
    return table


def term_counts(texts, table):
    """A row of term weights for each text of an Arrow array; zeros for a text without characters.

    Words (lower-cased A-Z, signs at their ends removed) as log(1 + count); class
    pairs and ratios as log(1 + occurrences in a thousand).
    """
    import zlib

    import numpy as np
    import pyarrow as pa

    words, codes, starts = token_hashes(texts)
    rows, distinct, n = len(texts), len(words), np.diff(starts)
    row = np.repeat(np.arange(rows), n)
    signs = SIGNS.encode()
    bucket = np.fromiter((zlib.crc32(w.strip(signs)) % WORDS for w in raw_words(words)), np.int64, distinct)
    out = np.zeros((rows, TERMS), np.float32)
    out[:, :WORDS] = np.bincount(row * WORDS + bucket[codes], minlength=rows * WORDS).reshape(rows, WORDS)
    used = np.unique(row * distinct + codes) // max(distinct, 1)
    same = row[:-1] == row[1:]
    first, second = codes[:-1][same], codes[1:][same]
    pairs = np.unique((row[:-1][same] * distinct + first) * distinct + second) // max(distinct, 1) ** 2
    most = np.maximum(n, 1)
    out[:, TERMS - 3] = np.bincount(row[:-1][same][first == second], minlength=rows) / most
    out[:, TERMS - 2] = (n - np.bincount(used, minlength=rows)) / most
    out[:, TERMS - 1] = (np.maximum(n - 1, 0) - np.bincount(pairs, minlength=rows)) / most
    for i, raw in enumerate(texts.cast(pa.large_binary()).to_pylist()):
        size = len(raw or b"")
        for at in range(0, size, 1 << 20):
            c = table[np.frombuffer(raw, np.uint8, min(size - at, (1 << 20) + 1), at)].astype(np.int64)
            out[i, WORDS : TERMS - 3] += np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
        out[i, WORDS : TERMS - 3] /= max(size, 1)
    out[:, WORDS:] *= 1000
    return np.log1p(out, out=out)


def weighted(counts, idf):
    """tf-idf in place; words and the other terms weigh the same in each row."""
    import numpy as np

    counts *= idf
    for part in (counts[:, :WORDS], counts[:, WORDS:]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return counts


def leading_axes(z, dims: int, rounds: int = 5, seed: int = 7):
    """Leading right singular vectors of z, by subspace iteration."""
    import numpy as np

    q = np.random.default_rng(seed).standard_normal((z.shape[1], dims + 16)).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(z.T @ (z @ q))
    _, _, turn = np.linalg.svd(z @ q, full_matrices=False)
    return q @ turn[:dims].T


@dataclass
class Neighbours:
    """A fitted space and its labelled vectors."""

    idf: object
    mean: object
    axes: object
    vectors: object
    labels: object
    texts: object
    prior: float
    k: int
    power: float

    def project(self, counts):
        import numpy as np

        z = weighted(counts.copy(), self.idf) @ self.axes - self.mean @ self.axes
        return (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def vote(self, counts, texts):
        """Share of label 1 among the k most similar vectors, weighted by similarity.

        ``texts`` are hashes of the rows' texts: a labelled row of the same text
        has no vote. Rows without terms, or without a similar vector, get the prior.
        """
        import numpy as np

        if not len(self.labels):
            return np.full(len(counts), self.prior)
        near = self.project(counts) @ self.vectors.T
        near[texts[:, None] == self.texts[None]] = -1
        k = min(self.k, len(self.labels))
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, 1).astype(np.float64), 0) ** self.power
        total = weight.sum(1)
        score = (weight * self.labels[best]).sum(1) / np.where(total > 0, total, 1)
        return np.clip(np.where((total > 0) & counts.any(1), score, self.prior), 0, 1)


def _features(rows: DataFrame) -> DataFrame:
    """(doc_id, quality, own, terms, weights): the non-zero terms of every text."""
    import pyarrow as pa

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = class_table()
        for batch in stream:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                counts = term_counts(part.column("text"), table)
                at_terms = [np.flatnonzero(r).astype(np.uint16) for r in counts]
                sparse = [pa.array([x.tobytes() for x in found], pa.binary()) for found in (at_terms, [r[t] for r, t in zip(counts, at_terms, strict=True)])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *sparse], names=[*rest, "terms", "weights"])

    rest = ["doc_id", "quality", "own"]
    bound_batches(rows.sparkSession)
    rows = rows.withColumn("own", F.xxhash64("text"))
    schema = rows.select(*rest, F.lit(b"").alias("terms"), F.lit(b"").alias("weights")).schema
    return rows.select(*rest, "text").mapInArrow(batches, schema)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000, dims: int = 32, k: int = 15, power: float = 8.0) -> Neighbours:
    """Fit on at most ``sample`` labelled documents (doc_id, quality 0 or 1).

    ``sample`` bounds what the driver and each worker hold; which rows are taken
    depends on a hash of doc_id only. Labels that are null, or of documents that
    are not there, are not used; of several labels of a
    document the highest, of several texts the least.
    """
    import numpy as np

    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("text").alias("text"))
    found = _features(rows).toArrow().sort_by("doc_id")  # a sort in Spark would read the terms twice
    counts = np.zeros((found.num_rows, TERMS), np.float32)
    for i, (terms, weights) in enumerate(zip(found["terms"], found["weights"], strict=True)):
        counts[i, np.frombuffer(terms.as_py(), np.uint16)] = np.frombuffer(weights.as_py(), np.float32)
    y, own = np.array(found["quality"], np.float64), np.array(found["own"], np.int64)
    del found
    idf = (np.log((1 + len(y)) / (1 + np.count_nonzero(counts, axis=0))) + 1).astype(np.float32)
    z = weighted(counts, idf)
    mean = z.mean(0) if len(y) else np.zeros(TERMS, np.float32)
    z -= mean
    axes = leading_axes(z, dims)
    vectors = z @ axes
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return Neighbours(idf, mean, axes, vectors, y, own, float(y.mean()) if len(y) else 0.5, k, power)


def score_quality(docs: DataFrame, model: Neighbours, threshold: float = 0.3, block: int = BLOCK) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 if score >= ``threshold``, else 0).

    Whole texts are scored, every row for itself; labelled rows of the very same
    text do not vote. Null and empty texts get the model's prior. Existing columns of the two names are replaced; an empty
    table gives no rows.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    own = "own_text" + "_" * max(map(len, docs.columns))
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table, known = class_table(), sent.value
        for batch in stream:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                score = known.vote(term_counts(part.column("text"), table), np.asarray(part.column(own)))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in rest), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=[*rest, "score", "predicted"]
                )

    schema = docs.select(*rest, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    return docs.select(*rest, F.xxhash64("text").alias(own)).mapInArrow(batches, schema)


def remainder(doc_id, of: int):
    """crc32 of doc_id as text, modulo ``of``; a null doc_id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def learnt(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Neighbours:
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return fit(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, learnt(spark, docs, sf_dir))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
