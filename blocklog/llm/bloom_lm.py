"""Language-model scores from a log-frequency Bloom filter.

N-gram counts are quantised to levels of a logarithmic scale (Talbot and
Osborne, 2007): an n-gram of level q is entered into a Bloom filter with every
level from 1 to q. Probing level after level gives its quantised count back.
Probabilities interpolate bigrams and words.

The filter is cut into segments by hash, built in tasks of their own. A filter
of at most BROADCAST_FILTER bytes is broadcast to the workers. A larger one
stays where it is: each batch of documents sends its distinct n-grams to the
ranges of segments they belong to, and gets their levels back. A range's
n-grams pass its segments in bounded batches, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, raw_words, read_table, slices, staged, token_hashes

#: Bytes of filter and word counts that are broadcast; beyond, n-grams go to the segments.
BROADCAST_FILTER = 32 << 20
#: Bytes of text per segment.
SEGMENT_TEXT = 2 << 20
#: Ranges of segments that n-grams are sent to; more only where a range would hold over RANGE_SEGMENTS of them.
RANGES, RANGE_SEGMENTS = 512, 64
#: Filter bits per entry, probes per entry, ratio of count levels.
BITS, PROBES, RATIO = 10, 7, 1.3
#: What the end of a text hashes to; no word holds a line break.
END_WORD = b"\n"
#: Documents, and bytes of them, that are counted, and that are scored, at once.
COUNTED, COUNTED_BYTES = 4000, 6 << 20
DOCS, DOCS_BYTES = 1500, 2 << 20
#: Row groups of packed rows: written and read a few at a time, whatever their size.
ROW_GROUPS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}
#: Bytes of an Arrow batch between the executor and its workers. Buffers over 4 MB
#: bypass Netty's pool, and the JVM's allocator keeps much of what they leave.
SENT_BYTES = 2 << 20
#: N-grams that probe the filter at once.
PROBED = 1 << 17
#: How many times the expected number of successors a history must be seen to trust its bigrams by half.
CAUTION = 3.0


def thresholds():
    """Least count of each level, up to 2^62."""
    import numpy as np

    out = [1]
    while out[-1] < 1 << 62:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return np.array(out, np.int64)


def mixed(x):
    """A 64-bit finaliser (fixed constants of splitmix64)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_hash(first, second):
    import numpy as np

    return mixed(first * np.uint64(0x9E3779B97F4A7C15) + second)


def starts_of(hashes, level: int):
    """Start and step of the double hashing of (n-gram, level)."""
    import numpy as np

    a = mixed(hashes + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return a, mixed(a) | np.uint64(1)


def places(hashes, level: int, bits):
    """The PROBES bit places of (n-gram, level) one after the other, by double hashing."""
    import numpy as np

    a, b = starts_of(hashes, level)
    for i in range(PROBES):
        yield (a + np.uint64(i) * b) % bits


def text_codes(texts):
    """(hash of each distinct word, tokens as indices into it, first token of each text); each text has its end."""
    import numpy as np
    import xxhash

    words, codes, starts = token_hashes(texts)
    hashed = xxhash.xxh64_intdigest
    hashes = np.array([*(hashed(w, 7) for w in raw_words(words)), hashed(END_WORD, 7)], np.uint64)
    codes = np.insert(codes, starts[1:], len(hashes) - 1)
    return hashes, codes, starts + np.arange(len(starts))


def distinct_of(values):
    """(distinct values in order of appearance, each value's index into them), by hashing."""
    import pyarrow as pa

    coded = pa.array(values).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def segment_of(hashes, segments: int):
    import numpy as np

    return ((hashes >> np.uint64(32)) % np.uint64(segments)).astype(np.int64)


def dealt(hashes, segments: int, ranges: int):
    """Order of the n-grams by range of segments, and first of each range and one more."""
    import numpy as np

    place = (segment_of(hashes, segments) * ranges // segments).astype(np.uint16 if ranges <= 1 << 16 else np.int64)
    return np.argsort(place, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(place, minlength=ranges))])


def first_of(place, segments: int, ranges: int):
    """A range's first segment."""
    return -(-place * segments // ranges)


def sent_bytes(segments: int, ranges: int) -> int:
    """Bytes of an n-gram's hash that its range leaves open."""
    most = ((1 << 32) // segments + 1) * -(-segments // ranges) - 1
    return min(8, 4 + (most.bit_length() + 7) // 8)


def shortened(hashes, segments: int, ranges: int):
    """Hashes as records of sent_bytes: the lower half, and what their range leaves open of the upper."""
    import numpy as np

    size = sent_bytes(segments, ranges)
    if size < 8:
        seg, top = segment_of(hashes, segments), hashes >> np.uint64(32)
        own = (seg - first_of(seg * ranges // segments, segments, ranges)).astype(np.uint64)
        hashes = (top // np.uint64(segments) * np.uint64(-(-segments // ranges)) + own) << np.uint64(32) | hashes & np.uint64((1 << 32) - 1)
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :size]).view(f"V{size}").ravel()


def restored(records, place: int, segments: int, ranges: int):
    """The hashes that shortened() made of n-grams of a range."""
    import numpy as np

    size, width = records.itemsize, np.uint64(-(-segments // ranges))
    out = np.zeros((len(records), 8), np.uint8)
    out[:, :size] = np.ascontiguousarray(records).view(np.uint8).reshape(-1, size)
    out = out.view(np.uint64).ravel()
    if size == 8:
        return out
    left = out >> np.uint64(32)
    top = left // width * np.uint64(segments) + left % width + np.uint64(first_of(place, segments, ranges))
    return top << np.uint64(32) | out & np.uint64((1 << 32) - 1)


def gathered(stream: Iterator, rows: int, size: int) -> Iterator:
    """The Arrow batches of texts of a stream, put together or cut to at most ``rows`` rows and about ``size`` bytes."""
    import pyarrow as pa

    held, n, total = [], 0, 0
    for batch in stream:
        for part in slices(batch, rows, size):
            if held and (n + part.num_rows > rows or total + part.nbytes > size):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n, total = [], 0, 0
            held.append(part)
            n, total = n + part.num_rows, total + part.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def thin(batch) -> Iterator:
    """Slices of an Arrow batch of about SENT_BYTES."""
    step = -(-batch.num_rows // max(1, -(-batch.nbytes // SENT_BYTES)))
    for at in range(0, batch.num_rows, max(1, step)):
        yield batch.slice(at, step)


def free() -> None:
    """Give back what Arrow keeps of the last batch."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def flat(column, kind):
    """(values of a binary Arrow array one after the other, first value of each row and one more); nulls are empty."""
    import numpy as np
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(x.cast(pa.large_binary()) for x in column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    values = np.frombuffer(data, kind, (ends[-1] - ends[0]) // size, ends[0]) if data and ends[-1] > ends[0] else np.zeros(0, kind)
    return values, (ends - ends[0]) // size


def cut(values, ends):
    """A binary Arrow array of the values from each end to the next."""
    import numpy as np
    import pyarrow as pa

    offsets = (np.asarray(ends) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))])


@dataclass
class Filter:
    """Filter bits of segments first to last, and exact word counts sorted by hash."""

    first: int
    last: int
    bits: object
    offsets: object
    sizes: object
    words: object
    counts: object

    @classmethod
    def of_range(cls, first: int, last: int, rows: list[tuple[int, bytes, bytes, bytes]]) -> Filter:
        """The filter of segments first to last from their (number, bits, words, counts)."""
        import numpy as np

        offsets, sizes = np.zeros(last - first + 1, np.int64), np.zeros(last - first + 1, np.int64)
        at = 0
        for seg, bits, *_ in rows:
            offsets[seg - first], sizes[seg - first] = at, 8 * len(bits)
            at += len(bits)
        bits, words, counts = (np.frombuffer(b"".join(r[i] for r in rows), t) for i, t in ((1, np.uint8), (2, np.uint64), (3, np.int64)))
        order = np.argsort(words)
        return cls(first, last, bits, offsets, sizes, words[order], counts[order])

    def levels(self, hashes, segments: int, limit: int):
        """Quantised count level of each n-gram that belongs here, else 0."""
        import numpy as np

        out = np.zeros(len(hashes), np.uint8)
        for at in range(0, len(hashes), PROBED):
            self._probe(hashes[at : at + PROBED], segments, limit, out[at : at + PROBED])
        return out

    def _probe(self, hashes, segments: int, limit: int, out) -> None:
        """Level by level, set ``out`` of the n-grams still held."""
        import numpy as np

        seg = segment_of(hashes, segments)
        alive = np.flatnonzero((seg >= self.first) & (seg <= self.last))
        seg = seg[alive] - self.first
        alive, seg = alive[self.sizes[seg] > 0], seg[self.sizes[seg] > 0]
        for level in range(1, limit + 1):
            if not len(alive):
                break
            h, size, base = hashes[alive], self.sizes[seg].astype(np.uint64), self.offsets[seg]
            held = np.arange(len(alive))
            a, b = starts_of(h, level)
            for i in range(PROBES):
                at = ((a[held] + np.uint64(i) * b[held]) % size[held]).astype(np.int64)
                held = held[(self.bits[base[held] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1]
            alive, seg = alive[held], seg[held]
            out[alive] = level

    def exact(self, hashes):
        """Exact training counts of words that belong here, else 0."""
        import numpy as np

        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.counts[at], 0)


@dataclass
class Model:
    """Totals of the training tokens, and where the segments are stored."""

    tokens: int
    types: int
    once: int
    segments: int
    table: DataFrame
    #: Bytes of filter bits, and words, of all segments.
    size: tuple
    grown: object

    def rates(self):
        """(probability of a word by level, share of the bigram estimate by level of the history).

        Unknown words together get the Good-Turing mass of words seen once. A
        history seen c times trusts its bigrams by c / (c + CAUTION T(c)), T(c) being the
        number of distinct words that c tokens of the corpus are expected to
        hold (with CAUTION 1 the Witten-Bell weight of unbiased followers).
        """
        import numpy as np

        t = thresholds().astype(float)
        count = np.concatenate([[0.0], np.sqrt(t[:-1] * np.maximum(t[1:] - 1, t[:-1])), [t[-1]]])
        unknown = min((self.once + 1) / (self.tokens + 2), 0.5) if self.tokens else 1.0
        word = np.concatenate([[unknown], (1 - unknown) * np.minimum(count[1:], max(self.tokens, 1)) / max(self.tokens, 1)])
        values, numbers = self.grown
        share = values / max(self.tokens, 1)
        distinct = np.array([(numbers * -np.expm1(c * np.log1p(-np.minimum(share, 1 - 1e-12)))).sum() if len(values) else 0.0 for c in count])
        return count, np.maximum(word, 1e-300), np.where(count > 0, count / np.maximum(count + CAUTION * distinct, 1e-9), 0)


def train(docs: DataFrame) -> Model:
    """Count words and bigrams of every text of ``docs`` and build the filter's segments.

    Words are lower-cased (A-Z) and split at ASCII white space; each text ends
    with an end token, which is also the history of its first. Null texts are
    empty. Nothing is sampled or pruned. The segment count follows the text's
    bytes, so each segment is built from a bounded number of n-grams.
    """
    import numpy as np
    import pyarrow as pa

    bound_batches(docs.sparkSession, SENT_BYTES)
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).head().n or 0
    segments = max(8, size // SEGMENT_TEXT)

    def tallied(texts) -> pa.RecordBatch:
        """The n-grams of texts with their counts, packed by segment."""
        hashes, codes, starts = text_codes(texts)
        before = np.concatenate([[len(hashes) - 1], codes[:-1]])
        pair, back = distinct_of(before * len(hashes) + codes)
        grams = [(hashes, np.bincount(codes, minlength=len(hashes))), (pair_hash(hashes[pair // len(hashes)], hashes[pair % len(hashes)]), np.bincount(back, minlength=len(pair)))]
        del codes, before, pair, back
        parts = []
        for kind, (h, n) in enumerate(grams):
            h, n = h[n > 0], n[n > 0].astype(np.uint32)
            order, ends = dealt(h, segments, segments)
            some = np.flatnonzero(np.diff(ends))
            ends = [*ends[some], len(h)]
            parts.append((pa.array(some), pa.array(np.full(len(some), kind, np.int32)), cut(h[order], ends), cut(n[order], ends)))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*parts, strict=True)], names=["seg", "kind", "h", "n"])

    def counted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(stream, COUNTED, COUNTED_BYTES):
            yield from thin(tallied(batch.column("text")))
            free()

    def built(table: pa.Table) -> pa.Table:
        levels, sums = thresholds(), []
        kinds = table["kind"].to_numpy()
        for kind in (0, 1):
            rows = table.filter(pa.array(kinds == kind))
            h, n = flat(rows["h"], np.uint64)[0], flat(rows["n"], np.uint32)[0]
            own, back = np.unique(h, return_inverse=True)
            sums.append((own, np.bincount(back, weights=n, minlength=len(own)).astype(np.int64)))
        h = np.concatenate([sums[0][0], sums[1][0]])
        q = np.searchsorted(levels, np.concatenate([sums[0][1], sums[1][1]]), side="right")
        bits = np.uint64((int(q.sum()) * BITS + 63) // 64 * 64)
        flags = np.zeros(int(bits), np.uint8)
        for level in range(1, int(q.max(initial=0)) + 1):
            for at in places(h[q >= level], level, bits):
                flags[at.astype(np.int64)] = 1
        values, numbers = np.unique(sums[0][1], return_counts=True)
        data = [table["seg"][0].as_py(), np.packbits(flags, bitorder="little").tobytes(), sums[0][0].tobytes(), sums[0][1].tobytes(), values.tolist(), numbers.tolist()]
        return pa.table([pa.array([x], t) for x, t in zip(data, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=["seg", "bits", "words", "counts", "freqs", "numbers"])

    packed = docs.select("text").mapInArrow(counted, "seg long, kind int, h binary, n binary")
    table = staged(packed.groupBy("seg").applyInArrow(built, "seg long, bits binary, words binary, counts binary, freqs array<long>, numbers array<long>"), "lm-segments", release=True)
    spectrum = table.select(F.explode(F.arrays_zip("freqs", "numbers")).alias("x")).groupBy(F.col("x.freqs").alias("f")).agg(F.sum("x.numbers").alias("n"))
    seen = spectrum.groupBy(F.floor(F.log2("f") * 8).alias("step")).agg(F.sum(F.col("f") * F.col("n")).alias("tokens"), F.sum("n").alias("n"), F.sum(F.when(F.col("f") == 1, F.col("n")).otherwise(0)).alias("once")).collect()
    size = table.agg(F.sum(F.octet_length("bits")).alias("bits"), F.sum(F.octet_length("words")).alias("words")).head()
    tokens, types = sum(int(r.tokens) for r in seen), sum(int(r.n) for r in seen)
    grown = np.array([r.tokens / r.n for r in seen], float), np.array([r.n for r in seen], float)
    return Model(tokens, types, sum(int(r.once) for r in seen), segments, table, (size.bits or 0, (size.words or 0) // 8), grown)


def load(model: Model) -> Filter:
    """All segments in one; only for models of at most BROADCAST_FILTER bytes."""
    import numpy as np

    sizes, offsets = np.zeros(model.segments, np.int64), np.zeros(model.segments, np.int64)
    bits = np.zeros(model.size[0], np.uint8)
    words, counts = np.zeros(model.size[1], np.uint64), np.zeros(model.size[1], np.int64)
    at = n = 0
    for r in model.table.select("seg", "bits", "words", "counts").toLocalIterator():
        sizes[r.seg], offsets[r.seg] = 8 * len(r.bits), at
        bits[at : at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
        own = np.frombuffer(r.words, np.uint64)
        words[n : n + len(own)], counts[n : n + len(own)] = own, np.frombuffer(r.counts, np.int64)
        at, n = at + len(r.bits), n + len(own)
    order = np.argsort(words)
    counts = counts[order]
    return Filter(0, model.segments - 1, bits, offsets, sizes, words[order], counts.astype(np.uint32) if counts.max(initial=0) < 1 << 32 else counts)


def score(docs: DataFrame, model: Model, broadcast: int = BROADCAST_FILTER, keep: list[str] | None = None) -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score and score to every row, with the columns ``keep`` (all).

    ``base_score`` is the add-one estimate from exact counts. ``score`` is the
    model's log10 probability of the text, from filter probes only. Null texts
    are empty and consist of their end. Existing columns of these names are
    replaced; an empty table gives no rows. A model of no tokens scores 0.

    ``broadcast`` bounds what is sent to every worker. Either way gives the same
    scores, and costs in proportion to the texts.
    """
    import numpy as np
    import pyarrow as pa

    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rest = [c for c in keep or docs.columns if c not in made]
    docs = docs.select(*dict.fromkeys([*rest, "text"]))
    spark, segments, limit = docs.sparkSession, model.segments, len(thresholds())
    bound_batches(spark, SENT_BYTES)
    totals, rates = (model.tokens, model.types), model.rates()
    zero = F.lit(0).cast("long")
    done = docs.select(*rest).withColumns({"n_tokens": zero, "n_known": zero, "train_tokens": zero, "base_score": F.lit(0.0), "score": F.lit(0.0)}).schema

    def summed(columns: list, codes, starts, u, b, exact):
        """Rows of a batch from each token's word level, bigram level and exact word count."""
        count, word_rate, trust = rates
        h = np.concatenate([u[-1:], u[:-1]])  # a text's first token follows the end token, and some text's end comes before it
        seen = np.where(b > 0, np.minimum(count[b] / np.maximum(count[h], 1), 1), 0)
        rate = trust[h] * seen + (1 - trust[h]) * word_rate[u]
        found = np.add.reduceat(np.log10(np.maximum(rate, 1e-300)), starts[:-1])
        known = np.add.reduceat((exact > 0).astype(np.int64), starts[:-1])
        lengths = np.diff(starts)
        base = np.add.reduceat(np.log10(exact + 1.0), starts[:-1]) - lengths * np.log10(totals[0] + totals[1] + 1)
        columns = [*columns, pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), totals[0], np.int64)), pa.array(base), pa.array(np.minimum(found, 0.0))]
        return pa.RecordBatch.from_arrays(columns, names=done.names)

    def grams(texts):
        """Hashes of a batch's distinct words and of its distinct pairs, each token as an index into the words, its pair's, and each text's first token."""
        hashes, codes, starts = text_codes(texts)
        before = np.concatenate([[len(hashes) - 1], codes[:-1]])
        pair, back = distinct_of(before * len(hashes) + codes)
        return hashes, pair_hash(hashes[pair // len(hashes)], hashes[pair % len(hashes)]), codes, back, starts

    if model.size[0] + 16 * model.size[1] <= broadcast:
        sent = spark.sparkContext.broadcast(load(model))

        def row_scores(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = sent.value
            words, pairs, codes, back, starts = grams(batch.column("text"))
            return summed([batch.column(c) for c in rest], codes, starts, own.levels(words, segments, limit)[codes], own.levels(pairs, segments, limit)[back], own.exact(words)[codes])

        def scored(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in gathered(stream, DOCS, DOCS_BYTES):
                yield row_scores(batch)
                free()

        return docs.mapInArrow(scored, done)

    ranges = min(segments, max(RANGES, -(-segments // RANGE_SEGMENTS)))
    record = f"V{sent_bytes(segments, ranges)}"

    # texts in packed batches, each a row with a number of its own
    def batched(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in gathered(stream, DOCS, COUNTED_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "rows"])
            number += 1

    def opened(data: bytes) -> pa.RecordBatch:
        return pa.ipc.open_stream(data).read_next_batch()

    def request(number: int, texts) -> pa.RecordBatch:
        words, pairs = grams(texts)[:2]
        (w, w_ends), (p, p_ends) = dealt(words, segments, ranges), dealt(pairs, segments, ranges)
        some = np.flatnonzero(np.diff(w_ends) + np.diff(p_ends))
        n = len(some)
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.ones(n, np.int32)), pa.array(np.full(n, number)), cut(shortened(pairs[p], segments, ranges), [*p_ends[some], len(p)]), cut(shortened(words[w], segments, ranges), [*w_ends[some], len(w)]), pa.nulls(n, pa.binary())], names=["place", "kind", "number", "data", "words", "counts"])

    def asked(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in stream:
            for number, data in zip(x.column("batch").to_pylist(), x.column("rows"), strict=True):
                yield from thin(request(number, opened(data.as_buffer()).column("text")))
                free()

    def answered(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Levels and exact counts of the n-grams sent to each range, whose segments come before them."""
        place, held, own = -1, [], None
        for x in stream:
            places, kinds = x.column("place").to_numpy(), x.column("kind").to_numpy()
            edges = [0, *np.flatnonzero((np.diff(places) != 0) | (np.diff(kinds) != 0)) + 1, x.num_rows]
            for at, end in zip(edges, edges[1:], strict=False):
                if at == end:
                    continue
                part = x.slice(at, end - at)
                if places[at] != place:
                    place, held, own = int(places[at]), [], None
                if kinds[at] == 0:
                    held += zip(*(part.column(c).to_pylist() for c in ("number", "data", "words", "counts")), strict=True)
                    continue
                if own is None:
                    own, held = Filter.of_range(first_of(place, segments, ranges), first_of(place + 1, segments, ranges) - 1, held), []
                (pairs, p_ends), (words, w_ends) = ((restored(v, place, segments, ranges), ends) for v, ends in (flat(part.column(c), record) for c in ("data", "words")))
                yield pa.RecordBatch.from_arrays([part.column("number"), part.column("place"), cut(own.levels(pairs, segments, limit), p_ends), cut(own.levels(words, segments, limit), w_ends), cut(own.exact(words).astype(np.int64), w_ends)], names=["batch", "place", "pairs", "words", "counts"])

    def finished(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["place"].to_numpy())
        answers = {c: right[c].to_pylist() for c in ("pairs", "words", "counts")}

        def back_in(name: str, kind, place):
            """The answers in the order of the batch's n-grams."""
            got = np.frombuffer(b"".join(answers[name][i] for i in order), kind)
            if len(got) != len(place):
                raise RuntimeError(f"{len(got)} of {len(place)} n-grams of a batch were answered")
            out = np.empty(len(got), kind)
            out[place] = got
            return out

        out = []
        for data in left["rows"].to_pylist():
            batch = opened(data)
            words, pairs, codes, back, starts = grams(batch.column("text"))
            w, p = dealt(words, segments, ranges)[0], dealt(pairs, segments, ranges)[0]
            out.append(summed([batch.column(c) for c in rest], codes, starts, back_in("words", np.uint8, w)[codes], back_in("pairs", np.uint8, p)[back], back_in("counts", np.int64, w)[codes]))
        free()
        return pa.Table.from_batches(out)

    rows = staged(docs.mapInArrow(batched, "batch long, rows binary"), "lm-batches", options=ROW_GROUPS)
    stored = model.table.select(F.expr(f"CAST(seg * {ranges} DIV {segments} AS INT)").alias("place"), F.lit(0).alias("kind"), F.col("seg").alias("number"), F.col("bits").alias("data"), "words", "counts")
    met = stored.union(rows.mapInArrow(asked, stored.schema)).repartition("place").sortWithinPartitions("place", "kind")
    answers = staged(met.mapInArrow(answered, "batch long, place int, pairs binary, words binary, counts binary"), "lm-answers", release=True, options=ROW_GROUPS | {"compression": "zstd"})
    return rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finished, done)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    docs = docs.withColumn("held_out", held)
    model = train(docs.where("NOT held_out"))
    return score(docs, model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
