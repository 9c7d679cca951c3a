"""Token ids in patched frame-of-reference blocks.

A segment is one self-contained binary: header, document table, index of block
starts, blocks. A block holds up to BLOCK ids as their distance from the
block's minimum, packed at a width that a percentile of them fits; the others
stand in an exception list. Segments are rows of a Parquet table, so that any
store Spark reads can hold them.

Layout, all little-endian: ``TPF1``, u32 block size, u64 number of ids, u32
number of documents, u32 number of blocks; i64 doc_id and u64 length for each
document (and u8: whether doc_id is null); u64 start of each block; blocks: u32
minimum, u16 number of ids, u8 width, u16 number of exceptions, packed bits, u16
place and u32 distance of each exception.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, new_path, partitions, read_table, token_hashes, worker_cache

BLOCK = 4096
#: Ids after which a segment is closed; a longer document is a segment of its own.
SEGMENT = 1 << 20
MAGIC = b"TPF1"
#: Entries a worker's tables of encoded strings may have.
CACHE = 800_000
#: Documents encoded at once.
DOCS = 1500


# How the tokenizers that Encoder cuts into words normalise and split.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def by_words(tokenizer: str) -> bool:
    """Whether a tokenizers file normalises and splits as Encoder's word path assumes."""
    import json

    with open(tokenizer, encoding="utf-8") as f:
        held = json.load(f)
    before = held.get("pre_tokenizer") or {}
    return held.get("normalizer") == NORMALIZER and before.get("pretokenizers", [None])[0] == SPLIT and not held.get("post_processor")


def pack_block(ids, percentile: float = 98.0) -> bytes:
    import numpy as np

    low = int(ids.min())
    gaps = ids - np.uint32(low)
    at = max(0, int(len(ids) * percentile / 100 + 0.5) - 1)
    width = int(np.partition(gaps, at)[at]).bit_length()
    over = np.flatnonzero(gaps >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    kept = gaps.copy()
    kept[over] = 0
    size = 16 if width <= 16 else 32
    bits = np.unpackbits(kept.astype(f"<u{size // 8}").view(np.uint8), bitorder="little").reshape(-1, size)
    packed = np.packbits(bits[:, :width], bitorder="little").tobytes()
    head = struct.pack("<IHBH", low, len(ids) - 1, width, len(over))
    return head + packed + over.astype("<u2").tobytes() + gaps[over].astype("<u4").tobytes()


def unpack_block(data: bytes, at: int):
    import numpy as np

    low, n, width, over = struct.unpack_from("<IHBH", data, at)
    n, at = n + 1, at + 9
    packed = (n * width + 7) // 8
    size = 16 if width <= 16 else 32
    bits = np.zeros((n, size), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, packed, at), count=n * width, bitorder="little").reshape(n, width)
    gaps = np.packbits(bits, bitorder="little").view(f"<u{size // 8}").astype(np.uint32)
    at += packed
    gaps[np.frombuffer(data, "<u2", over, at)] = np.frombuffer(data, "<u4", over, at + 2 * over)
    return gaps + np.uint32(low)


def pack_segment(doc_ids: list, lengths, ids, block: int = BLOCK) -> bytes:
    """One binary of whole documents in order; ids are those of all, in a row."""
    import numpy as np

    blocks = [pack_block(ids[a : a + block]) for a in range(0, len(ids), block)]
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    head = MAGIC + struct.pack("<IQII", block, len(ids), len(doc_ids), len(blocks))
    table = known.tobytes() + np.asarray(lengths, "<u8").tobytes() + nulls.tobytes()
    starts = len(head) + len(table) + 8 * len(blocks) + np.concatenate([[0], np.cumsum([len(b) for b in blocks])])[:-1]
    return b"".join([head, table, starts.astype("<u8").tobytes(), *blocks])


def read_segment(data: bytes, first: int = 0, last: int | None = None):
    """(doc_ids, lengths, ids of the blocks that hold ids first to last)."""
    import numpy as np

    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    block, total, docs, blocks = struct.unpack_from("<IQII", data, 4)
    at = 24
    known = np.frombuffer(data, "<i8", docs, at)
    lengths = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
    nulls = np.frombuffer(data, np.uint8, docs, at + 16 * docs)
    starts = np.frombuffer(data, "<u8", blocks, at + 17 * docs)
    wanted = starts[first // block : None if last is None else last // block + 1]
    parts = [unpack_block(data, int(s)) for s in wanted]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return [None if n else int(d) for d, n in zip(known, nulls, strict=True)], lengths, ids


def gathered(begins, sizes, flat, order):
    """The runs flat[begins:begins + sizes] of each index in ``order``, in a row; and where each ends."""
    import numpy as np

    counts = sizes[order]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(begins[order] - (ends - counts), counts)], ends


class Table:
    """Strings and the ids they are encoded to, as flat arrays found by hash.

    Filled until it has CACHE entries; what comes later is encoded each time. It
    starts anew once most of what is asked for is lacking.
    """

    def __init__(self):
        import numpy as np
        import pyarrow as pa

        self.words = pa.array([], pa.large_string())
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def look_up(self, words, encode):
        """(index of each of some distinct ``words``, sizes, flat ids); ``encode`` gives the last two of words it lacks."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import xxhash

        hashed = xxhash.xxh64_intdigest
        h = np.array([hashed(w) for w in words.to_pylist()], np.uint64)
        pos = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
        hit = self.keys[pos] == h if len(self.keys) else np.zeros(len(h), bool)
        at = np.full(len(h), -1, np.int64)
        at[hit] = self.slots[pos[hit]]
        if hit.any():  # equal hashes are not equal words yet
            same = np.asarray(pc.equal(words.filter(pa.array(hit)), self.words.take(pa.array(at[hit]))))
            at[np.flatnonzero(hit)[~same]] = -1
        lacking = np.flatnonzero(at < 0)
        if len(lacking) * 2 > len(h) and len(self.words) >= CACHE:
            self.__init__()
            return self.look_up(words, encode)
        if not len(lacking):
            return at, self.sizes, self.flat
        new = words.take(pa.array(lacking))
        sizes, flat = encode(new)
        at[lacking] = len(self.sizes) + np.arange(len(lacking))
        sizes, flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
        if len(self.words) < CACHE:
            self.words = pa.concat_arrays([self.words, new])
            order = np.argsort(h[lacking])
            where = np.searchsorted(self.keys, h[lacking][order])
            self.keys = np.insert(self.keys, where, h[lacking][order])
            self.slots = np.insert(self.slots, where, at[lacking][order])
            self.sizes, self.flat = sizes, flat
        return at, sizes, flat


class Encoder:
    """A tokenizers file applied to the white-space pieces of texts, each once per worker.

    Exact only for tokenizers whose pre-tokenizer drops white space, so that no
    token spans it; ``whole`` encodes texts in one call instead. Words of ASCII
    and Latin letters, which Unicode normalisation leaves alone, are cut as the
    tokenizer's pre-tokenizer cuts them, and their pieces encoded; all other
    words go to the tokenizer as they are.
    """

    def __init__(self, path: str, whole: bool = False):
        import regex
        from tokenizers import Tokenizer

        self.whole = whole
        held = worker_cache(f"tokens:{path}")
        if not held:
            held.update(tokenizer=Tokenizer.from_file(path), words=Table(), pieces=Table())
        self.tokenizer, self.words, self.pieces = held["tokenizer"], held["words"], held["pieces"]
        self.plain = regex.compile(r"[\x21-\x7EÀ-ÖØ-öø-ÿ]+")
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def encode_pieces(self, pieces):
        import numpy as np

        sizes, flat = [], []
        some = pieces.to_pylist()
        for at in range(0, len(some), 2000):
            for e in self.tokenizer.encode_batch(some[at : at + 2000], add_special_tokens=False):
                sizes.append(len(e.ids))
                flat.extend(e.ids)
        return np.array(sizes, np.int64), np.array(flat, np.uint32)

    def encode_words(self, words):
        """Sizes and ids of words that are free of ASCII white space."""
        import numpy as np

        made = [self.encode_some(words[at : at + 50_000]) for at in range(0, len(words), 50_000)]
        return np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])

    def encode_some(self, words):
        import numpy as np
        import pyarrow as pa

        plain, cut = self.plain.fullmatch, self.cut.findall
        parts = [cut(w.lower()) if plain(w) and "<|" not in w else [w] for w in words.to_pylist()]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        coded = pa.array([p for ps in parts for p in ps], pa.large_string()).dictionary_encode()
        at, sizes, flat = self.pieces.look_up(coded.dictionary, self.encode_pieces)
        flat, ends = gathered(np.cumsum(sizes) - sizes, sizes, flat, at[np.asarray(coded.indices)])
        ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return np.diff(ends), flat

    def ids(self, texts, end: int):
        """(lengths, ids) of an Arrow array of texts, each closed by ``end``; null is empty."""
        import numpy as np

        if self.whole:
            rows = [np.array([*e.ids, end], np.uint32) for e in self.tokenizer.encode_batch([x.as_py() or "" for x in texts], add_special_tokens=False)]
            return np.array([len(r) for r in rows], np.int64), np.concatenate([*rows, np.zeros(0, np.uint32)])
        words, codes, starts = token_hashes(texts, lower=False)
        at, sizes, flat = self.words.look_up(words, self.encode_words)
        sizes, flat = np.append(sizes, 1), np.append(flat, np.uint32(end))
        begins = np.cumsum(sizes) - sizes
        order = np.insert(at[codes], starts[1:], len(sizes) - 1)  # the end id after each text's words
        found, ends = gathered(begins, sizes, flat, order)
        last = ends[starts[1:] + np.arange(len(starts) - 1)]
        return np.diff(last, prepend=0), found


def write_tokens(docs: DataFrame, tokenizer: str, end: int, path: str, segment: int = SEGMENT, whole: bool | None = None, parts: int | None = None) -> None:
    """Encode every whole text and write segments in ascending doc_id order.

    A null text is empty; a null doc_id comes first. Rows of one doc_id are
    ordered by the hash of their text and all kept, so that repeated ids can
    also be dealt to several partitions. An empty table writes no segments.
    ``whole`` encodes each text in one call; unset, that is done for tokenizers
    that by_words() doesn't know.
    Rows at ``path``: part, seg (both ascending), n_docs, n_ids, data.
    """
    import pyarrow as pa

    names = ["part", "seg", "n_docs", "n_ids", "data"]

    def segments(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, seg = TaskContext.get().partitionId(), 0
        encoder = Encoder(tokenizer, whole)
        ids: list = []
        lengths: list = []
        doc_ids: list = []
        held = 0

        def close():
            data = pack_segment(doc_ids, np.concatenate(lengths), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], names=names)

        for batch in stream:
            for at in range(0, batch.num_rows, DOCS):
                some = batch.slice(at, DOCS)
                n, found = encoder.ids(some.column("text"), end)
                lengths.append(n)
                ids.append(found)
                doc_ids.extend(some.column("doc_id").to_pylist())
                held += len(found)
                if held >= segment:
                    yield close()
                    seg, held, ids, lengths, doc_ids = seg + 1, 0, [], [], []
        if doc_ids:
            yield close()

    spark = docs.sparkSession
    whole = not by_words(tokenizer) if whole is None else whole
    bound_batches(spark)
    rows = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts or partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    rows.mapInArrow(segments, "part int, seg int, n_docs long, n_ids long, data binary").write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, seg) of each document, read from its segment.

    ``start`` counts the ids of all documents before it.
    """
    import pyarrow as pa

    def documents(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np

        for batch in stream:
            for part, seg, data in zip(batch.column("part"), batch.column("seg"), batch.column("data"), strict=True):
                doc_ids, lengths, ids = read_segment(data.as_py())
                ends = np.cumsum(lengths)
                raw, n = memoryview(ids.astype("<u4").tobytes()), len(doc_ids)
                sums = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(sums, pa.int64()), pa.array(np.full(n, part.as_py(), np.int32)), pa.array(np.full(n, seg.as_py(), np.int32))],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "part", "seg"],
                )

    stored = spark.read.schema("part int, seg int, n_docs long, n_ids long, data binary").parquet(path)
    rows = stored.select("part", "seg", "data").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, seg int")
    sizes = stored.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row for each partition written
    before, bases = 0, []
    for r in sizes:
        bases.append((r.part, before))
        before += r.n
    bases = spark.createDataFrame(bases, "part int, base long")
    own = stored.select("part", "seg", "n_ids").join(F.broadcast(bases), "part")
    own = own.selectExpr("part", "seg", "base + coalesce(sum(n_ids) OVER (PARTITION BY part ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base")
    return rows.join(own, ["part", "seg"]).select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "part", "seg")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, tokenizer: str | None = None, end: int = 1, path: str | None = None) -> DataFrame:
    """Write ``docs`` as token segments and read them back (see read_tokens)."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, tokenizer or word_bpe(), end, path)
    return read_tokens(spark, path)


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")
