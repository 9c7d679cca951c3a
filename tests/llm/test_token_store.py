import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from blocklog.llm import token_store as op

NASTY = ["", None, "it's DON'T x<|endoftext|>y ÀÉß ẞ İstanbul ΣΑΣ é a b 1²3 ½ '' ''' 's'S", "  lead\x1ctrail \x85 x y  ", "µm ªº ÿŸ ...!!! a.b-c_d 'll''ve 日本語 \U0001f600x", "÷×ÿ", "x" * 3000, "word " * 9000, "á ́b", "\x00 a\x00b", "Don'TS 'RE'ALLY we'll"]


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=1, max_size=300))
def test_blocks_round_trip(ids):
    a = np.array(ids, np.uint32)
    assert (op.unpack_block(op.pack_block(a), 0) == a).all()


def test_outliers_do_not_widen_a_block():
    a = np.arange(4096, dtype=np.uint32) % 64
    plain = len(op.pack_block(a))
    a[7] = 49000
    assert len(op.pack_block(a)) == plain + 6


def test_segment_reads_a_part():
    ids = np.arange(20000, dtype=np.uint32) % 49408
    data = op.pack_segment([5, None], [15000, 5000], ids, block=512)
    docs, lengths, back = op.read_segment(data)
    assert docs == [5, None] and lengths.tolist() == [15000, 5000] and (back == ids).all()
    _, _, part = op.read_segment(data, 600, 1400)
    assert (part == ids[512:1536]).all()
    with pytest.raises(ValueError):
        op.read_segment(b"xxxx" + data[4:])


@pytest.mark.parametrize("cache", [800_000, 3])
def test_encoder_is_the_library(prose, monkeypatch, cache):
    monkeypatch.setattr(op, "CACHE", cache)
    op.worker_cache(f"tokens:{op.word_bpe()}").clear()
    t = Tokenizer.from_file(op.word_bpe())
    texts = NASTY + [prose(i, 80).title() + "," for i in range(5)]
    encoder = op.Encoder(op.word_bpe())
    for _ in range(3):
        n, ids = encoder.ids(pa.array(texts), 1)
        at = 0
        for x, k in zip(texts, n, strict=True):
            assert ids[at : at + k].tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 1]
            at += k
        assert at == len(ids)
    n, whole = op.Encoder(op.word_bpe(), whole=True).ids(pa.array(texts), 1)
    assert (whole == ids).all()


def test_documents_in_order(spark, tmp_path, prose):
    t = Tokenizer.from_file(op.word_bpe())
    rows = [(i * 7 % 40, x, "s") for i, x in enumerate(NASTY)] + [(None, "null id", "s"), (3, "twice", "s"), (3, "twice", "s")] + [(100 + i, prose(i, 50), "s") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    op.write_tokens(df, op.word_bpe(), 1, f"file://{tmp_path}/t", segment=100)
    got = sorted(op.read_tokens(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda d: -1 if d is None else d)
    texts, at = {}, 0
    for d, x, _ in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        texts.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in texts[r.doc_id]
        texts[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    assert op.encode_documents(df.limit(0)).count() == 0


def test_other_tokenizers_encode_whole_texts(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from blocklog.llm import token_store

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_store.by_words(token_store.word_bpe()) and not token_store.by_words(path)
    texts = ["Hello  world", " it's 42\n\nlines ", "", "é ß"]
    token_store.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, 0, f"file://{tmp_path}/t")
    got = token_store.read_tokens(spark, f"file://{tmp_path}/t").orderBy("doc_id").collect()
    own = Tokenizer.from_file(path)
    assert [r.n_tokens for r in got] == [len(own.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
