import math
from collections import Counter

import numpy as np
import pytest

from blocklog.llm import bloom_lm as op


def words(text):
    return (text or "").encode().lower().split() + [b"\n"]


def chained(prose, seed, n):
    """Text whose every other word follows from the one before."""
    return " ".join(f"{w} {w[::-1]}x" for w in prose(seed, n // 2).split())


@pytest.mark.parametrize("broadcast", [192 << 20, 0])
def test_counts_and_base(spark, prose, monkeypatch, broadcast):
    monkeypatch.setattr(op, "DOCS", 7)
    train = [(i, chained(prose, i, 40 + i)) for i in range(60)] + [(900, None), (901, "A a\x1cb")]
    held = [(1000 + i, chained(prose, 500 + i, 60) + " unseen") for i in range(20)] + [(2000, None), (2001, ""), (2001, ""), (2002, "a " * 30000)]
    model = op.train(spark.createDataFrame(train, "doc_id long, text string"))
    c = Counter(w for _, t in train for w in words(t))
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.types, model.once) == (n, v, sum(x == 1 for x in c.values()))
    df = spark.createDataFrame([(i, t, "x") for i, t in held], "doc_id long, text string, score string")
    got = op.score(df, model, broadcast).collect()
    assert sorted(round(r.score, 9) for r in got) == sorted(round(r.score, 9) for r in op.score(df, model).collect())
    assert len(got) == len(held)
    for r in got:
        w = words(dict(held)[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score <= 0
    own = [r for r in got if 1000 <= r.doc_id < 2000]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)


def test_filter_gives_quantised_counts_back(spark, prose):
    train = [(i, "the " * 50 + prose(i, 100)) for i in range(20)]
    model = op.train(spark.createDataFrame(train, "doc_id long, text string"))
    shard = op.load(model)
    c = Counter(w for _, t in train for w in words(t))
    import xxhash

    names = list(c)
    h = np.array([xxhash.xxh64_intdigest(w, 7) for w in names], np.uint64)
    q = shard.levels(h, model.segments, len(op.thresholds()))
    want = np.searchsorted(op.thresholds(), [c[w] for w in names], side="right")
    assert (q >= want).all() and (q == want).mean() > 0.95
    assert shard.exact(h).tolist() == [c[w] for w in names]
    other = np.random.default_rng(1).integers(0, 2**63, 20000).astype(np.uint64)
    assert (shard.levels(other, model.segments, 60) > 0).mean() < 0.02


def test_probabilities_of_a_history_sum_to_about_one(spark, prose):
    train = [(i, prose(i, 300)) for i in range(30)]
    model = op.train(spark.createDataFrame(train, "doc_id long, text string"))
    count, word, trust = model.rates()
    c = Counter(w for _, t in train for w in words(t))
    level = np.searchsorted(op.thresholds(), list(c.values()), side="right")
    assert abs(word[level].sum() + word[0] - 1) < 0.1
    assert (trust >= 0).all() and (trust <= 1).all()


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = op.train(none)
    row = op.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).head()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    assert op.score(none, model).count() == op.score(none, model, 0).count() == 0


def test_batches_beyond_the_first_slice(spark, prose):
    docs = [(i, f"{prose(i, 6).upper()} w{i % 700}") for i in range(2 * op.COUNTED + 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    model = op.train(df)
    c = Counter(w for _, t in docs for w in words(t))
    assert (model.tokens, model.types) == (sum(c.values()), len(c))
    for r in op.score(df, model).collect():
        w = words(docs[r.doc_id][1])
        assert (r.n_tokens, r.n_known) == (len(w), len(w))
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (model.tokens + len(c) + 1)) for x in w), rel_tol=1e-9)


def test_many_segments_beyond_the_broadcast(spark, prose, monkeypatch):
    """Rows that meet the segments follow ranges and batches of texts, not segments; a range's rows come in several Arrow batches."""
    docs = [(i, chained(prose, i, 40) + f" own{i}") for i in range(60)] + [(900, None), (901, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    kept, staged = {}, op.staged
    for name, value in (("SEGMENT_TEXT", 64), ("RANGES", 5), ("RANGE_SEGMENTS", 1 << 20), ("DOCS", 7)):
        monkeypatch.setattr(op, name, value)
    monkeypatch.setattr(op, "staged", lambda frame, name, *a, **b: kept.setdefault(name, staged(frame, name, *a, **b)))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        model = op.train(df)
        near, far = ({r.doc_id: r for r in op.score(df, model, broadcast).collect()} for broadcast in (192 << 20, 0))
    finally:
        spark.conf.set(key, before)
    batches = kept["lm-batches"].count()
    assert model.segments > 200 and batches > 8
    assert kept["lm-answers"].count() <= 5 * batches
    c = Counter(w for _, t in docs for w in words(t))
    n, v = sum(c.values()), len(c)
    for i, text in docs:
        w = words(text)
        assert (far[i].n_tokens, far[i].n_known, far[i].train_tokens) == (len(w), len(w), n)
        assert math.isclose(far[i].base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(far[i].score, near[i].score, rel_tol=1e-9)


@pytest.mark.parametrize("segments", [8, 256, 257, 353, 513, 4101, 32769, 700001])
def test_shortened_hashes_come_back(segments):
    ranges = min(segments, max(op.RANGES, -(-segments // op.RANGE_SEGMENTS)))
    h = np.concatenate([np.random.default_rng(1).integers(0, 2**64, 5000, np.uint64), np.array([0, 2**32 - 1, 2**63, 2**64 - 1], np.uint64)])
    order, ends = op.dealt(h, segments, ranges)
    records = op.shortened(h[order], segments, ranges)
    assert records.itemsize == (8 if segments <= 256 else 7)
    back = [op.restored(records[ends[p] : ends[p + 1]], p, segments, ranges) for p in range(ranges)]
    assert (np.concatenate(back) == h[order]).all()
