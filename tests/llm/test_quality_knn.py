import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from blocklog.llm import quality_knn as op


def junk(prose, i):
    return " | ".join(prose(i, 40).split()) if i % 2 else "!! ".join(prose(i, 40).upper().split())


def test_held_out_accuracy_and_edges(spark, prose):
    docs = [(i, junk(prose, i) if i % 3 == 0 else prose(i, 20 + i % 200), "s", 9) for i in range(300)]
    df = spark.createDataFrame(docs + [(1000, None, "s", 9), (1001, "", "s", 9), (1, docs[1][1], "s", 9)], "doc_id long, text string, score string, predicted long")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(240)] + [(None, 1), (5, None), (5, 1), (77777, 0)], "doc_id long, quality int")
    model = op.fit(df, labels, sample=150)
    assert 145 <= len(model.labels) <= 150 and abs(model.prior - 2 / 3) < 0.15
    got = {r.doc_id: r for r in op.score_quality(df, model).collect()}
    right = [got[i].predicted == int(i % 3 != 0) for i in range(240, 300)]
    assert np.mean(right) > 0.95
    assert got[1000].score == got[1001].score == model.prior
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert op.score_quality(df, model).count() == len(docs) + 3


def test_votes_are_those_of_all_pairs(spark, prose):
    docs = [(i, junk(prose, i) if i % 3 == 0 else prose(i, 50)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = op.fit(df, df.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality")), k=5)
    counts = op.term_counts(pa.array([t for _, t in docs]), op.class_table())
    got = {r.doc_id: r.score for r in op.score_quality(df, model, block=7).collect()}
    for (i, text), v in zip(docs, model.project(counts), strict=True):
        own = xxhash.xxh64_intdigest(text.encode(), 42)
        near = [(float(v @ w), y) for w, y, t in zip(model.vectors, model.labels, model.texts, strict=True) if int(t) % (1 << 64) != own]
        assert len(near) == 59
        near = sorted(near, reverse=True)[:5]
        want = sum(max(s, 0) ** 8 * y for s, y in near) / sum(max(s, 0) ** 8 for s, _ in near)
        assert abs(got[i] - want) < 1e-3


def test_words_decide_where_signs_tell_nothing(spark):
    """Texts of two word lists with equal shapes: the same letter classes, lengths and signs."""
    good, bad = ([f"{c}{v}{c}{w}{d}" for c in cs for v in "aeiou" for w in "aeiou" for d in cs] for cs in ("bcdf", "klmn"))

    def text(i):
        r = random.Random(i)
        return " ".join(r.choice(good if i % 2 else bad) + r.choice(["", "", ",", "."]) for _ in range(60 + r.randrange(60)))

    df = spark.createDataFrame([(i, text(i)) for i in range(400)], "doc_id long, text string")
    model = op.fit(df, df.where("doc_id < 300").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    got = {r.doc_id: r.score for r in op.score_quality(df, model).collect()}
    held = range(300, 400)
    assert np.mean([(got[i] >= 0.5) == (i % 2 == 1) for i in held]) > 0.95
    signs = op.term_counts(pa.array([text(i) for i in held]), op.class_table())[:, op.WORDS : op.TERMS - 3].reshape(50, 2, -1)
    assert np.allclose(signs[:, 0].mean(0), signs[:, 1].mean(0), atol=0.5)


def test_terms_against_plain_counting(prose):
    table = op.class_table()
    texts = ["a a b a a b", None, "", " \t", "Ab, ab. AB", prose(3, 500), "x" * 5000 + " y" * 3000]
    whole = op.term_counts(pa.array(texts), table)
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        words = raw.lower().split()
        pairs = [*zip(words, words[1:])]
        most = max(len(words), 1)
        ratios = [sum(a == b for a, b in pairs) / most, (len(words) - len(set(words))) / most, (len(pairs) - len(set(pairs))) / most]
        assert np.allclose(whole[i, op.TERMS - 3 :], np.log1p(1000 * np.array(ratios)), rtol=1e-5)
        two = np.zeros(op.CLASSES**2)
        for a, b in zip(raw, raw[1:]):
            two[int(table[a]) * op.CLASSES + int(table[b])] += 1000 / len(raw)
        assert np.allclose(whole[i, op.WORDS : op.TERMS - 3], np.log1p(two), rtol=1e-5)
        assert np.isclose(np.expm1(whole[i, : op.WORDS]).sum(), len(words), rtol=1e-4)
    assert (whole[1] == whole[2]).all() and not whole[1].any()
    for at in range(len(texts)):
        assert (op.term_counts(pa.array(texts).slice(at, 2), table) == whole[at : at + 2]).all()


def test_no_labels_and_no_documents(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert op.score_quality(df, op.fit(df, none)).head().score == 0.5
    assert op.score_quality(df.limit(0), op.fit(df, none)).count() == 0


def test_long_texts_count_whole():
    short = "ab | " * 1000
    one, many = op.term_counts(pa.array([short, short * 300]), op.class_table())[:, op.WORDS : op.TERMS - 3]
    assert np.allclose(one, many, atol=0.02)
