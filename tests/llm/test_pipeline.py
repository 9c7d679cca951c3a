"""The pipeline's stages, each against a plain version on its own input."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from blocklog.llm import decontaminate, near_dedup, token_store
from blocklog.llm.mixing import budgets


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    """Input and output rows of each stage, written and read again between them."""
    folder, docs, out = tmp_path_factory.mktemp("p"), spark.read.parquet(f"{data}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, data).write.parquet(f"file://{folder}/{name}")
        docs = spark.read.parquet(f"file://{folder}/{name}")
        out[name] = before, docs
    return out


def test_order_and_columns(stages, spark, data):
    assert list(stages) == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "mixing to target weights", "token output"]
    columns = spark.read.parquet(f"{data}/documents.parquet").columns
    assert all(after.columns == columns for before, after in [*stages.values()][:-1])


def test_quality(stages, spark, data):
    before, after = stages["quality classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    had, kept = ({r.doc_id for r in x.collect()} for x in (before, after))
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    good = [d for d in held if labels[d]]
    assert kept < had and sum(d in kept for d in good) >= 0.95 * len(good)


def test_near_dedup(stages):
    before, after = stages["simhash near-dedup"]
    rows = sorted((r.doc_id, near_dedup.simhash(r.text)) for r in before.collect())
    label = {d: d for d, _ in rows}
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if (x ^ y).bit_count() <= 4 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {d: low if g == high else g for d, g in label.items()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(label.values()))


def test_decontamination(stages, spark, data):
    before, after = stages["benchmark decontamination"]
    from test_decontaminate import brute

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    found = brute([(r.doc_id, r.text) for r in before.collect()], items, 10)
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, _, hit, _ in found if not hit)
    assert decontaminate.SEPARATORS


def test_mixing(stages):
    before, after = stages["mixing to target weights"]
    key = lambda r: (f"domain{int(r.source[-1]) % 3}", r.lang, r.source)
    size = {r.doc_id: (key(r), len(r.text.encode().split())) for r in before.collect()}
    tokens = {}
    for leaf, n in size.values():
        tokens[leaf] = tokens.get(leaf, 0) + n
    given = budgets(tokens, 0.5 * sum(tokens.values()), {}, 2)
    taken, last = dict.fromkeys(tokens, 0), {}
    for r in after.collect():
        leaf, n = size[r.doc_id]
        taken[leaf] += n
        last[leaf] = max(last.get(leaf, 0), n)
    assert all(given[leaf] <= taken[leaf] < given[leaf] + max(last.get(leaf, 1), 1) for leaf in tokens if given[leaf])


def test_tokens(stages):
    before, after = stages["token output"]
    t = Tokenizer.from_file(token_store.word_bpe())
    want, at = [], 0
    for r in sorted(before.collect(), key=lambda r: r.doc_id):
        ids = np.array([*t.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, after.collect())) == sorted(want)


def test_run_is_the_stages(stages, spark, data):
    got = corpus_pipeline.run(spark, data)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages["token output"][1].collect()))
