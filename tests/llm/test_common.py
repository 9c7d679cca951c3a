import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blocklog.llm.common import slices, staged, token_hashes

TEXTS = ["A b", "", "c D  e\t", " f", None, "É x\x1cy z", "g H", "b a b"]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("texts", [TEXTS, [t or "k" for t in TEXTS]])
@pytest.mark.parametrize("lower", [True, False])
def test_words_of_every_slice(kind, texts, lower):
    def want(text):
        raw = (text or "").encode()
        return [w.decode() for w in re.split(rb"[\x20\x09-\x0d]+", raw.lower() if lower else raw) if w]

    whole = pa.record_batch([pa.array(texts, kind)], ["text"])
    for at in range(len(texts) + 1):
        for n in range(len(texts) - at + 1):
            words, codes, starts = token_hashes(whole.slice(at, n).column("text"), lower)
            words = words.to_pylist()
            assert [[words[c] for c in codes[a:b]] for a, b in zip(starts, starts[1:])] == [*map(want, texts[at : at + n])]


def test_slices_hold_every_row_once():
    batch = pa.record_batch([pa.array(["x" * n for n in (5, 0, 50, 3, 3, 3, 0)] + [None, "é" * 4]), pa.array(range(9))], ["text", "i"])
    for rows, size in ((2, 100), (9, 8), (9, 1), (100, 1000)):
        got = [*slices(batch, rows, size)]
        assert [i for part in got for i in part.column("i").to_pylist()] == [*range(9)]
        assert all(part.num_rows <= rows and (part.num_rows == 1 or sum(len((t or "").encode()) for t in part.column("text").to_pylist()) <= size) for part in got)
    assert [*slices(batch.slice(0, 0), 3, 3)] == []


@pytest.mark.parametrize("release", [False, True])
def test_staged_releases_its_shuffle_files(spark, release):
    def files():
        found = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ").split()
        return {f for f in found if "/shuffle_" in f}

    before = files()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert len(staged(df, "released", release=release).collect()) == 7
    assert bool(files() - before) != release
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
