import re

import pytest
from pyspark.sql import functions as F

from blocklog.llm import decontaminate as op

DOCS, ITEMS = "doc_id long, text string, item_id string, copy long", "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, size):
    windows = [(str(i), tuple(w[a : a + size])) for i, t in items for w in [words(t)] if w for a in range(max(1, len(w) - size + 1))]
    out = []
    for d, t, *_ in docs:
        w, hit, ids = words(t), set(), set()
        for i, x in windows:
            for a in range(len(w) - len(x) + 1):
                if tuple(w[a : a + len(x)]) == x:
                    hit.update(range(a, a + len(x)))
                    ids.add(i)
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def test_against_brute_force(spark, prose):
    items = [(1, prose(1, 25)), (2, "Ka ba, zed!"), (3, None), (4, "..."), (5, prose(1, 25)), (6, prose(2, 12)), (10, "ka ka ka ka"), (11, "Éa X9")]
    docs = [(i, prose(100 + i, 60), "x", 7) for i in range(6)]
    docs += [
        (10, prose(50, 20) + " -- " + prose(1, 25).upper().replace("É", "é") + " " + prose(51, 5), "x", 7),
        (11, "ka   BA zed", "x", 7),
        (11, "ka BA zee", "x", 7),
        (12, " ".join(prose(2, 12).split()[:10]), "x", 7),
        (13, " ".join(prose(2, 12).split()[:9]), "x", 7),
        (14, None, "x", 7),
        (15, "", "x", 7),
        (16, "ka " * 3000, "x", 7),
        (17, "a Éa x9 éa x9", "x", 7),
        (12, " ".join(prose(2, 12).split()[:10]), "x", 7),
        (None, prose(1, 25), "x", 7),
    ]
    got = op.find_contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    rows = sorted([(r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in got.collect()], key=str)
    assert rows == brute(docs, items, 10)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", "", 0)], DOCS), spark.createDataFrame([], ITEMS)
    row = op.find_contamination(docs, items).head()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)
    assert op.find_contamination(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("span", [1, 3, 8])
def test_proximity(spark, span):
    text = "ka x x lo x x x mi ka lo mi x x x x x ka x x x x x x x x lo mi".replace("x", "zz").split()
    docs = spark.createDataFrame([(1, " ".join(text)), (2, "ka lo")], "doc_id long, text string")
    terms = ["lo", "mi"]
    index = op.build_index(docs)
    queries = spark.createDataFrame([(1, terms)], "item_id long, terms array<string>")
    got = {(r.doc_id, r.pos) for r in op.proximity_matches(index, queries, span).collect()}
    at = {t: [i for i, w in enumerate(text) if w == t] for t in terms}  # "mi" and "lo" are 3 and 4 in all, so "mi" is rarer
    rare = min(terms, key=lambda t: (len(at[t]) + (t == "lo"), terms.index(t)))
    other = terms[1 - terms.index(rare)]
    assert got == {(1, i) for i in at[rare] if any(abs(i - j) <= span for j in at[other])}


def test_no_python_on_the_main_path(spark, data):
    plan = op.op1_decontaminate(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert F is not None
