import itertools
import random

import pytest

from blocklog.llm import mixing as op


def brute_fill(budget, caps, weights):
    """Water level by bisection: each gets the lesser of level x weight and its capacity."""
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(caps[n], mid * weights[n]) for n in caps) < budget:
            low = mid
        else:
            high = mid
    return {n: min(caps[n], high * weights[n]) for n in caps}


@pytest.mark.parametrize("seed", range(8))
def test_fill(seed):
    r = random.Random(seed)
    caps = {i: r.choice([0, r.randrange(1, 50), r.randrange(100, 1000)]) for i in range(6)}
    weights = {i: r.choice([0.5, 1, 3]) for i in caps}
    budget = r.randrange(1, 1200)
    got, want = op.fill(budget, caps, weights), brute_fill(budget, caps, weights)
    assert all(abs(got[i] - want[i]) < 1e-3 for i in caps)


def test_shortage_stays_among_siblings_first():
    tokens = {("a", "x"): 10, ("a", "y"): 500, ("b", "z"): 500}
    assert op.budgets(tokens, 400, {}, 1) == {("a", "x"): 10, ("a", "y"): 190, ("b", "z"): 200}
    assert op.budgets({("a", "x"): 10, ("b", "z"): 500}, 400, {}, 2) == {("a", "x"): 20, ("b", "z"): 380}
    assert op.budgets({}, 10, {}, 1) == {}


def test_selection_is_a_prefix_of_each_epoch(spark):
    r = random.Random(3)
    rows = [(i, f"d{i % 2}", None if i % 7 == 0 else "en", f"s{i % 3}" if i % 4 else "hot", r.choice([0, 1, 5, 40]), "keep") for i in range(300)]
    rows += [rows[3], (None, "d0", "en", "hot", 9, "keep")]
    docs = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long, epoch string").drop("epoch")
    for share in (0.3, 1.4):
        got = op.mix(docs, share=share).collect()
        key = lambda x: (x["domain"] or "", x["lang"] or "", x["source"] or "")
        tokens = {}
        for x in docs.collect():
            tokens[key(x)] = tokens.get(key(x), 0) + x.n_tokens
        given = op.budgets(tokens, share * sum(tokens.values()), {}, 2)
        hashes = {}
        from pyspark.sql import functions as F

        for e in (0, 1):
            for x in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(42), F.lit(e), "doc_id"), 1).alias("h")).distinct().collect():
                hashes[e, x.doc_id] = x.h
        want = []
        for leaf, budget in given.items():
            spent = 0
            for e in (0, 1):
                own = sorted((x for x in docs.collect() if key(x) == leaf), key=lambda x: (hashes[e, x.doc_id], -1 if x.doc_id is None else x.doc_id))
                for _, tied in itertools.groupby(own, key=lambda x: x.doc_id):
                    tied = list(tied)
                    if spent < budget or (tokens[leaf] == 0 and e == 0):
                        want += [(e, x.doc_id) for x in tied]
                    elif e == 0 and spent == budget == tokens[leaf]:  # a whole epoch, documents without tokens included
                        want += [(e, x.doc_id) for x in tied]
                    spent += sum(x.n_tokens for x in tied)
                if spent < tokens[leaf] * (e + 1):
                    break
        missing = set(want) ^ {(x.epoch, x.doc_id) for x in got}
        odd = {(e, i) for e, i in missing if next(x.n_tokens for x in docs.collect() if x.doc_id == i)}
        assert not odd
        taken = {}
        for x in got:
            taken[key(x)] = taken.get(key(x), 0) + x.n_tokens
        assert all(taken.get(k, 0) >= b for k, b in given.items())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, domain string, lang string, source string, n_tokens long")
    assert op.mix(docs).count() == 0


def test_words(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(None,), ("",), (" a  b\t\n",), ("x\x1cy",)], "t string")
    assert [r.n for r in rows.select(op.word_count(F.col("t")).alias("n")).collect()] == [0, 0, 2, 1]


def test_names_of_its_own_pass_unchanged(spark):
    names = ["whole", "budget", "last", "last_bucket", "place", "bucket", "before", "row", "_domain", "n"]
    rows = [(i, 10, "x", "en", "s", *[f"v{i}"] * len(names), 7) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, domain string, lang string, source string, " + ", ".join(f"{n} string" for n in names) + ", epoch int")
    got = op.mix(df, share=0.5)
    assert got.columns == df.columns
    got = got.collect()
    assert len(got) == 10 and all(r[n] == f"v{r.doc_id}" for r in got for n in names) and {r.epoch for r in got} == {0}
