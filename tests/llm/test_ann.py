import numpy as np
import pytest

from blocklog.llm import ann as op

E = "vec_id long, embedding array<float>, score string"


def brute(rows, queries, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        out[q] = [(int(ids[i]), float(d[i])) for i in np.lexsort((ids, d))[:k] if d[i] < np.inf]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 24))
    x[700:] = x[3] + 0.01 * rng.standard_normal((800, 24))  # over half of all rows in one place
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame(rows, E)
    got = {}
    for r in op.search(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows, range(0, 1500, 50), 10)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        true = dict(want[q])
        hits += len({f[1] for f in found} & set(true))
        assert all(abs(f[2] - true[f[1]]) < 1e-12 for f in found if f[1] in true)
        assert sorted((f[2], f[1]) for f in found) == [(f[2], f[1]) for f in found]
    assert len(got) == 30 and hits / 300 >= 0.9


def test_small_and_odd_tables(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], ""), (1, [0.0, 1.0], ""), (2, [0.0, 1.0], ""), (3, None, ""), (4, [0.0, 0.0], ""), (5, [nan, 1.0], ""), (6, [None, 1.0], ""), (7, [1.0], ""), (8, [float("inf"), 1.0], ""), (None, [1.0, 1.0], ""), (2, [0.0, 1.0], ""), (0, [1.0, 0.0], "")]
    df = spark.createDataFrame(rows, E)
    got = sorted((r["rank"], r.vec_id, round(r.score, 9)) for r in op.search(df, df.where("vec_id % 100 = 0")).collect())
    assert got == [(1, 1, round(2**0.5, 9)), (2, 2, round(2**0.5, 9))]
    assert op.search(df.limit(0), df.limit(0)).count() == 0
    assert op.search(df.where("vec_id = 0"), df).count() == 0


@pytest.mark.parametrize("step", [3, 8, 50])
def test_scan_without_doubt_is_exact(step):
    rng = np.random.default_rng(2)
    q, x = rng.standard_normal((4, 20)), rng.standard_normal((90, 20))
    turn, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    ids = np.arange(90)
    i, j, d = op.scan(q, np.full(4, np.inf), x, (q @ turn, x @ turn), np.array([-1, 5, -1, -1]), ids, 7, step, 1e9)
    for n in range(4):
        true = np.sqrt(((q[n] - x) ** 2).sum(1))
        true[5] = np.inf if n == 1 else true[5]
        assert j[i == n].tolist() == np.lexsort((ids, true))[:7].tolist()
        assert np.allclose(d[i == n], np.sort(true)[:7])
