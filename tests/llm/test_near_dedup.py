import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from blocklog.llm import near_dedup as op
from blocklog.llm.components import roots


def slow_print(text, size=4):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def groups(values, distance):
    n = len(values)
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


@pytest.mark.parametrize("text", [None, "", " \t", "one", "a b c", "A É ß b\x1cc d e", "x " * 70000, "the same the same the same the same"])
def test_simhash(text):
    assert op.simhash(text) == slow_print(text)


def family(seed, n=60):
    r = random.Random(seed)
    base = r.getrandbits(64)
    out = [base]
    for _ in range(n):
        x = r.choice(out)
        for _ in range(r.randrange(0, 6)):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return out + [r.getrandbits(64) for _ in range(20)] + [0, (1 << 64) - 1, 1 << 63]


@pytest.mark.parametrize("count", [10, 10**8, 10**10, 10**13])
def test_every_plan_covers_every_pair(count):
    r, plan = random.Random(5), op.plan_masks(4, count)
    for _ in range(3000):
        x = sum(1 << b for b in r.sample(range(64), r.randrange(0, 5)))
        assert any(sum(x >> b & 1 for b in segment) <= 1 for segment in plan)


@pytest.mark.parametrize(("chunk", "count"), [(4096, 10), (6, 10), (4096, 10**9)])
def test_links_connect_like_brute_force(spark, chunk, count):
    values = sorted(set(family(7)))
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    found = roots(op.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, op.plan_masks(4, count), chunk)).collect()
    root = {r.node: r.root for r in found}
    mine = [root.get(v, v) for v in signed]
    want = groups(values, 4)
    assert len({*zip(mine, want, strict=True)}) == len(set(mine)) == len(set(want))


def test_runs_over_batch_ends():
    values = np.array(sorted(set(family(9))), np.uint64)
    h = np.sort(np.arange(len(values)) % 3)
    for step in (1, 5, 1000):
        stream = [pa.RecordBatch.from_arrays([pa.array(h[i : i + step]), pa.array(values[i : i + step].view(np.int64))], names=["h", "fp"]) for i in range(0, len(h), step)]
        out = [r for b in op.linked_runs(4, 4096, iter(stream)) for r in b.to_pylist()]
        assert not any(r["over"] for r in out)
        for k in range(3):
            own = [int(v) for v in values[h == k]]
            want, lab = groups(own, 4), {v: i for i, v in enumerate(own)}
            for r in out:
                a, b = (int(np.int64(r[c]).astype(np.uint64)) for c in "ab")
                if a in lab and b in lab:
                    x, y = sorted((lab[a], lab[b]))
                    lab = {v: x if i == y else i for v, i in lab.items()}
            assert len({*zip(want, [lab[v] for v in own], strict=True)}) == len(set(want))
        over = [r for b in op.linked_runs(4, 10, iter(stream)) for r in b.to_pylist() if r["over"]]
        assert len(over) == len(values)


def test_documents(spark, prose):
    base = prose(1, 300)
    near = base.split()
    near[150] = "changed"
    docs = [(5, base), (3, " ".join(near)), (9, base), (9, base), (7, prose(2, 300)), (1, None), (2, ""), (None, base), (4, "short one"), (8, "SHORT one")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, fp string, component_id long")
    prints = [slow_print(t) for _, t in docs]
    label = groups(prints, 4)
    least = {g: min(i for (i, _), x in zip(docs, label, strict=True) if x == g and i is not None) for g in set(label)}
    hot = op.near_duplicates(df, hot_rows=2).collect()
    got = op.near_duplicates(df).collect()
    assert sorted(hot, key=str) == sorted(got, key=str)
    assert sorted([(r.doc_id, r.component_id) for r in got], key=str) == sorted([(i, least[g]) for (i, _), g in zip(docs, label, strict=True)], key=str)
    kept = op.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert op.near_duplicates(df.limit(0)).count() == 0


def near(text):
    words = text.split()
    words[len(words) // 2] = "changed"
    return " ".join(words)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(None, "a"), (None, "b"), (None, "c"), (None, None), (None, "")], {(None, "a"), (None, "b"), (None, "c"), (None, "")}),
        ([(3, "a"), (None, "near a"), (None, "b"), (None, "c")], {(3, "a"), (None, "b"), (None, "c")}),
        ([(5, "a"), (9, "a"), (5, "near b"), (3, "b")], {(5, "a"), (3, "b")}),
        ([(5, "a"), (5, "b"), (5, "b"), (None, "c"), (None, "c"), (None, "near c")], {(5, "a"), (5, "b"), (None, "c")}),
        ([(5, "near a"), (5, "a"), (None, "a")], {(5, "a")}),
    ],
)
def test_ids_that_are_null_or_stand_for_several_texts(spark, prose, rows, want):
    texts = {"": "", None: ""} | {name: prose(seed, 300) for seed, name in enumerate("abc", 1)}
    texts |= {f"near {name}": near(texts[name]) for name in "abc"}
    assert all((slow_print(texts[x]) ^ slow_print(texts[f"near {x}"])).bit_count() <= 4 for x in "abc")
    names = {t: n.removeprefix("near ") for n, t in texts.items() if n is not None}
    df = spark.createDataFrame([(i, t and texts[t], 1) for i, t in rows], "doc_id long, text string, n long")
    got = op.one_of_each(df).collect()
    assert sorted(((r.doc_id, names[r.text or ""]) for r in got), key=str) == sorted(want, key=str)


def test_a_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in roots(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_one_of_each_with_names_of_its_own_and_several_texts_of_an_id(spark, prose):
    a, b = prose(1, 40), prose(2, 40)
    names = ["d", "c", "first", "key", "copy", "row", "own_id", "own_copy", "fp", "n"]
    rows = [(5, a), (7, a), (5, b), (3, b), (None, prose(3, 40)), (None, prose(4, 40))]
    df = spark.createDataFrame([(i, t, *range(len(names))) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = op.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(5, a), (3, b), (0, rows[4][1]), (0, rows[5][1])])
