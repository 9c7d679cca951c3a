import random

import pytest
from pyspark.sql import functions as F

from blocklog.operators import compaction, integrity, journal, log, lookup, runs, segments, stats
from blocklog.sources.tables import dense_rank_of

W = "wseq long, lba long, tomb boolean, payload string"


def writes(seed, n=120, keys=17):
    r = random.Random(seed)
    return [(i, r.randrange(keys), r.random() < 0.2, f"v{i}") for i in range(n)]


def test_overwrites_leave_the_last_value_in_key_order(spark):
    rows = [(k, k, False, str(k)) for k in range(100, -1, -1)] + [(200 + k, k, False, str(100 - k)) for k in range(101)]
    found = log.latest(spark.createDataFrame(rows, W)).orderBy("lba").collect()
    assert [(r.lba, r.payload) for r in found] == [(k, str(100 - k)) for k in range(101)]


@pytest.mark.parametrize("batch", [1, 7, 64])
def test_placed_log_keeps_the_newest_of_each_batch(spark, batch):
    rows = writes(1)
    want = []
    for b in range(0, len(rows), batch):
        last = {k: (s, t) for s, k, t, _ in rows[b : b + batch]}
        want += [(b // batch * batch + i, k, *last[k]) for i, k in enumerate(sorted(last))]
    got = log.place(spark.createDataFrame(rows, W), batch).select("hba", "lba", "wseq", "tomb").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_compaction_does_not_change_what_is_read(spark):
    rows = writes(2)
    model = {k: None if t else v for s, k, t, v in rows}
    df = spark.createDataFrame(rows, W).withColumn("version", F.col("wseq"))
    parts = [df.where(F.col("wseq") % 3 == i) for i in range(3)]
    merged = compaction.merge_runs(parts)
    assert {r.lba: r.payload for r in merged.collect()} == {k: v for k, v in model.items() if v is not None}
    kept = compaction.merge_runs(parts, bottom=False)
    assert {r.lba for r in kept.where("tomb").collect()} == {k for k, v in model.items() if v is None}


def test_a_value_wins_over_a_tombstone_of_its_version(spark):
    rows = spark.createDataFrame([(1, 5, True, "x"), (1, 5, False, "y"), (2, 4, False, "z"), (2, 6, True, "w")], "lba long, version long, tomb boolean, payload string")
    assert {(r.lba, r.payload) for r in lookup.newest(rows).collect()} == {(1, "y"), (2, "w")}


def test_tombstone_of_a_nearer_tier_hides_the_key(spark):
    rows = spark.createDataFrame([(5, 1, True, 0), (9, 1, False, 2), (3, 2, False, 1)], "wseq long, lba long, tomb boolean, tier int")
    assert [r.lba for r in lookup.tiered(rows).collect()] == [2]


@pytest.mark.parametrize("parts", [1, 5, 1000])
def test_read_runs(spark, parts):
    r = random.Random(3)
    hbas = [r.choice([i, i, i, i + 1000 * r.randrange(3)]) for i in range(200)]
    want, start = [], 0
    for i in range(1, 201):
        if i == 200 or hbas[i] != hbas[i - 1] + 1:
            want.append((start * 2, hbas[start], i - start))
            start = i
    live = spark.createDataFrame([(2 * i, h) for i, h in enumerate(hbas)], "lba long, hba long")
    assert sorted(map(tuple, lookup.read_runs(live, parts).select("first_lba", "first_hba", "n").collect())) == want


def test_dense_rank(spark):
    keys = random.Random(4).sample(range(-500, 100000), 300)
    got = dense_rank_of(spark.createDataFrame([(k,) for k in keys], "k long"), "k", buckets=16).collect()
    assert {r.k: r["rank"] for r in got} == {k: i for i, k in enumerate(sorted(keys))}


def test_leaf_probe_below_between_and_above(spark):
    index = spark.createDataFrame([(0, 10, 3), (1, 2000, 3), (2, 2001, 1)], "leaf long, max_key long, nr_record long")
    probes = spark.createDataFrame([(-5,), (10,), (11,), (1999,), (2001,), (2002,)], "k long")
    got = {r.k: r.leaf for r in runs.leaf_probe(probes, index).collect()}
    assert got == {-5: 0, 10: 0, 11: 1, 1999: 1, 2001: 2}


def test_quota_stops_after_the_victim_that_reaches_it(spark):
    counts = spark.createDataFrame([(0, 3), (1, 3), (2, 5), (3, 9), (4, 0)], "seg long, nr_valid long")
    got = segments.quota(segments.victims(counts, 10), 7).orderBy("moved_before").collect()
    assert [(r.seg, r.moved_before) for r in got] == [(0, 0), (1, 3), (2, 6)]


def test_hole_fill_takes_the_fullest_first(spark):
    live = spark.createDataFrame([(0, 0), (1, 0), (1, 2), (2, 0), (2, 1), (2, 2), (2, 3)], "seg long, off long")
    pending = spark.createDataFrame([(k,) for k in (30, 10, 20)], "lba long")
    got = log.hole_fill(pending, live, 4, live.select("seg").distinct()).collect()
    assert sorted((r.lba, r.seg, r.off) for r in got) == [(10, 1, 1), (20, 1, 3), (30, 0, 1)]


def test_hole_fill_returns_rows_beyond_the_holes(spark):
    live = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)], "seg long, off long")
    pending = spark.createDataFrame([(k,) for k in (50, 10, 40, 20, 30)], "lba long")
    got = log.hole_fill(pending, live, 3, live.select("seg").distinct()).collect()
    assert sorted(map(tuple, got)) == [(10, 0, 2, 2), *((k, None, None, None) for k in (20, 30, 40, 50))]


def test_next_free_wraps(spark):
    t = spark.createDataFrame([(0, False), (1, True), (2, True)], "seg long, valid boolean")
    assert segments.next_free(t, 1).head().seg == 0
    assert segments.gc_needed(0, 100, 320)


def test_tampering_gives_null_not_data(spark):
    rows = spark.createDataFrame([(1, 0, 1, "abc"), (2, 0, 1, None)], "hba long, seg long, wseq long, payload string")
    sealed = integrity.seal(rows, b"s")
    assert {r.hba: r.payload and bytes(r.payload) for r in integrity.unseal(sealed, b"s").collect()} == {1: b"abc", 2: None}
    assert not integrity.unseal(sealed.withColumn("hba", F.lit(9).cast("long")), b"s").where("ok").count()
    assert not integrity.unseal(sealed.withColumn("sealed", integrity.flipped(F.col("sealed"), 14)), b"s").where("ok").count()


def test_journal_replay_equals_the_log(spark):
    rows = spark.createDataFrame([(i, k, t, v) for i, k, t, v in writes(5, 2500)], W)
    records = journal.records(rows)
    chosen = journal.checkpoint_choice(records)
    got = journal.replay(journal.as_of(rows, chosen), records, chosen)
    want = log.latest(rows.withColumn("hba", F.col("wseq"))).select("lba", "hba", "tomb")
    assert sorted(map(tuple, got.select("lba", "hba", "tomb").collect())) == sorted(map(tuple, want.collect()))


def test_lru(spark):
    rows = [(s, i, leaf) for s in range(2) for i, leaf in enumerate([1, 2, 1, 3, 2, 1, 1])]
    got = stats.lru_hits(spark.createDataFrame(rows, "stream long, seq long, leaf long"), 2).collect()
    assert sorted(map(tuple, got)) == [(0, 2, 5), (1, 2, 5)]


def slow_lru(leaves, capacity):
    hits, used = 0, []
    for leaf in leaves:
        hits += leaf in used[-capacity:]
        used = [x for x in used if x != leaf] + [leaf]
    return hits, len(leaves) - hits


@pytest.mark.parametrize(("capacity", "part"), [(3, 7), (20, 5), (4, 1000)])
def test_lru_over_all_parts(spark, capacity, part):
    r = random.Random(6)
    leaves = [min(r.randrange(12), r.randrange(12)) + i // 100 for i in range(300)]
    rows = spark.createDataFrame([(i + 50 * (i > 200), leaf) for i, leaf in enumerate(leaves)], "seq long, leaf long")
    assert tuple(stats.lru_hits_whole(rows, capacity, part).head()) == slow_lru(leaves, capacity)
    assert tuple(stats.lru_hits_whole(rows.limit(0), capacity, part).head()) == (0, 0)


def test_lru_of_the_whole_event_log(spark, data):
    from blocklog.plans import catalogue
    from blocklog.schema import LEAF_CACHE

    leaves = [x.user_id for x in spark.read.parquet(f"{data}/events.parquet").orderBy("event_id").collect()]
    assert tuple(catalogue.QUERIES["lru_cache_whole"](spark, data).head()) == slow_lru(leaves, LEAF_CACHE)


def test_empty_log(spark):
    empty = spark.createDataFrame([], W)
    assert log.latest(empty).count() == log.place(empty, 8).count() == 0
    assert lookup.read_runs(empty.select("lba", F.col("wseq").alias("hba"))).count() == 0


@pytest.mark.parametrize("leaves", [1, 2, 3, 9, 10])
def test_inner_nodes_reach_one_root(spark, leaves):
    index = spark.createDataFrame([(i, 10 * i) for i in range(leaves)], "leaf long, max_key long")
    want, below, level = [], [(i, 10 * i) for i in range(leaves)], 0
    while level == 0 or len(below) > 1:
        level, groups = level + 1, [below[i : i + 3] for i in range(0, len(below), 3)]
        want += [(level, n, g[-1][1], len(g)) for n, g in enumerate(groups)]
        below = [(n, g[-1][1]) for n, g in enumerate(groups)]
    got = runs.inner_nodes(index, leaves, fanout=3).select("level", "node", "max_key", "children").collect()
    assert sorted(map(tuple, got)) == want
    lower = runs.inner_nodes(index, leaves, fanout=3, levels=1).collect()
    assert sorted(r.node for r in lower) == [w[1] for w in want if w[0] == 1]
