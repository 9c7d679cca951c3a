import random

import pytest

from blocklog.plans import streamed
from blocklog.sources.store import Store
from blocklog.streaming.ingest import put_returning_old, seal_segments

W = "wseq long, lba long, tomb boolean, payload string"


@pytest.mark.parametrize("seed", [1, 2])
def test_store_against_a_dictionary(spark, tmp_path, seed):
    r, model, seq = random.Random(seed), {}, 0
    store = Store(spark, f"file://{tmp_path}/s", records=8)
    for _ in range(4):
        rows = []
        for _ in range(12):
            k, t = r.randrange(20), r.random() < 0.25
            rows.append((seq, k, t, f"v{seq}"))
            model[k] = None if t else f"v{seq}"
            seq += 1
        store.append(spark.createDataFrame(rows, W))
        if r.random() < 0.5:
            store.compact()
    live = {k: v for k, v in model.items() if v is not None}
    assert {x.lba: x.payload for x in store.scan().collect()} == live
    store.compact()
    assert {x.lba: x.payload for x in Store(spark, store.path).scan().collect()} == live
    assert {x.lba for x in store.scan(5, 9).collect()} == {k for k in live if 5 <= k <= 9}
    last = [(f.first_key, f.last_key) for f in store.level(1)]
    assert all(a[1] < b[0] for a, b in zip(last, last[1:], strict=False))
    assert len(store.measurement().collect()) == 1


def test_delete_and_read(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.append(spark.createDataFrame([(0, 1, False, "a"), (1, 2, False, "b")], W))
    store.delete(spark.createDataFrame([(1,)], "lba long"))
    got = store.read(spark.createDataFrame([(1,), (2,), (3,)], "lba long"))
    assert {x.lba: x.payload for x in got.collect()} == {1: None, 2: "b", 3: None}
    assert store.stats()["flushes"] == 2


def test_stream_ends_where_the_log_does(spark, data):
    from blocklog.plans import catalogue

    want = {r.lba: r.payload for r in catalogue.major_compaction(spark, data).collect()}
    assert {r.lba: r.payload for r in streamed.ingest_events(spark, data).collect()} == want


def test_sealing_counts_distinct_keys(spark):
    keys = [1, 1, 2, 3, 1, 4, 4, 5, 1, 2]
    got = seal_segments(spark.createDataFrame([(0, i, k) for i, k in enumerate(keys)], "stream long, wseq long, lba long"), capacity=3).orderBy("wseq").collect()
    assert [r.seg for r in got] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 2]


def test_a_writer_that_loses_harms_no_run(spark, tmp_path):
    one, two = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    one.append(spark.createDataFrame([(0, 1, False, "a")], W))
    with pytest.raises(RuntimeError):
        two.append(spark.createDataFrame([(0, 2, False, "b")], W))
    assert {x.lba: x.payload for x in Store(spark, one.path).scan().collect()} == {1: "a"}


def test_a_batch_and_its_number_are_one_snapshot(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.append(spark.createDataFrame([(0, 1, False, "a")], W), {"next_batch": 1})
    assert store.snapshot.number == 1 and Store(spark, store.path).stats()["next_batch"] == 1


def test_stateful_put_over_restarts_and_a_batch_delivered_again(spark, tmp_path):
    schema = "lba long, wseq long, hba long"
    parts = [
        [(1, 10, 100), (1, 12, 120), (2, 11, 110), (None, 13, 130)],
        [(1, 11, 115), (1, 15, 150), (1, 14, 140), (3, 16, 160), (None, 17, 170)],  # 115 comes late
        [(1, 15, 155), (1, 20, 200), (2, 9, 90), (2, 21, 210), (2, 21, 205)],  # 155 and 205 are no newer
    ]
    want = [
        {(1, 10, 100, None), (1, 12, 120, 100), (2, 11, 110, None), (None, 13, 130, None)},
        {(1, 11, 115, 115), (1, 14, 140, 120), (1, 15, 150, 140), (3, 16, 160, None), (None, 17, 170, 130)},
        {(1, 15, 155, 155), (1, 20, 200, 150), (2, 9, 90, 90), (2, 21, 210, 110), (2, 21, 205, 205)},
    ]
    source, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint"

    def run():
        put_returning_old(spark.readStream.schema(schema).parquet(str(source)), str(out), str(checkpoint)).awaitTermination()
        return [set(map(tuple, spark.read.parquet(str(out / str(n))).select("lba", "wseq", "hba", "old_hba").collect())) for n in range(len(list(out.iterdir())))]

    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(str(source))
        assert run() == want[: n + 1]
    for name in ("2", ".2.crc"):
        (checkpoint / "commits" / name).unlink(missing_ok=True)
    assert run() == want


def test_put_takes_a_part_of_many_files_as_one_batch(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(streamed, "event_log", lambda spark, d: spark.range(400).selectExpr("id AS wseq", "id % 7 AS lba", "false AS tomb", "0.5D AS payload"))
    monkeypatch.setattr(streamed, "folder", lambda spark, name: str(tmp_path / name))
    got = {r.wseq: r.old_hba for r in streamed.put_events(spark, data).collect()}
    assert got == {i: i - 7 if i >= 7 else None for i in range(400)}
    assert sorted(p.name for p in (tmp_path / "put" / "out").iterdir()) == ["0", "1", "2", "3"]
    assert len([p for p in (tmp_path / "put" / "in").iterdir() if p.suffix == ".parquet"]) > 4
