"""A versioned store: a log, sorted runs, a catalogue and atomic snapshots.

Data is written first; a snapshot becomes visible when its one-line manifest
is renamed into place. Readers pin a snapshot and see immutable files.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compaction import merge_runs
from ..operators.integrity import measurement
from ..operators.lookup import newest
from ..schema import FILE_RECORDS, LEVEL0_FILES

ROW = "lba long, version long, tomb boolean, payload string"


@dataclass
class RunFile:
    """One catalogue row: a sorted, immutable run."""

    id: int
    level: int
    version: int
    first_key: int
    last_key: int
    nr_record: int
    path: str


@dataclass
class Snapshot:
    number: int = 0
    next_version: int = 0
    next_id: int = 0
    files: list[RunFile] = field(default_factory=list)
    counters: dict[str, int] = field(default_factory=dict)


class Store:
    """Keyed versioned data in a folder of any file system Spark writes."""

    def __init__(self, spark: SparkSession, path: str, records: int = FILE_RECORDS, level0: int = LEVEL0_FILES):
        self.spark, self.path, self.records, self.level0 = spark, path, records, level0
        self.snapshot = self._load()

    # -- snapshots ---------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _load(self) -> Snapshot:
        fs, root = self._fs(f"{self.path}/snapshots")
        if not fs.exists(root):
            return Snapshot()
        names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().endswith(".json"))
        if not names:
            return Snapshot()
        text = "".join(r.value for r in self.spark.read.text(f"{self.path}/snapshots/{names[-1]}").collect())
        raw = json.loads(text)
        return Snapshot(raw["number"], raw["next_version"], raw["next_id"], [RunFile(**f) for f in raw["files"]], raw["counters"])

    def commit(self, files: list[RunFile], counted: dict[str, int] | None = None) -> None:
        """Make ``files`` the catalogue: write a manifest aside, then rename it."""
        old = self.snapshot
        counters = dict(old.counters)
        for k, v in (counted or {}).items():
            counters[k] = counters.get(k, 0) + v
        new = Snapshot(old.number + 1, max([f.version + 1 for f in files] + [old.next_version]), max([f.id + 1 for f in files] + [old.next_id]), files, counters)
        fs, part = self._fs(f"{self.path}/snapshots/.{new.number:012d}-{uuid.uuid4().hex}.part")
        _, final = self._fs(f"{self.path}/snapshots/{new.number:012d}.json")
        if fs.exists(final):
            raise RuntimeError(f"snapshot {new.number} exists already: another writer was first")
        out = fs.create(part, True)
        out.write(json.dumps(asdict(new)).encode())
        out.close()
        if not fs.rename(part, final):
            raise RuntimeError(f"snapshot {new.number} exists already: another writer was first")
        self.snapshot = new

    def catalogue(self) -> DataFrame:
        rows = [(f.id, f.level, f.version, f.first_key, f.last_key, f.nr_record) for f in self.snapshot.files]
        return self.spark.createDataFrame(rows, "id long, level long, version long, first_key long, last_key long, nr_record long")

    # -- writing -----------------------------------------------------------

    def _new_run(self, id_: int) -> str:
        """A folder that no other writer has, so that one that loses the race for a snapshot harms no run."""
        return f"{self.path}/runs/{id_:08d}-{uuid.uuid4().hex}"

    def _write_run(self, rows: DataFrame, level: int, version: int, id_: int) -> RunFile | None:
        path = self._new_run(id_)
        rows.select("lba", "version", "tomb", "payload").sortWithinPartitions("lba").write.parquet(path)
        s = self.spark.read.schema(ROW).parquet(path).agg(F.min("lba").alias("a"), F.max("lba").alias("b"), F.count("*").alias("n")).head()
        return RunFile(id_, level, version, s.a, s.b, s.n, path) if s.n else None

    def append(self, rows: DataFrame, counted: dict[str, int] | None = None) -> None:
        """Flush a batch (wseq, lba, tomb, payload) as one level-0 run, newest write per key.

        ``counted`` is added to the counters by the same snapshot that shows the
        run; of a batch without rows it makes a snapshot of its own.
        """
        version, id_ = self.snapshot.next_version, self.snapshot.next_id
        if len(self.level(0)) >= self.level0:
            self.compact()
            version, id_ = self.snapshot.next_version, self.snapshot.next_id
        batch = rows.groupBy("lba").agg(F.max_by(F.struct("tomb", "payload"), "wseq").alias("r"))
        batch = batch.select("lba", F.lit(version).cast("long").alias("version"), "r.tomb", F.col("r.payload").cast("string").alias("payload"))
        parts = max(1, self.spark.sparkContext.defaultParallelism)
        run = self._write_run(batch.repartitionByRange(parts, "lba"), 0, version, id_)
        if run:
            self.commit([*self.snapshot.files, run], {"flushes": 1, "records_written": run.nr_record} | (counted or {}))
        elif counted:
            self.commit(self.snapshot.files, counted)

    def delete(self, keys: DataFrame) -> None:
        """Tombstones for the keys (lba)."""
        self.append(keys.select(F.lit(0).cast("long").alias("wseq"), "lba", F.lit(True).alias("tomb"), F.lit(None).cast("string").alias("payload")))

    def level(self, n: int) -> list[RunFile]:
        return sorted((f for f in self.snapshot.files if f.level == n), key=lambda f: (f.first_key, f.last_key))

    def compact(self) -> None:
        """Merge level 0 into level 1: the bottom, so tombstones end here."""
        demoted = self.level(0)
        if not demoted:
            return
        low, high = min(f.first_key for f in demoted), max(f.last_key for f in demoted)
        relative = [f for f in self.level(1) if f.first_key <= high and low <= f.last_key]
        version, id_ = self.snapshot.next_version, self.snapshot.next_id
        spread = sorted(demoted, key=lambda f: f.first_key)
        apart = all(a.last_key < b.first_key for a, b in zip(spread, spread[1:], strict=False))
        held = [f for f in self.snapshot.files if f not in demoted and f not in relative]
        has_tombs = bool(self._read(demoted).where("tomb").head(1))
        if not relative and apart and not has_tombs:  # a move only changes labels
            self.commit(held + [RunFile(f.id, 1, version, f.first_key, f.last_key, f.nr_record, f.path) for f in demoted], {"moves": 1})
            return
        merged = merge_runs([self._read([f]) for f in [*demoted, *relative]])
        total = sum(f.nr_record for f in [*demoted, *relative])
        parts = -(-total // self.records)
        path = self._new_run(id_)
        merged.select("lba", "version", "tomb", "payload").repartitionByRange(parts, "lba").sortWithinPartitions("lba").write.parquet(path)
        out = self.spark.read.schema(ROW).parquet(path).withColumn("f", F.col("_metadata.file_path"))
        made = out.groupBy("f").agg(F.min("lba").alias("a"), F.max("lba").alias("b"), F.count("*").alias("n")).orderBy("a").collect()
        files = [RunFile(id_ + i, 1, version, r.a, r.b, r.n, r.f) for i, r in enumerate(made)]
        self.commit(held + files, {"compactions": 1, "records_merged": total, "records_kept": sum(f.nr_record for f in files)})

    # -- reading -----------------------------------------------------------

    def _read(self, files: list[RunFile]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], ROW)
        return self.spark.read.schema(ROW).parquet(*[f.path for f in files])

    def scan(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """Live rows with keys from first to last; files outside the range are not listed."""
        files = [f for f in self.snapshot.files if (last is None or f.first_key <= last) and (first is None or f.last_key >= first)]
        rows = self._read(files)
        if first is not None:
            rows = rows.where(F.col("lba") >= first)
        if last is not None:
            rows = rows.where(F.col("lba") <= last)
        return newest(rows).where("NOT tomb").select("lba", "version", "payload")

    def get(self, key: int) -> DataFrame:
        return self.scan(key, key)

    def read(self, requests: DataFrame) -> DataFrame:
        """Each requested key with its payload, null where there is none."""
        return requests.join(self.scan(), "lba", "left")

    def stats(self) -> dict[str, int]:
        return dict(self.snapshot.counters)

    def reset_stats(self) -> None:
        self.snapshot.counters.clear()
        self.commit(self.snapshot.files)

    def measurement(self) -> DataFrame:
        return measurement(self.scan(), "lba")
