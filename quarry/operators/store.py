"""A table store that a batch enters as a whole or not at all, and once.

A batch leaves records, rendered lines, dead letters, watermark rows and counters. All of them are
written to folders that nobody reads yet; then one ledger entry, created atomically, makes them
visible together. A write that was killed anywhere before leaves the old version as it was; the
same batch again changes nothing, since the ledger remembers the last batch of each writer.

Records are partitioned by table and date. A batch adds a folder to the partitions that it
touches and leaves the others alone; equal keys are settled when such a partition is read, the
later batch standing, and a partition that has gathered ``compact_after`` folders is rewritten
into one. Old versions stay readable until ``vacuum``.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.maps import series_key
from quarry.operators import accounting
from quarry.operators.dedup import lww

KEY = ["table", "series_key", "ts_ns"]
#: What a batch leaves beside its records, by folder.
BESIDE = ("lines", "dead", "watermarks", "counters")


def day(ts_ns: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.floor(ts_ns / 1_000_000_000)), "yyyy-MM-dd")


def place(table: str) -> str:
    """Folder name of a table, whatever characters its name has."""
    return "t" + hashlib.sha256(table.encode()).hexdigest()[:16]  # a letter in front: no number to Spark


class Store:
    def __init__(self, spark: SparkSession, root: str, compact_after: int = 8, after: Callable[[str], None] = lambda step: None):
        """``after`` is called behind each step of a commit; tests stop there."""
        self.spark, self.root, self.compact_after, self.after = spark, root.rstrip("/"), compact_after, after
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # ledger

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/_ledger")
        if not self._fs.exists(folder):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"[0-9]{20}\.json", n))

    def entry(self, version: int | None = None) -> dict:
        """The ledger entry of a version, by default the last."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "writers": {}, "parts": {}, "names": {}, "schema": None}
        stream = self._fs.open(self._path(f"{self.root}/_ledger/{version:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, entry: dict) -> bool:
        """Creates the entry of a version; False where another writer was first."""
        jvm = self.spark.sparkContext._jvm
        final = self._path(f"{self.root}/_ledger/{entry['version']:020d}.json")
        draft = self._path(f"{self.root}/_ledger/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(draft, final, none)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    # writing

    def commit(self, writer: str, batch: int, settled: DataFrame, marks: DataFrame | None = None, arrival: tuple[str, ...] = ("pos", "state_key")) -> bool:
        """Enters a batch; False where the ledger has it already. ``settled``: one row for each line, as
        ``plans.pipeline`` gives them; ``marks``: watermark rows. ``arrival`` orders equal keys
        within the batch. The lines are read once, into a staged table that the rest is made of."""
        if not re.fullmatch(r"[\w-]+", writer):
            raise ValueError(f"a writer is named with letters, digits, _ and -: {writer!r}")
        if self.entry()["writers"].get(writer, -1) >= batch:
            return False
        at = f"writer={writer}/batch={batch}"
        staging = f"{self.root}/_staging/{at}"
        settled.write.mode("overwrite").parquet(staging)
        staged = self.spark.read.schema(settled.schema).parquet(staging)
        self.after("staged")
        shipped = staged.where("stage = 'shipped'")
        shipped.select(F.col("lp").alias("value")).write.mode("overwrite").option("compression", "gzip").text(f"{self.root}/lines/{at}")
        self.after("lines")
        staged.where("stage = 'quarantined'").select("state_key", "reason", "line").write.mode("overwrite").json(f"{self.root}/dead/{at}")
        self.after("dead")
        accounting.tally(staged).write.mode("overwrite").parquet(f"{self.root}/counters/{at}")
        self.after("counters")
        if marks is not None:
            marks.write.mode("overwrite").parquet(f"{self.root}/watermarks/{at}")
            self.after("watermarks")
        left_out = {"stage", "reason", "line", "lp"}
        records = shipped.select(*(c for c in shipped.columns if c not in left_out)).withColumn("series_key", series_key(F.col("tags")))
        while True:  # once more only where another writer was first
            entry = self.entry()
            new = self._add(entry, records, [*arrival])
            self.after("records")
            new["writers"] = {**entry["writers"], writer: batch}
            if self._publish(new):
                break
        self.after("ledger")
        self._fs.delete(self._path(staging), True)
        return True

    def _add(self, entry: dict, records: DataFrame, arrival: list[str]) -> dict:
        """Writes records beside the existing ones and returns the entry that would show them."""
        version = entry["version"] + 1
        schema = self._widened(entry, records)
        folder = f"{version:020d}-{uuid.uuid4().hex[:8]}"
        self._write(lww(records, KEY, arrival), folder)
        names = dict(entry["names"])
        parts = {k: list(v) for k, v in entry["parts"].items()}
        data = f"{self.root}/data/__c={folder}"
        touched = self.spark.read.parquet(data).select("table", "__t", "__d").distinct().collect() if self._has_files(data) else []  # tables x dates of a batch
        full = []
        for r in touched:
            names[r["__t"]] = r["table"]
            part = f"__t={r['__t']}/__d={r['__d']}"
            parts.setdefault(part, []).append(folder)
            if len(parts[part]) >= self.compact_after:
                full.append(part)
        new = {"version": version, "writers": entry["writers"], "parts": parts, "names": names, "schema": schema}
        if full:
            whole = f"{version:020d}-{uuid.uuid4().hex[:8]}"
            self._write(self._settle({p: parts[p] for p in full}, schema), whole)
            parts |= {p: [whole] for p in full}
        return new

    def _has_files(self, path: str) -> bool:
        at = self._path(path)
        return self._fs.exists(at) and any(f.getPath().getName().startswith("__t=") for f in self._fs.listStatus(at))

    def _write(self, records: DataFrame, folder: str) -> None:
        x = records.withColumns({"__t": F.concat(F.lit("t"), F.substring(F.sha2("table", 256), 1, 16)), "__d": day(F.col("ts_ns"))})
        x.write.mode("overwrite").partitionBy("__t", "__d").parquet(f"{self.root}/data/__c={folder}")

    def _widened(self, entry: dict, records: DataFrame) -> dict:
        """The columns so far and those of the batch; a column's type stays that of its first write."""
        known = T.StructType.fromJson(entry["schema"]) if entry["schema"] else T.StructType([])
        types = {f.name: f.dataType for f in known}
        for f in records.schema:
            if types.get(f.name, f.dataType) != f.dataType:
                raise ValueError(f"column {f.name} is {types[f.name].simpleString()} and cannot become {f.dataType.simpleString()}")
            if f.name not in types:
                known = known.add(f.name, f.dataType, True)
        return json.loads(known.json())

    # reading

    def _settle(self, parts: dict[str, list[str]], schema: dict) -> DataFrame:
        """Rows of partitions, of equal keys the one of the latest folder."""
        paths = [f"{self.root}/data/__c={folder}/{part}" for part, folders in parts.items() for folder in folders]
        x = self.spark.read.schema(T.StructType.fromJson(schema)).option("basePath", f"{self.root}/data").parquet(*paths)
        return lww(x, KEY, ["__c"]).select(*(f["name"] for f in schema["fields"]))

    def records(self, table: str | None = None, version: int | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
        """Records as of a version, of a table, of dates (yyyy-mm-dd) from ``since`` to ``until``. Partitions of
        one folder are read as they are; the others settle equal keys."""
        entry = self.entry(version)
        if entry["schema"] is None:
            return self.spark.createDataFrame([], "table string, series_key string, ts_ns long")
        dates = lambda p: p.rsplit("=", 1)[1]
        parts = {p: f for p, f in entry["parts"].items() if (table is None or p.startswith(f"__t={place(table)}/")) and (since is None or dates(p) >= since) and (until is None or dates(p) <= until)}
        out = self.spark.createDataFrame([], T.StructType.fromJson(entry["schema"]))
        single = [f"{self.root}/data/__c={f[0]}/{p}" for p, f in parts.items() if len(f) == 1]
        if single:
            out = self.spark.read.schema(out.schema).option("basePath", f"{self.root}/data").parquet(*single).select(*out.columns)
        if several := {p: f for p, f in parts.items() if len(f) > 1}:
            settled = self._settle(several, entry["schema"])
            out = out.unionByName(settled) if single else settled
        return out

    def beside(self, kind: str) -> DataFrame | None:
        """Lines, dead letters, watermark rows or counters of the batches that the ledger has, with writer
        and batch; None where there are none."""
        if kind not in BESIDE:
            raise ValueError(f"one of {BESIDE}, not {kind!r}")
        known = [(w, b) for w, b in self.entry()["writers"].items() if self._fs.exists(self._path(f"{self.root}/{kind}/writer={w}"))]
        if not known:
            return None
        reader = self.spark.read.option("basePath", f"{self.root}/{kind}")
        paths = [f"{self.root}/{kind}/writer={w}" for w, _ in known]
        x = reader.text(paths) if kind == "lines" else reader.schema("state_key string, reason string, line string, writer string, batch long").json(paths) if kind == "dead" else reader.parquet(*paths)
        last = F.create_map(*(y for w, b in known for y in (F.lit(w), F.lit(b))))
        return x.where(F.col("batch") <= F.element_at(last, F.col("writer").cast("string")))

    def vacuum(self, keep: int = 10) -> int:
        """Removes ledger entries before the last ``keep`` and record folders that no entry left names; returns
        how many folders went. Run it while no batch is being written."""
        versions = self.versions()
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_ledger/{v:020d}.json"), False)
        used = {f for v in versions[-keep:] for folders in self.entry(v)["parts"].values() for f in folders}
        data = self._path(f"{self.root}/data")
        gone = [f.getPath() for f in self._fs.listStatus(data) if f.getPath().getName().removeprefix("__c=") not in used] if self._fs.exists(data) else []
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)


def fan_out(store: Store, writer: str, settle: Callable[[DataFrame, int], tuple[DataFrame, DataFrame | None]]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: ``settle(lines, batch)`` makes a batch's settled rows and watermark rows, which
    are entered together."""

    def run(lines: DataFrame, batch: int) -> None:
        settled, marks = settle(lines, batch)
        store.commit(writer, batch, settled, marks)

    return run
