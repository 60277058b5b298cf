"""Host captures to the seven measurements: typed tables, tags, and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.functions.lineproto import encode_line
from quarry.functions.maps import named
from quarry.operators import hostmetrics
from quarry.operators.hostmetrics import CPU_COLUMNS, MEASUREMENTS
from quarry.plans.spec import MetricsSpec

KINDS = {"f": "float", "i": "integer"}
#: Fields in the order in which they are written: integers, but for those with a percentage or a load.
FLOATS = ("percent", "usage_", "load")
STATES = ["user", "system", "iowait", "nice", "irq", "softirq", "steal", "guest", "guest_nice"]


def read_captures(spark: SparkSession, root: str) -> DataFrame:
    """(host, tick, now_ns, source, content) of captured system files, ``<root>/<host>/<tick>_<now_ns>/<source>``.
    Files whose path does not have this form are left out."""
    form = r"/([^/]+)/([0-9]+)_([0-9]+)/([^/]+)$"
    x = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    part = lambda i: F.regexp_extract(F.col("path"), form, i)
    x = x.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")).where(F.col("path").rlike(form))
    return x.select(part(1).alias("host"), part(2).cast("int").alias("tick"), part(3).cast("long").alias("now_ns"), part(4).alias("source"), "content")


def kind_of(field: str) -> str:
    return "float" if any(f in field for f in FLOATS) else "integer"


def static_kind(value: object) -> str:
    return "boolean" if isinstance(value, bool) else "integer" if isinstance(value, int) else "float" if isinstance(value, float) else "string"


def samples(snapshots: DataFrame, statvfs: DataFrame | None, spec: MetricsSpec) -> dict[str, DataFrame]:
    """(host, tick, tags of the measurement, its fields) of each collector that is wanted."""
    counters = hostmetrics.parse_proc_stat(snapshots)
    make = {
        "cpu": lambda: hostmetrics.cpu_usage(counters).withColumn("usage_idle", F.greatest(100.0 - F.col("usage_active"), F.lit(0.0))),
        "mem": lambda: hostmetrics.mem(snapshots),
        "swap": lambda: hostmetrics.swap(snapshots),
        "disk": lambda: hostmetrics.disk(hostmetrics.parse_mountinfo(snapshots), statvfs),
        "diskio": lambda: hostmetrics.diskio(snapshots),
        "net": lambda: hostmetrics.net(snapshots),
        "system": lambda: hostmetrics.system(snapshots, counters),
    }
    return {c: make[c]() for c in spec.collectors if c != "disk" or statvfs is not None}


def measured(name: str, rows: DataFrame, spec: MetricsSpec) -> DataFrame:
    """(table, host, tick, ts_ns, tags, fields, lp) of a measurement's samples with ``ts_ns``. Its own fields come in
    their order, then the static ones whose names are free; absent fields are left out of the line."""
    tags, fields = MEASUREMENTS[name]
    own = [c for c in fields if c in rows.columns]
    static = {k: v for k, v in spec.fields_static.items() if k not in fields}
    x = hostmetrics.metric_fields(rows.select("host", "tick", "ts_ns", *(c for c in tags if c != "host"), *own), static)
    mine: dict[str, Column] = {c: named(c) for c in tags if c != "host"}
    kinds = {**{c: kind_of(c) for c in own}, **{k: static_kind(v) for k, v in static.items()}}
    by_name = {**{k: F.lit(v) for k, v in spec.tags_static.items()}, "host": F.col("host"), **mine}
    lp = encode_line(F.lit(name), by_name, {c: (named(c), k) for c, k in kinds.items()}, F.col("ts_ns"))
    return x.select(F.lit(name).alias("table"), "host", "tick", "ts_ns", hostmetrics.metric_tags(F.col("host"), mine, spec.tags_static).alias("tags"), *(named(c) for c in kinds), lp.alias("lp"))


def collect(snapshots: DataFrame, statvfs: DataFrame | None = None, spec: MetricsSpec | None = None) -> dict[str, DataFrame]:
    """The measurements by name. All rows of a host's tick have one time, later than that of the tick before.
    ``statvfs``: (host, tick, path, f_blocks, f_bavail, f_frsize, f_files, f_ffree); without it there
    is no disk measurement."""
    spec = spec or MetricsSpec()
    times = hostmetrics.tick_time(snapshots.groupBy("host", "tick").agg(F.max("now_ns").alias("now_ns"))).select("host", "tick", "ts_ns")
    return {name: measured(name, rows.drop("now_ns").join(times, ["host", "tick"]), spec) for name, rows in samples(snapshots, statvfs, spec).items()}


def metric_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, host, tick, ts_ns, lp) of all measurements together."""
    parts = [t.select("table", "host", "tick", "ts_ns", "lp") for t in tables.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("lp is not null")


class CpuDeltas(StatefulProcessor):
    """Cpu usage of a host from counters that arrive tick after tick. State: the last tick, its time and
    its counters by cpu. A tick that is not later than the last one gives nothing; counters that
    went back count as no time; the first tick gives nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "tick long, ts_ns long")
        self.last = handle.getMapState("last", "cpu string", ", ".join(f"{c} long" for c in CPU_COLUMNS))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tick, ts = self.clock.get() if self.clock.exists() else (None, None)
        known = {k[0]: np.array(v, np.int64) for k, v in self.last.iterator()}
        out: list[tuple] = []
        for now, rows_ in pd.concat(list(rows)).sort_values(["tick", "cpu"]).groupby("tick"):
            if tick is not None and now <= tick:
                continue
            clock = int(rows_["now_ns"].max())
            ts = clock if ts is None else max(clock, ts + 1)
            tick = int(now)
            fresh = {r[0]: np.array(r[1:], np.int64) for r in rows_[["cpu", *CPU_COLUMNS]].itertuples(index=False)}
            out += [(key[0], tick, ts, cpu, *usage(np.maximum(c - known[cpu], 0))) for cpu, c in fresh.items() if cpu in known]
            known = fresh
        self.last.clear()
        for cpu, c in known.items():
            self.last.updateValue((cpu,), tuple(int(v) for v in c))
        if tick is not None:
            self.clock.update((tick, ts))
        if out:
            yield pd.DataFrame(out, columns=["host", "tick", "ts_ns", "cpu", "usage_idle", "usage_active", *(f"usage_{s}" for s in STATES)])

    def close(self) -> None:
        pass


def usage(delta: np.ndarray) -> list[float]:
    """idle, active and the states, in per cent of the time that passed."""
    d = dict(zip(CPU_COLUMNS, (int(v) for v in delta), strict=True))
    total = sum(d[c] for c in CPU_COLUMNS[:8])
    d["user"], d["nice"] = max(d["user"] - d["guest"], 0), max(d["nice"] - d["guest_nice"], 0)
    part = {c: d[c] / total * 100.0 if total else 0.0 for c in CPU_COLUMNS}
    active = 100.0 - part["idle"] if total else 0.0
    return [max(100.0 - active, 0.0), active, *(part[s] for s in STATES)]


def cpu_stream(counters: DataFrame, spec: MetricsSpec | None = None) -> DataFrame:
    """The cpu measurement of a stream of ``hostmetrics.parse_proc_stat`` rows."""
    schema = "host string, tick long, ts_ns long, cpu string, usage_idle double, usage_active double, " + ", ".join(f"usage_{s} double" for s in STATES)
    rows = counters.groupBy("host").transformWithStateInPandas(CpuDeltas(), schema, "append", "none")
    return measured("cpu", rows, spec or MetricsSpec())
