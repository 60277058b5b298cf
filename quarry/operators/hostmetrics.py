"""Host measurements from captured system files: (host, tick, now_ns, source, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: File systems that hold no data of their own (fixed values).
PSEUDO_FS = """tmpfs devtmpfs devfs iso9660 overlay aufs squashfs proc sysfs cgroup cgroup2 devpts mqueue hugetlbfs debugfs
tracefs securityfs pstore bpf configfs fusectl binfmt_misc autofs nsfs ramfs rpc_pipefs selinuxfs efivarfs""".split()
#: Columns of a cpu line, in the kernel's order (fixed values).
CPU_COLUMNS = ["user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal", "guest", "guest_nice"]
#: Tags and fields of the measurements, fields in the order in which they are written (fixed values).
MEASUREMENTS = {
    "cpu": (["cpu", "host"], ["usage_idle", "usage_active", "usage_user", "usage_system", "usage_iowait", "usage_nice", "usage_irq", "usage_softirq", "usage_steal", "usage_guest", "usage_guest_nice"]),
    "mem": (["host"], ["total", "available", "used", "free", "used_percent", "available_percent", "buffered", "cached"]),
    "swap": (["host"], ["total", "used", "free", "used_percent"]),
    "disk": (["host", "device", "path", "fstype"], ["total", "free", "used", "used_percent", "inodes_total", "inodes_free", "inodes_used"]),
    "diskio": (["host", "name"], ["reads", "writes", "read_bytes", "write_bytes", "read_time", "write_time", "io_time", "weighted_io_time", "iops_in_progress"]),
    "net": (["host", "interface"], ["bytes_recv", "bytes_sent", "packets_recv", "packets_sent", "err_in", "err_out"]),
    "system": (["host"], ["load1", "load5", "load15", "n_cpus", "uptime"]),
}
#: Fields that only some hosts have.
OPTIONAL = {"buffered", "cached", "inodes_total", "inodes_free", "inodes_used"}


def pct(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole * 100.0)


def saturating(a: Column, b: Column) -> Column:
    """a - b, but at least 0; null where one is null."""
    return F.when(a > b, a - b).when(a <= b, F.lit(0).cast("bigint"))


def _lines(snapshots: DataFrame, source: str) -> DataFrame:
    x = snapshots.where(F.col("source") == source)
    return x.select("host", "tick", "now_ns", F.posexplode(F.split("content", "\n")).alias("i", "l"))


def _tokens() -> Column:
    return F.array_remove(F.split(F.col("l"), r"\s+"), "")


def _number(tokens: Column, i: int) -> Column:
    return F.coalesce(F.get(tokens, F.lit(i)).try_cast("bigint"), F.lit(0))


def parse_proc_stat(snapshots: DataFrame) -> DataFrame:
    """(host, tick, now_ns, cpu, ten counters): the leading ``cpu`` lines; missing columns are 0."""
    first_other = F.array_position(F.transform(F.split("content", "\n"), lambda s: s.startswith("cpu")), F.lit(False))
    x = snapshots.where("source = 'stat'").withColumn("stop", F.when(first_other == 0, F.lit(2**31 - 1)).otherwise(first_other))
    x = x.select("host", "tick", "now_ns", "stop", F.posexplode(F.split("content", "\n")).alias("i", "l")).where("i + 1 < stop")
    t = x.withColumn("t", _tokens())
    name = F.get("t", F.lit(0))
    return t.select("host", "tick", "now_ns", F.when(name == "cpu", "cpu-total").otherwise(name).alias("cpu"), *(_number(F.col("t"), i + 1).alias(c) for i, c in enumerate(CPU_COLUMNS)))


def cpu_usage(counters: DataFrame) -> DataFrame:
    """Shares of the time since the tick before, by host and cpu; the first tick gives none. Guest
    time is part of user time and is taken out of it; counters that went back count 0."""
    w = Window.partitionBy("host", "cpu").orderBy("tick")
    d = counters.withColumns({f"d_{c}": saturating(F.col(c), F.lag(c).over(w)) for c in CPU_COLUMNS}).where("d_user is not null")
    d = d.withColumn("all", sum((F.col(f"d_{c}") for c in CPU_COLUMNS[1:8]), F.col("d_user")))
    d = d.withColumns({"d_user": saturating(F.col("d_user"), F.col("d_guest")), "d_nice": saturating(F.col("d_nice"), F.col("d_guest_nice"))})
    share = {c: F.when(F.col("all") == 0, 0.0).otherwise(F.col(f"d_{c}") / F.col("all") * 100.0) for c in CPU_COLUMNS}
    active = F.when(F.col("all") == 0, 0.0).otherwise(100.0 - share["idle"])
    return d.select("host", "tick", "now_ns", "cpu", active.alias("usage_active"), *(share[c].alias(f"usage_{c}") for c in CPU_COLUMNS))


def _meminfo(snapshots: DataFrame) -> DataFrame:
    keys = ["MemTotal", "MemAvailable", "MemFree", "Buffers", "Cached", "SReclaimable", "Shmem", "SwapTotal", "SwapFree"]
    x = _lines(snapshots, "meminfo").select("host", "tick", "now_ns", F.regexp_extract("l", r"^(\w+):", 1).alias("k"), (F.regexp_extract("l", r":\s*([0-9]+)", 1).try_cast("bigint") * 1024).alias("v"))
    return x.groupBy("host", "tick", "now_ns").pivot("k", keys).agg(F.max("v"))


def mem(snapshots: DataFrame) -> DataFrame:
    m = _meminfo(snapshots)
    total, free_for = F.col("MemTotal"), F.col("MemAvailable")
    used = saturating(total, free_for)
    return m.where("MemTotal is not null").select(
        "host", "tick", "now_ns", total.alias("total"), free_for.alias("available"), used.alias("used"), F.col("MemFree").alias("free"),
        pct(used, total).alias("used_percent"), pct(free_for, total).alias("available_percent"), F.col("Buffers").alias("buffered"),
        saturating(F.col("Cached") + F.col("SReclaimable"), F.col("Shmem")).alias("cached"),
    )


def swap(snapshots: DataFrame) -> DataFrame:
    used = saturating(F.col("SwapTotal"), F.col("SwapFree"))
    return _meminfo(snapshots).where("SwapTotal is not null").select("host", "tick", "now_ns", F.col("SwapTotal").alias("total"), used.alias("used"), F.col("SwapFree").alias("free"), pct(used, F.col("SwapTotal")).alias("used_percent"))


def _unescape(path: Column) -> Column:
    for code, char in (("\\040", " "), ("\\011", "\t"), ("\\012", "\n"), ("\\134", "\\")):
        path = F.replace(path, F.lit(code), F.lit(char))
    return path


def parse_mountinfo(snapshots: DataFrame) -> DataFrame:
    """(host, tick, now_ns, path, fstype, device) of mounts that hold data."""
    x = _lines(snapshots, "mountinfo").withColumn("t", F.split("l", " "))
    dash = F.array_position("t", F.lit("-")).cast("int")
    x = x.withColumn("dash", dash).where("dash > 0")
    at = lambda n: F.get("t", F.col("dash") + n - 1)
    return x.select("host", "tick", "now_ns", _unescape(F.get("t", F.lit(4))).alias("path"), at(1).alias("fstype"), _unescape(at(2)).alias("device")).where(~F.col("fstype").isin(PSEUDO_FS))


def disk(mounts: DataFrame, statvfs: DataFrame) -> DataFrame:
    """Mounts with their sizes; inodes only where the file system counts them."""
    x = mounts.join(statvfs, ["host", "tick", "path"])
    total, free = F.col("f_blocks") * F.col("f_frsize"), F.col("f_bavail") * F.col("f_frsize")
    used = saturating(total, free)
    files = lambda c: F.when(F.col("f_files") > 0, c)
    inodes = saturating(F.col("f_files"), F.col("f_ffree"))
    return x.select("host", "tick", "now_ns", "path", "device", "fstype", total.alias("total"), free.alias("free"), used.alias("used"), pct(used, total).alias("used_percent"), files(F.col("f_files")).alias("inodes_total"), files(F.col("f_ffree")).alias("inodes_free"), files(inodes).alias("inodes_used"))


def diskio(snapshots: DataFrame) -> DataFrame:
    """Cumulative counters of block devices; sectors are 512 bytes."""
    x = _lines(snapshots, "diskstats").withColumn("t", _tokens()).where((F.size("t") >= 14) & ~F.get("t", F.lit(2)).rlike("^(loop|ram)"))
    n = lambda i, k=1: _number(F.col("t"), i) * k
    names = {"reads": n(3), "read_bytes": n(5, 512), "read_time": n(6), "writes": n(7), "write_bytes": n(9, 512), "write_time": n(10), "iops_in_progress": n(11), "io_time": n(12), "weighted_io_time": n(13)}
    return x.select("host", "tick", "now_ns", F.get("t", F.lit(2)).alias("name"), *(c.alias(k) for k, c in names.items()))


def net(snapshots: DataFrame) -> DataFrame:
    """Cumulative counters of network interfaces."""
    x = _lines(snapshots, "netdev").where(F.col("l").contains(":")).select("host", "tick", "now_ns", F.trim(F.split_part("l", F.lit(":"), F.lit(1))).alias("interface"), F.array_remove(F.split(F.split_part("l", F.lit(":"), F.lit(2)), r"\s+"), "").alias("t"))
    at = {"bytes_recv": 0, "packets_recv": 1, "err_in": 2, "bytes_sent": 8, "packets_sent": 9, "err_out": 10}
    return x.select("host", "tick", "now_ns", "interface", *(_number(F.col("t"), i).alias(k) for k, i in at.items()))


def system(snapshots: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """Load averages, number of cpus, uptime in whole seconds."""
    t = F.split("content", " ")
    key = ["host", "tick"]
    load = snapshots.where("source = 'loadavg'").select(*key, "now_ns", *(F.get(t, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("load1", "load5", "load15"))))
    up = snapshots.where("source = 'uptime'").select(*key, F.get(t, F.lit(0)).try_cast("double").cast("bigint").alias("uptime"))
    cpus = (counters if counters is not None else parse_proc_stat(snapshots)).where("cpu <> 'cpu-total'").groupBy(*key).agg(F.count(F.lit(1)).alias("n_cpus"))
    return load.join(up, key, "left").join(cpus, key, "left")


def tick_time(ticks: DataFrame) -> DataFrame:
    """Adds ``ts_ns``: the clock, but always later than the tick before. In closed form: the
    running maximum of the clock less the place, plus the place."""
    w = Window.partitionBy("host").orderBy("tick")
    n = F.row_number().over(w)
    x = ticks.withColumn("__n", n)
    return x.withColumn("ts_ns", F.col("__n") + F.max(F.col("now_ns") - F.col("__n")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__n")


def metric_tags(host: Column, own: dict[str, Column], static: dict[str, str]) -> Column:
    """Global tags < host < the measurement's own."""
    from quarry.functions.maps import merge
    from quarry.operators.records import tags_static

    mine = F.create_map(*(x for k, c in own.items() for x in (F.lit(k), c))) if own else None
    return merge(tags_static(static), F.create_map(F.lit("host"), host), *([mine] if mine is not None else []))


def metric_fields(samples: DataFrame, static: dict[str, object]) -> DataFrame:
    """Static fields are added where the measurement has none of that name; order is kept."""
    return samples.select("*", *(F.lit(v).alias(k) for k, v in static.items() if k not in samples.columns))


def counter_rate(counters: DataFrame, key: list[str], order: str, value: str, ts_ns: str) -> DataFrame:
    """Adds ``rate`` per second since the row before; a counter that went back gives 0."""
    w = Window.partitionBy(*key).orderBy(order)
    seconds = (F.col(ts_ns) - F.lag(ts_ns).over(w)) / 1e9
    return counters.withColumn("rate", F.when(seconds > 0, saturating(F.col(value), F.lag(value).over(w)) / seconds))
