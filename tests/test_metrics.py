"""Host captures to lines, whole measurements, streams of counters, and the checks on what was written."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import gates, hostmetrics
from quarry.plans import metrics
from quarry.plans.spec import MetricsSpec
from quarry.streaming import stateful

SPEC = MetricsSpec(tags_static={"region": "eu west", "host": "spoofed"}, fields_static={"deployment": "prod", "used": 999, "up": True})
SNAPSHOT = "host string, tick int, now_ns long, source string, content string"
STAT = ["cpu 100 0 50 800 50 0 0 0 20 0\ncpu0 100 0 50 800 50 0 0 0 20 0\nintr 1", "cpu 150 0 70 820 60 0 0 0 30 0\ncpu0 150 0 70 820 60 0 0 0 30 0\nintr 1"]
CAPTURE = {
    "meminfo": "MemTotal: 16 kB\nMemFree: 3 kB\nMemAvailable: 8 kB\nBuffers: 1 kB\nCached: 5 kB\nSReclaimable: 2 kB\nShmem: 3 kB\nSwapTotal: 10 kB\nSwapFree: 8 kB\n",
    "mountinfo": "36 35 98:0 / / rw shared:1 - ext4 /dev/sda1 rw\n37 35 0:5 / /proc rw - proc proc rw\n",
    "diskstats": " 8 0 sda 10 0 10 3 20 0 20 4 1 7 9\n 7 0 loop0 1 1 1 1 1 1 1 1 1 1 1\n",
    "netdev": "Inter-| x\n face | y\n eth0: 100 3 0 0 0 0 0 0 200 4 0 0\n",
    "loadavg": "0.5 0.25 0.0 1/2 3",
    "uptime": "3600.75 1.5",
}
FILES = "host string, tick int, path string, f_blocks long, f_bavail long, f_frsize long, f_files long, f_ffree long"


def captures(spark):
    rows = [("h1", t, 100 - t, s, c) for t in (0, 1) for s, c in [*CAPTURE.items(), ("stat", STAT[t])]]
    return spark.createDataFrame(rows, SNAPSHOT), spark.createDataFrame([("h1", 0, "/", 1000, 250, 1, 100, 40), ("h1", 1, "/", 1000, 250, 1, 0, 0)], FILES)


REST = 'deployment="prod",up=true'


def test_lines_of_every_measurement(spark):
    snapshots, statvfs = captures(spark)
    got = {(r.table, r.tick, r.lp) for r in metrics.metric_lines(metrics.collect(snapshots, statvfs, SPEC)).collect()}
    want = set()
    for tick, ts in ((0, 100), (1, 101)):  # the clock went back, the time did not
        tags = "host=h1,region=eu\\ west"
        want |= {
            ("mem", tick, f"mem,{tags} total=16384i,available=8192i,used=8192i,free=3072i,used_percent=50,available_percent=50,buffered=1024i,cached=4096i,{REST} {ts}"),
            ("swap", tick, f"swap,{tags} total=10240i,used=2048i,free=8192i,used_percent=20,{REST} {ts}"),
            ("diskio", tick, f"diskio,host=h1,name=sda,region=eu\\ west reads=10i,writes=20i,read_bytes=5120i,write_bytes=10240i,read_time=3i,write_time=4i,io_time=7i,weighted_io_time=9i,iops_in_progress=1i,used=999i,{REST} {ts}".replace("used=999i,deployment=\"prod\",up=true", "deployment=\"prod\",used=999i,up=true")),
            ("net", tick, f"net,host=h1,interface=eth0,region=eu\\ west bytes_recv=100i,bytes_sent=200i,packets_recv=3i,packets_sent=4i,err_in=0i,err_out=0i,deployment=\"prod\",used=999i,up=true {ts}"),
            ("system", tick, f"system,{tags} load1=0.5,load5=0.25,load15=0,n_cpus=1i,uptime=3600i,deployment=\"prod\",used=999i,up=true {ts}"),
        }
        inodes = "inodes_total=100i,inodes_free=40i,inodes_used=60i," if tick == 0 else ""
        want.add(("disk", tick, f"disk,device=/dev/sda1,fstype=ext4,host=h1,path=/,region=eu\\ west total=1000i,free=250i,used=750i,used_percent=75,{inodes}{REST} {ts}"))
    for cpu in ("cpu-total", "cpu0"):
        want.add(("cpu", 1, f"cpu,cpu={cpu},host=h1,region=eu\\ west usage_idle=20,usage_active=80,usage_user=40,usage_system=20,usage_iowait=10,usage_nice=0,usage_irq=0,usage_softirq=0,usage_steal=0,usage_guest=10,usage_guest_nice=0,deployment=\"prod\",used=999i,up=true 101"))
    assert got == want
    only = metrics.collect(snapshots, None, MetricsSpec(collectors=("mem", "disk")))
    assert list(only) == ["mem"] and only["mem"].first().tags == {"host": "h1"}


def test_schema_of_what_was_written(spark):
    snapshots, statvfs = captures(spark)
    lines = metrics.metric_lines(metrics.collect(snapshots, statvfs, SPEC)).where("table <> 'net'")
    broken = lines.withColumn("lp", F.when(F.col("table") == "swap", F.replace("lp", F.lit("free=8192i,"), F.lit(""))).otherwise(F.col("lp")))
    required = {m: ([*tags, "region"], fields) for m, (tags, fields) in hostmetrics.MEASUREMENTS.items()}
    got = {r.measurement: (r.n_rows, r.missing) for r in gates.measurement_schema(broken, required, optional=hostmetrics.OPTIONAL).collect()}
    assert got["mem"] == (2, "") and got["cpu"] == (2, "") and got["swap"] == (2, "free") and got["disk"] == (2, "")
    assert got["net"][0] == 0 and got["net"][1].startswith("host,interface,region,bytes_recv")


def test_captures_are_read_by_their_paths(spark, tmp_path):
    for tick in (0, 1):
        folder = tmp_path / "h1" / f"{tick}_{1000 + tick}"
        folder.mkdir(parents=True)
        for source, content in [*CAPTURE.items(), ("stat", STAT[tick])]:
            (folder / source).write_text(content)
    (tmp_path / "h1" / "notes").write_text("x")
    got = {(r.host, r.tick, r.now_ns, r.source, r.content) for r in metrics.read_captures(spark, str(tmp_path)).collect()}
    assert got == {("h1", t, 1000 + t, s, c) for t in (0, 1) for s, c in [*CAPTURE.items(), ("stat", STAT[t])]}


def test_counters_of_a_stream(spark, tmp_path):
    """Two runs, a late tick, counters that start anew: as the batch over the ticks in order."""
    stateful.prepare_streaming(spark)
    line = lambda n: f"cpu {n} 0 {n // 2} {3 * n} 0 0 0 0 0 0\nintr"
    ticks = [(0, 100), (1, 180), (2, 30), (3, 90), (4, 90)]
    rows = [("h", t, 10**9 * t, "stat", line(n)) for t, n in ticks]
    folder = str(tmp_path / "in")

    def go(new):
        spark.createDataFrame(new, SNAPSHOT).coalesce(1).write.mode("append").parquet(folder)
        stream = hostmetrics.parse_proc_stat(spark.readStream.schema(SNAPSHOT).parquet(folder))
        q = metrics.cpu_stream(stream, SPEC).select("tick", "ts_ns", "lp").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    go(rows[:3])
    go([rows[1], *rows[3:]])  # tick 1 comes again, too late
    got = {(r.tick, r.lp) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.tick, r.lp) for r in metrics.collect(spark.createDataFrame(rows, SNAPSHOT), None, SPEC)["cpu"].collect()}
    assert got == want and len(got) == 4 and any("usage_idle=100,usage_active=0" in lp for _, lp in got)


def test_container_records_as_they_must_be(spark):
    rows = [(5, "stdout", "BEGIN x END", {"pod": "p"}), (6, "stderr", "y", {"pod": "p"}), (10, "stdout", "BEGIN cut", {"pod": "q"}), (None, "stdout", "END", {})]
    df = spark.createDataFrame(rows, "ts_ns long, channel string, text string, tags map<string,string>")
    r = gates.container_check(df, "ts_ns", 5, 10, "channel", "text", ("BEGIN", "END"), {"pod": "p"}).first()
    assert r.asDict() == {"n": 4, "outside": 2, "has_stdout": True, "has_stderr": True, "n_starts": 2, "n_whole": 1, "n_wrong_tags": 2}
    assert not gates.container_check(df.where("channel = 'stdout'"), "ts_ns", 5, 10, "channel", "text", ("BEGIN", "END"), {}).first().has_stderr


@pytest.mark.parametrize("threshold", [20, 300])
def test_warnings_of_the_first_batches(spark, threshold):
    df = spark.range(2000).select(F.floor(F.col("id") / 100).alias("batch"), F.create_map(F.lit("user"), F.col("id").cast("string"), F.lit("kind"), (F.col("id") % 7).cast("string"), F.lit("late"), F.when(F.col("id") < 1000, "x").otherwise(F.col("id").cast("string"))).alias("tags"))
    got = {r.key: (r.batch, r.n_values) for r in gates.cardinality_warnings(gates.tag_sketches(df, "batch", threshold), "batch", threshold, 10).collect()}
    batch = threshold // 100
    assert set(got) == {"user"} and got["user"][0] == batch and abs(got["user"][1] - 100 * (batch + 1)) <= 3
