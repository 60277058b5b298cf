"""Registered queries that write what the tables hold as files, streams or a store, and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.lineproto import encode_line
from quarry.functions.parse import coerce, ingest_ns, parse_json, timestamp_ns
from quarry.operators import accounting, enrich, framing, gates, hostmetrics, watermarks
from quarry.operators.store import Store
from quarry.plans import metrics
from quarry.plans.pipeline import settle
from quarry.plans.spec import MetricsSpec
from quarry.queries import ARRIVALS, HOUR, HOURS, PIPE, PUBLISHED, WM, arrivals, events, pipe_lines, query, snapshots
from quarry.session import scratch
from quarry.sources import containers, files
from quarry.streaming import stateful

#: Small ranges, so that also small files are read in several tasks.
RANGE = 1 << 16


def event_texts(t) -> DataFrame:
    return t("events").select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("value"))


def event_of(lines: DataFrame, column: str = "line") -> DataFrame:
    m = parse_json(F.col(column))
    return lines.select("*", F.explode(F.array(m)).alias("m")).select(F.element_at("m", "event_id").cast("long").alias("event_id"), F.element_at("m", "event_type").alias("event_type"))


@query("read_lines_back", "SELECT event_id, event_type FROM events")
def read_lines_back(t) -> DataFrame:
    x = event_texts(t)
    where = scratch(x.sparkSession)
    x.select("value").write.text(where)
    return event_of(files.decoded(files.read_lines(x.sparkSession, where, "events", "part-*", complete_only=True, range_bytes=RANGE)))


@query("rotated_set_back", "SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS place FROM events")
def rotated_set_back(t) -> DataFrame:
    """Events in the order of their ids over a live log and its rotated siblings."""
    x = event_texts(t)
    spark, where = x.sparkSession, scratch(x.sparkSession)
    x.repartitionByRange(5, "event_id").sortWithinPartitions("event_id").select("value").write.text(where)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted(f.getPath().getName() for f in fs.listStatus(path(where)) if f.getPath().getName().startswith("part-"))
    for i, name in enumerate(parts):
        new = path(f"{where}/app.log" + (f".{len(parts) - 1 - i}" if i < len(parts) - 1 else ""))
        fs.rename(path(f"{where}/{name}"), new)
        fs.setTimes(new, 10**12 + 1000 * i, -1)
    lines = files.read_rotated_set(spark, f"{where}/app.log", "s", range_bytes=RANGE)
    placed = framing.running_total(lines, F.lit(1), ["state_key"], "place")
    m = parse_json(F.col("raw"))
    return placed.select(F.element_at(m, "event_id").cast("long").alias("event_id"), F.element_at(m, "event_type").alias("event_type"), "place")


def _streamed(spark: SparkSession, stream: DataFrame, where: str) -> None:
    stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()


@query("stream_lines_back", "SELECT event_id, event_type, CAST(1 AS BIGINT) AS times FROM events")
def stream_lines_back(t) -> DataFrame:
    """A stream that stops and goes on when more files are there; each line comes once."""
    x = event_texts(t)
    spark, where = x.sparkSession, scratch(x.sparkSession)
    for part in (0, 1):
        x.where(F.col("event_id") % 3 == 0 if part else F.col("event_id") % 3 != 0).select("value").write.mode("append").text(f"{where}/in")
        _streamed(spark, stateful.stream_lines(spark, f"{where}/in", "events", "part-*", range_bytes=RANGE), where)
    read = event_of(spark.read.parquet(f"{where}/out"))
    return read.groupBy("event_id", "event_type").agg(F.count(F.lit(1)).alias("times"))


@query("stamp_stream_back", f"SELECT event_id AS pos, {HOURS} + row_number() OVER (PARTITION BY event_type, {HOURS} ORDER BY event_id) - 1 AS ts_ns FROM events")
def stamp_stream_back(t) -> DataFrame:
    """Stamps with state on disk, in one run over all events of a stream."""
    e = events(t).select("state_key", "pos", "source_ts_ns")
    spark, where = e.sparkSession, scratch(e.sparkSession)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    e.write.parquet(f"{where}/in")
    try:
        stateful.prepare_streaming(spark)
        _streamed(spark, stateful.stamped_stream(spark.readStream.schema(e.schema).parquet(f"{where}/in"), HOUR), where)
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{where}/out").where("not exhausted and not out_of_window").select("pos", "ts_ns")


TURNS = "SELECT 't' || conv_id || '-' || turn AS time, CASE WHEN role = 'user' THEN 'stdout' ELSE 'stderr' END AS stream, md5(replace(text, chr(10), ' ')) AS log_md5 FROM conversations"


def _turns(t) -> DataFrame:
    c = t("conversations")
    return c.select("conv_id", "turn", F.when(F.col("role") == "user", "stdout").otherwise("stderr").alias("stream"), F.regexp_replace("text", "\n", " ").alias("text"), F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("time"))


def _read_back(lines: DataFrame, read) -> DataFrame:
    """Two halves of each message, one line behind the other, as files of a folder."""
    where = scratch(lines.sparkSession)
    halves = lines.select("conv_id", "turn", F.posexplode("halves").alias("half", "value"))
    halves.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "half").select("value").write.text(where)
    messages, _ = read(lines.sparkSession, where, pattern="part-*")
    at = lambda k: F.element_at("parsed", k)
    return messages.where("not unclosed and not truncated").select(at("time").alias("time"), at("stream").alias("stream"), F.md5(at("log").cast("binary")).alias("log_md5"))


@query("docker_files_back", TURNS)
def docker_files_back(t) -> DataFrame:
    half = F.floor(F.length("text") / 2).cast("int")
    log = [F.substring(F.col("text"), F.lit(1), half), F.concat(F.substring(F.col("text"), half + 1, F.length("text")), F.lit("\n"))]
    return _read_back(_turns(t).withColumn("halves", F.array(*(F.to_json(F.struct(x.alias("log"), "stream", "time")) for x in log))), containers.read_docker_json)


@query("cri_files_back", TURNS)
def cri_files_back(t) -> DataFrame:
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    return _read_back(_turns(t).withColumn("halves", F.array(F.concat_ws(" ", "time", "stream", F.lit("P"), first), F.concat_ws(" ", "time", "stream", F.lit("F"), rest))), containers.read_cri)


def _stored(t) -> Store:
    """Lines of the pipeline in two batches, the second one twice."""
    x = pipe_lines(t)
    spark = x.sparkSession
    store = Store(spark, scratch(spark))
    cut = x.agg(F.floor(F.avg("pos"))).first()[0]
    for batch, part in enumerate((x.where(F.col("pos") <= cut), x.where(F.col("pos") > cut))):
        resume = store.records().groupBy("state_key", "tick").agg((F.max("seq") + 1).alias("next_seq")) if batch else None
        settled = settle(part, PIPE, resume=resume)
        marks = settled.where("stage = 'shipped'").groupBy(F.col("source").alias("stream")).agg(F.max("tick").alias("watermark_ns"), F.lit(0).cast("long").alias("lateness_ns"), F.lit(0).cast("long").alias("violations"))
        store.commit("agent", batch, settled, marks)
    store.commit("agent", 1, x.limit(0).select(F.lit("never read").alias("stage")))
    return store


KEPT = "k AS (SELECT *, epoch_us(ts) // 1000000 * 1000000000 AS tick FROM events WHERE event_id % 97 <> 0 AND event_id % 89 <> 0 AND event_type <> 'click')"


@query("store_records_back", f"WITH {KEPT} SELECT event_id AS pos, '***' || user_id AS user_name, CAST(12 AS BIGINT) AS value, tick + row_number() OVER (PARTITION BY tick ORDER BY event_id) - 1 AS ts_ns FROM k")
def store_records_back(t) -> DataFrame:
    return _stored(t).records("log").select("pos", F.col("f_user").alias("user_name"), F.col("f_value").alias("value"), "ts_ns")


@query("store_beside_back", f"""
WITH {KEPT}, s AS (SELECT CASE WHEN event_id % 97 = 0 THEN 'unparseable' WHEN event_id % 89 = 0 THEN 'field ''value'' will not coerce to integer' WHEN event_type = 'click' THEN 'f' ELSE 's' END AS s FROM events),
 p AS (SELECT row_number() OVER (PARTITION BY tick ORDER BY event_id) AS n, tick FROM k)
SELECT 'lines' AS kind, '' AS name, CAST(count(*) AS BIGINT) AS n FROM k
UNION ALL SELECT 'dead', s, CAST(count(*) AS BIGINT) FROM s WHERE s NOT IN ('f', 's') GROUP BY s
UNION ALL SELECT 'watermark', 'events', max(tick) FROM k
UNION ALL SELECT 'counter', v.name, CAST(CASE v.name WHEN 'lines_read' THEN (SELECT count(*) FROM s) WHEN 'lines_shipped' THEN (SELECT count(*) FROM k) WHEN 'lines_quarantined' THEN (SELECT count(*) FROM s WHERE s NOT IN ('f', 's')) WHEN 'dropped_filter' THEN (SELECT count(*) FROM s WHERE s = 'f') WHEN 'files_read' THEN 2 WHEN 'pk_disambiguated' THEN (SELECT count(*) FROM p WHERE n > 1) ELSE 0 END AS BIGINT)
 FROM (VALUES ('lines_read'), ('lines_shipped'), ('lines_quarantined'), ('dropped_filter'), ('dropped_sample'), ('files_read'), ('multiline_truncated'), ('pk_disambiguated'), ('out_of_window'), ('watermark_violations'), ('otlp_records_received'), ('otlp_records_rejected'), ('at_risk')) v(name)""")
def store_beside_back(t) -> DataFrame:
    store = _stored(t)
    kind = lambda k, name, n: (F.lit(k).alias("kind"), name.alias("name"), n.cast("long").alias("n"))
    lines = store.beside("lines").agg(F.count(F.lit(1)).alias("n")).select(*kind("lines", F.lit(""), F.col("n")))
    dead = store.beside("dead").groupBy(F.split_part("reason", F.lit(":"), F.lit(1)).alias("k")).agg(F.count(F.lit(1)).alias("n")).select(*kind("dead", F.col("k"), F.col("n")))
    marks = store.beside("watermarks").groupBy("stream").agg(F.max("watermark_ns").alias("n")).select(*kind("watermark", F.col("stream"), F.col("n")))
    totals = accounting.totals(store.beside("counters")).where("source is null")
    names = [*accounting.TALLY, "at_risk"]
    counted = totals.select(F.explode(F.create_map(*(x for c in names for x in (F.lit(c), F.col(c))))).alias("k", "v")).select(*kind("counter", F.col("k"), F.col("v")))
    return lines.unionByName(dead).unionByName(marks).unionByName(counted)


@query("watermark_restored", f"""
WITH {PUBLISHED}, r AS (SELECT s.batch, s.batch_max, CASE WHEN len(l) < 256 THEN {2 * HOUR} ELSE v.lateness_ns END AS lateness_ns FROM s JOIN v USING (batch))
SELECT CAST(batch AS BIGINT) AS batch, CAST(lateness_ns AS BIGINT) AS lateness_ns, max(greatest(batch_max - lateness_ns, {1704070800 * 10**9})) OVER (ORDER BY batch) AS watermark_ns FROM r""")
def watermark_restored(t) -> DataFrame:
    a = arrivals(t)
    before = a.sparkSession.createDataFrame([("all", 2 * HOUR, 1704070800 * 10**9)], "stream string, lateness_ns long, watermark_ns long")
    return watermarks.estimates(a, ["stream"], "arrival", "batch", WM, restored=before).select("batch", "lateness_ns", "watermark_ns")


@query("watermark_over_files", f"""
WITH {ARRIVALS}, m AS (SELECT event_type, batch, max(max(ts_ns)) OVER (PARTITION BY event_type ORDER BY batch) AS mark FROM b WHERE event_type <> 'click' OR batch % 9 < 2 GROUP BY event_type, batch),
 h AS (SELECT *, least(coalesce(lead(batch) OVER (PARTITION BY event_type ORDER BY batch) - 1, batch + 3), batch + 3) AS until FROM m),
 l AS (SELECT d.batch, count(*) AS n_files, min(mark) AS mark FROM (SELECT DISTINCT batch FROM m) d JOIN h ON d.batch BETWEEN h.batch AND until GROUP BY d.batch)
SELECT CAST(batch AS BIGINT) AS batch, CAST(n_files AS BIGINT) AS n_files, max(mark) OVER (ORDER BY batch) AS watermark_ns FROM l""".replace("event_id, epoch_us(ts)", "event_id, event_type, epoch_us(ts)"))
def watermark_over_files(t) -> DataFrame:
    """Each event type is a file; one of them is silent for seven of nine batches."""
    from pyspark.sql import Window

    a = arrivals(t).join(t("events").select("event_id", "event_type"), "event_id").where((F.col("event_type") != "click") | (F.col("batch") % 9 < 2))
    w = Window.partitionBy("event_type").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    marks = a.groupBy("stream", "event_type", "batch").agg(F.max("ts_ns").alias("m")).withColumn("watermark_ns", F.max("m").over(w))
    return watermarks.over_files(marks, ["stream"], "event_type", "batch", idle=3).select("batch", "n_files", "watermark_ns")


METRICS = MetricsSpec(tags_static={"region": "eu"}, fields_static={"up": True})


def _captures(t) -> DataFrame:
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    row = lambda name, k, tick: say(f"{name} ", (50 + k % 7) * tick, " 0 ", tick * 20, " ", tick * 20, " ", tick * 10, " 0 0 0 ", tick * 10, " 0\n")
    contents = {
        "stat": lambda k, tick: F.concat(row("cpu", k, tick), row("cpu0", k, tick), F.lit("intr 5")),
        "meminfo": lambda k, tick: say("MemTotal: ", k + 1000, " kB\nMemFree: 100 kB\nMemAvailable: ", tick + 400, " kB\nSwapTotal: ", k % 3, " kB\nSwapFree: 1 kB\n"),
        "mountinfo": lambda k, tick: say("36 35 98:0 / /m\\040d rw - ext4 /dev/sda1 rw\n37 1 0:1 / /p rw - proc proc rw"),
        "diskstats": lambda k, tick: say(" 8 0 sda ", k, " 2 ", k + tick, " 4 6 7 8 9 0 1 2\n 7 0 loop0 1 1 1 1 1 1 1 1 1 1 1"),
        "netdev": lambda k, tick: say("face |bytes\n  eth0: ", k, " 2 3 4 5 6 7 8 ", k + tick, " 10 11 12\n"),
        "loadavg": lambda k, tick: say(k, ".25 0.5 0.75 1/2 3"),
        "uptime": lambda k, tick: say(k + tick, ".75 9.5"),
    }
    x = snapshots(t, "", lambda k, tick: F.explode(F.array(*(F.struct(F.lit(s).alias("source"), c(k, tick).alias("content")) for s, c in contents.items()))))
    return x.select("host", "tick", "now_ns", "content.source", "content.content")


def _metric_lines(t) -> DataFrame:
    taken = _captures(t)
    k = F.substring("host", F.lit(2), F.lit(20)).cast("long")
    statvfs = taken.where("source = 'mountinfo'").select("host", "tick", F.lit("/m d").alias("path"), (k * 10).alias("f_blocks"), (k * 4).alias("f_bavail"), F.lit(4096).cast("long").alias("f_frsize"), F.when(k % 2 == 0, 100).otherwise(0).cast("long").alias("f_files"), F.lit(40).cast("long").alias("f_ffree"))
    return metrics.metric_lines(metrics.collect(taken, statvfs, METRICS))


_HOSTS = "h AS (SELECT c_custkey AS k, 'h' || c_custkey AS host, CAST(i AS BIGINT) AS i, 1000000000000000000 + i * 10000000000 AS ts FROM customer, (VALUES (0), (1)) v(i))"
_PLAIN = "regexp_replace(CAST({0} AS VARCHAR), '[.]0$', '')"
_PCT = "CASE WHEN {1} = 0 THEN 0.0::DOUBLE ELSE CAST({0} AS DOUBLE) / {1} * 100.0::DOUBLE END"


def _pct(part: str, whole: str) -> str:
    return _PLAIN.format(_PCT.format(part, whole))


_CPU = {"user": "40 + k % 7", "system": "20", "idle": "20", "iowait": "10", "guest": "10"}
_STATE = lambda s: _PLAIN.format(f"CAST({_CPU[s]} AS DOUBLE) / (100 + k % 7) * 100.0::DOUBLE") if s in _CPU else "'0'"
_ACTIVE = "(100.0::DOUBLE - 20.0::DOUBLE / (100 + k % 7) * 100.0::DOUBLE)"
METRIC_SQL = f"""
WITH {_HOSTS}
SELECT host, i AS tick, 'mem,host=' || host || ',region=eu total=' || (k + 1000) * 1024 || 'i,available=' || (400 + i) * 1024 || 'i,used=' || (k + 600 - i) * 1024 || 'i,free=102400i,used_percent=' || {_pct("(k + 600 - i) * 1024", "((k + 1000) * 1024)")} || ',available_percent=' || {_pct("(400 + i) * 1024", "((k + 1000) * 1024)")} || ',up=true ' || ts AS lp FROM h
UNION ALL SELECT host, i, 'swap,host=' || host || ',region=eu total=' || k % 3 * 1024 || 'i,used=' || greatest(k % 3 - 1, 0) * 1024 || 'i,free=1024i,used_percent=' || {_pct("greatest(k % 3 - 1, 0) * 1024", "(k % 3 * 1024)")} || ',up=true ' || ts FROM h
UNION ALL SELECT host, i, 'diskio,host=' || host || ',name=sda,region=eu reads=' || k || 'i,writes=6i,read_bytes=' || (k + i) * 512 || 'i,write_bytes=4096i,read_time=4i,write_time=9i,io_time=1i,weighted_io_time=2i,iops_in_progress=0i,up=true ' || ts FROM h
UNION ALL SELECT host, i, 'net,host=' || host || ',interface=eth0,region=eu bytes_recv=' || k || 'i,bytes_sent=' || (k + i) || 'i,packets_recv=2i,packets_sent=10i,err_in=3i,err_out=11i,up=true ' || ts FROM h
UNION ALL SELECT host, i, 'system,host=' || host || ',region=eu load1=' || k || '.25,load5=0.5,load15=0.75,n_cpus=1i,uptime=' || (k + i) || 'i,up=true ' || ts FROM h
UNION ALL SELECT host, i, 'disk,device=/dev/sda1,fstype=ext4,host=' || host || ',path=/m\\ d,region=eu total=' || k * 40960 || 'i,free=' || k * 16384 || 'i,used=' || k * 24576 || 'i,used_percent=' || {_pct("k * 24576", "(k * 40960)")} || CASE WHEN k % 2 = 0 THEN ',inodes_total=100i,inodes_free=40i,inodes_used=60i' ELSE '' END || ',up=true ' || ts FROM h
UNION ALL SELECT host, i, 'cpu,cpu=' || cpu || ',host=' || host || ',region=eu usage_idle=' || {_PLAIN.format(f"(100.0::DOUBLE - {_ACTIVE})")} || ',usage_active=' || {_PLAIN.format(_ACTIVE)} || {" || ".join(f"',usage_{s}=' || {_STATE(s)}" for s in metrics.STATES)} || ',up=true ' || ts FROM h, (VALUES ('cpu-total'), ('cpu0')) c(cpu) WHERE i = 1"""


@query("metric_lines", METRIC_SQL)
def metric_lines(t) -> DataFrame:
    return _metric_lines(t).select("host", F.col("tick").cast("long").alias("tick"), "lp")


@query("metric_schema", "SELECT m AS measurement, CAST(count(*) * f AS BIGINT) AS n_rows, CASE WHEN m = 'net' THEN 'rack' ELSE '' END AS missing FROM customer, (VALUES ('cpu', 2), ('mem', 2), ('swap', 2), ('disk', 2), ('diskio', 2), ('net', 2), ('system', 2)) v(m, f) GROUP BY m, f")
def metric_schema(t) -> DataFrame:
    """All that a measurement must have is there; a tag that nobody writes is told."""
    required = {m: ([*tags, "region", *(["rack"] if m == "net" else [])], [*fields, "up"]) for m, (tags, fields) in hostmetrics.MEASUREMENTS.items()}
    return gates.measurement_schema(_metric_lines(t), required, optional=hostmetrics.OPTIONAL)


@query("container_check", """
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (turn >= 3) AS BIGINT) AS outside, bool_or(role = 'user') AS has_stdout, bool_or(role <> 'user') AS has_stderr,
 CAST(count(*) AS BIGINT) AS n_starts, CAST(count(*) FILTER (conv_id % 4 <> 0) AS BIGINT) AS n_whole, CAST(count(*) FILTER (conv_id % 5 = 0) AS BIGINT) AS n_wrong_tags FROM conversations""")
def container_check(t) -> DataFrame:
    """Each turn as a container message with a mark at its begin, and, for most, one at its end."""
    x = _turns(t)
    text = F.concat(F.lit("BEGIN "), "text", F.when(F.col("conv_id") % 4 != 0, " FINISH").otherwise(""))
    tags = F.create_map(F.lit("pod"), F.when(F.col("conv_id") % 5 == 0, "other").otherwise("web"))
    return gates.container_check(x.select(F.col("turn").cast("long").alias("ts_ns"), "stream", text.alias("text"), tags.alias("tags")), "ts_ns", 0, 3, "stream", "text", ("BEGIN ", " FINISH"), {"pod": "web"})


@query("cardinality_warnings", """
WITH b AS (SELECT user_id, event_id // 20 AS batch FROM events WHERE event_id // 20 < 10), f AS (SELECT user_id, min(batch) AS batch FROM b GROUP BY user_id),
 n AS (SELECT g.batch, count(*) AS n FROM range(10) g(batch) JOIN f ON f.batch <= g.batch GROUP BY g.batch)
SELECT 'user' AS key, CAST(min(batch) AS BIGINT) AS batch, CAST(arg_min(n, batch) AS BIGINT) AS n_values FROM n WHERE n > 20 HAVING count(*) > 0""")
def cardinality_warnings(t) -> DataFrame:
    tags = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"))
    x = t("events").select(F.floor(F.col("event_id") / 20).alias("batch"), tags.alias("tags"))
    return gates.cardinality_warnings(gates.tag_sketches(x, "batch", 20), "batch", 20, 10)


@query("coerce_values", """
WITH w AS (SELECT unnest(string_split(text, ' ')) AS v FROM documents UNION ALL SELECT props->>'k' FROM events UNION ALL SELECT CAST(user_id % 2 = 0 AS VARCHAR) FROM events UNION ALL SELECT CAST(CAST(value * 4 AS BIGINT) / 4 AS VARCHAR) FROM events)
SELECT v, CAST(count(*) AS BIGINT) AS n, CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN TRY_CAST(v AS BIGINT) END AS as_integer,
 CASE WHEN regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(v AS DOUBLE) END AS as_float,
 CASE WHEN v IN ('true','True','TRUE','t','T') THEN 'true' WHEN v IN ('false','False','FALSE','f','F') THEN 'false' ELSE '' END AS as_boolean FROM w WHERE NOT regexp_full_match(lower(v), '[+-]?(inf|infinity|nan)') GROUP BY v""")
def coerce_values(t) -> DataFrame:
    """Every word and what it is as a value of each kind."""
    e = t("events")
    words = t("documents").select(F.explode(F.split("text", " ")).alias("v")).union(e.select(F.element_at(parse_json(F.col("props")), "k"))).union(e.select((F.col("user_id") % 2 == 0).cast("string"))).union(e.select((F.round(F.col("value") * 4).cast("long") / 4).cast("string")))
    words = words.where(~F.lower("v").rlike("^[+-]?(inf|infinity|nan)$")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return words.select("v", "n", coerce(F.col("v"), "integer").alias("as_integer"), coerce(F.col("v"), "float").alias("as_float"), F.coalesce(coerce(F.col("v"), "boolean").cast("string"), F.lit("")).alias("as_boolean"))


@query("ingest_time", "SELECT event_id, true AS later FROM events")
def ingest_time(t) -> DataFrame:
    return t("events").select("event_id", (ingest_ns() > timestamp_ns(F.col("ts"))).alias("later"))


@query("label_file_back", "SELECT c_custkey, 'app=' || n_name AS labels FROM customer JOIN nation ON n_nationkey = c_nationkey")
def label_file_back(t) -> DataFrame:
    from quarry.functions.maps import shown

    n = t("nation")
    where = scratch(n.sparkSession)
    entry = F.concat(F.lit("ns/p"), F.col("n_nationkey").cast("string"))
    pods = n.agg(F.map_from_entries(F.collect_list(F.struct(entry.alias("k"), F.create_map(F.lit("app"), F.col("n_name"), F.lit("hash"), F.lit("x")).alias("v")))).alias("m"))
    pods.select(F.to_json("m").alias("value")).write.text(where)
    labels = enrich.read_pod_labels(n.sparkSession, where)
    paths = t("customer").select("c_custkey", F.lit("ns").alias("namespace"), F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("pod"))
    return enrich.join_pod_labels(paths, labels, ["app"]).select("c_custkey", shown(F.col("label_tags")).alias("labels"))


@query("encode_texts", r"""
SELECT doc_id, md5('doc text="' || replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(13), ''), chr(10), '\n') || '" 5') AS lp_md5 FROM documents""")
def encode_texts(t) -> DataFrame:
    line = encode_line(F.lit("doc"), {}, {"text": (F.col("text"), "string")}, F.lit(5))
    return t("documents").select("doc_id", F.md5(line.cast("binary")).alias("lp_md5"))


@query("multiline_disabled", "SELECT CAST(doc_id AS VARCHAR) AS state_key, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents) GROUP BY doc_id")
def multiline_disabled(t) -> DataFrame:
    from quarry.queries import document_lines

    return framing.join_multiline(document_lines(t), None).where("n_lines = 1 and not truncated").groupBy("state_key").agg(F.count(F.lit(1)).alias("n"))


@query("multiline_byte_cap", """
WITH RECURSIVE l AS (SELECT CAST(doc_id AS VARCHAR) AS state_key, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS pos FROM documents),
 x AS (SELECT *, regexp_matches(line, '^[A-Z]') AS starts, CAST(strlen(line) + 1 AS BIGINT) AS size FROM l),
 r AS (SELECT state_key, pos, CAST(0 AS BIGINT) AS rec, CAST(1 AS BIGINT) AS n, size AS bytes, size >= 300 AS cut FROM x WHERE pos = 0
       UNION ALL
       SELECT x.state_key, x.pos, CASE WHEN cut OR starts THEN rec + 1 ELSE rec END, CASE WHEN cut OR starts THEN 1 ELSE n + 1 END, CASE WHEN cut OR starts THEN x.size ELSE bytes + x.size END,
              CASE WHEN cut THEN x.size >= 300 WHEN starts THEN false ELSE n + 1 >= 4 OR bytes + x.size >= 300 END
       FROM r JOIN x ON x.state_key = r.state_key AND x.pos = r.pos + 1)
SELECT r.state_key, min(r.pos) AS pos, CAST(count(*) AS INT) AS n_lines, bool_or(cut) AS truncated, md5(string_agg(line, chr(10) ORDER BY r.pos)) AS line_md5 FROM r JOIN x ON x.state_key = r.state_key AND x.pos = r.pos GROUP BY r.state_key, rec""")
def multiline_byte_cap(t) -> DataFrame:
    """Records cut at four lines or 300 bytes; a first line that is longer waits while another record was open."""
    from quarry.queries import document_lines

    x = framing.join_multiline(document_lines(t), "^[A-Z]", max_lines=4, max_bytes=300)
    return x.select("state_key", "pos", "n_lines", "truncated", F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query("cri_byte_cap", """
WITH RECURSIVE f AS (SELECT CAST(conv_id AS VARCHAR) AS state_key, turn, CASE WHEN role = 'user' THEN 'stdout' ELSE 'stderr' END AS stream, turn % 5 = 4 AS closes, replace(text, chr(10), ' ') AS text FROM conversations),
 x AS (SELECT *, row_number() OVER (PARTITION BY state_key, stream ORDER BY turn) AS i, CAST(strlen(text) AS BIGINT) AS size FROM f),
 r AS (SELECT state_key, stream, i, CAST(0 AS BIGINT) AS rec, size AS bytes, NOT closes AND size >= 200 AS cut, closes AS done FROM x WHERE i = 1
       UNION ALL
       SELECT x.state_key, x.stream, x.i, CASE WHEN cut OR done THEN rec + 1 ELSE rec END, CASE WHEN cut OR done THEN x.size ELSE bytes + x.size END,
              NOT x.closes AND CASE WHEN cut OR done THEN x.size ELSE bytes + x.size END >= 200, x.closes
       FROM r JOIN x ON x.state_key = r.state_key AND x.stream = r.stream AND x.i = r.i + 1)
SELECT r.state_key, r.stream, max(turn) AS pos, 't' || min(turn) AS time, md5(string_agg(text, '' ORDER BY turn)) AS log_md5, bool_or(cut) AS truncated FROM r JOIN x ON x.state_key = r.state_key AND x.stream = r.stream AND x.i = r.i GROUP BY r.state_key, r.stream, rec""")
def cri_byte_cap(t) -> DataFrame:
    """Messages cut at 200 bytes; what is left opens a message with a time of its own."""
    c = t("conversations")
    line = F.concat_ws(" ", F.concat(F.lit("t"), F.col("turn").cast("string")), F.when(F.col("role") == "user", "stdout").otherwise("stderr"), F.when(F.col("turn") % 5 == 4, "F").otherwise("P"), F.regexp_replace("text", "\n", " "))
    lines = c.select(F.col("conv_id").cast("string").alias("state_key"), F.col("turn").cast("long").alias("pos"), line.alias("line"))
    x = framing.reassemble_cri(lines, 200)[0]
    return x.select("state_key", "stream", "pos", "time", F.md5(F.col("log").cast("binary")).alias("log_md5"), "truncated")


@query("flagged_mounts", """
SELECT 'h' || c_custkey AS host, CAST(i AS INT) AS tick, p AS path FROM customer, (VALUES (0), (1)) v(i), (VALUES ('/m/tmpfs2'), ('/m/ramfs_'), ('/m/ext4')) w(p)""")
def flagged_mounts(t) -> DataFrame:
    """Mounts of every file system that holds no data, written out here, and of names near to them that do."""
    pseudo = ["tmpfs", "devtmpfs", "devfs", "iso9660", "overlay", "aufs", "squashfs", "proc", "sysfs", "cgroup", "cgroup2", "devpts", "mqueue", "hugetlbfs", "debugfs", "tracefs", "securityfs", "pstore", "bpf", "configfs", "fusectl", "binfmt_misc", "autofs", "nsfs", "ramfs", "rpc_pipefs", "selinuxfs", "efivarfs"]
    text = "\n".join(f"{30 + i} 1 0:{i} / /m/{fs} rw - {fs} dev rw" for i, fs in enumerate([*pseudo, "tmpfs2", "ramfs_", "ext4"]))
    return hostmetrics.parse_mountinfo(snapshots(t, "mountinfo", lambda k, tick: F.lit(text))).select("host", "tick", "path")
