"""Registered queries over the given tables, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import lineproto
from quarry.functions.maps import merge, series_key, shown
from quarry.functions.parse import coerce, decode_lossy, parse_json, parse_plain, parse_ts_ns, plain_float, timestamp_ns
from quarry.operators import accounting, dedup, enrich, framing, gates, hostmetrics, records, sinks, stamping, watermarks
from quarry.plans.pipeline import compose
from quarry.plans.spec import Filter, Redact, Sample, SourceSpec, WatermarkSpec
from quarry.session import prepare
from quarry.sources import files, otlp, winlog

HOUR = 3_600_000_000_000
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def events(t) -> DataFrame:
    """Events as records: streams by type, hour-rounded source times, ids as positions."""
    e = t("events")
    ns = timestamp_ns(F.col("ts"))
    return e.select(F.col("event_type").alias("state_key"), F.col("event_id").alias("pos"), "user_id", "event_type", "value", "props", ns.alias("event_ns"), (ns - F.pmod(ns, F.lit(HOUR))).alias("source_ts_ns"), F.create_map(F.lit("stream"), F.lit("events"), F.lit("event_type"), F.col("event_type")).alias("tags"))


HOURS = f"epoch_us(ts) * 1000 - (epoch_us(ts) * 1000) % {HOUR}"


@query("flagship_exact_ingest", f"""
WITH s AS (SELECT *, {HOURS} AS tick FROM events)
SELECT event_type, CAST(count(*) AS BIGINT) AS lines, CAST(count(DISTINCT tick) AS BIGINT) AS naive_rows, CAST(count(*) AS BIGINT) AS stamped_rows, CAST(count(*) - count(DISTINCT tick) AS BIGINT) AS lost_naive FROM s GROUP BY event_type""")
def flagship(t) -> DataFrame:
    stamped = stamping.stamp(events(t), HOUR)
    key = ["event_type", "ts_ns"]
    naive = dedup.collision_report(stamped.withColumn("ts_ns", F.col("tick")), ["event_type"], key)
    exact = dedup.collision_report(stamped, ["event_type"], key)
    return naive.join(exact.select("event_type", F.col("rows").alias("stamped_rows")), "event_type").select("event_type", "lines", F.col("rows").alias("naive_rows"), "stamped_rows", F.col("lost").alias("lost_naive"))


@query("map_props_json", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def map_props_json(t) -> DataFrame:
    return t("events").select("event_id", coerce(F.element_at(parse_json(F.col("props")), "k"), "integer").alias("k"))


@query("parse_plain_lines", r"""
SELECT doc_id, CAST(i AS BIGINT) AS pos, len(rtrim(l, chr(13))) AS n_chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) WHERE regexp_matches(l, '\S')""")
def parse_plain_lines(t) -> DataFrame:
    x = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    x = records.drop_blank(x.withColumn("line", decode_lossy(F.col("line").cast("binary"))))
    return x.select("doc_id", F.col("pos").cast("long").alias("pos"), F.length(F.element_at(parse_plain(F.col("line")), "message")).cast("long").alias("n_chars"))


@query("coerce_quarantine", """
WITH w AS (SELECT unnest(string_split(text, ' ')) AS v FROM documents UNION ALL SELECT props->>'k' FROM events UNION ALL SELECT CAST(user_id % 2 = 0 AS VARCHAR) FROM events)
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (regexp_full_match(v, '[+-]?[0-9]{1,18}')) AS BIGINT) AS n_integer,
 CAST(count(*) FILTER (regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') OR regexp_full_match(lower(v), '[+-]?(inf|infinity|nan)')) AS BIGINT) AS n_float,
 CAST(count(*) FILTER (v IN ('true','True','TRUE','t','T','false','False','FALSE','f','F')) AS BIGINT) AS n_boolean FROM w""")
def coerce_quarantine(t) -> DataFrame:
    words = t("documents").select(F.explode(F.split("text", " ")).alias("v"))
    words = words.union(t("events").select(F.element_at(parse_json(F.col("props")), "k"))).union(t("events").select((F.col("user_id") % 2 == 0).cast("string")))
    ok = {f"n_{k}": F.count_if(coerce(F.col("v"), k).isNotNull()) for k in ("integer", "float", "boolean")}
    return words.agg(F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in ok.items()))


@query("tag_allowlist_lastwins", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'event_type=' || event_type || ',host=n1,stream=' || event_type ELSE 'event_type=' || event_type || ',host=n1,stream=events' END AS tags FROM events""")
def tag_allowlist(t) -> DataFrame:
    spec = SourceSpec("events", "t", tags=("stream", "event_type", "absent", "empty"), tags_static={"host": "n1", "event_type": "static"})
    e = t("events")
    parsed = merge(F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("empty"), F.lit(""), F.lit("other"), F.lit("x")), F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("stream"), F.col("event_type"))))
    return e.select("event_id", shown(records.record_tags(parsed, spec, F.lit("events"))).alias("tags"))


@query("visibility_and_pod_tags", """
SELECT c_custkey, '_visibility=role(ops),container=c' || c_nationkey || ',namespace=ns' || (c_custkey % 5) || ',pod=' || lower(replace(c_name, '#', '-')) || ',stream=s' AS tags FROM customer""")
def visibility(t) -> DataFrame:
    c = t("customer").withColumn("path", container_path())
    spec = SourceSpec("s", "t", visibility="role(ops)")
    return c.select("c_custkey", shown(records.record_tags(F.create_map(F.lit("a"), F.lit("b")), spec, F.lit("s"), enrich.pod_tags(F.col("path")))).alias("tags"))


def container_path():
    return F.concat(F.lit("/var/log/containers/"), F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.lit("_ns"), (F.col("c_custkey") % 5).cast("string"), F.lit("_c"), F.col("c_nationkey").cast("string"), F.lit("-"), F.sha2(F.col("c_custkey").cast("string"), 256), F.lit(".log"))


@query("ts_formats", "SELECT event_id, epoch_us(ts) * 1000 AS ns, true AS all_equal FROM events")
def ts_formats(t) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    texts = {"unix_us": us.cast("string"), "unix_ns": (us * 1000).cast("string"), "rfc3339": F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")}
    seconds = {"unix_s": F.floor(us / 1_000_000).cast("string"), "unix_ms": F.floor(us / 1000).cast("string")}
    same = parse_ts_ns(seconds["unix_s"], "unix_s") == F.floor(us / 1_000_000) * 1_000_000_000
    same = same & (parse_ts_ns(seconds["unix_ms"], "unix_ms") == F.floor(us / 1000) * 1_000_000)
    for fmt, c in texts.items():
        same = same & (parse_ts_ns(c, fmt) == us * 1000)
    return t("events").select("event_id", (us * 1000).alias("ns"), same.alias("all_equal"))


KINDS = {"value": "float", "user_id": "integer", "event_type": "string"}


def typed(t) -> DataFrame:
    return events(t).select("*", F.col("value").alias("f_value"), F.col("user_id").alias("f_user_id"), F.col("event_type").alias("f_event_type"))


def _filtered(name: str, filters: list[Filter], where: str) -> None:
    @query(name, f"SELECT event_id AS pos, event_type FROM events WHERE {where}")
    def run(t) -> DataFrame:
        return typed(t).where(records.passes_filters(filters, KINDS)).select("pos", "event_type")


_filtered("filter_deny", [Filter("event_type", "click")], "event_type <> 'click'")
_filtered("filter_allow", [Filter("event_type", "view", drop=False), Filter("event_type", "click", drop=False)], "event_type IN ('view', 'click')")
_filtered("filter_deny_wins", [Filter("event_type", "click"), Filter("event_type", "click", drop=False), Filter("user_id", "7", drop=False)], "event_type <> 'click' AND user_id = 7")

FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, {bytes}), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
_NS = "(epoch_us(ts) * 1000)"
_BYTES = "list_concat(list_transform(string_split(concat('event_type', '|', event_type, '|', 'stream', '|', 'events', '|', 'user_id', '|', user_id, '|'), ''), lambda c: CASE WHEN c = '|' THEN 0::HUGEINT ELSE ord(c)::HUGEINT END), list_transform(range(8), lambda i: ((" + _NS + " >> CAST(8 * i AS INTEGER)) & 255)::HUGEINT))"


def _sampled(name: str, rule: Sample, where: str) -> None:
    @query(name, f"SELECT event_id AS pos FROM (SELECT *, {FNV.format(bytes=_BYTES)} AS h FROM events) WHERE {where}")
    def run(t) -> DataFrame:
        return typed(t).where(records.passes_samples([rule], {"user_id": "integer"}, "event_ns")).select("pos")


_sampled("sample_rate4", Sample(4), "h % 4 = 0")
_sampled("sample_pred", Sample(3, "event_type", "click"), "event_type <> 'click' OR h % 3 = 0")


@query("redact_tokens", r"""SELECT doc_id, md5(regexp_replace(text, 'token = "([0-9a-f]{4})[0-9a-f]*"', 'token = "\1***"', 'g')) AS text_md5 FROM documents""")
def redact_tokens(t) -> DataFrame:
    rule = Redact("text", 'token = "([0-9a-f]{4})[0-9a-f]*"', 'token = "$1***"')
    x = t("documents").withColumnRenamed("text", "f_text")
    return x.withColumns(records.redacted([rule], {"text": "string"})).select("doc_id", F.md5(F.col("f_text").cast("binary")).alias("text_md5"))


@query("redact_email", r"""SELECT doc_id, md5(regexp_replace(text, '[a-z0-9._]+@[a-z0-9.]+', '***', 'g')) AS text_md5 FROM documents""")
def redact_email(t) -> DataFrame:
    x = t("documents").withColumnRenamed("text", "f_text")
    return x.withColumns(records.redacted([Redact("text", "[a-z0-9._]+@[a-z0-9.]+")], {"text": "string"})).select("doc_id", F.md5(F.col("f_text").cast("binary")).alias("text_md5"))


@query("stamp_hour", f"SELECT event_id AS pos, {HOURS} + row_number() OVER (PARTITION BY event_type, {HOURS} ORDER BY event_id) - 1 AS ts_ns FROM events")
def stamp_hour(t) -> DataFrame:
    return stamping.stamp(events(t), HOUR).select("pos", "ts_ns")


@query("naive_vs_stamped", f"SELECT event_type, CAST(count(*) AS BIGINT) AS lines, CAST(count(DISTINCT {HOURS}) AS BIGINT) AS rows, CAST(count(*) - count(DISTINCT {HOURS}) AS BIGINT) AS lost FROM events GROUP BY event_type")
def naive(t) -> DataFrame:
    return dedup.collision_report(stamping.stamp(events(t), 1), ["event_type"], ["event_type", "ts_ns"])


@query("stamp_exhausted", "SELECT event_type, CAST(greatest(count(*) - 10, 0) AS BIGINT) AS spent FROM (SELECT event_type, epoch_us(ts) // 86400000000 AS d FROM events) GROUP BY event_type, d HAVING count(*) > 10")
def stamp_exhausted(t) -> DataFrame:
    day = F.col("event_ns") - F.pmod("event_ns", F.lit(24 * HOUR))
    return stamping.stamp(events(t).withColumn("source_ts_ns", day), 10).where("exhausted").groupBy("event_type", "tick").agg(F.count(F.lit(1)).alias("spent")).select("event_type", "spent")


@query("stamp_resume", f"""
WITH s AS (SELECT event_id, event_type, {HOURS} AS tick FROM events)
SELECT event_id AS pos, tick + row_number() OVER (PARTITION BY event_type, tick ORDER BY event_id) - 1 AS ts_ns FROM s""")
def stamp_resume(t) -> DataFrame:
    """Two runs, the second going on where the first ended, stamp as one would."""
    e = events(t)
    cut = e.groupBy("state_key").agg(F.floor(F.avg("pos")).alias("cut"))
    x = e.join(cut, "state_key")
    first = stamping.stamp(x.where("pos <= cut"), HOUR)
    second = stamping.stamp(x.where("pos > cut"), HOUR, resume=first.groupBy("state_key", "tick").agg((F.max("seq") + 1).alias("next_seq")))
    return first.unionByName(second).select("pos", "ts_ns")


@query("stamp_series_scope", f"SELECT event_id AS pos, {HOURS} + row_number() OVER (PARTITION BY event_type, {HOURS} ORDER BY event_id) - 1 AS ts_ns FROM events")
def stamp_series(t) -> DataFrame:
    split = events(t).withColumn("state_key", F.concat("state_key", F.lit("-"), (F.col("pos") % 3).cast("string")))
    return stamping.stamp_by_series(split, HOUR, ["pos"]).select("pos", "ts_ns")


@query("disambiguate_by_tag", f"SELECT event_id AS pos, {HOURS} AS ts_ns, 'event_type=' || event_type || ',seq=' || (row_number() OVER (PARTITION BY event_type, {HOURS} ORDER BY event_id) - 1) || ',stream=events' AS tags FROM events")
def disambiguate(t) -> DataFrame:
    return stamping.disambiguate_by_tag(stamping.stamp(events(t), HOUR)).select("pos", "ts_ns", shown(F.col("tags")).alias("tags"))


def document_lines(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").cast("string").alias("state_key"), F.posexplode(F.split("text", "\n")).alias("p", "line")).select("state_key", F.col("p").cast("long").alias("pos"), "line")


LINES = "l AS (SELECT CAST(doc_id AS VARCHAR) AS state_key, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS pos FROM documents)"


@query("multiline_join", f"""
WITH {LINES}, i AS (SELECT *, sum(CAST(regexp_matches(line, '^[A-Z]') AS INT)) OVER (PARTITION BY state_key ORDER BY pos) AS island FROM l)
SELECT state_key, min(pos) AS pos, CAST(count(*) AS INT) AS n_lines, md5(string_agg(line, chr(10) ORDER BY pos)) AS line_md5 FROM i GROUP BY state_key, island""")
def multiline_join(t) -> DataFrame:
    x = framing.join_multiline(document_lines(t), "^[A-Z]", max_lines=10**6, max_bytes=10**9)
    return x.select("state_key", "pos", "n_lines", F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query("multiline_line_cap", f"""
WITH {LINES}, i AS (SELECT *, sum(CAST(regexp_matches(line, '^Z') AS INT)) OVER (PARTITION BY state_key ORDER BY pos) AS island FROM l),
 n AS (SELECT *, (row_number() OVER (PARTITION BY state_key, island ORDER BY pos) - 1) // 4 AS chunk FROM i)
SELECT state_key, min(pos) AS pos, CAST(count(*) AS INT) AS n_lines, count(*) = 4 AS truncated FROM n GROUP BY state_key, island, chunk""")
def multiline_line_cap(t) -> DataFrame:
    return framing.join_multiline(document_lines(t), "^Z", max_lines=4, max_bytes=10**9).select("state_key", "pos", "n_lines", "truncated")


def turns(t) -> DataFrame:
    """Turns of conversations as fragments of two streams: even turns go on, odd ones end."""
    c = t("conversations").withColumn("text", F.regexp_replace("text", "\n", " "))
    return c.select(F.col("conv_id").cast("string").alias("state_key"), F.col("turn").cast("long").alias("pos"), F.when(F.col("role") == "user", "stdout").otherwise("stderr").alias("stream"), (F.col("turn") % 3 == 2).alias("closes"), "text")


FRAGMENTS = """f AS (SELECT CAST(conv_id AS VARCHAR) AS state_key, turn AS pos, CASE WHEN role = 'user' THEN 'stdout' ELSE 'stderr' END AS stream, turn % 3 = 2 AS closes, replace(text, chr(10), ' ') AS text FROM conversations),
 m AS (SELECT *, coalesce(sum(CAST(closes AS INT)) OVER (PARTITION BY state_key, stream ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS message FROM f)
SELECT state_key, stream, max(pos) AS pos, 't' || min(pos) AS time, md5(string_agg(text, '' ORDER BY pos)) AS log_md5, NOT bool_or(closes) AS unclosed FROM m GROUP BY state_key, stream, message"""


def _messages(x: DataFrame) -> DataFrame:
    return x.select("state_key", "stream", "pos", "time", F.md5(F.col("log").cast("binary")).alias("log_md5"), "unclosed")


@query("docker_reassemble", "WITH " + FRAGMENTS)
def docker(t) -> DataFrame:
    log = F.concat("text", F.when(F.col("closes"), "\n").otherwise(""))
    line = F.to_json(F.struct(log.alias("log"), "stream", F.concat(F.lit("t"), F.col("pos").cast("string")).alias("time")))
    return _messages(framing.reassemble_docker(turns(t).select("state_key", "pos", line.alias("line")), 10**9)[0])


@query("cri_reassemble", "WITH " + FRAGMENTS)
def cri(t) -> DataFrame:
    line = F.concat_ws(" ", F.concat(F.lit("t"), F.col("pos").cast("string")), "stream", F.when(F.col("closes"), "F").otherwise("P"), "text")
    return _messages(framing.reassemble_cri(turns(t).select("state_key", "pos", line.alias("line")), 10**9)[0])


@query("cri_frame_errors", """
SELECT CASE WHEN turn % 4 = 0 THEN 'unparseable: no stream' WHEN turn % 4 = 1 THEN 'unparseable: bad stream std' WHEN turn % 4 = 2 THEN 'unparseable: no tag' ELSE 'unparseable: bad tag X' END AS reason, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY ALL""")
def cri_errors(t) -> DataFrame:
    k = F.col("turn") % 4
    line = F.when(k == 0, "t0").when(k == 1, "t0 std F x").when(k == 2, "t0 stdout").otherwise("t0 stderr X y")
    x = t("conversations").select(F.col("conv_id").cast("string").alias("state_key"), F.col("turn").cast("long").alias("pos"), line.alias("line"))
    return framing.reassemble_cri(x)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


PATH = "'/var/log/containers/' || lower(replace(c_name, '#', '-')) || '_ns' || (c_custkey % 5) || '_c' || c_nationkey || '-' || sha256(CAST(c_custkey AS VARCHAR)) || '.log'"


@query("cri_path", "SELECT c_custkey, lower(replace(c_name, '#', '-')) AS pod, 'ns' || (c_custkey % 5) AS namespace, 'c' || c_nationkey AS container, sha256(CAST(c_custkey AS VARCHAR)) AS container_id FROM customer")
def cri_path(t) -> DataFrame:
    return t("customer").select("c_custkey", enrich.parse_cri_path(container_path()).alias("p")).select("c_custkey", "p.*")


@query("stream_label", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'file.app' ELSE lower(replace(c_name, '#', '-')) || '_ns' || (c_custkey % 5) || '_c' || c_nationkey END AS label FROM customer")
def stream_label(t) -> DataFrame:
    path = F.when(F.col("c_custkey") % 7 == 0, "/var/log/app.log").otherwise(container_path())
    return t("customer").select("c_custkey", enrich.stream_label(path, files.stream_id("file", path)).alias("label"))


@query("series_cardinality", "SELECT CAST(count(DISTINCT (event_type, user_id % 10)) AS BIGINT) AS n_series, CAST(count(DISTINCT event_type) AS BIGINT) AS n_streams, CAST(0 AS BIGINT) AS n_id_tags FROM events")
def cardinality(t) -> DataFrame:
    tags = F.create_map(F.lit("stream"), F.col("event_type"), F.lit("shard"), (F.col("user_id") % 10).cast("string"))
    return gates.series_cardinality(t("events").select(tags.alias("tags")))


@query("pod_labels", "SELECT c_custkey, 'app=' || n_name AS labels FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey % 2 = 0 UNION ALL SELECT c_custkey, '' FROM customer WHERE c_nationkey % 2 = 1")
def pod_labels(t) -> DataFrame:
    labels = t("nation").where("n_nationkey % 2 = 0").select((F.lit("ns")).alias("namespace"), F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("pod"), F.create_map(F.lit("app"), F.col("n_name"), F.lit("pod-template-hash"), F.lit("x")).alias("labels"))
    paths = t("customer").select("c_custkey", F.lit("ns").alias("namespace"), F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("pod"))
    return enrich.join_pod_labels(paths, labels, ["app", "team"]).select("c_custkey", shown(F.col("label_tags")).alias("labels"))


def arrivals(t) -> DataFrame:
    """Events in an order of arrival that is not that of their times; batches of 250."""
    o = F.col("event_id") + (F.col("event_id") * 7919) % 50
    # events of one ``o`` differ by less than 50 in their ids, in whose order they arrive
    x = t("events").select(F.lit("all").alias("stream"), "event_id", timestamp_ns(F.col("ts")).alias("ts_ns"), (o * 64 + F.col("event_id") - o + 50).alias("pos"))
    x = framing.running_total(x, F.lit(1), ["stream"], "arrival", before=True)
    return x.withColumn("batch", F.floor(F.col("arrival") / 250))


ARRIVALS = """a AS (SELECT 'all' AS stream, event_id, epoch_us(ts) * 1000 AS ts_ns, row_number() OVER (ORDER BY event_id + (event_id * 7919) % 50, event_id) - 1 AS arrival FROM events),
 b AS (SELECT *, arrival // 250 AS batch, greatest(0, max(ts_ns) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - ts_ns) AS late FROM a)"""
WM = WatermarkSpec(floor_ns=HOUR // 4, ceiling_ns=5 * HOUR)
PUBLISHED = f"""{ARRIVALS}, e AS (SELECT batch, max(arrival) AS stop, max(ts_ns) AS batch_max FROM b GROUP BY batch),
 s AS (SELECT e.batch, any_value(batch_max) AS batch_max, list_sort(list(late)) AS l FROM e JOIN b ON b.arrival > 0 AND b.arrival <= stop AND b.arrival > stop - 4096 GROUP BY e.batch),
 v AS (SELECT batch, batch_max, CAST(CASE WHEN len(l) < 256 THEN {WM.ceiling_ns} ELSE least({WM.ceiling_ns}, greatest({WM.floor_ns}, l[CAST(round((len(l) - 1) * 0.999) AS INT) + 1])) END AS BIGINT) AS lateness_ns FROM s),
 p AS (SELECT 'all' AS stream, batch, lateness_ns, max(batch_max - lateness_ns) OVER (ORDER BY batch) AS watermark_ns FROM v)"""


@query("lateness", f"WITH {ARRIVALS} SELECT event_id, CASE WHEN arrival > 0 THEN late END AS lateness FROM b")
def late(t) -> DataFrame:
    return watermarks.lateness(arrivals(t), ["stream"], "arrival").select("event_id", "lateness")


@query("watermark_batches", f"WITH {PUBLISHED} SELECT CAST(batch AS BIGINT) AS batch, lateness_ns, watermark_ns FROM p")
def watermark_batches(t) -> DataFrame:
    return watermarks.estimates(arrivals(t), ["stream"], "arrival", "batch", WM).select("batch", "lateness_ns", "watermark_ns")


@query("watermark_violations", f"WITH {PUBLISHED} SELECT CAST(b.batch AS BIGINT) AS batch, CAST(count(*) FILTER (b.ts_ns < q.watermark_ns) AS BIGINT) AS violations FROM b LEFT JOIN p q ON q.batch = b.batch - 1 GROUP BY b.batch")
def watermark_violations(t) -> DataFrame:
    a = arrivals(t)
    return watermarks.violations(a, watermarks.estimates(a, ["stream"], "arrival", "batch", WM), ["stream"], "batch").select("batch", "violations")


@query("watermark_complete", f"WITH {PUBLISHED}, h AS (SELECT DISTINCT {HOURS} + {HOUR} AS window_end_ns FROM events) SELECT window_end_ns, window_end_ns <= (SELECT max(watermark_ns) FROM p) AS complete FROM h")
def watermark_complete(t) -> DataFrame:
    windows = events(t).select(F.lit("all").alias("stream"), (F.col("source_ts_ns") + HOUR).alias("window_end_ns")).distinct()
    return watermarks.is_complete(windows, watermarks.estimates(arrivals(t), ["stream"], "arrival", "batch", WM), ["stream"]).select("window_end_ns", "complete")


@query("watermark_summary", f"WITH {PUBLISHED} SELECT 'all' AS stream, CAST(count(*) AS BIGINT) AS n_rows, max(watermark_ns) AS watermark_ns, max(lateness_ns) AS lateness_ns, CAST((SELECT count(*) FROM b JOIN p q ON q.batch = b.batch - 1 WHERE b.ts_ns < q.watermark_ns) AS BIGINT) AS violations FROM p")
def watermark_summary(t) -> DataFrame:
    a = arrivals(t)
    p = watermarks.estimates(a, ["stream"], "arrival", "batch", WM)
    return gates.watermark_summary(watermarks.watermark_rows(p, watermarks.violations(a, p, ["stream"], "batch"), ["stream"], "batch"), ["stream"])


@query("lww_latest", f"SELECT user_id, {HOURS} AS ts_ns, max(event_id) AS pos FROM events GROUP BY ALL")
def lww_latest(t) -> DataFrame:
    return dedup.lww(events(t).withColumnRenamed("source_ts_ns", "ts_ns"), ["user_id", "ts_ns"], ["pos"]).select("user_id", "ts_ns", "pos")


@query("replay_dedup", "SELECT CAST(count(*) + count(*) FILTER (event_id % 5 = 0) AS BIGINT) AS delivered, CAST(count(*) AS BIGINT) AS distinct_rows, CAST(count(*) FILTER (event_id % 5 = 0) AS BIGINT) AS replays FROM events")
def replay(t) -> DataFrame:
    e = stamping.stamp(events(t), HOUR).withColumn("series_key", series_key(F.col("tags")))
    return dedup.replay_report(e.unionByName(e.where("pos % 5 = 0")), ["series_key", "ts_ns"])


@query("counter_rate", """
WITH c AS (SELECT user_id, event_id, epoch_us(ts) * 1000 AS ts_ns, row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 1000 + event_id % 17 AS v FROM events)
SELECT event_id, round(CASE WHEN ts_ns > lag(ts_ns) OVER w THEN greatest(v - lag(v) OVER w, 0) / ((ts_ns - lag(ts_ns) OVER w) / 1e9) END, 6) AS rate FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def counter_rate(t) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    c = t("events").select("user_id", "event_id", timestamp_ns(F.col("ts")).alias("ts_ns"), (n * 1000 + F.col("event_id") % 17).alias("v"))
    return hostmetrics.counter_rate(c, ["user_id"], "event_id", "v", "ts_ns").select("event_id", F.round("rate", 6).alias("rate"))


def snapshots(t, source: str, content) -> DataFrame:
    """Captures of hosts (customers), two ticks each, with numbers that follow from the keys."""
    k = F.col("c_custkey")
    ticks = F.explode(F.array(F.lit(0), F.lit(1))).alias("tick")
    x = t("customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("h"), k.cast("string")).alias("host"), ticks)
    return x.select("host", "tick", (F.lit(10**18) + F.col("tick") * 10**10).alias("now_ns"), F.lit(source).alias("source"), content(F.col("k"), F.col("tick")).alias("content"))


def _say(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query("cpu_usage", """
SELECT 'h' || c_custkey AS host, cpu, round(100.0 * (50 + c_custkey % 7 - 10) / (100 + c_custkey % 7), 6) AS usage_user, round(100.0 - 100.0 * 20 / (100 + c_custkey % 7), 6) AS usage_active FROM customer, (VALUES ('cpu-total'), ('cpu0')) v(cpu)""")
def cpu(t) -> DataFrame:
    def content(k, tick):
        row = lambda name: _say(f"{name} ", (50 + k % 7) * tick, " 0 ", tick * 20, " ", tick * 20, " ", tick * 10, " 0 0 0 ", tick * 10, " 0\n")
        return F.concat(row("cpu"), row("cpu0"), F.lit("intr 5\ncpu9 1 1 1 1"))

    u = hostmetrics.cpu_usage(hostmetrics.parse_proc_stat(snapshots(t, "stat", content)))
    return u.select("host", "cpu", F.round("usage_user", 6).alias("usage_user"), F.round("usage_active", 6).alias("usage_active"))


@query("proc_meminfo", """
SELECT 'h' || c_custkey AS host, CAST(i AS INT) AS tick, (c_custkey + 1000) * 1024 AS total, CAST((c_custkey + 1000 - 400 - i) * 1024 AS BIGINT) AS used, CAST((30 + c_custkey % 9 - 5) * 1024 AS BIGINT) AS cached FROM customer, (VALUES (0), (1)) v(i)""")
def meminfo(t) -> DataFrame:
    content = lambda k, tick: _say("MemTotal: ", k + 1000, " kB\nMemFree: 100 kB\nMemAvailable: ", tick + 400, " kB\nBuffers: 7 kB\nCached: ", k % 9 + 10, " kB\nSReclaimable: 20 kB\nShmem: 5 kB\n")
    return hostmetrics.mem(snapshots(t, "meminfo", content)).select("host", "tick", "total", "used", "cached")


@query("proc_swap", "SELECT 'h' || c_custkey AS host, CAST(i AS INT) AS tick, CAST(c_custkey % 3 * 1024 AS BIGINT) AS total, CAST(greatest(c_custkey % 3 - 1, 0) * 1024 AS BIGINT) AS used FROM customer, (VALUES (0), (1)) v(i)")
def swap(t) -> DataFrame:
    return hostmetrics.swap(snapshots(t, "meminfo", lambda k, tick: _say("SwapTotal: ", k % 3, " kB\nSwapFree: 1 kB"))).select("host", "tick", "total", "used")


@query("proc_diskstats", "SELECT 'h' || c_custkey AS host, CAST(i AS INT) AS tick, 'sda' AS name, CAST(c_custkey AS BIGINT) AS reads, CAST((c_custkey + i) * 512 AS BIGINT) AS read_bytes, CAST(8 * 512 AS BIGINT) AS write_bytes FROM customer, (VALUES (0), (1)) v(i)")
def diskstats(t) -> DataFrame:
    content = lambda k, tick: _say(" 8 0 sda ", k, " 2 ", k + tick, " 4 6 7 8 9 0 1 2\n 7 0 loop0 1 1 1 1 1 1 1 1 1 1 1\n 1 0 ram0 1 1 1 1 1 1 1 1 1 1 1\n 9 9 short 1")
    return hostmetrics.diskio(snapshots(t, "diskstats", content)).select("host", "tick", "name", "reads", "read_bytes", "write_bytes")


#: One mount of each file system that holds no data, and two of names that are near to them.
PSEUDO_MOUNTS = "\n".join(f"{40 + i} 1 0:{i} / /pseudo/{name} rw - {name} {name} rw" for i, name in enumerate(hostmetrics.PSEUDO_FS))


@query("mountinfo_disk", "SELECT 'h' || c_custkey AS host, CAST(i AS INT) AS tick, '/mnt/my disk' AS path, CAST(c_custkey * 10 * 4096 AS BIGINT) AS total, CAST(c_custkey * 6 * 4096 AS BIGINT) AS used, CASE WHEN c_custkey = 0 THEN 0.0 ELSE 60.0 END AS used_percent, CAST(NULL AS BIGINT) AS inodes_total FROM customer, (VALUES (0), (1)) v(i)")
def mountinfo(t) -> DataFrame:
    snaps = snapshots(t, "mountinfo", lambda k, tick: _say("36 35 98:0 / /mnt/my\\040disk rw shared:1 - ext4 /dev/sda1 rw\n" + PSEUDO_MOUNTS))
    size = snaps.select("host", "tick", F.lit("/mnt/my disk").alias("path"), F.substring("host", F.lit(2), F.lit(20)).cast("long").alias("k"))
    stat = size.select("host", "tick", "path", (F.col("k") * 10).alias("f_blocks"), (F.col("k") * 4).alias("f_bavail"), F.lit(4096).cast("long").alias("f_frsize"), F.lit(0).cast("long").alias("f_files"), F.lit(0).cast("long").alias("f_ffree"))
    return hostmetrics.disk(hostmetrics.parse_mountinfo(snaps), stat).select("host", "tick", "path", "total", "used", F.round("used_percent", 6).alias("used_percent"), "inodes_total")


@query("proc_net", "SELECT 'h' || c_custkey AS host, CAST(i AS INT) AS tick, 'eth0' AS interface, CAST(c_custkey AS BIGINT) AS bytes_recv, CAST(c_custkey + i AS BIGINT) AS bytes_sent, CAST(3 AS BIGINT) AS err_in FROM customer, (VALUES (0), (1)) v(i)")
def netdev(t) -> DataFrame:
    content = lambda k, tick: _say("Inter-| Receive | Transmit\n face |bytes packets\n  eth0: ", k, " 2 3 4 5 6 7 8 ", k + tick, " 10 11 12\n")
    return hostmetrics.net(snapshots(t, "netdev", content)).select("host", "tick", "interface", "bytes_recv", "bytes_sent", "err_in")


@query("proc_system", "SELECT 'h' || c_custkey AS host, CAST(i AS INT) AS tick, c_custkey + 0.25 AS load1, CAST(2 AS BIGINT) AS n_cpus, CAST(c_custkey + i AS BIGINT) AS uptime FROM customer, (VALUES (0), (1)) v(i)")
def system(t) -> DataFrame:
    load = snapshots(t, "loadavg", lambda k, tick: _say(k, ".25 0.5 0.75 1/2 3"))
    up = snapshots(t, "uptime", lambda k, tick: _say(k + tick, ".75 9.5"))
    stat = snapshots(t, "stat", lambda k, tick: F.lit("cpu 1 2\ncpu0 1\ncpu1 1\nintr 1"))
    return hostmetrics.system(load.unionByName(up).unionByName(stat)).select("host", "tick", "load1", "n_cpus", "uptime")


@query("tick_time", """
WITH c AS (SELECT user_id, event_id, (epoch_us(ts) // 86400000000) * 86400000000000 AS now_ns, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT event_id, n + max(now_ns - n) OVER (PARTITION BY user_id ORDER BY event_id) AS ts_ns FROM c""")
def tick_time(t) -> DataFrame:
    day = timestamp_ns(F.col("ts")) - F.pmod(timestamp_ns(F.col("ts")), F.lit(24 * HOUR))
    return hostmetrics.tick_time(t("events").select(F.col("user_id").alias("host"), F.col("event_id").alias("tick"), day.alias("now_ns"))).select(F.col("tick").alias("event_id"), "ts_ns")


CUSTOMER_LP = """'t,nation=' || c_nationkey || ',segment=' || replace(c_mktsegment, ' ', '\\ ') || ' id=' || c_custkey || 'i,name="' || c_name || '",rich=' || (c_acctbal > 0) || ' ' || (1700000000000000000 + c_custkey)"""


def customer_lines(t) -> DataFrame:
    tags = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    fields = {"id": (F.col("c_custkey"), "integer"), "name": (F.col("c_name"), "string"), "rich": (F.col("c_acctbal") > 0, "boolean")}
    return t("customer").select("c_custkey", lineproto.encode_line(F.lit("t"), tags, fields, F.lit(1700000000000000000) + F.col("c_custkey")).alias("lp"))


@query("encode_lp", f"SELECT c_custkey, {CUSTOMER_LP} AS lp FROM customer")
def encode_lp(t) -> DataFrame:
    return customer_lines(t)


@query("plain_floats", "SELECT event_id, regexp_replace(CAST(CAST(CAST(value * 100 AS BIGINT) AS DECIMAL(18,0)) / 4 AS VARCHAR), '[.]0$', '') AS txt FROM events")
def plain_floats(t) -> DataFrame:
    return t("events").select("event_id", plain_float((F.round(F.col("value") * 100).cast("long") / 4).cast("double")).alias("txt"))


@query("inject_tags", f"SELECT c_custkey, replace({CUSTOMER_LP}, ' id=', ',host=n1 id=') AS lp FROM customer")
def inject(t) -> DataFrame:
    return customer_lines(t).select("c_custkey", lineproto.inject_tags(F.col("lp"), F.create_map(F.lit("host"), F.lit("n1"))).alias("lp"))


@query("parse_lp", "SELECT c_custkey, 't' AS table_name, 'nation=' || c_nationkey || ',segment=' || c_mktsegment AS tags, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(c_acctbal > 0 AS VARCHAR) AS rich, 1700000000000000000 + c_custkey AS ts_ns FROM customer")
def parse_lp(t) -> DataFrame:
    p = customer_lines(t).select("c_custkey", lineproto.parse_line(F.col("lp")).alias("p"))
    value = lambda k: lineproto.field_value(F.element_at("p.fields", k)).alias(k)
    return p.select("c_custkey", F.col("p.table").alias("table_name"), shown(F.col("p.tags")).alias("tags"), value("id"), value("name"), value("rich"), F.col("p.ts_ns").alias("ts_ns"))


@query("validate_batch", "SELECT CAST(count(*) FILTER (c_custkey % 10 <> 0) AS BIGINT) AS good, CAST(count(*) FILTER (c_custkey % 10 = 0) AS BIGINT) AS bad FROM customer")
def validate(t) -> DataFrame:
    broken = customer_lines(t).withColumn("lp", F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("poison"), "c_custkey")).otherwise(F.col("lp")))
    good, bad = sinks.validate_batch(broken)
    return good.select(F.lit(1).alias("g"), F.lit(0).alias("b")).unionAll(bad.select(F.lit(0), F.lit(1))).agg(F.sum("g").alias("good"), F.sum("b").alias("bad"))


@query("assign_batches", "SELECT event_id AS pos, CAST((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 100 AS BIGINT) AS batch FROM events")
def assign(t) -> DataFrame:
    return sinks.assign_batches(events(t), 100).select("pos", "batch")


@query("exact_count", "SELECT event_type, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT event_id) AS BIGINT) AS n_distinct, min(event_id) AS min_idx, max(event_id) AS max_idx FROM events GROUP BY event_type")
def exact_count(t) -> DataFrame:
    return gates.exact_count(t("events"), ["event_type"], "event_id")


@query("stream_exact_set", "SELECT CAST(o_orderkey AS BIGINT) AS key, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 11 = 0 THEN 2 END AS BIGINT) AS n_rows, CASE WHEN o_orderkey % 7 = 0 THEN 'missing' ELSE 'replayed' END AS problem FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0")
def stream_exact_set(t) -> DataFrame:
    o = t("orders").select(F.col("o_orderkey").alias("key"))
    stored = o.where("key % 7 <> 0")
    return gates.exact_set(stored.unionByName(stored.where("key % 11 = 0")), o, ["key"])


@query("label_allowlist", "SELECT 'app' AS key, CAST(count(*) AS BIGINT) AS n_records, 'required' AS verdict FROM customer UNION ALL SELECT 'pod-template-hash', CAST(count(*) AS BIGINT), 'forbidden' FROM customer WHERE c_custkey % 2 = 0")
def allow(t) -> DataFrame:
    tags = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("app"), F.lit("a"), F.lit("pod-template-hash"), F.lit("h"))).otherwise(F.create_map(F.lit("app"), F.lit("a"), F.lit("other"), F.lit("o")))
    return gates.label_allowlist(t("customer").select(tags.alias("tags")), ["app"], ["pod-template-hash"])


@query("window_check", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (epoch_us(ts) * 1000 BETWEEN 1704067200000000000 AND 1705276800000000000) AS BIGINT) AS inside FROM events GROUP BY event_type")
def window_check(t) -> DataFrame:
    return gates.window_check(events(t), "event_ns", 1704067200000000000, 1705276800000000000, "event_type")


@query("latest_per_measurement", "SELECT event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY event_type")
def latest(t) -> DataFrame:
    return gates.latest(t("events").select("event_type", "event_id", "value"), ["event_type"], "event_id")


@query("substring_counts", "SELECT lang, CAST(count(*) FILTER (contains(text, 'Licensed under')) AS BIGINT) AS licensed, CAST(count(*) FILTER (contains(text, 'token = ')) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def substrings(t) -> DataFrame:
    return gates.substring_counts(t("documents"), ["lang"], "text", {"licensed": "Licensed under", "tokens": "token = "})


@query("tag_cardinality", "SELECT 'user' AS key, CAST(count(DISTINCT user_id) AS BIGINT) AS n_values FROM events HAVING count(DISTINCT user_id) > 20")
def tag_cardinality(t) -> DataFrame:
    tags = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"))
    return gates.tag_cardinality(t("events").select(tags.alias("tags")), 20)


@query("loss_model", f"SELECT CAST(sum(n) AS BIGINT) AS lines, round(sum(12 * (1 - pow(1 - 1.0 / 12, n))), 4) AS expected_rows FROM (SELECT count(*) AS n FROM events GROUP BY {HOURS})")
def loss(t) -> DataFrame:
    per = events(t).groupBy("source_ts_ns").agg(F.count(F.lit(1)).alias("n"))
    return gates.loss_model(per, 12).select("lines", F.round("expected_rows", 4).alias("expected_rows"))


REQUEST = """{"resourceLogs":[{"resource":{"attributes":[{"key":"host.name","value":{"stringValue":"node1"}},{"key":"level","value":{"stringValue":"res"}}]},"scopeLogs":[{"scope":{"name":"lib","attributes":[{"key":"level","value":{"stringValue":"scope"}}]},"logRecords":["""


@query("otlp_flatten", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey > 0 THEN o_orderkey * 1000 ELSE o_orderkey * 1000 + 7 END AS ts_ns,
 'body=order ' || o_orderkey || ',count=' || o_custkey || ',host.name=node1,level=' || CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'scope' END || ',scope.name=lib' || CASE WHEN o_orderkey % 5 > 0 THEN ',severity_number=' || (o_orderkey % 5) ELSE '' END AS tags FROM orders""")
def otlp_flatten(t) -> DataFrame:
    k = F.col("o_orderkey")
    level = F.when(k % 3 == 0, F.concat(F.lit(',{"key":"level","value":{"stringValue":"'), F.col("o_orderpriority"), F.lit('"}}'))).otherwise("")
    line = F.concat(F.lit(REQUEST + '{"timeUnixNano":"'), F.when(k % 2 == 0, k * 1000).otherwise(0).cast("string"), F.lit('","observedTimeUnixNano":"'), (k * 1000 + 7).cast("string"), F.lit('","severityNumber":'), (k % 5).cast("string"), F.lit(',"body":{"stringValue":"order '), k.cast("string"), F.lit('"},"attributes":[{"key":"count","value":{"intValue":"'), F.col("o_custkey").cast("string"), F.lit('"}}'), level, F.lit("]}]}]}]}"))
    return otlp.flatten(t("orders").select("o_orderkey", line.alias("value")), "value", ["o_orderkey"]).select("o_orderkey", F.col("source_ts_ns").alias("ts_ns"), shown(F.col("parsed")).alias("tags"))


@query("winlog_xml", """
SELECT c_custkey, 'Provider ' || c_nationkey AS provider, CAST(c_custkey AS VARCHAR) AS record_id, c_name AS user_name, 'plain' || c_custkey AS data0, 1704067200123456700 AS ts_ns FROM customer""")
def winlog_xml(t) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    xml = F.concat(F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="Provider '), F.col("c_nationkey").cast("string"), F.lit('"/><EventID>4624</EventID><TimeCreated SystemTime="2024-01-01T00:00:00.1234567Z"/><EventRecordID>'), k, F.lit('</EventRecordID></System><EventData><Data Name="User">'), F.col("c_name"), F.lit("</Data><Data>plain"), k, F.lit("</Data></EventData></Event>"))
    customers = t("customer").select("c_custkey", "c_nationkey", "c_name").repartition("c_custkey")  # few bytes for each event: one file would be one task
    x = winlog.parse_winlog(customers.select("c_custkey", xml.alias("xml")), declared=["EventID"])
    at = lambda key, name: F.element_at("parsed", key).alias(name)
    return x.select("c_custkey", at("Provider", "provider"), at("EventRecordID", "record_id"), at("User", "user_name"), at("Data0", "data0"), F.col("source_ts_ns").alias("ts_ns"))


@query("journal_export", "SELECT event_id AS pos, event_type AS unit, epoch_us(ts) * 1000 AS ts_ns FROM events WHERE event_id % 4 > 0")
def journal(t) -> DataFrame:
    message = F.when(F.col("event_id") % 4 > 0, F.concat(F.lit(',"MESSAGE":"m","_SYSTEMD_UNIT":"'), "event_type", F.lit('"'))).otherwise(',"_PID":"1"')
    line = F.concat(F.lit('{"__REALTIME_TIMESTAMP":"'), F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.lit('"'), message, F.lit("}"))
    x = files.read_journal(t("events").select(F.lit("j").alias("state_key"), F.col("event_id").alias("pos"), line.alias("line")), ["MESSAGE"])
    return x.select("pos", F.element_at("parsed", "_SYSTEMD_UNIT").alias("unit"), F.col("source_ts_ns").alias("ts_ns"))


@query("exec_output", "SELECT 'h' || c_custkey AS host, 'disk,host=n1 used=' || c_custkey || 'i' AS line FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'h' || c_custkey, 'nospace' FROM customer WHERE c_custkey % 3 <> 0")
def exec_output(t) -> DataFrame:
    c = t("customer")
    runs = c.select(F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("host"), F.lit(0).alias("ts"), F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0).alias("exit_code"), F.concat(F.lit("disk used="), F.col("c_custkey").cast("string"), F.lit("i\n\n  \nnospace\n")).alias("stdout"))
    return files.read_exec_output(runs, {"host": "n1"}).select("host", "line")


PIPE = SourceSpec("events", "log", "json", "ts", "unix_us", "s", ("level",), {"host": "n1"}, {"value": "integer", "user": "string"}, filters=(Filter("level", "click"),), redactions=(Redact("user", "^u", "***"),))


def pipe_lines(t) -> DataFrame:
    broken = F.col("event_id") % 97 == 0
    bad_field = F.col("event_id") % 89 == 0
    line = F.concat(F.lit('{"ts": '), F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.lit(', "level": "'), "event_type", F.lit('", "user": "u'), F.col("user_id").cast("string"), F.lit('", "value": "'), F.when(bad_field, "x").otherwise("12"), F.lit('"}'))
    return t("events").select(F.lit("events.app").alias("state_key"), F.col("event_id").alias("pos"), F.when(broken, "{oops").otherwise(line).alias("line"))


@query("pipeline_counters", """
WITH s AS (SELECT CASE WHEN event_id % 97 = 0 OR event_id % 89 = 0 THEN 'q' WHEN event_type = 'click' THEN 'f' ELSE 's' END AS s FROM events), c AS (SELECT count(*) AS n, count(*) FILTER (s = 's') AS a, count(*) FILTER (s = 'q') AS q, count(*) FILTER (s = 'f') AS f FROM s)
SELECT v.source, CAST(n AS BIGINT) AS lines_read, CAST(a AS BIGINT) AS lines_shipped, CAST(q AS BIGINT) AS lines_quarantined, CAST(f AS BIGINT) AS dropped_filter, CAST(0 AS BIGINT) AS dropped_sample, CAST(0 AS BIGINT) AS at_risk FROM c, (VALUES ('events'), (NULL)) v(source)""")
def pipeline_counters(t) -> DataFrame:
    return compose(pipe_lines(t), PIPE).counters()


@query("pipeline_lines", """
WITH k AS (SELECT * FROM events WHERE event_id % 97 <> 0 AND event_id % 89 <> 0 AND event_type <> 'click'), u AS (SELECT *, epoch_us(ts) // 1000000 * 1000000000 AS tick FROM k)
SELECT event_id AS pos, 'log,host=n1,level=' || event_type || ',stream=events user="***' || user_id || '",value=12i ' || (tick + row_number() OVER (PARTITION BY tick ORDER BY event_id) - 1) AS lp FROM u""")
def pipeline_lines(t) -> DataFrame:
    return compose(pipe_lines(t), PIPE).ok.select("pos", "lp")


@query("pipeline_quarantine", """
SELECT CASE WHEN event_id % 97 = 0 THEN 'unparseable' ELSE 'field ''value'' will not coerce to integer' END AS kind, CAST(count(*) AS BIGINT) AS lines, 'events' AS source FROM events WHERE event_id % 97 = 0 OR event_id % 89 = 0 GROUP BY ALL""")
def pipeline_quarantine(t) -> DataFrame:
    q = compose(pipe_lines(t), PIPE).quarantined.withColumn("source", F.lit("events"))
    return accounting.quarantine_by_reason(q)


from quarry import roundtrips  # noqa: E402, F401  registers its queries here
