import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import accounting, dedup, enrich, framing, gates, records, stamping, watermarks
from quarry.plans.pipeline import compose, compose_all
from quarry.plans.spec import Filter, Multiline, Redact, Sample, SourceSpec, WatermarkSpec, expand


def lines(spark, *texts, key="s"):
    return spark.createDataFrame([(key, i, t) for i, t in enumerate(texts)], "state_key string, pos long, line string")


def framed(df):
    return [(r.line, r.truncated) for r in df.orderBy("pos").collect()]


def test_multiline_joins_and_keeps_orphans(spark):
    x = lines(spark, "  at orphan()", "2026-08-10 first", "  at foo()", "  at bar()", "2026-08-10 second")
    got = framed(framing.join_multiline(x, r"^\d{4}-\d{2}-\d{2}"))
    assert got == [("  at orphan()", False), ("2026-08-10 first\n  at foo()\n  at bar()", False), ("2026-08-10 second", False)]


def test_multiline_caps(spark):
    assert framed(framing.join_multiline(lines(spark, "START", "a", "b", "c", "d"), "^START", max_lines=4)) == [("START\na\nb\nc", True), ("d", False)]
    big = "x" * 40
    assert framed(framing.join_multiline(lines(spark, "START", big, "tail"), "^START", max_bytes=32)) == [(f"START\n{big}", True), ("tail", False)]
    # a first line that fills a record waits while the one before was open
    long = "START" + big
    assert framed(framing.join_multiline(lines(spark, "START a", long, "b", "c"), "^START", max_bytes=32)) == [("START a", False), (f"{long}\nb", True), ("c", False)]
    assert framed(framing.join_multiline(lines(spark, long, "b"), "^START", max_bytes=32)) == [(long, True), ("b", False)]

def step_by_step(texts, start, max_lines, max_bytes):
    """Multi-line records, one line after another."""
    done, held, size = [], [], 0
    for t in texts:
        if held and t.startswith(start):
            done.append(("\n".join(held), False))
            held, size = [t], len(t) + 1
            continue
        held.append(t)
        size += len(t) + 1
        if len(held) >= max_lines or size >= max_bytes:
            done.append(("\n".join(held), True))
            held, size = [], 0
    return done + ([("\n".join(held), False)] if held else [])


def test_multiline_equals_a_step_by_step_simulation(spark, monkeypatch):
    monkeypatch.setattr(framing, "SPAN", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rng = random.Random(5)
        for max_lines, max_bytes, shares in ((10**6, 30, (0.0, 0.7)), (3, 25, (0.3,)), (1, 10**6, (0.3,))):
            for share in shares:
                texts = [("S" if rng.random() < share else "c") + "x" * rng.choice([0, 1, 5, 12, 40]) for _ in range(60)]
                got = framed(framing.join_multiline(lines(spark, *texts), "^S", max_lines, max_bytes))
                assert got == step_by_step(texts, "S", max_lines, max_bytes), (max_lines, max_bytes, share)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fragments_are_cut_in_order(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rng = random.Random(3)
        texts = [f"t{i} stdout {'F' if rng.random() < 0.1 else 'P'} {'y' * rng.randint(0, 9)}" for i in range(80)]
        got = [(r.log, r.time, r.truncated, r.unclosed) for r in framing.reassemble_cri(lines(spark, *texts), max_bytes=20)[0].orderBy("pos").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, held, since = [], "", None
    for t in texts:
        time, _, tag, text = t.split(" ", 3)
        held, since = held + text, since or time
        if tag == "F" or len(held) >= 20:
            want.append((held, since, tag == "P", False))
            held, since = "", None
    assert got == want + ([(held, since, False, True)] if since else [])


def test_a_stream_that_never_begins_stays_in_bounded_rows(spark):
    x = spark.range(300_000).select(F.lit("s").alias("state_key"), F.col("id").alias("pos"), F.lit("no beginning").alias("line"))
    got = framing.join_multiline(x, "^START", max_lines=500).agg(F.count(F.lit(1)).alias("n"), F.max("n_lines").alias("most"), F.sum("n_lines").alias("lines")).first()
    assert (got.n, got.most, got.lines) == (600, 500, 300_000)


def test_multiline_off_and_empty(spark):
    assert framed(framing.join_multiline(lines(spark, "a", "b"), None)) == [("a", False), ("b", False)]
    assert framing.join_multiline(lines(spark, "a").limit(0), "^x").count() == 0


def test_running_total_over_spans(spark, monkeypatch):
    monkeypatch.setattr(framing, "SPAN", 3)
    x = lines(spark, *("Sx" if i % 4 == 0 else "x" for i in range(20)))
    got = framing.running_total(x, F.col("line").startswith("S"), ["state_key"], "n").orderBy("pos").collect()
    assert [r.n for r in got] == [i // 4 + 1 for i in range(20)]


def test_cri(spark):
    x = lines(spark, "t1 stdout P one ", "t2 stderr F err", "t3 stdout F two words", "t4 stdout F", "t5 stdout F ", "", "t6 std F x", "t7 stdout X y", "t8 stdout P open")
    good, bad = framing.reassemble_cri(x)
    got = {(r.stream, r.pos): (r.time, r.log, r.unclosed) for r in good.collect()}
    assert got == {("stdout", 2): ("t1", "one two words", False), ("stderr", 1): ("t2", "err", False), ("stdout", 3): ("t4", "", False), ("stdout", 4): ("t5", "", False), ("stdout", 8): ("t8", "open", True)}
    assert sorted(r.pos for r in bad.collect()) == [5, 6, 7]


def test_docker_cap_and_errors(spark):
    x = lines(spark, '{"log":"12345","stream":"stdout","time":"a"}', '{"log":"67890","stream":"stdout","time":"b"}', '{"log":"z\\n","stream":"stdout","time":"c"}', "no json", '{"log":"x","time":"t"}')
    good, bad = framing.reassemble_docker(x, max_bytes=10)
    assert [(r.log, r.time, r.truncated) for r in good.orderBy("pos").collect()] == [("1234567890", "a", True), ("z", "c", False)]
    assert bad.count() == 2


SPEC = SourceSpec("app", "log", "json", "ts", "unix_ms", "ms", ("level", "empty"), {"host": "n1"}, {"n": "integer", "msg": "string"})


def test_records(spark):
    x = lines(spark, '{"ts":1,"level":"info","empty":"","n":"5","msg":{"a":1}}', '{"ts":"x","n":1}', '{"ts":2,"n":1.0}', '{"ts":3,"n":null}', "junk", "  ", '{"ts":4}')
    p = compose(x, SPEC)
    ok = {r.pos: r for r in p.ok.collect()}
    assert ok[0].f_n == 5 and ok[0].f_msg == '{"a":1}' and ok[0].tags == {"stream": "app", "host": "n1", "level": "info"} and ok[0].ts_ns == 10**6
    reasons = {r.pos: r.reason for r in p.quarantined.collect()}
    assert set(reasons) == {1, 2, 3, 4, 6}
    assert reasons[1].startswith("bad timestamp") and "will not coerce" in reasons[2] and "will not coerce" in reasons[3] and reasons[4].startswith("unparseable") and reasons[6].startswith("unencodable")
    total = p.counters().where("source is null").first()
    assert (total.lines_read, total.lines_shipped, total.lines_quarantined, total.at_risk) == (6, 1, 5, 0)


def test_dropped_records_take_no_place_in_a_tick(spark):
    spec = SourceSpec("app", "log", "json", "ts", "unix_s", "s", ("level",), {}, {"n": "integer"}, filters=(Filter("level", "debug"),))
    x = lines(spark, '{"ts":1,"level":"debug","n":1}', '{"ts":1,"level":"info","n":2}', '{"ts":1,"level":"info","n":3}')
    assert [r.ts_ns for r in compose(x, spec).ok.orderBy("pos").collect()] == [10**9, 10**9 + 1]


def test_redaction_follows_sampling_and_leaves_tags(spark):
    spec = SourceSpec("app", "log", "json", "ts", "unix_s", "s", ("msg",), {}, {"msg": "string"}, redactions=(Redact("msg", r"user=(\d)\d*", "user=$1***"),))
    r = compose(lines(spark, '{"ts":1,"msg":"user=123 x"}'), spec).ok.first()
    assert r.f_msg == "user=1*** x" and r.tags["msg"] == "user=123 x"


def test_sampling_is_deterministic(spark):
    df = spark.range(1000).select(F.create_map(F.lit("k"), F.col("id").cast("string")).alias("tags"), F.col("id").alias("source_ts_ns"))
    keep = records.passes_samples([Sample(4)], {})
    a, b = {r.source_ts_ns for r in df.where(keep).collect()}, {r.source_ts_ns for r in df.repartition(7).where(keep).collect()}
    assert a == b and 180 < len(a) < 320
    assert df.where(records.passes_samples([Sample(1)], {})).count() == 1000


def test_stamp(spark):
    df = spark.createDataFrame([("s", i, 5_000_000 + i % 3) for i in range(10)], "state_key string, pos long, source_ts_ns long")
    got = stamping.stamp(df, 10**6)
    assert [r.ts_ns for r in got.orderBy("pos").collect()] == [5_000_000 + i for i in range(10)]
    assert stamping.stamp(df, 1).where("ts_ns = source_ts_ns").count() == 10
    state = stamping.resume_state(got)
    again = stamping.stamp(df.where("pos < 2"), 10**6, resume=state)
    assert sorted(r.ts_ns for r in again.collect()) == [5_000_010, 5_000_011]
    negative = spark.createDataFrame([("s", 0, -1)], df.schema)
    assert stamping.stamp(negative, 1000).first().tick == -1000
    many = spark.range(1002).select(F.lit("s").alias("state_key"), F.col("id").alias("pos"), F.lit(0).cast("long").alias("source_ts_ns"))
    assert stamping.stamp(many, 1000).where("exhausted").count() == 2


def test_lww_and_reports(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 1, 3)], "k string, ts long, n long")
    assert sorted((r.k, r.n) for r in dedup.lww(df, ["k", "ts"], ["n"]).collect()) == [("a", 2), ("b", 3)]
    assert dedup.replay_report(df, ["k", "ts"]).first().asDict() == {"delivered": 3, "distinct_rows": 2, "replays": 1}


def simulate(times, size, spec):
    samples, latest, published, out = [], None, None, []
    for at in range(0, len(times), size):
        broken = 0
        for t in times[at : at + size]:
            if latest is not None:
                samples.append(max(0, latest - t))
            broken += published is not None and t < published
            latest = t if latest is None else max(latest, t)
        top = max(times[at : at + size])
        s = sorted(samples[-spec.window :])
        late = spec.ceiling_ns if len(s) < spec.least else min(spec.ceiling_ns, max(spec.floor_ns, s[int((len(s) - 1) * spec.quantile + 0.5)]))
        published = top - late if published is None else max(published, top - late)
        out.append((late, published, broken))
    return out


def test_watermarks_equal_a_step_by_step_simulation(spark):
    spec = WatermarkSpec(floor_ns=10, ceiling_ns=5000, window=512, least=100)
    times = [i * 10 - (i * 7919) % 97 * (i % 5 == 0) * 13 for i in range(3000)]
    df = spark.createDataFrame([("s", i, t, i // 250) for i, t in enumerate(times)], "stream string, pos long, ts_ns long, batch long")
    p = watermarks.estimates(df, ["stream"], "pos", "batch", spec)
    v = watermarks.violations(df, p, ["stream"], "batch")
    got = [(r.lateness_ns, r.watermark_ns, r.violations) for r in p.join(v, ["stream", "batch"]).orderBy("batch").collect()]
    assert got == simulate(times, 250, spec)


@pytest.mark.parametrize(
    "path,want",
    [
        ("/var/log/containers/web-59f8c_my-shop_istio-proxy-" + "a" * 64 + ".log", ("web-59f8c", "my-shop", "istio-proxy")),
        ("/var/log/app.log", None),
        ("/var/log/containers/a_b_c-" + "a" * 32 + ".log", None),
        ("/var/log/containers/a_b_web-cafe-" + "0" * 64 + ".log", ("a", "b", "web-cafe")),
    ],
)
def test_container_paths(spark, path, want):
    r = spark.createDataFrame([(path,)], "p string").select(enrich.parse_cri_path(F.col("p")).alias("c")).first().c
    assert (r and (r.pod, r.namespace, r.container)) == want


def test_pod_labels(spark, tmp_path):
    (tmp_path / "labels.json").write_text('{"shop/web": {"app": "a", "pod-template-hash": "x"}}')
    labels = enrich.read_pod_labels(spark, str(tmp_path / "labels.json"))
    paths = spark.createDataFrame([("shop", "web"), ("shop", "db")], "namespace string, pod string")
    got = {r.pod: r.label_tags for r in enrich.join_pod_labels(paths, labels, ["app", "team"]).collect()}
    assert got == {"web": {"app": "a"}, "db": {}}
    assert all(r.label_tags == {} for r in enrich.join_pod_labels(paths, labels, []).collect())


def test_gates(spark):
    stored = spark.createDataFrame([(0,), (1,), (1,), (9,)], "k long")
    got = {r.k: r.problem for r in gates.exact_set(stored, spark.range(3).withColumnRenamed("id", "k"), ["k"]).collect()}
    assert got == {1: "replayed", 2: "missing", 9: "extra"}
    assert gates.missing_columns(stored, ["k"], ["v"]) == ["v"]


def test_counters_roll_up(spark):
    df = spark.createDataFrame([("a", "shipped"), ("a", "filter"), ("b", "sample")], "source string, stage string")
    got = {r.source: (r.lines_read, r.at_risk) for r in accounting.counters(df).collect()}
    assert got == {"a": (2, 0), "b": (1, 0), None: (3, 0)}


def test_specs_are_checked(monkeypatch):
    for bad in ({"parser": "xml"}, {"resolution": "h"}, {"fields": {"a": "int"}}, {"parser": "cri", "multiline": Multiline("^a")}, {"name": ""}):
        with pytest.raises(ValueError):
            SourceSpec(**({"name": "n", "table": "t"} | bad))
    with pytest.raises(TypeError):
        SourceSpec("n", "t", unknown=1)
    for bad in (lambda: Filter("", "x"), lambda: Sample(0), lambda: Sample(2, field="a"), lambda: Redact("f", "(?=x)")):
        with pytest.raises(ValueError):
            bad()
    monkeypatch.setenv("NODE", "n7")
    assert expand("${NODE}-x") == "n7-x"
    with pytest.raises(ValueError):
        expand("${NOT_SET_ANYWHERE}")


def test_sources_together(spark):
    other = SourceSpec("plain", "raw", "plain", fields={"message": "string"})
    p = compose_all([(lines(spark, '{"ts":1,"n":1}'), SPEC), (lines(spark, "hello", key="p"), other)])
    assert sorted(r.table for r in p.ok.collect()) == ["log", "raw"]
    with pytest.raises(ValueError):
        compose_all([(lines(spark, "a"), other), (lines(spark, "a"), other)])
    with pytest.raises(ValueError):
        compose_all([])


def test_replay_changes_nothing(spark):
    x = lines(spark, *(f'{{"ts":{i // 10},"n":{i}}}' for i in range(100)))
    runs = compose(x, SPEC).ok.unionByName(compose(x.repartition(5), SPEC).ok)
    assert gates.exact_count(dedup.lww(runs.withColumn("k", F.to_json("tags")), ["k", "ts_ns"], ["pos"]), ["table"], "f_n").first()[1:] == (100, 100, 0, 99)


def test_journal_windows_and_requests_through_specs(spark):
    fields = {"MESSAGE": "string"}
    x = lines(spark, '{"__REALTIME_TIMESTAMP":"1700000000000001","MESSAGE":"m","_PID":"1"}', '{"__REALTIME_TIMESTAMP":"5","_PID":"1"}', "junk", '{"MESSAGE":"no time"}')
    p = compose(x, SourceSpec("j", "journal", "journal", tags=("_PID",), fields=fields, resolution="us"))
    assert [(r.pos, r.ts_ns, r.tags["_PID"]) for r in p.ok.collect()] == [(0, 1700000000000001000, "1")]
    assert {r.pos: r.reason for r in p.quarantined.collect()} == {2: "unparseable: not a journal entry", 3: "bad timestamp: missing"}
    total = p.counters().where("source is null").first()
    assert (total.lines_read, total.lines_shipped, total.lines_quarantined) == (3, 1, 2)

    event = '<Event xmlns="x"><System><EventID>7</EventID><TimeCreated SystemTime="2024-01-01T00:00:00Z"/></System></Event>'
    p = compose(lines(spark, event, "no event", "<Event><broken></Event>", event.replace("7", "a & b")), SourceSpec("w", "win", "winlog", fields={"EventID": "integer"}))
    assert [(r.pos, r.ts_ns, r.f_EventID) for r in p.ok.collect()] == [(0, 1704067200000000000, 7)]
    assert sorted(r.pos for r in p.quarantined.collect()) == [1, 2, 3]

    log = '{"timeUnixNano":"1000000007","body":{"stringValue":"b"},"attributes":[{"key":"n","value":{"stringValue":"%s"}}]}'
    request = '{"resourceLogs":[{"resource":{"attributes":[{"key":"host","value":{"stringValue":"h"}}]},"scopeLogs":[{"logRecords":[%s,%s,%s]}]}]}' % (log % 1, log % 2, log % "x")
    p = compose(lines(spark, request, "{oops", '{"resourceLogs":5}', "{}", "[]"), SourceSpec("o", "otel", "otlp", tags=("host",), fields={"body": "string", "n": "integer"}))
    assert [(r.pos, r.f_n, r.ts_ns, r.tags["host"]) for r in p.ok.orderBy("f_n").collect()] == [(0, 1, 1000000000, "h"), (0, 2, 1000000001, "h")]
    assert sorted((r.pos, r.reason.split(":")[0]) for r in p.quarantined.collect()) == [(0, "field 'n' will not coerce to integer"), (1, "unparseable"), (2, "unparseable"), (4, "unparseable")]


def test_pod_labels_through_specs(spark):
    path = "/var/log/containers/web_shop_app-" + "a" * 64 + ".log"
    x = lines(spark, "t stdout F hello").withColumn("path", F.lit(path))
    labels = spark.createDataFrame([("shop", "web", {"app": "front", "host": "label", "hash": "x"})], "namespace string, pod string, labels map<string,string>")
    spec = SourceSpec("k", "logs", "cri", tags_static={"host": "n1", "zone": "z"}, fields={"log": "string"}, kubernetes=True, labels=("app", "host"))
    assert compose(x, spec, labels).ok.first().tags == {"stream": "web_shop_app", "host": "label", "zone": "z", "app": "front", "namespace": "shop", "pod": "web", "container": "app"}
    assert "app" not in compose(x, spec).ok.first().tags
