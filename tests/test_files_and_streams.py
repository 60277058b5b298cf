import gzip
import os

from pyspark.sql import functions as F

from quarry.operators import framing, hostmetrics, sinks, stamping
from quarry.sources import containers, files, otlp, winlog
from quarry.streaming import stateful


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\nthr\ree\nlast")
    (tmp_path / "b.txt").write_bytes(b"no\n")
    x = files.read_lines(spark, str(tmp_path), "src", "*.log")
    assert [(r.state_key, r.raw) for r in x.orderBy("pos").collect()] == [("src.a", "one"), ("src.a", "two"), ("src.a", "thr\ree"), ("src.a", "last")]
    assert files.read_lines(spark, str(tmp_path), "src", "*.log", complete_only=True).count() == 3
    assert files.read_lines(spark, str(tmp_path / "absent")).count() == 0


def test_order_survives_splits(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"{i}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000b")
    try:
        got = [int(r.raw) for r in files.read_lines(spark, str(tmp_path)).orderBy("pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == list(range(20_000))


def test_rotated_set(spark, tmp_path):
    for i, name in enumerate(["app.log.2", "app.log.1", "app.log"]):
        (tmp_path / name).write_text(f"{i}\n")
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    got = files.read_rotated_set(spark, str(tmp_path / "app.log"), "s").orderBy("pos").collect()
    assert [(r.state_key, r.raw) for r in got] == [("s.app", "0"), ("s.app", "1"), ("s.app", "2")]


def test_decoding_counts(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"ok\nbad\xff\xfe}\n")
    got = files.decoded(files.read_lines(spark, str(tmp_path))).orderBy("pos").collect()
    assert [r.replaced for r in got] == [0, 2]


def test_otlp_values(spark):
    line = '{"resourceLogs":[{"resource":{"attributes":[{"key":"a","value":{"arrayValue":{"values":[{"stringValue":"x"},{"intValue":"1"}]}}},{"key":"none"}]},"scopeLogs":[{"logRecords":[{"timeUnixNano":"5","body":{"bytesValue":"AP8="}}]}]}]}'
    r = otlp.flatten(spark.createDataFrame([(line,)], "value string")).first()
    assert r.parsed == {"a": '["x",1]', "body": "00ff"} and r.source_ts_ns == 5


def test_winlog_without_data(spark):
    xml = '<Event xmlns="x"><System><EventID>1</EventID><TimeCreated SystemTime="2024-01-01T00:00:00Z"/></System></Event>'
    df = spark.createDataFrame([(xml,)], "xml string")
    assert winlog.parse_winlog(df).first().parsed["EventID"] == "1"
    assert winlog.parse_winlog(df, declared=["Absent"]).count() == 0


def test_winlog_reads_an_event_once(spark):
    df = spark.createDataFrame([("<Event ><System><EventID>1</EventID></System></Event>",)], "xml string")
    kept = winlog.parse_winlog(df, declared=["EventID"]).where("parsed['EventID'] = '1'").select("parsed", "source_ts_ns")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml(") == 2 and "XPath" not in plan  # names, and texts


def test_winlog_odd_events(spark):
    def event(system: str, data: str = "") -> str:
        return f"<Event xmlns='x'><System>{system}</System><EventData>{data}</EventData></Event>"

    one = "<EventID>1</EventID>"
    cases = [
        (event(one, "<Data Name='a'>1</Data><Data>u</Data><Data Name='a'>2</Data>"), {"EventID": "1", "a": "2", "Data0": "u"}),
        (event("<EventID>1<!-- c -->2</EventID>", "<Data Name='a'>x<!-- c -->y</Data><Data Name='b'><![CDATA[<system>&]]>;</Data>"), {"EventID": "12", "a": "xy", "b": "<system>&;"}),
        (event(one, "<Data> </Data><Data></Data><Data/><Data> v\n</Data><Data Name='n'>\t</Data>"), {"EventID": "1", "Data0": " ", "Data1": " v\n", "n": "\t"}),
        (event(one, "<Data Name='no'/><Data Name='a &amp; b'>&lt;&#65;</Data>"), {"EventID": "1", "a & b": "<A"}),
        (event("<EventID Qualifiers='7'>1</EventID><EventID>2</EventID><eventID>3</eventID><Provider Guid='g'/><Provider Name='p name=q'/>"), {"EventID": "1", "Provider": "p name=q"}),
        (event(one, "<data Name='d'>1</data><Data name='low'>2</Data><Data Name='x name=y'>a/data b</Data>"), {"EventID": "1", "Data0": "2", "x name=y": "a/data b"}),
        ("<?xml version='1.0' encoding='utf-8'?>\n" + event(one) + "\n<!-- end -->", {"EventID": "1"}),
        (event("<EventID/>", "text").replace("<Sys", "<System/><Sys") + " ", {}),
        ("<Event><p:System><p:EventID>1</p:EventID></p:System></Event>", {"EventID": "1"}),
        *((bad, None) for bad in (None, "", "text", "<Event>", "<Eventx></Eventx>", event(one) + "junk", event(one) + event(one), event(one) + "<x/>", event("<EventID>&no;</EventID>"))),
    ]
    df = spark.createDataFrame([(i, xml) for i, (xml, _) in enumerate(cases)], "i int, xml string")
    got = {r.i: r for r in winlog.parse_winlog(df).withColumn("event", winlog.is_event(F.col("xml"))).collect()}
    for i, (xml, want) in enumerate(cases):
        assert got[i].parsed == (want if want is None else want | {"Xml": xml}), xml
        assert got[i].event == (want is not None), xml


def test_dead_letters_and_lines(spark, tmp_path):
    df = spark.createDataFrame([("s", "why", "line")], "state_key string, reason string, line string")
    sinks.write_dead_letter(df, str(tmp_path / "dead"))
    assert spark.read.json(str(tmp_path / "dead")).first().reason == "why"
    sinks.write_lp(spark.createDataFrame([("t f=1i 1",)], "lp string"), str(tmp_path / "lp"))
    parts = [gzip.decompress(p.read_bytes()) for p in (tmp_path / "lp").glob("*.gz")]
    assert b"".join(parts) == b"t f=1i 1\n"


def test_cpu_that_does_not_move(spark):
    rows = [("h", t, 0, "stat", "cpu 1 1 1 1 1 1 1\ncpu0 1 1 1 1 1 1 1\nintr 1") for t in (0, 1)]
    snaps = spark.createDataFrame(rows, "host string, tick int, now_ns long, source string, content string")
    got = hostmetrics.cpu_usage(hostmetrics.parse_proc_stat(snaps)).collect()
    assert len(got) == 2 and all(r.usage_active == 0.0 and r.usage_idle == 0.0 for r in got)


def test_tick_time_never_goes_back(spark):
    clock = [5, 5, 4, 10, 3]
    df = spark.createDataFrame([("h", i, t) for i, t in enumerate(clock)], "host string, tick int, now_ns long")
    assert [r.ts_ns for r in hostmetrics.tick_time(df).orderBy("tick").collect()] == [5, 6, 7, 10, 11]


def run_stream(df, name, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    stateful.prepare_streaming(spark)
    text = "".join(f"{'START' if i % 3 == 0 else ' more'} {i}\n" for i in range(31))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text(text + "START end\n")
    lines = stateful.stream_lines(spark, str(tmp_path / "in"))
    got = run_stream(stateful.framed_stream(lines.select("state_key", "pos", "line"), "^START", max_lines=2, timeout_ms=10**9), "framed", spark)
    batch = files.read_lines(spark, str(tmp_path / "in")).select("state_key", "pos", F.col("raw").alias("line"))
    want = framing.join_multiline(batch, "^START", max_lines=2)
    # the last record is still open in the stream
    assert sorted(r.line for r in got.collect()) == sorted(r.line for r in want.collect())[:-1]


def test_stamped_and_watermark_streams(spark, tmp_path):
    stateful.prepare_streaming(spark)
    folder = str(tmp_path / "records")
    data = spark.range(500).select(F.lit("s").alias("state_key"), F.col("id").alias("pos"), (F.floor(F.col("id") / 50) * 10**6).alias("source_ts_ns"))
    data.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(data.schema).parquet(folder)
    got = run_stream(stateful.stamped_stream(stream, 10**6), "stamped", spark)
    want = stamping.stamp(data, 10**6)
    assert {(r.pos, r.ts_ns) for r in got.collect()} == {(r.pos, r.ts_ns) for r in want.collect()}
    marks = run_stream(stateful.watermark_stream(stream.select(F.col("state_key").alias("stream"), "pos", F.col("source_ts_ns").alias("ts_ns"))), "marks", spark).collect()
    assert len(marks) == 1 and marks[0].lateness_ns == 100 * 10**6 and marks[0].watermark_ns == 9 * 10**6 - 100 * 10**6


CRI = "t1 stdout P one \nt2 stderr F err\nt3 stdout F two\nbad\nt4 stdout P 12345678\nt5 stdout F 9\nt6 stderr P open\n"


def test_cri_files_and_streams(spark, tmp_path):
    stateful.prepare_streaming(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text(CRI)
    messages, rejected = containers.read_cri(spark, str(tmp_path / "in"), max_bytes=8)
    assert rejected.count() == 1
    want = {(r.parsed["stream"], r.time, r.log, r.truncated) for r in messages.collect()}
    assert ("stdout", "t1", "one two", False) in want and ("stdout", "t4", "12345678", True) in want and ("stderr", "t6", "open", False) in want
    lines = stateful.stream_lines(spark, str(tmp_path / "in")).select("state_key", "pos", "line")
    got = run_stream(stateful.reassembled_stream(framing.cri_fragments(lines)[0], max_bytes=8, timeout_ms=10**9), "messages", spark)
    assert {(r.stream, r.time, r.log, r.truncated) for r in got.collect()} == want - {("stderr", "t6", "open", False)}


def test_docker_files(spark, tmp_path):
    (tmp_path / "d.log").write_text('{"log":"a","stream":"stdout","time":"1"}\n{"log":"b\\n","stream":"stdout","time":"2"}\n')
    messages, rejected = containers.read_docker_json(spark, str(tmp_path))
    assert [(r.log, r.time) for r in messages.collect()] == [("ab", "1")] and rejected.count() == 0
