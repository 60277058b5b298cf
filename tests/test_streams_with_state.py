"""Timers, eviction, restored estimates and the least of files, in streams that run."""

import time

import pytest

from quarry.operators import watermarks
from quarry.plans.spec import WatermarkSpec
from quarry.streaming import stateful

MS = 10**6


def fed(spark, folder, rows, schema):
    """A stream over a folder; ``put`` adds a file of rows to it."""

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))

    put(rows)
    return spark.readStream.schema(schema).parquet(str(folder)), put


def until(query, spark, name, want, seconds=90):
    stop = time.time() + seconds
    while time.time() < stop:
        got = spark.table(name).collect()
        if want(got):
            break
        time.sleep(0.5)
    query.stop()
    return got


@pytest.mark.parametrize("kind", ["multiline", "cri"])
def test_a_quiet_record_leaves_by_its_timer(spark, tmp_path, kind):
    stateful.prepare_streaming(spark)
    if kind == "multiline":
        stream, _ = fed(spark, tmp_path / "in", [("k", 1, "START lonely"), ("k", 2, "more")], "state_key string, pos long, line string")
        out = stateful.framed_stream(stream, "^START", timeout_ms=200)
    else:
        stream, _ = fed(spark, tmp_path / "in", [("k", "stdout", 1, "t1", "open ", False), ("k", "stdout", 2, "t2", "end", False)], "state_key string, stream string, pos long, time string, text string, closes boolean")
        out = stateful.reassembled_stream(stream, timeout_ms=200)
    q = out.writeStream.format("memory").queryName(f"timer_{kind}").outputMode("append").trigger(processingTime="1 second").start()
    got = until(q, spark, f"timer_{kind}", len)
    assert [r.line if kind == "multiline" else (r.log, r.time, r.unclosed) for r in got] == (["START lonely\nmore"] if kind == "multiline" else [("open end", "t1", True)])


def finished(df, name, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_forgotten_ticks(spark, tmp_path, monkeypatch):
    """Two ticks are remembered: the third pushes out the first, which starts anew when it returns, and
    is told apart as older than all that are known."""
    stateful.prepare_streaming(spark)
    ticks = [10, 10, 20, 30, 10, 30, 40]
    stream, _ = fed(spark, tmp_path / "in", [("k", i, t * MS) for i, t in enumerate(ticks)], "state_key string, pos long, source_ts_ns long")
    monkeypatch.setattr(stateful, "Stamper", lambda tick, kept, make=stateful.Stamper: make(tick, kept, 2))
    got = {r.pos: (r.ts_ns - ticks[r.pos] * MS, r.out_of_window) for r in finished(stateful.stamped_stream(stream, MS), "ticks", spark)}
    assert got == {0: (0, False), 1: (1, False), 2: (0, False), 3: (0, False), 4: (0, True), 5: (1, False), 6: (0, False)}


SPEC = WatermarkSpec(floor_ns=10 * MS, ceiling_ns=5_000 * MS)


@pytest.mark.parametrize("saved,held", [(250, 250), (999_999, 5_000), (1, 10)])
def test_a_restored_estimate_goes_on_within_its_bounds(spark, tmp_path, saved, held):
    stateful.prepare_streaming(spark)
    times = [100_000, 100_010, 100_005]
    stream, _ = fed(spark, tmp_path / "in", [("s", i, t * MS) for i, t in enumerate(times)], "stream string, pos long, ts_ns long")
    restored = spark.createDataFrame([("s", saved * MS, None)], "stream string, lateness_ns long, watermark_ns long")
    (r,) = finished(stateful.watermark_stream(stream, SPEC, restored), f"restored_{saved}", spark)
    assert (r.lateness_ns, r.watermark_ns) == (held * MS, (100_010 - held) * MS)
    records = spark.createDataFrame([("s", i, 0, t * MS) for i, t in enumerate(times)], "stream string, pos long, batch long, ts_ns long")
    (b,) = watermarks.estimates(records, ["stream"], "pos", "batch", SPEC, restored=restored).collect()
    assert (b.lateness_ns, b.watermark_ns) == (r.lateness_ns, r.watermark_ns)
    ahead = spark.createDataFrame([("s", saved * MS, 200_000 * MS)], restored.schema)
    assert watermarks.estimates(records, ["stream"], "pos", "batch", SPEC, restored=ahead).first().watermark_ns == 200_000 * MS


def test_a_silent_file_holds_its_stream_for_a_while_only(spark, tmp_path):
    stateful.prepare_streaming(spark)
    stream, put = fed(spark, tmp_path / "in", [("s", "a", 5), ("s", "b", 3)], "stream string, file string, watermark_ns long")
    q = stateful.files_watermark_stream(stream, idle_ms=4_000).writeStream.format("memory").queryName("least").outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        stop = time.time() + 60
        while time.time() < stop and not spark.table("least").count():
            time.sleep(0.3)
        put([("s", "a", 9)])
        while time.time() < stop and spark.table("least").count() < 2:
            time.sleep(0.3)
        time.sleep(5)
        put([("s", "a", 12)])
        while time.time() < stop and spark.table("least").count() < 3:
            time.sleep(0.3)
    finally:
        q.stop()
    got = [(r.n_files, r.watermark_ns) for r in spark.table("least").collect()]
    assert got[0] == (2, 3) and got[-1] == (1, 12) and sorted(w for _, w in got) == [w for _, w in got]


def test_files_of_a_stream_in_batches(spark):
    rows = [("s", "a", b, 10 * b) for b in range(8)] + [("s", "b", 0, 1), ("s", "b", 1, 4), ("s", "b", 6, 8)]
    df = spark.createDataFrame(rows, "stream string, file string, batch long, watermark_ns long")
    got = {r.batch: (r.n_files, r.watermark_ns) for r in watermarks.over_files(df, ["stream"], "file", "batch", idle=2).collect()}
    assert got == {0: (2, 0), 1: (2, 4), 2: (2, 4), 3: (2, 4), 4: (1, 40), 5: (1, 50), 6: (2, 50), 7: (2, 50)}


@pytest.mark.parametrize("spec", [WatermarkSpec(1, 10**6, window=7, least=2, quantile=0.5), WatermarkSpec(1, 10**6, window=200, least=3, quantile=0.99), WatermarkSpec(1, 10**6, window=130, least=256)])
def test_windows_over_blocks_equal_a_plain_window(spark, spec):
    import random

    rng = random.Random(1)
    times = [rng.randrange(2000) for _ in range(600)]
    df = spark.createDataFrame([("s", i, i // 13, t) for i, t in enumerate(times)], "stream string, pos long, batch long, ts_ns long")
    got = {r.batch: r.lateness_ns for r in watermarks.estimates(df, ["stream"], "pos", "batch", spec).collect()}
    samples, latest, want = [], None, {}
    for i, t in enumerate(times):
        if latest is not None:
            samples.append(max(0, latest - t))
        latest = t if latest is None else max(latest, t)
        if i % 13 == 12 or i == len(times) - 1:
            s = sorted(samples[-spec.window :])
            n = len(s)
            want[i // 13] = spec.ceiling_ns if n < spec.least else min(spec.ceiling_ns, max(spec.floor_ns, s[int((n - 1) * spec.quantile + 0.5)]))
    assert got == want
