"""The table store: whole batches once, whatever stops in between."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import accounting
from quarry.operators.store import Store, fan_out
from quarry.plans.pipeline import compose, settle
from quarry.plans.spec import Filter, Multiline, SourceSpec
from quarry.streaming import stateful

DAY = 86_400_000
SPEC = SourceSpec("app", "log", "json", "ts", "unix_ms", "ms", ("level",), {"host": "n1"}, {"n": "integer", "msg": "string"}, filters=(Filter("level", "debug"),))


def lines(spark, texts, key="k", start=0):
    return spark.createDataFrame([(key, start + i, x, f"/logs/{key}") for i, x in enumerate(texts)], "state_key string, pos long, line string, path string")


def text(day, n, level="info", ms=0):
    return f'{{"ts":{day * DAY + ms},"level":"{level}","n":{n},"msg":"m{n}"}}'


FIRST = [text(1, 1), text(1, 2), text(2, 3), text(1, 4, "debug"), "junk", '{"ts":5}']
SECOND = [text(2, 30), text(3, 31), text(3, 32, "debug"), "more junk"]


def batch(spark, number):
    return settle(lines(spark, FIRST if number == 0 else SECOND), SPEC)


def contents(store):
    rows = sorted((r.ts_ns, r.f_n) for r in store.records("log").collect())
    beside = {k: store.beside(k) for k in ("lines", "dead", "counters")}
    return rows, sorted(r.value for r in beside["lines"].collect()), sorted((r.reason, r.line) for r in beside["dead"].collect()), sorted((r.batch, r.lines_read, r.lines_shipped) for r in beside["counters"].collect())


def test_settled_rows_say_what_compose_says(spark):
    x = lines(spark, FIRST)
    whole, p = settle(x, SPEC), compose(x, SPEC)
    shipped = whole.where("stage = 'shipped'")
    assert sorted(r.lp for r in shipped.collect()) == sorted(r.lp for r in p.ok.collect())
    assert sorted((r.pos, r.line, r.reason) for r in whole.where("stage = 'quarantined'").collect()) == sorted((r.pos, r.line, r.reason) for r in p.quarantined.collect())
    assert {r.pos: r.tags for r in shipped.collect()} == {r.pos: r.tags for r in p.ok.collect()}
    total = accounting.totals(accounting.tally(whole)).where("source is null").first()
    assert (total.lines_read, total.lines_shipped, total.lines_quarantined, total.dropped_filter, total.files_read, total.pk_disambiguated, total.at_risk) == (6, 3, 2, 1, 1, 1, 0)


def test_counters_of_multiline_and_requests(spark):
    spec = SourceSpec("m", "log", multiline=Multiline("^S", max_lines=2), fields={"message": "string"})
    t = accounting.tally(settle(lines(spark, ["S1", "a", "b", "S2"]), spec)).first()
    assert (t.lines_read, t.lines_shipped, t.multiline_truncated) == (3, 3, 1)
    request = '{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"timeUnixNano":"5","body":{"stringValue":"x"}},{"timeUnixNano":"6","body":{"stringValue":"y"},"attributes":[{"key":"n","value":{"stringValue":"z"}}]}]}]}]}'
    t = accounting.tally(settle(lines(spark, [request, "{oops"]), SourceSpec("o", "otel", "otlp", fields={"body": "string", "n": "integer"}))).first()
    assert (t.otlp_records_received, t.otlp_records_rejected, t.lines_shipped) == (3, 2, 1)


def test_a_batch_twice_changes_nothing_and_days_stay_apart(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.commit("w", 0, batch(spark, 0)) and store.commit("w", 1, batch(spark, 1))
    before, entry = contents(store), store.entry()
    assert not store.commit("w", 1, batch(spark, 1)) and not store.commit("w", 0, batch(spark, 0))
    assert contents(store) == before and store.entry() == entry
    assert before[0] == [(DAY * 10**6, 1), (DAY * 10**6 + 1, 2), (2 * DAY * 10**6, 30), (3 * DAY * 10**6, 31)]  # day 2: the later row of one key
    sizes = {p.rsplit("=", 1)[1]: len(f) for p, f in entry["parts"].items()}
    assert sizes == {"1970-01-02": 1, "1970-01-03": 2, "1970-01-04": 1}
    assert [r.f_n for r in store.records("log", version=1).where("ts_ns >= 172800000000000").collect()] == [3]
    assert [r.f_n for r in store.records("log", since="1970-01-04").collect()] == [31]
    assert store.records("other").count() == 0 and Store(spark, f"file://{tmp_path}/none").records().count() == 0


class Stop(Exception):
    pass


@pytest.mark.parametrize("step", ["staged", "lines", "dead", "counters", "watermarks", "records", "ledger"])
def test_a_write_that_is_killed_anywhere(spark, tmp_path, step):
    marks = spark.createDataFrame([("app", 5, 1, 0)], "stream string, watermark_ns long, lateness_ns long, violations long")
    whole = Store(spark, f"file://{tmp_path}/whole")
    for b in (0, 1):
        whole.commit("w", b, batch(spark, b), marks)

    def stop(at):
        if at == step:
            raise Stop

    root = f"file://{tmp_path}/s"
    Store(spark, root).commit("w", 0, batch(spark, 0), marks)
    before = contents(Store(spark, root))
    with pytest.raises(Stop):
        Store(spark, root, after=stop).commit("w", 1, batch(spark, 1), marks)
    assert (contents(Store(spark, root)) == before) == (step != "ledger")
    Store(spark, root).commit("w", 1, batch(spark, 1), marks)
    assert contents(Store(spark, root)) == contents(whole)
    assert sorted(r.batch for r in Store(spark, root).beside("watermarks").collect()) == [0, 1]


def test_two_writers_at_once(spark, tmp_path):
    root, met = f"file://{tmp_path}/s", []

    def meanwhile(step):
        if step == "records" and not met:
            met.append(1)
            Store(spark, root).commit("b", 7, batch(spark, 1))

    assert Store(spark, root, after=meanwhile).commit("a", 0, batch(spark, 0))
    store = Store(spark, root)
    assert store.entry()["writers"] == {"a": 0, "b": 7} and store.entry()["version"] == 2
    assert sorted(r.f_n for r in store.records("log").collect()) == [1, 2, 3, 31]  # a came last, so its 3 stands
    assert store.vacuum(keep=1) == 1 and sorted(r.f_n for r in store.records("log").collect()) == [1, 2, 3, 31]


def test_partitions_are_compacted_and_types_stay(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", compact_after=3)
    for b in range(5):
        store.commit("w", b, settle(lines(spark, [text(1, b), text(1, 100 + b, ms=b)]), SPEC))
    assert [len(f) for f in store.entry()["parts"].values()] == [1]
    assert sorted(r.f_n for r in store.records().collect()) == [4, 100, 101, 102, 103, 104]  # batch 0 had two lines in one tick
    floats = SourceSpec("app", "log", "json", "ts", fields={"n": "float"})
    with pytest.raises(ValueError, match="f_n is bigint"):
        store.commit("w", 5, settle(lines(spark, [text(1, 1)]), floats))
    wider = SourceSpec("app", "log", "json", "ts", fields={"level": "string"})
    store.commit("w", 5, settle(lines(spark, [text(4, 1)]), wider))
    assert [r.f_level for r in store.records(since="1970-01-05").collect()] == ["info"]
    with pytest.raises(ValueError, match="writer"):
        store.commit("a/b", 0, batch(spark, 0))


def test_a_stream_into_the_store_stops_and_goes_on(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    stops = {"records"}

    def stop(step):
        if step in stops:
            stops.clear()
            raise Stop

    def go(after=lambda step: None):
        store = Store(spark, f"file://{tmp_path}/s", after=after)
        settled = lambda x, b: (settle(x, SPEC, resume=ticks(store)), None)
        stream = stateful.stream_lines(spark, str(folder), closed=False)
        q = stream.writeStream.foreachBatch(fan_out(store, "agent", settled)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return store

    def ticks(store):
        x = store.records()
        return x.groupBy("state_key", "tick").agg((F.max("seq") + 1).alias("next_seq")) if "seq" in x.columns else None

    (folder / "a.log").write_text("\n".join(FIRST) + "\n" + text(1, 5)[:10])
    go()
    with (folder / "a.log").open("a") as f:
        f.write(text(1, 5)[10:] + "\n")
    with pytest.raises(Exception, match="Stop"):
        go(stop)
    store = go()
    rows, written, dead, counted = contents(store)
    assert [n for _, n in rows] == [1, 2, 5, 3] and len(written) == 4 and len(dead) == 2 and counted == [(0, 6, 3), (1, 1, 1)]
