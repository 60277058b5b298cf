"""Physical lines to logical records. Order is (state_key, pos)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions that one task counts before the counts are put together; a stream longer than this
#: is counted by several tasks.
SPAN = 1 << 20


def _by_spans(df: DataFrame, value: Column, total, key: list[str], name: str, order: str, last: int) -> DataFrame:
    """Adds the running ``total`` (an aggregate) of a value in an order: within spans of positions,
    and then over the few span totals, so that one long stream is no single task."""
    x = df.withColumn("__value", value).withColumn("__span", F.floor(F.col(order) / SPAN))
    totals = x.groupBy(*key, "__span").agg(total("__value").alias("__t"))
    earlier = Window.partitionBy(*key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*key, "__span", total("__t").over(earlier).alias("__base"))
    within = Window.partitionBy(*key, "__span").orderBy(order).rowsBetween(Window.unboundedPreceding, last)
    return x.withColumn(name, total("__value").over(within)).join(totals, [*key, "__span"]).drop("__value", "__span")


def running_total(df: DataFrame, flag: Column, key: list[str], name: str, before: bool = False, order: str = "pos") -> DataFrame:
    """Adds the running sum of a 0/1 flag. ``before`` leaves out the row itself."""
    x = _by_spans(df, flag.cast("long"), F.sum, key, name, order, -1 if before else 0)
    return x.withColumn(name, F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col("__base"), F.lit(0))).drop("__base")


def running_max(df: DataFrame, value: Column, key: list[str], name: str, order: str) -> DataFrame:
    """Adds the greatest value of the rows before; null for the first."""
    return _by_spans(df, value, F.max, key, name, order, -1).withColumn(name, F.greatest(name, "__base")).drop("__base")


def _chunks(rows: DataFrame, key: list[str], max_n: int | None, max_bytes: int, waits: bool) -> DataFrame:
    """(key, group, pos, mode, chunk, cut): the chunk of each row (key, group, pos, size, may_cut) of a
    group in the order of its rows, and whether the row ends a chunk because that is full.

    A chunk that is full starts a count from nought, so rows are met in order; they carry
    numbers alone and a task keeps no more than the counts of the open chunk, however long the
    group is. Mode -1: the only outcome. With ``waits``, a first row that is full by itself
    gives its group two: 0 where that row ends a chunk, 1 where it waits for one more."""
    most = max_n or 1 << 62

    def walk(at: int, end: int, state: tuple, hold: bool, total: np.ndarray, may_cut: np.ndarray) -> tuple[tuple, np.ndarray, np.ndarray]:
        mode, n, size, chunk = state
        first, chunks, cut = at, np.empty(end - at, np.int64), np.zeros(end - at, bool)
        while True:
            full = max(at, min(at + most - n - 1, int(np.searchsorted(total, total[at] + max_bytes - size)) - 1))
            if hold and full == first:
                full += 1
            while full < end and not may_cut[full]:
                full += 1
            chunks[at - first : full + 1 - first] = chunk
            if full >= end:
                return (mode, n + end - at, size + int(total[end] - total[at]), chunk), chunks, cut
            cut[full - first] = True
            at, n, size, chunk = full + 1, 0, 0, chunk + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, states = None, []
        for batch in batches:
            count = batch.num_rows
            if not count:
                continue
            names = [batch.column(k) for k in (*key, "group")]
            new = np.zeros(count, bool)
            for c in names:
                codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            new[0] = last != [c[0].as_py() for c in names]
            last = [c[-1].as_py() for c in names]
            goes_on = not new[0]
            size, may_cut = batch.column("size").to_numpy(), batch.column("may_cut").to_numpy(zero_copy_only=False)
            total = np.concatenate([[0], np.cumsum(size)])
            starts = np.flatnonzero(new | (np.arange(count) == 0))
            ends = np.append(starts[1:], count)
            big = (ends - starts >= most) | (total[ends] - total[starts] >= max_bytes)
            big[0] |= goes_on
            mode, chunk, cut, stays = np.full(count, -1, np.int32), np.zeros(count, np.int64), np.zeros(count, bool), np.ones(count, bool)
            if not (goes_on and len(starts) == 1):
                carried, states = states, [(-1, int(ends[-1] - starts[-1]), int(total[-1] - total[starts[-1]]), 0)]
            else:
                carried = states
            both = []
            for at, end in zip(starts[big].tolist(), ends[big].tolist(), strict=True):
                begins = bool(new[at])
                before = carried if not begins else [(0, 0, 0, 0), (1, 0, 0, 0)] if waits and (size[at] >= max_bytes or most == 1) else [(-1, 0, 0, 0)]
                after = [walk(at, end, s, begins and s[0] == 1, total, may_cut) for s in before]
                if end == count:
                    states = [s for s, _, _ in after]
                if len(after) == 1:
                    chunk[at:end], cut[at:end] = after[0][1:]
                else:
                    stays[at:end] = False
                    both += [(np.arange(at, end), np.full(end - at, s[0], np.int32), c, x) for s, c, x in after]
            parts = [(np.flatnonzero(stays), mode[stays], chunk[stays], cut[stays]), *both]
            place, mode, chunk, cut = (np.concatenate(x) for x in zip(*parts, strict=True))
            kept = batch.select([*key, "group", "pos"]).take(pa.array(place))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(mode), pa.array(chunk), pa.array(cut)], names=[*kept.schema.names, "mode", "chunk", "cut"])

    rows = rows.select(*key, "group", "pos", F.col("size").cast("long").alias("size"), "may_cut")
    # as many parts as are set: the engine would gather rows this narrow into few tasks
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, *key, "group").sortWithinPartitions(*key, "group", "pos")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ordered.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (*key, "group", "pos")) + ", mode int, chunk long, cut boolean")


def _settled(chunks: DataFrame, key: list[str]) -> DataFrame:
    """Chunks of the outcome that holds: groups with two take the first where the group before them
    left nothing open. What a group leaves open is known, or is what it met, or its opposite.
    Only groups with two outcomes and those right before them are looked at."""
    two = chunks.where("mode = 0 and chunk = 0").select(*key, "group").distinct()
    looked_at = two.withColumn("group", F.explode(F.array(F.col("group"), F.col("group") - 1))).distinct()
    left = lambda mode: F.max_by(~F.col("cut"), F.when(F.col("mode").isin(-1, mode), F.col("pos")))
    g = chunks.join(looked_at, [*key, "group"], "left_semi").groupBy(*key, "group").agg(left(0).alias("fresh"), left(1).alias("held"), (F.max("mode") >= 0).alias("two"))
    turns = (F.col("fresh") & ~F.col("held")).cast("int")
    until = Window.partitionBy(*key).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("turned", F.coalesce(F.sum(turns).over(until), F.lit(0)))
    g = g.withColumn("known", F.max(F.when(F.col("fresh") == F.col("held"), F.struct("group", "fresh", "turned"))).over(until))
    met = F.coalesce("known.fresh", F.lit(False)) != ((F.col("turned") - F.coalesce("known.turned", F.lit(0))) % 2 == 1)
    g = g.where("two").select(*key, "group", met.cast("int").alias("__met"))
    return chunks.join(g, [*key, "group"], "left").where("mode = -1 or mode = __met").drop("__met")


def join_multiline(lines: DataFrame, starts_with: str | None, max_lines: int = 500, max_bytes: int = 65_536) -> DataFrame:
    """(state_key, pos, line, n_lines, truncated): a line that matches opens a record, others
    continue it; the record has the position of its first line. A record that is full is cut
    and the next line opens a new one, as does a continuation without a beginning. A first
    line that fills a record by itself while the one before was open waits for one more line.

    Places in records are found from positions and sizes alone; the texts of one record, which
    the limits bound, are all that comes together."""
    if starts_with is None:
        return lines.select("state_key", "pos", "line", F.lit(1).alias("n_lines"), F.lit(False).alias("truncated"))
    key = ["state_key"]
    x = lines.select("state_key", "pos", F.coalesce(F.col("line").rlike(starts_with), F.lit(False)).alias("starts"), (F.octet_length("line") + 1).alias("size"))
    x = running_total(x, F.col("starts"), key, "group").withColumn("may_cut", F.lit(True))
    places = _settled(_chunks(x, key, max_lines, max_bytes, True), key)
    rows = lines.select("state_key", "pos", "line").join(places, ["state_key", "pos"])
    g = rows.groupBy("state_key", "group", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"), F.max("cut").alias("truncated"))
    text = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    return g.select("state_key", F.get("rows", F.lit(0))["pos"].alias("pos"), text.alias("line"), F.size("rows").alias("n_lines"), "truncated")


def _reassemble(fragments: DataFrame, max_bytes: int) -> DataFrame:
    """Fragments (state_key, stream, pos, time, text, closes) to messages, in each stream by itself.
    Messages carry the first fragment's time and the position of the line that closed them."""
    key = ["state_key", "stream"]
    x = fragments.select(*key, "pos", "closes", F.octet_length("text").alias("size"))
    x = running_total(x, F.col("closes"), key, "group", before=True).withColumn("may_cut", ~F.col("closes"))
    places = _chunks(x, key, None, max_bytes, False).drop("mode")
    rows = fragments.join(places, [*key, "pos"])
    g = rows.groupBy(*key, "group", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "time", "text", "closes"))).alias("rows"), F.max("cut").alias("truncated"))
    last = F.element_at("rows", -1)
    return g.select(
        *key,
        last["pos"].alias("pos"),
        F.get("rows", F.lit(0))["time"].alias("time"),
        F.array_join(F.transform("rows", lambda r: r["text"]), "").alias("log"),
        "truncated",
        (~last["closes"] & ~F.col("truncated")).alias("unclosed"),
    )


DOCKER = "log string, stream string, time string"


def docker_fragments(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fragments, and the lines that are none, with the reason."""
    keys = F.from_json("line", "map<string,string>", {"allowSingleQuotes": "false"})
    x = lines.withColumn("m", keys)
    p = x.select("state_key", "pos", "line", *(F.element_at("m", k).alias(k) for k in ("log", "stream", "time")))
    ok = F.col("log").isNotNull() & F.col("stream").isNotNull() & F.col("time").isNotNull()
    good = p.where(ok).select("state_key", "stream", "pos", "time", F.regexp_replace("log", r"\n\z", "").alias("text"), F.col("log").endswith("\n").alias("closes"))
    return good, p.where(~ok).select("state_key", "pos", "line", F.lit("unparseable: not a container log line").alias("reason"))


def reassemble_docker(lines: DataFrame, max_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    good, bad = docker_fragments(lines)
    return _reassemble(good, max_bytes), bad


def cri_fragments(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``<time> <stream> <P|F> <message>``; the message may be missing."""
    p = lines.withColumn("p", F.split("line", " ", 4))
    part = lambda i: F.get("p", F.lit(i))
    reason = (
        F.when(F.coalesce(part(0), F.lit("")) == "", "unparseable: empty line")
        .when(part(1).isNull(), "unparseable: no stream")
        .when(~part(1).isin("stdout", "stderr"), F.concat(F.lit("unparseable: bad stream "), part(1)))
        .when(part(2).isNull(), "unparseable: no tag")
        .when(~part(2).isin("P", "F"), F.concat(F.lit("unparseable: bad tag "), part(2)))
    )
    p = p.withColumn("reason", reason)
    good = p.where("reason is null").select("state_key", part(1).alias("stream"), "pos", part(0).alias("time"), F.coalesce(part(3), F.lit("")).alias("text"), (part(2) == "F").alias("closes"))
    return good, p.where("reason is not null").select("state_key", "pos", "line", "reason")


def reassemble_cri(lines: DataFrame, max_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    good, bad = cri_fragments(lines)
    return _reassemble(good, max_bytes), bad


def envelope(messages: DataFrame) -> DataFrame:
    """Messages with a ``parsed`` map {log, stream, time}: one mapping serves both runtimes."""
    pairs = [x for k in ("log", "stream", "time") for x in (F.lit(k), F.col(k))]
    return messages.withColumn("parsed", F.create_map(*pairs)).withColumnRenamed("stream", "channel")
