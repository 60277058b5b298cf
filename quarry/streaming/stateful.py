"""Streaming forms: lines from closed files, framing, stamping and watermarks with state.

State commits together with the offsets, so a half-built record or a used place in a tick is
never lost or used twice. Rows of a micro-batch come in no order and are sorted by position
before use.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.plans.spec import WatermarkSpec
from quarry.sources import lines
from quarry.sources.files import decoded, stream_id

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REMEMBERED_TICKS = 64


def prepare_streaming(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_lines(spark: SparkSession, folder: str, source: str = "file", pattern: str | None = None, closed: bool = True, range_bytes: int | None = None) -> DataFrame:
    """(state_key, path, pos, line) of the lines of a folder's files, each once, ``pos`` the byte at which
    it begins. A batch is what was written since the last one, in ranges of ``range_bytes``.

    ``closed``: files do not grow, and a last line without a line feed counts. Otherwise files may
    grow, and a line waits until its line feed is there."""
    reader = spark.readStream.format(lines.register(spark)).option("path", folder).option("closed", str(closed).lower())
    if pattern:
        reader = reader.option("pattern", pattern)
    if range_bytes:
        reader = reader.option("range_bytes", range_bytes)
    x = decoded(reader.load())
    return x.select(stream_id(source, F.col("path")).alias("state_key"), "path", "pos", "line")


class Framer(StatefulProcessor):
    """Multi-line records. An open record waits in state for its next line or the timeout."""

    def __init__(self, starts_with: str, max_lines: int = 500, max_bytes: int = 65_536, timeout_ms: int = 1_000):
        self.start, self.max_lines, self.max_bytes, self.timeout_ms = starts_with, max_lines, max_bytes, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "pos long, line string")
        self.begins = re.compile(self.start)

    def _rows(self, key, done: list[tuple[list[tuple[int, str]], bool]]) -> pd.DataFrame:
        return pd.DataFrame({"state_key": [key[0]] * len(done), "pos": [r[0][0] for r, _ in done], "line": ["\n".join(x for _, x in r) for r, _ in done], "n_lines": [len(r) for r, _ in done], "truncated": [t for _, t in done]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(r[0], r[1]) for r in self.lines.get()] if self.lines.exists() else []
        size = sum(len(x.encode()) + 1 for _, x in held)
        done: list[tuple[list[tuple[int, str]], bool]] = []
        new = pd.concat(list(rows)).sort_values("pos")
        for pos, line in zip(new["pos"].tolist(), new["line"].tolist(), strict=True):
            if self.begins.search(line) and held:
                done.append((held, False))
                held, size = [(pos, line)], len(line.encode()) + 1
                continue
            held.append((pos, line))
            size += len(line.encode()) + 1
            if len(held) >= self.max_lines or size >= self.max_bytes:
                done.append((held, True))
                held, size = [], 0
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if held:
            self.lines.put(held)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        else:
            self.lines.clear()
        if done:
            yield self._rows(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [(r[0], r[1]) for r in self.lines.get()] if self.lines.exists() else []
        self.lines.clear()
        if held:
            yield self._rows(key, [(held, False)])

    def close(self) -> None:
        pass


class Reassembler(StatefulProcessor):
    """Container messages from fragments (state_key, stream, pos, time, text, closes). An open
    message waits in state for its end or the timeout; a full one is cut."""

    def __init__(self, max_bytes: int = 1 << 20, timeout_ms: int = 1_000):
        self.max_bytes, self.timeout_ms = max_bytes, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "pos long, time string, log string")

    def _rows(self, key, done: list[tuple[int, str, str, bool, bool]]) -> pd.DataFrame:
        out = pd.DataFrame(done, columns=["pos", "time", "log", "truncated", "unclosed"])
        out.insert(0, "stream", key[1])
        out.insert(0, "state_key", key[0])
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.open.get() if self.open.exists() else None
        time, parts, size, done, last = (held[1], [held[2]], len(held[2].encode()), [], held[0]) if held else (None, [], 0, [], 0)
        new = pd.concat(list(rows)).sort_values("pos")
        for pos, at, text, closes in zip(new["pos"].tolist(), new["time"].tolist(), new["text"].tolist(), new["closes"].tolist(), strict=True):
            time = at if not parts else time
            parts.append(text)
            size += len(text.encode())
            last = pos
            if closes or size >= self.max_bytes:
                done.append((pos, time, "".join(parts), not closes, False))
                parts, size = [], 0
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if parts:
            self.open.update((last, time, "".join(parts)))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        else:
            self.open.clear()
        if done:
            yield self._rows(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.open.get() if self.open.exists() else None
        self.open.clear()
        if held:
            yield self._rows(key, [(held[0], held[1], held[2], False, True)])

    def close(self) -> None:
        pass


class Stamper(StatefulProcessor):
    """Places in ticks, with the ticks that were opened last. A tick that had to be forgotten would
    start anew; a new tick older than all remembered ones is flagged."""

    def __init__(self, tick_ns: int, carried: list[str], remembered: int = REMEMBERED_TICKS):
        self.tick_ns, self.carried, self.remembered = tick_ns, carried, remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ticks = handle.getListState("ticks", "tick long, next long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {r[0]: r[1] for r in self.ticks.get()} if self.ticks.exists() else {}
        new = pd.concat(list(rows)).sort_values("pos")
        stamps, spent, outside = [], [], []
        for ts in new["source_ts_ns"].tolist():
            tick = ts - ts % self.tick_ns
            late = tick not in known and len(known) >= self.remembered and tick < min(known)
            if tick not in known:
                if len(known) >= self.remembered:
                    del known[next(iter(known))]
                known[tick] = 0
            place = known[tick]
            full = self.tick_ns > 1 and place >= self.tick_ns
            if not full:
                known[tick] = place + 1
            stamps.append(ts if self.tick_ns == 1 else tick + place)
            spent.append(full)
            outside.append(late)
        self.ticks.put(list(known.items()))
        yield new.assign(ts_ns=stamps, exhausted=spent, out_of_window=outside)[["state_key", *self.carried, "ts_ns", "exhausted", "out_of_window"]]

    def close(self) -> None:
        pass


class Completeness(StatefulProcessor):
    """Observed lateness of a stream; one row for each micro-batch. What an earlier run had come to
    may be handed over: its estimate, held between floor and ceiling, stands until there are
    enough samples, and no watermark below its own is published."""

    def __init__(self, spec: WatermarkSpec | None = None):
        self.spec = spec or WatermarkSpec()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", "lateness long")
        self.marks = handle.getValueState("marks", "max_ts long, published long, violations long, restored long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        late, mark = int(initialState["lateness_ns"].max()), initialState["watermark_ns"].max()
        self.marks.update((None, None if pd.isna(mark) else int(mark), 0, min(self.spec.ceiling_ns, max(self.spec.floor_ns, late))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self.spec
        samples = [r[0] for r in self.samples.get()] if self.samples.exists() else []
        latest, published, broken, restored = self.marks.get() if self.marks.exists() else (None, None, 0, None)
        batch_max = None
        for ts in pd.concat(list(rows)).sort_values("pos")["ts_ns"].tolist():
            if latest is not None:
                samples.append(max(0, latest - ts))
            broken += published is not None and ts < published
            latest = ts if latest is None else max(latest, ts)
            batch_max = ts if batch_max is None else max(batch_max, ts)
        samples = samples[-s.window :]
        if len(samples) < s.least:
            late = s.ceiling_ns if restored is None else restored
        else:
            late = min(s.ceiling_ns, max(s.floor_ns, sorted(samples)[int((len(samples) - 1) * s.quantile + 0.5)]))
        published = batch_max - late if published is None else max(published, batch_max - late)
        self.samples.put([(x,) for x in samples])
        self.marks.update((latest, published, broken, restored))
        yield pd.DataFrame({"stream": [key[0]], "watermark_ns": [published], "lateness_ns": [late], "violations": [broken]})

    def close(self) -> None:
        pass


class LeastOfFiles(StatefulProcessor):
    """A stream's watermark from those of its files: the least of the marks in state. A file that has
    been silent for ``idle_ms`` leaves the state by itself; what was published is not taken back."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getMapState("files", "file string", "mark long", ttlDurationMs=self.idle_ms)
        self.published = handle.getValueState("published", "mark long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for file, mark in pd.concat(list(rows)).groupby("file")["watermark_ns"].max().items():
            self.files.updateValue((file,), (int(mark),))
        marks = [v[0] for _, v in self.files.iterator()]
        before = self.published.get()[0] if self.published.exists() else None
        mark = min(marks) if before is None else max(before, min(marks))
        self.published.update((mark,))
        yield pd.DataFrame({"stream": [key[0]], "n_files": [len(marks)], "watermark_ns": [mark]})

    def close(self) -> None:
        pass


def framed_stream(lines: DataFrame, starts_with: str, **caps) -> DataFrame:
    return lines.groupBy("state_key").transformWithStateInPandas(Framer(starts_with, **caps), "state_key string, pos long, line string, n_lines int, truncated boolean", "append", "processingTime")


def reassembled_stream(fragments: DataFrame, max_bytes: int = 1 << 20, timeout_ms: int = 1_000) -> DataFrame:
    """``fragments``: as ``framing.docker_fragments`` and ``framing.cri_fragments`` give them."""
    return fragments.groupBy("state_key", "stream").transformWithStateInPandas(Reassembler(max_bytes, timeout_ms), "state_key string, stream string, pos long, time string, log string, truncated boolean, unclosed boolean", "append", "processingTime")


def stamped_stream(records: DataFrame, tick_ns: int) -> DataFrame:
    kept = [f for f in records.schema.fields if f.name != "state_key"]
    schema = ", ".join(["state_key string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "ts_ns long, exhausted boolean, out_of_window boolean"])
    return records.groupBy("state_key").transformWithStateInPandas(Stamper(tick_ns, [f.name for f in kept]), schema, "append", "none")


def watermark_stream(records: DataFrame, spec: WatermarkSpec | None = None, restored: DataFrame | None = None) -> DataFrame:
    """``records``: (stream, pos, ts_ns); ``restored``: (stream, lateness_ns, watermark_ns) of an earlier run, a
    table, not a stream."""
    before = None if restored is None else restored.select("stream", "lateness_ns", "watermark_ns").groupBy("stream")
    return records.groupBy("stream").transformWithStateInPandas(Completeness(spec), "stream string, watermark_ns long, lateness_ns long, violations long", "append", "none", before)


def files_watermark_stream(marks: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """``marks``: (stream, file, watermark_ns), as ``watermark_stream`` gives them for each file."""
    return marks.groupBy("stream").transformWithStateInPandas(LeastOfFiles(idle_ms), "stream string, n_files int, watermark_ns long", "append", "processingTime")
