"""Lines of files by byte ranges, as a data source for tables and for streams.

A range owns the lines whose line feed lies in it; the range in which a line ends looks back for
its beginning. So a file of any size is read in many tasks, no line is read twice or left out,
the position of a line is the byte at which it begins, and a last line that has no line feed yet
is known to the one range that reaches the end of the file.

As a stream, an offset is the number of bytes of every file that were taken. What was appended
since comes as the next batch, cut into ranges; a line whose end has not been written waits. A
query that was stopped goes on inside a file. A file that became shorter than what was taken is
read anew from its beginning; a renamed file is another file.

Paths are those that ``pyarrow.fs`` opens: local and mounted ones, s3 (also as s3a), gs, hdfs, abfs.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, rank int, pos long, raw binary, ended boolean"
RANGE_BYTES = 128 << 20
CHUNK = 4 << 20
BACK = 64 << 10


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and its own path of a path or address."""
    if re.match(r"^file:/[^/]", path):
        path = "file://" + path[5:]
    path = re.sub(r"^s3[an]://", "s3://", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, pattern: str | None, rotated: bool = False) -> list[tuple[str, int, int]]:
    """(path, size, rank) of a file, of the files of a folder whose names match, or of a log and its
    rotated siblings. Ranks are by name; of a rotated set by age, the live file last. A folder
    or file that is missing has none."""
    store, inner = opened(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if rotated:
        folder, name = inner.rsplit("/", 1)
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        kept = sorted((f for f in found if f.type == fs.FileType.File and f.base_name.startswith(name)), key=lambda f: (f.base_name == name, f.mtime_ns or 0, f.path))
    else:
        info = store.get_file_info(inner)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner)) if info.type == fs.FileType.Directory else []
        # brackets mean themselves, as in shells they would not
        wanted = None if pattern is None or info.type == fs.FileType.File else re.compile(fnmatch.translate(pattern.replace("[", "[[]")))
        kept = sorted((f for f in found if f.type == fs.FileType.File and not (info.type != fs.FileType.File and f.base_name.startswith((".", "_"))) and (wanted is None or wanted.match(f.base_name))), key=lambda f: f.path)
    return [(prefix + f.path, f.size, i) for i, f in enumerate(kept)]


class Ranges(InputPartition):
    """Pieces (path, rank, start, end, last) that one task reads; ``last``: the end of the file is its end."""

    def __init__(self, pieces: list[tuple[str, int, int, int, bool]]):
        self.pieces = pieces


def cut(pieces: Iterator[tuple[str, int, int, int, bool]], size: int) -> list[Ranges]:
    """Long pieces in ranges of ``size`` bytes, short ones together up to as much."""
    out: list[Ranges] = []
    held: list[tuple[str, int, int, int, bool]] = []
    room = size
    for path, rank, start, end, last in pieces:
        for at in range(start, end, size):
            stop = min(end, at + size)
            if held and stop - at > room:
                out.append(Ranges(held))
                held, room = [], size
            held.append((path, rank, at, stop, last and stop == end))
            room -= stop - at
    return [*out, Ranges(held)] if held else out


def before(f, at: int) -> bytes:
    """Bytes from behind the last line feed before ``at`` up to ``at``."""
    parts: list[bytes] = []
    while at > 0:
        begin = max(0, at - BACK)
        f.seek(begin)
        part = f.read(at - begin)
        mark = part.rfind(b"\n")
        if mark >= 0:
            parts.append(part[mark + 1 :])
            break
        parts.append(part)
        at = begin
    return b"".join(reversed(parts))


def range_lines(f, start: int, end: int, last: bool) -> Iterator[tuple[np.ndarray, pa.Array, bool]]:
    """(positions, lines with their line feeds, ended) of the lines that end in [start, end)."""
    open_, at, begun = [], start, None  # parts of the line that is open, where it begins
    while at < end:
        f.seek(at)
        chunk = f.read(min(CHUNK, end - at))
        if not chunk:
            break
        at += len(chunk)
        marks = np.flatnonzero(np.frombuffer(chunk, np.uint8) == 10)
        if not len(marks):
            open_.append(chunk)
            continue
        if begun is None:
            head = before(f, start)
            open_.insert(0, head)
            begun = start - len(head)
        kept = int(marks[-1]) + 1
        data = b"".join([*open_, chunk[:kept]])
        ends = marks + 1 + (len(data) - kept)
        bounds = np.concatenate([[0], ends])
        yield begun + bounds[:-1], pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)]), True
        begun += len(data)
        open_ = [chunk[kept:]]
    if last:
        if begun is None:
            head = before(f, start)
            open_.insert(0, head)
            begun = start - len(head)
        rest = b"".join(open_)
        if rest:
            yield np.array([begun]), pa.array([rest], pa.binary()), False


def stripped(lines: pa.Array, ended: bool) -> pa.Array:
    """Lines without their line feed and one carriage return before it."""
    lines = pc.binary_slice(lines, 0, -1) if ended else lines
    return pc.if_else(pc.ends_with(lines, "\r"), pc.binary_slice(lines, 0, -1), lines)


def read_ranges(part: Ranges) -> Iterator[pa.RecordBatch]:
    for path, rank, start, end, last in part.pieces:
        store, inner = opened(path)
        with store.open_input_file(inner) as f:
            for positions, lines, ended in range_lines(f, start, end, last):
                n = len(lines)
                yield pa.RecordBatch.from_arrays([pa.repeat(path, n), pa.repeat(pa.scalar(rank, pa.int32()), n), pa.array(positions, pa.int64()), stripped(lines, ended), pa.repeat(ended, n)], names=["path", "rank", "pos", "raw", "ended"])


class BatchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        o = self.options
        files = listed(o["path"], o.get("pattern"), o.get("rotated") == "true")
        return cut(((path, rank, 0, size, True) for path, size, rank in files), int(o.get("range_bytes", RANGE_BYTES))) or [Ranges([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from read_ranges(partition)


class StreamReader(DataSourceStreamReader):
    """Offsets: {"files": {path: bytes taken}}. Files that are gone leave the offsets."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": {path: size for path, size, _ in listed(self.options["path"], self.options.get("pattern"))}}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        # a closed file's last line counts without a line feed, once: when the whole file comes at once
        closed = self.options.get("closed") == "true"
        taken, pieces = start["files"], []
        for path, size in sorted(end["files"].items()):
            done = taken.get(path, 0)
            done = 0 if size < done else done
            if size > done:
                pieces.append((path, 0, done, size, closed))
        return cut(iter(pieces), int(self.options.get("range_bytes", RANGE_BYTES)))

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from read_ranges(partition)


class LineSource(DataSource):
    """Options: path; pattern (``*`` and ``?``, for the names in a folder); rotated (the path is a log with
    rotated siblings); range_bytes; closed (streams: files do not grow, so a last line without a
    line feed counts)."""

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(dict(self.options))


def register(spark: SparkSession) -> str:
    spark.dataSource.register(LineSource)
    return LineSource.name()
