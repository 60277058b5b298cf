"""Lines by byte ranges: tables, rotated sets, and streams that grow, stop and go on."""

import os
import random

import pytest

from quarry.sources import files, lines
from quarry.streaming import stateful


def plain(data: bytes) -> list[tuple[int, bytes, bool]]:
    out, at = [], 0
    for part in data.splitlines(keepends=True) if b"\r" not in data else data.replace(b"\r", b"\x01").splitlines(keepends=True):
        part = part.replace(b"\x01", b"\r")
        ended = part.endswith(b"\n")
        body = part[:-1] if ended else part
        out.append((at, body[:-1] if body.endswith(b"\r") else body, ended))
        at += len(part)
    return out


def by_ranges(path, size: int) -> list[tuple[int, bytes, bool]]:
    n = os.path.getsize(path)
    got = []
    for part in lines.cut(iter([(str(path), 0, 0, n, True)]), size):
        for batch in lines.read_ranges(part):
            got += zip(batch["pos"].to_pylist(), batch["raw"].to_pylist(), batch["ended"].to_pylist(), strict=True)
    return got


@pytest.mark.parametrize("seed", range(6))
def test_any_cut_gives_the_same_lines(tmp_path, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(lines, "CHUNK", rng.choice([1, 3, 64]))
    monkeypatch.setattr(lines, "BACK", rng.choice([1, 2, 50]))
    data = bytes(rng.choice(b"ab\n\r") for _ in range(rng.choice([0, 1, 30, 400]))) + rng.choice([b"", b"\n", b"tail"])
    (tmp_path / "x.log").write_bytes(data)
    for size in (1, 2, 7, 1000):
        assert by_ranges(tmp_path / "x.log", size) == plain(data), (data, size)


def test_short_files_share_a_task_and_long_ones_are_cut():
    parts = lines.cut(iter([("a", 0, 0, 5, True), ("b", 1, 0, 5, True), ("c", 2, 0, 25, True), ("d", 3, 0, 0, True)]), 10)
    assert [[(p, s, e, last) for p, _, s, e, last in r.pieces] for r in parts] == [[("a", 0, 5, True), ("b", 0, 5, True)], [("c", 0, 10, False)], [("c", 10, 20, False)], [("c", 20, 25, True)]]


def test_names_and_folders(tmp_path):
    for name in ("a.log", "b.txt", "c[1].log", ".hidden.log", "_tmp.log"):
        (tmp_path / name).write_text("x\n")
    (tmp_path / "sub.log").mkdir()
    names = lambda pattern: [os.path.basename(p) for p, *_ in lines.listed(f"file:{tmp_path}", pattern)]
    assert names("*.log") == ["a.log", "c[1].log"] and names("c[1]*") == ["c[1].log"] and names("?.*") == ["a.log", "b.txt"]
    assert len(names(None)) == 3 and lines.listed(str(tmp_path / "none"), None) == [] and lines.listed(str(tmp_path / "none" / "a.log"), None, True) == []


def test_a_large_file_is_read_in_many_tasks_in_order(spark, tmp_path):
    body = "".join(f"line {i} {'x' * (i % 50)}\n" for i in range(40_000))
    (tmp_path / "big.log").write_text(body + "open")
    x = files.read_lines(spark, f"file://{tmp_path}", "s", "*.log", range_bytes=100_000)
    assert x.rdd.getNumPartitions() >= 10
    got = x.orderBy("pos").collect()
    assert [r.raw for r in got] == body.splitlines() + ["open"]
    assert [r.pos for r in got[:3]] == [0, len("line 0 \n"), len("line 0 \nline 1 x\n")]
    assert files.read_lines(spark, str(tmp_path), complete_only=True, range_bytes=100_000).count() == 40_000


def test_rotated_files_are_one_stream(spark, tmp_path):
    for i, (name, text) in enumerate([("app.log.2", "0\n1"), ("app.log.1", "2\n3\n"), ("app.log", "4\n5")]):
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    of = lambda **k: [r.raw for r in files.read_rotated_set(spark, str(tmp_path / "app.log"), "s", range_bytes=2, **k).orderBy("pos").collect()]
    assert of() == list("012345") and of(complete_only=True) == list("01234")


def run(spark, folder, out, checkpoint, **options):
    stream = stateful.stream_lines(spark, str(folder), **options)
    q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted((r.path.rsplit("/", 1)[1], r.pos, r.line) for r in spark.read.parquet(str(out)).collect())


def test_a_stopped_stream_goes_on_inside_a_file(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    log = folder / "a.log"
    log.write_bytes(b"one\ntwo\nthr")
    go = lambda: run(spark, folder, tmp_path / "out", tmp_path / "ck", closed=False, range_bytes=5)
    assert go() == [("a.log", 0, "one"), ("a.log", 4, "two")]
    with log.open("ab") as f:
        f.write(b"ee\r\nfour")
    (folder / "b.log").write_bytes(b"\xffb\n")
    want = [("a.log", 0, "one"), ("a.log", 4, "two"), ("a.log", 8, "three"), ("b.log", 0, "�b")]
    assert go() == want and go() == want
    with log.open("ab") as f:
        f.write(b"\n")
    assert go() == sorted([*want, ("a.log", 15, "four")])
    log.write_bytes(b"anew\n")  # copied away and truncated
    assert go() == sorted([*want, ("a.log", 15, "four"), ("a.log", 0, "anew")])
