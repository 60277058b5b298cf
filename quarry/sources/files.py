"""Lines of files, with an order that survives splitting."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.parse import decode_lossy, parse_json
from quarry.sources import lines


def stream_id(source: str, path: Column) -> Column:
    """``<source>.<file name without .log>``"""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return F.concat(F.lit(f"{source}."), F.regexp_replace(name, r"\.log$", ""))


#: Bytes of one file, and of a rotated set's files before one, that positions have room for.
FILE_BITS = 44


def _scan(spark: SparkSession, path: str, range_bytes: int | None, **options: str) -> DataFrame:
    reader = spark.read.format(lines.register(spark)).option("path", path)
    if range_bytes:
        reader = reader.option("range_bytes", range_bytes)
    return reader.options(**options).load().withColumn("raw", F.col("raw").cast("string"))


def read_lines(spark: SparkSession, path: str, source: str = "file", pattern: str | None = None, complete_only: bool = False, range_bytes: int | None = None) -> DataFrame:
    """(state_key, path, pos, raw) of a file or of the files in a folder.

    Lines end with a line feed; one carriage return before it is removed. ``pos`` is the byte at
    which the line begins, whatever ranges the file is read in. ``pattern`` (``*`` and ``?``)
    chooses files of the folder itself. ``complete_only`` leaves out a last line without its
    line feed. A folder that is missing has no lines."""
    x = _scan(spark, path, range_bytes, **({"pattern": pattern} if pattern else {}))
    x = x.where("ended") if complete_only else x
    return x.select(stream_id(source, F.col("path")).alias("state_key"), "path", "pos", "raw")


def read_rotated_set(spark: SparkSession, path: str, source: str = "file", complete_only: bool = False, range_bytes: int | None = None) -> DataFrame:
    """A log and its rotated siblings, which share its name as a prefix, as one stream: oldest
    first, then by byte. ``complete_only`` leaves out a last line of the live file that has no
    line feed yet; such a line of a rotated file is complete, since nobody writes there."""
    name = path.rsplit("/", 1)[1]
    x = _scan(spark, path, range_bytes, rotated="true")
    x = x.where(F.col("ended") | ~F.col("path").endswith("/" + name)) if complete_only else x
    return x.select(F.lit(f"{source}.{re.sub(r'[.]log$', '', name)}").alias("state_key"), "path", (F.col("rank").cast("long") * (1 << FILE_BITS) + F.col("pos")).alias("pos"), "raw")


def decoded(lines: DataFrame) -> DataFrame:
    """Adds ``line``: the raw bytes as valid text, and how many sequences had to be replaced."""
    line = decode_lossy(F.col("raw"))
    return lines.withColumn("line", line).withColumn("replaced", F.length("line") - F.length(F.replace("line", F.lit("�"), F.lit(""))))


def read_journal(lines: DataFrame, declared: list[str]) -> DataFrame:
    """Entries of a JSON journal export: (state_key, pos, parsed, source_ts_ns). The entry's own
    time counts; entries without any declared field are skipped."""
    x = lines.withColumn("parsed", parse_json(F.col("line")))
    ts = F.try_multiply(F.element_at("parsed", "__REALTIME_TIMESTAMP").try_cast("bigint"), F.lit(1000))
    return x.withColumn("source_ts_ns", ts).where(F.col("parsed").isNotNull() & F.exists(F.map_keys("parsed"), lambda k: k.isin(declared)))


def read_exec_output(runs: DataFrame, tags: dict[str, str], cap: int = 1 << 20) -> DataFrame:
    """Lines of successful runs (host, ts, exit_code, stdout), each with the global tags. Output
    beyond the cap in bytes and blank lines are left out."""
    from quarry.functions.lineproto import inject_tags
    from quarry.functions.parse import is_blank
    from quarry.operators.records import tags_static

    capped = F.make_valid_utf8(F.substring(F.encode("stdout", "UTF-8"), 1, cap).cast("string"))
    x = runs.where("exit_code = 0").select("host", "ts", F.posexplode(F.split(capped, "\r?\n")).alias("pos", "line"))
    x = x.where(~is_blank(F.col("line")))
    return x.withColumn("line", inject_tags(F.col("line"), tags_static(tags))) if tags else x
