"""Where records end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.lineproto import encode_line, parse_line, unencodable
from quarry.functions.maps import named
from quarry.operators.framing import running_total


def assign_batches(records: DataFrame, batch_lines: int = 5_000, key: str = "state_key", order: str = "pos") -> DataFrame:
    """Adds ``batch``: consecutive records of a stream, so many in each."""
    x = running_total(records, F.lit(1), [key], "batch", before=True, order=order)
    return x.withColumn("batch", F.floor(F.col("batch") / batch_lines))


def unencodable_reason(kinds: dict[str, str]) -> Column:
    """Why a record has no line; null where it has one."""
    return unencodable(F.col("table"), {k: (named(f"f_{k}"), kind) for k, kind in sorted(kinds.items())})


def line_of(kinds: dict[str, str], tags: Column | dict[str, Column]) -> Column:
    return encode_line(F.col("table"), tags, {k: (named(f"f_{k}"), kind) for k, kind in sorted(kinds.items())}, F.col("ts_ns"))


def encoded(records: DataFrame, kinds: dict[str, str], tags: Column | dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Records with their line in ``lp``, and those that have none with the reason. ``tags``: a column for
    each tag, in place of the map column ``tags``."""
    fields = {k: (named(f"f_{k}"), kind) for k, kind in sorted(kinds.items())}
    bad = unencodable(F.col("table"), fields)
    x = records.where(bad.isNull()).withColumn("lp", encode_line(F.col("table"), F.col("tags") if tags is None else tags, fields, F.col("ts_ns")))
    return x, records.withColumn("reason", bad).where("reason is not null")


def validate_batch(lines: DataFrame, column: str = "lp") -> tuple[DataFrame, DataFrame]:
    """Lines that read back as a record, and the others: one bad line does not hold up a batch."""
    good = parse_line(F.col(column)).isNotNull()
    return lines.where(good), lines.where(~F.coalesce(good, F.lit(False)))


def write_lp(encoded_lines: DataFrame, path: str, column: str = "lp") -> None:
    encoded_lines.select(F.col(column).alias("value")).write.mode("append").option("compression", "gzip").text(path)


def write_dead_letter(rejected: DataFrame, path: str) -> None:
    """One JSON object for each rejected line with its reason, by stream."""
    rejected.select("state_key", "reason", "line").write.mode("append").partitionBy("state_key").json(path)
