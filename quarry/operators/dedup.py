"""One row for each table, tag set and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lww(records: DataFrame, key: list[str], arrival: list[Column | str]) -> DataFrame:
    """The last row to arrive stands. ``arrival`` has to be unique within a key."""
    newest = Window.partitionBy(*key).orderBy(*(F.desc(a) if isinstance(a, str) else a.desc() for a in arrival))
    return records.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def collision_report(records: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """(by, lines, rows, lost): lines that share the key of another would vanish. Keys are grouped
    first, so a hot group is counted from its distinct keys."""
    return records.groupBy(*by, *[k for k in key if k not in by]).agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("rows")).withColumn("lost", F.col("lines") - F.col("rows"))


def replay_report(delivered: DataFrame, key: list[str]) -> DataFrame:
    """(delivered, distinct_rows, replays) of deliveries that may repeat."""
    each = delivered.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.sum("n").alias("delivered"), F.count(F.lit(1)).alias("distinct_rows")).withColumn("replays", F.col("delivered") - F.col("distinct_rows"))
