"""Unique timestamps: source time rounded down to a tick, plus the place within the tick."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.maps import merge, series_key


def stamp(records: DataFrame, tick_ns: int, order: list[str] | None = None, scope: list[str] | None = None, resume: DataFrame | None = None) -> DataFrame:
    """Adds tick, seq, ts_ns and ``exhausted`` (no place left in the tick). At one nanosecond the
    source time passes unchanged.

    ``order`` has to be unique within the scope, so that a replay gives the same stamps.
    ``scope`` is the stream by default; with the series key it also keeps apart streams that
    share their tags. ``resume``: (scope, tick, next_seq) of an earlier run, for which counting
    goes on. The window is over (scope, tick), so one busy stream spreads over many tasks."""
    scope = scope or ["state_key"]
    if tick_ns == 1:
        return records.withColumns({"tick": F.col("source_ts_ns"), "seq": F.lit(0).cast("long"), "ts_ns": F.col("source_ts_ns"), "exhausted": F.lit(False)})
    x = records.withColumn("tick", F.col("source_ts_ns") - F.pmod("source_ts_ns", F.lit(tick_ns)))
    place = F.row_number().over(Window.partitionBy(*scope, "tick").orderBy(*(order or ["pos"]))).cast("long") - 1
    x = x.withColumn("seq", place)
    if resume is not None:
        x = x.join(resume.select(*scope, "tick", "next_seq"), [*scope, "tick"], "left").withColumn("seq", F.col("seq") + F.coalesce("next_seq", F.lit(0))).drop("next_seq")
    return x.withColumns({"ts_ns": F.col("tick") + F.col("seq"), "exhausted": F.col("seq") >= tick_ns})


def stamp_by_series(records: DataFrame, tick_ns: int, order: list[str]) -> DataFrame:
    """Stamping over whole tag sets instead of streams."""
    return stamp(records.withColumn("series_key", series_key(F.col("tags"))), tick_ns, order, ["series_key"])


def resume_state(stamped: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(scope, tick, next_seq) to hand to the next run: the last tick of each stream."""
    scope = scope or ["state_key"]
    by_tick = stamped.groupBy(*scope, "tick").agg((F.max("seq") + 1).alias("next_seq"))
    last = F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("tick")))
    return by_tick.withColumn("n", last).where("n = 1").drop("n")


def disambiguate_by_tag(stamped: DataFrame) -> DataFrame:
    """The other way to make records unique: the time stays on its tick and a ``seq`` tag tells
    them apart."""
    return stamped.withColumns({"tags": merge(F.col("tags"), F.create_map(F.lit("seq"), F.col("seq").cast("string"))), "ts_ns": F.col("tick")})
