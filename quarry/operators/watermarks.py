"""Completeness watermarks from observed lateness. Late records are counted and kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.framing import running_max, running_total
from quarry.plans.spec import WatermarkSpec


def lateness(records: DataFrame, key: list[str], order: str, ts: str = "ts_ns") -> DataFrame:
    """Adds ``lateness``: how far a record lies behind the latest before it; null for the first.
    ``order`` is a number, unique in a stream."""
    x = running_max(records, F.col(ts), key, "__ahead", order)
    return x.withColumn("lateness", F.when(F.col("__ahead").isNotNull(), F.greatest(F.lit(0), F.col("__ahead") - F.col(ts)))).drop("__ahead")


def _ranks(ends: DataFrame, samples: DataFrame, key: list[str], batch: str, spec: WatermarkSpec) -> DataFrame:
    """(key, batch, n, top): number of samples in the window of each batch end, and its greatest ones,
    falling, as many as the quantile can reach down.

    Samples lie in blocks. Of a block that the window holds whole, only its greatest samples go to
    the batch; of the two at the window's ends, those inside."""
    size = max(1, spec.window // 64)
    reach = int((1 - spec.quantile) * spec.window) + 2
    blocked = samples.withColumn("__block", F.floor(F.col("__i") / size))
    whole = blocked.groupBy(*key, "__block").agg(F.slice(F.sort_array(F.collect_list("lateness"), False), 1, reach).alias("top"))
    edges = blocked.groupBy(*key, "__block").agg(F.collect_list(F.struct("__i", "lateness")).alias("all"))
    low, high = F.greatest(F.col("__end") - spec.window + 1, F.lit(0)), F.col("__end")
    x = ends.withColumns({"low": low, "high": high, "first": F.ceil(low / size), "past": F.floor((high + 1) / size)})
    inside = x.where("past > first").select(*key, batch, F.explode(F.sequence("first", F.col("past") - 1)).alias("__block")).join(whole, [*key, "__block"]).select(*key, batch, "top")
    ragged = F.array_distinct(F.filter(F.array(F.when(F.col("low") % size != 0, F.floor(F.col("low") / size)), F.when((F.col("high") + 1) % size != 0, F.col("past"))), lambda b: b.isNotNull()))
    part = x.where("high >= 0").select(*key, batch, "low", "high", F.explode(ragged).alias("__block")).join(edges, [*key, "__block"])
    held = F.transform(F.filter("all", lambda s: s["__i"].between(F.col("low"), F.col("high"))), lambda s: s["lateness"])
    part = part.select(*key, batch, F.slice(F.sort_array(held, False), 1, reach).alias("top"))
    tops = inside.unionByName(part).groupBy(*key, batch).agg(F.slice(F.sort_array(F.flatten(F.collect_list("top")), False), 1, reach).alias("top"))
    return x.join(tops, [*key, batch], "left").select(*key, batch, "batch_max_ns", F.greatest(F.col("high") - F.col("low") + 1, F.lit(0)).alias("n"), "top")


def estimates(records: DataFrame, key: list[str], order: str, batch: str, spec: WatermarkSpec | None = None, ts: str = "ts_ns", restored: DataFrame | None = None) -> DataFrame:
    """(key, batch, batch_max_ns, lateness_ns, watermark_ns): at the end of each batch the estimate
    from the last samples, and the published watermark, which never goes back.

    With fewer samples than ``least`` the estimate is the ceiling, or what an earlier run had come
    to: ``restored`` has (key, lateness_ns, watermark_ns), whose lateness is held between floor and
    ceiling and below whose watermark none is published."""
    spec = spec or WatermarkSpec()
    x = lateness(records, key, order, ts)
    x = running_total(x, F.lit(1), key, "__n", order=order).withColumn("__n", F.col("__n") - 2)  # number of samples before, less one
    ends = x.groupBy(*key, batch).agg(F.max("__n").alias("__end"), F.max(ts).alias("batch_max_ns"))
    got = _ranks(ends, x.where("__n >= 0").select(*key, F.col("__n").alias("__i"), "lateness"), key, batch, spec)
    at = F.round((F.col("n") - 1) * F.lit(spec.quantile)).cast("int")
    held = lambda c: F.least(F.lit(spec.ceiling_ns), F.greatest(F.lit(spec.floor_ns), c))
    if restored is None:
        first, mark = F.lit(spec.ceiling_ns), F.lit(None).cast("long")
    else:
        before = restored.groupBy(*key).agg(F.max("lateness_ns").alias("__late"), F.max("watermark_ns").alias("__mark"))
        got = got.join(before, key, "left")
        first, mark = F.coalesce(held(F.col("__late")), F.lit(spec.ceiling_ns)), F.col("__mark")
    late = F.when(F.col("n") < spec.least, first).otherwise(held(F.get("top", (F.col("n") - 1 - at).cast("int"))))
    got = got.withColumns({"lateness_ns": late.cast("long"), "__mark": mark})
    so_far = Window.partitionBy(*key).orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)
    published = F.max(F.greatest(F.col("batch_max_ns") - F.col("lateness_ns"), F.col("__mark"))).over(so_far)
    return got.select(*key, batch, "batch_max_ns", "lateness_ns", published.alias("watermark_ns"))


def violations(records: DataFrame, published: DataFrame, key: list[str], batch: str, ts: str = "ts_ns") -> DataFrame:
    """(key, batch, violations): records below the watermark that earlier batches had published."""
    earlier = F.lag("watermark_ns").over(Window.partitionBy(*key).orderBy(batch))
    before = published.select(*key, batch, earlier.alias("__w"))
    return records.join(before, [*key, batch]).groupBy(*key, batch).agg(F.count_if(F.col(ts) < F.col("__w")).alias("violations"))


def watermark_rows(published: DataFrame, broken: DataFrame, key: list[str], batch: str) -> DataFrame:
    """(key, watermark_ns, lateness_ns, violations) after each batch; violations add up."""
    so_far = Window.partitionBy(*key).orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)
    return published.join(broken, [*key, batch], "left").select(*key, batch, "watermark_ns", "lateness_ns", F.sum(F.coalesce("violations", F.lit(0))).over(so_far).alias("violations"))


def over_files(rows: DataFrame, stream: list[str], file: str, batch: str, idle: int = 10) -> DataFrame:
    """(stream, batch, n_files, watermark_ns): a stream is as complete as the least complete of its files. A
    file's mark holds for the batches in which it is silent, ``idle`` of them at most; then the
    file is left out until it speaks again. What was published is not taken back."""
    spoken = Window.partitionBy(*stream, file).orderBy(batch)
    until = F.least(F.coalesce(F.lead(batch).over(spoken) - 1, F.col(batch) + idle), F.col(batch) + idle)
    held = rows.withColumn("__until", until).select(*stream, F.explode(F.sequence(batch, "__until")).alias(batch), "watermark_ns")
    least = held.join(rows.select(*stream, batch).distinct(), [*stream, batch]).groupBy(*stream, batch).agg(F.count(F.lit(1)).alias("n_files"), F.min("watermark_ns").alias("__least"))
    so_far = Window.partitionBy(*stream).orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)
    return least.select(*stream, batch, "n_files", F.max("__least").over(so_far).alias("watermark_ns"))


def is_complete(windows: DataFrame, rows: DataFrame, key: list[str], end: str = "window_end_ns") -> DataFrame:
    """Adds ``complete``: the last watermark of the stream has reached the end of the window. A
    stream without a watermark is never complete."""
    last = rows.groupBy(*key).agg(F.max("watermark_ns").alias("__w"))
    return windows.join(last, key, "left").withColumn("complete", F.coalesce(F.col(end) <= F.col("__w"), F.lit(False))).drop("__w")
