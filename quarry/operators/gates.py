"""Acceptance checks on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.maps import series_key


def exact_count(stored: DataFrame, by: list[str], idx: str) -> DataFrame:
    """Rows, distinct indices and their range: all of N, N, 0, N - 1 when nothing was lost."""
    return stored.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(idx).alias("n_distinct"), F.min(idx).alias("min_idx"), F.max(idx).alias("max_idx"))


def exact_set(stored: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """(key, n_rows, problem): ``missing``, ``extra`` or ``replayed`` keys."""
    got = stored.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    both = expected.select(*key).distinct().withColumn("wanted", F.lit(True)).join(got, key, "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "extra").when(F.col("n") > 1, "replayed")
    return both.select(*key, F.coalesce("n", F.lit(0)).alias("n_rows"), problem.alias("problem")).where("problem is not null")


def series_cardinality(records: DataFrame) -> DataFrame:
    """(n_series, n_streams, n_id_tags): distinct tag sets, and values that look like container ids."""
    each = records.groupBy(series_key(F.col("tags")).alias("k")).agg(F.first("tags").alias("tags"))
    ids = F.exists(F.map_values("tags"), lambda v: v.rlike("^[0-9a-fA-F]{64}$"))
    return each.agg(F.count(F.lit(1)).alias("n_series"), F.countDistinct(F.element_at("tags", "stream")).alias("n_streams"), F.count_if(ids).alias("n_id_tags"))


def label_allowlist(records: DataFrame, required: list[str], forbidden: list[str]) -> DataFrame:
    """(key, n_records, verdict) of the tag keys that matter."""
    keys = records.select(F.explode(F.map_keys("tags")).alias("key")).where(F.col("key").isin(required + forbidden)).groupBy("key").agg(F.count(F.lit(1)).alias("n_records"))
    return keys.withColumn("verdict", F.when(F.col("key").isin(forbidden), "forbidden").otherwise("required"))


def window_check(records: DataFrame, ts: str, begin_ns: int, end_ns: int, channel: str) -> DataFrame:
    """Records inside a time window by channel."""
    return records.groupBy(channel).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(ts).between(begin_ns, end_ns)).alias("inside"))


def container_check(records: DataFrame, ts: str, begin_ns: int, end_ns: int, channel: str, text: str, marks: tuple[str, str], expected: dict[str, str]) -> DataFrame:
    """One row of what must hold for container records: all inside the window [begin, end), both channels
    there, each split message whole (as many records begin with one mark as hold both), and
    every record with the expected tags."""
    starts = F.contains(text, F.lit(marks[0]))
    wrong = F.lit(False)
    for k, v in expected.items():
        wrong = wrong | ~F.coalesce(F.element_at("tags", k) == v, F.lit(False))
    return records.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.coalesce((F.col(ts) >= begin_ns) & (F.col(ts) < end_ns), F.lit(False))).alias("outside"),
        (F.count_if(F.col(channel) == "stdout") > 0).alias("has_stdout"),
        (F.count_if(F.col(channel) == "stderr") > 0).alias("has_stderr"),
        F.count_if(starts).alias("n_starts"),
        F.count_if(starts & F.contains(text, F.lit(marks[1]))).alias("n_whole"),
        F.count_if(wrong).alias("n_wrong_tags"),
    )


def missing_columns(measurement: DataFrame, tags: list[str], fields: list[str]) -> list[str]:
    """Required columns that a measurement lacks."""
    return [c for c in [*tags, *fields] if c not in measurement.columns]


def measurement_schema(lines: DataFrame, required: dict[str, tuple[list[str], list[str]]], column: str = "lp", optional: set[str] = frozenset()) -> DataFrame:
    """(measurement, n_rows, missing) of what was written: required tags and fields that some row lacks, in
    order; a measurement without rows lacks them all."""
    from quarry.functions.lineproto import parse_line

    x = lines.select(F.explode(F.array(parse_line(F.col(column)))).alias("p")).select(F.col("p.table").alias("measurement"), F.map_keys("p.tags").alias("t"), F.map_keys("p.fields").alias("f"))
    wanted = [(m, "t", k) for m, (tags, _) in required.items() for k in tags] + [(m, "f", k) for m, (_, fields) in required.items() for k in fields if k not in optional]
    lack = [F.when(F.count_if(~F.array_contains(side, k)) > 0, k).alias(f"__{m}_{side}_{k}") for m, side, k in wanted]
    seen = x.groupBy("measurement").agg(F.count(F.lit(1)).alias("n_rows"), *lack)
    names = [(m, f"__{m}_{side}_{k}", k) for m, side, k in wanted]
    found = F.array_compact(F.array(*(F.when(F.col("measurement") == m, F.when(F.col("n_rows").isNull(), k).otherwise(F.col(c))) for m, c, k in names)))
    every = lines.sparkSession.createDataFrame([(m,) for m in required], "measurement string")
    return every.join(seen, "measurement", "left").select("measurement", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.array_join(found, ",").alias("missing"))


def latest(records: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last row of each group, by aggregation instead of a sort."""
    rest = [c for c in records.columns if c not in by]
    return records.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*by, "r.*")


def watermark_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.max("watermark_ns").alias("watermark_ns"), F.max("lateness_ns").alias("lateness_ns"), F.max("violations").alias("violations"))


def substring_counts(records: DataFrame, by: list[str], text: str, needles: dict[str, str]) -> DataFrame:
    return records.groupBy(*by).agg(*(F.count_if(F.contains(text, F.lit(n))).alias(name) for name, n in needles.items()))


def tag_cardinality(records: DataFrame, threshold: int) -> DataFrame:
    """Tags with more distinct values than the threshold: each would be a series of its own."""
    tags = records.select(F.explode("tags").alias("key", "value")).distinct()
    return tags.groupBy("key").agg(F.count(F.lit(1)).alias("n_values")).where(F.col("n_values") > threshold)


def tag_sketches(records: DataFrame, batch: str, threshold: int) -> DataFrame:
    """(batch, key, sketch) of the distinct values of each tag in each batch. Sketches of different batches and
    runs can be put together. Their size is such that up to the threshold they keep the values'
    hashes themselves, so counts there are exact but for colliding hashes."""
    size = min(21, max(10, (threshold * 4 // 3).bit_length() + 4))
    return records.select(batch, F.explode("tags").alias("key", "value")).groupBy(batch, "key").agg(F.hll_sketch_agg("value", F.lit(size)).alias("sketch"))


def cardinality_warnings(sketches: DataFrame, batch: str, threshold: int, first: int) -> DataFrame:
    """(key, batch, n_values): tags that have more values than the threshold within the first batches, the batch
    in which they passed it and how many values there were up to it."""
    early = sketches.where(F.col(batch) < first)
    so_far = early.select("key", "sketch", F.col(batch).alias("__b")).withColumn(batch, F.explode(F.sequence("__b", F.lit(first - 1).cast("long"))))
    n = so_far.groupBy("key", batch).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_values")).where(F.col("n_values") > threshold)
    return n.groupBy("key").agg(F.min_by("n_values", batch).alias("n_values"), F.min(batch).alias(batch)).select("key", batch, "n_values")


def loss_model(per_tick: DataFrame, slots: int) -> DataFrame:
    """(lines, expected_rows) when the lines of a tick fall at random on so many tag sets:
    slots * (1 - (1 - 1/slots)**n) of n lines remain."""
    return per_tick.agg(F.sum("n").alias("lines"), F.sum(slots * (1 - F.pow(F.lit(1 - 1 / slots), F.col("n")))).alias("expected_rows"))
