"""Where every line went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ["shipped", "quarantined", "filter", "sample"]


def counters(outcomes: DataFrame, source: str = "source") -> DataFrame:
    """(source, lines_read, lines_shipped, lines_quarantined, dropped_filter, dropped_sample,
    at_risk) for each source, and for all together where source is null. ``outcomes`` has one
    row for each line with its stage; ``at_risk`` is 0 when every line is accounted for."""
    by = outcomes.rollup(source).agg(F.count(F.lit(1)).alias("lines_read"), *(F.count_if(F.col("stage") == s).alias(s) for s in STAGES))
    return by.select(
        source,
        "lines_read",
        F.col("shipped").alias("lines_shipped"),
        F.col("quarantined").alias("lines_quarantined"),
        F.col("filter").alias("dropped_filter"),
        F.col("sample").alias("dropped_sample"),
        (F.col("lines_read") - sum((F.col(s) for s in STAGES[1:]), F.col(STAGES[0]))).alias("at_risk"),
    )


def quarantine_by_reason(rejected: DataFrame, source: str = "source") -> DataFrame:
    """Rejected lines by the kind of their reason, the text before the first colon."""
    return rejected.groupBy(source, F.split_part("reason", F.lit(":"), F.lit(1)).alias("kind")).agg(F.count(F.lit(1)).alias("lines"))


#: Counters of a batch or a run, in their order.
TALLY = ["lines_read", "lines_shipped", "lines_quarantined", "dropped_filter", "dropped_sample", "files_read", "multiline_truncated", "pk_disambiguated", "out_of_window", "watermark_violations", "otlp_records_received", "otlp_records_rejected"]


def tally(settled: DataFrame) -> DataFrame:
    """The counters of each source, in one pass over the settled rows. ``settled`` has source and stage,
    and tells where it knows: path, truncated, seq, out_of_window, violation, parser."""
    have = set(settled.columns)
    stage = F.col("stage")
    otlp = F.col("parser") == "otlp"
    counts = {
        "lines_read": F.count(F.lit(1)),
        "lines_shipped": F.count_if(stage == "shipped"),
        "lines_quarantined": F.count_if(stage == "quarantined"),
        "dropped_filter": F.count_if(stage == "filter"),
        "dropped_sample": F.count_if(stage == "sample"),
        "files_read": F.countDistinct("path") if "path" in have else F.countDistinct("state_key"),
        "multiline_truncated": F.count_if("truncated") if "truncated" in have else None,
        "pk_disambiguated": F.count_if((stage == "shipped") & (F.col("seq") > 0)) if "seq" in have else None,
        "out_of_window": F.count_if("out_of_window") if "out_of_window" in have else None,
        "watermark_violations": F.count_if("violation") if "violation" in have else None,
        "otlp_records_received": F.count_if(otlp) if "parser" in have else None,
        "otlp_records_rejected": F.count_if(otlp & (stage == "quarantined")) if "parser" in have else None,
    }
    return settled.groupBy("source").agg(*((F.lit(0).cast("long") if c is None else c).alias(k) for k, c in counts.items()))


def totals(tallies: DataFrame) -> DataFrame:
    """Counters by source, and for all together where source is null, with ``at_risk``: lines read that
    are accounted for nowhere, 0 in a batch."""
    by = tallies.rollup("source").agg(*(F.sum(c).alias(c) for c in TALLY))
    return by.withColumn("at_risk", F.col("lines_read") - F.col("lines_shipped") - F.col("lines_quarantined") - F.col("dropped_filter") - F.col("dropped_sample"))


def quarantined_by_kind(settled: DataFrame) -> DataFrame:
    """(source, kind, lines) of the quarantined."""
    return quarantine_by_reason(settled.where("stage = 'quarantined'"))
