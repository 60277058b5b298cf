"""Mixing sources to target weights, in DataFrame expressions only.

Token mass is summed over cells (source, language, topic). Each value of a margin gets a
target: the budget in proportion to a power of its mass, but no more than its mass; what such
values cannot take goes to the others. Iterative proportional fitting then rakes the expected
tokens of the cells: each sweep scales them to the source, then to the language, then to the
topic targets, and holds each cell at its mass where it would exceed it, so that the next
scaling moves the open cells instead. A cell's probability is its expected tokens over its
mass, never above 1; a document is kept when its own uniform number, a hash of its id, falls
below the probability of its cell. ``residuals`` tells how far each margin stays from its target.

All rows of a document's cell share one probability, so nothing is ever gathered by
source, however large the source: only sums by cell are shuffled. A window holds the cells of
one value of a margin; totals of all cells are single numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import free_name, load, materialize, shared_dir

MARGINS = ("source", "lang", "topic")
#: Sweeps in one plan; between them the cells are written, so that plans stay small.
SWEEPS_AT_ONCE = 3
SPACE = r"[\x20\x09-\x0D]+"


def topic() -> Column:
    """A coarse topic by rule from the text alone; first rule that holds."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return (
        F.when(t.contains("Licensed under") | t.contains("All rights reserved"), "legal")
        .when(t.contains(" | "), "table")
        .when(t.contains("@") | t.contains(' = "'), "record")
        .when(t.contains("\n"), "article")
        .otherwise("note")
    )


def targets(cells: DataFrame, margin: str, power: float, share: float, rounds: int) -> DataFrame:
    """(margin, target): expected tokens of each value of a margin. They are in proportion to its
    mass to ``power`` (1 leaves a margin as it is, 0 makes it even) up to its mass, and sum to
    ``share`` of all mass. Each round gives what the values at their mass leave over to the rest."""
    mass = cells.groupBy(margin).agg(F.sum("mass").alias("m")).withColumn("raised", F.pow("m", F.lit(power)))
    total, raised = mass.agg(F.sum("m"), F.sum("raised")).first()
    factor = share * total / raised if raised else 0.0
    for _ in range(rounds):
        full = F.lit(factor) * F.col("raised") >= F.col("m")
        at_mass, rest = mass.agg(F.sum(F.when(full, F.col("m")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("raised")))).first()
        if rest:
            factor = max(factor, (share * total - at_mass) / rest)
    return mass.select(margin, F.least("m", F.lit(factor) * F.col("raised")).alias(f"{margin}_target"))


def rake(cells: DataFrame, sweeps: int) -> DataFrame:
    """``expected``, the tokens of each cell, after some sweeps, at most its mass. ``cells`` has the
    mass and, for each margin, the target of its value."""
    out = cells
    for _ in range(sweeps):
        for margin in MARGINS:
            scaled = F.col("expected") * F.col(f"{margin}_target") / F.sum("expected").over(Window.partitionBy(margin))
            out = out.withColumn("expected", F.least("mass", scaled))
    return out


def fit(rows: DataFrame, powers: dict[str, float], share: float, sweeps: int, rounds: int) -> DataFrame:
    """Cells of (source, lang, topic, n_tokens) rows with mass, targets of their values and expected
    tokens; written out."""
    where = shared_dir(rows.sparkSession)
    cells = materialize(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").cast("double").alias("mass")), where, "cells")
    out = cells
    for margin in MARGINS:
        out = out.join(targets(cells, margin, powers[margin], share, rounds), margin)
    out = out.withColumn("expected", F.lit(share) * F.col("mass"))
    for turn in range(0, sweeps, SWEEPS_AT_ONCE):
        out = materialize(rake(out, min(SWEEPS_AT_ONCE, sweeps - turn)), where, f"fitted-{turn}")
    return out


def residuals(fitted: DataFrame) -> DataFrame:
    """(margin, value, target, expected) of a fit: what each value was to get and gets."""
    out = None
    for margin in MARGINS:
        part = fitted.groupBy(F.col(margin).alias("value")).agg(F.first(f"{margin}_target").alias("target"), F.sum("expected").alias("expected")).select(F.lit(margin).alias("margin"), "value", "target", "expected")
        out = part if out is None else out.unionByName(part)
    return out


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the id: the first 13 hex digits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.9}


def mass_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens) of every row, as ``mix`` understands them."""
    words = F.size(F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), SPACE), ""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        topic().alias("topic"),
        F.greatest(words, F.lit(1)).cast("long").alias("n_tokens"),
    )


def mix(docs: DataFrame, powers: dict[str, float] | None = None, share: float = 0.7, sweeps: int = 12, rounds: int = 6, seed: int = 17) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, prob, kept) for every row of ``docs``.

    Tokens are words; a document without words counts as one token. Null sources and
    languages are values of their own, ``""``. A null id has no uniform number of its own and
    takes that of the empty string. Rows with equal ids share their number. An empty table
    gives no row.
    """
    rows = materialize(mass_rows(docs), shared_dir(docs.sparkSession), "rows")
    fitted = fit(rows, POWERS | (powers or {}), share, sweeps, rounds).select(*MARGINS, (F.col("expected") / F.col("mass")).alias("prob"))
    out = rows.join(fitted, list(MARGINS))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("prob", 9).alias("prob"), (uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed) < F.col("prob")).alias("kept"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir))


def sql(powers: dict[str, float] | None = None, share: float = 0.7, sweeps: int = 12, rounds: int = 6, seed: int = 17) -> str:
    """The same in SQL, one CTE for each scaling."""
    powers = POWERS | (powers or {})
    ctes = [
        """d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
            CASE WHEN contains(t, 'Licensed under') OR contains(t, 'All rights reserved') THEN 'legal' WHEN contains(t, ' | ') THEN 'table'
                 WHEN contains(t, '@') OR contains(t, ' = "') THEN 'record' WHEN contains(t, chr(10)) THEN 'article' ELSE 'note' END AS topic,
            CAST(greatest(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')), 1) AS BIGINT) AS n_tokens
          FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents))""",
        "c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS mass FROM d GROUP BY ALL)",
    ]
    for m in MARGINS:
        ctes.append(f"t_{m}0 AS (SELECT *, {share} * sum(m) OVER () / sum(raised) OVER () AS f FROM (SELECT {m}, sum(mass) AS m, pow(sum(mass), {powers[m]}) AS raised FROM c GROUP BY {m}))")
        for i in range(rounds):
            ctes.append(
                f"""t_{m}{i + 1} AS (SELECT {m}, m, raised, CASE WHEN rest > 0 THEN greatest(f, ({share} * total - at_mass) / rest) ELSE f END AS f
            FROM (SELECT *, sum(m) OVER () AS total, sum(CASE WHEN f * raised >= m THEN m ELSE 0 END) OVER () AS at_mass, sum(CASE WHEN f * raised >= m THEN 0 ELSE raised END) OVER () AS rest FROM t_{m}{i}))"""
            )
    joined = " ".join(f"JOIN (SELECT {m}, least(m, f * raised) AS {m}_target FROM t_{m}{rounds}) USING ({m})" for m in MARGINS)
    ctes.append(f"f0 AS (SELECT *, {share} * mass AS expected FROM c {joined})")
    n = 0
    for _ in range(sweeps):
        for m in MARGINS:
            n += 1
            ctes.append(f"f{n} AS (SELECT * REPLACE (least(mass, expected * {m}_target / sum(expected) OVER (PARTITION BY {m})) AS expected) FROM f{n - 1})")
    return (
        "WITH "
        + ",\n".join(ctes)
        + f"""
SELECT doc_id, source, lang, topic, n_tokens, round(prob, 9) AS prob,
       CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / {float(16**13)!r} < prob AS kept
FROM d JOIN (SELECT source, lang, topic, expected / mass AS prob FROM f{n}) USING (source, lang, topic)"""
    )


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the sample keeps, with their columns as they are. Null, empty, repeated
    and very long rows are as in ``mix``."""
    mark = free_name(docs, "kept_id")
    probs = mix(docs).where("kept").select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(probs, docs["doc_id"].cast("long").eqNullSafe(F.col(mark)), "left_semi").select(*docs.columns)
