"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Every document gets its measures within its own row. A rule rejects a document when a
measure is above the cutoff of its stratum (its language). Cutoffs are selected on the
labelled good documents of the stratum, from loose to strict along a fixed grid: a cutoff
is taken while the exact binomial test rejects, at level delta, that its rate of false
rejections is above alpha. Along the grid this is fixed-sequence testing; over rules and
strata delta is divided (Bonferroni), and alpha is divided over the rules. So with
probability 1 - delta the rules together reject at most the share alpha of the good
documents in every stratum. A stratum with too few labels gets no cutoff.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import load, materialize, shared_dir

SPACE = r"[\x20\x09-\x0D]+"

#: Measures and the grid of cutoffs of each, from loose to strict.
RULES: dict[str, list[float]] = {
    "symbol_share": [1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeat_share": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075],
    "word_length": [40.0, 30.0, 25.0, 20.0, 17.5, 15.0, 12.5, 11.0, 10.0],
}


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Adds the measures to the columns ``keep`` of every row. A null text has no words.

    Repeated 3-word windows are found by their 64-bit hashes: positions are sorted by hash,
    and only in documents that hold an equal pair."""
    text = F.coalesce(F.col("text"), F.lit(""))
    x = docs.select(*keep, text.alias("__t"))
    x = x.withColumn("__w", F.array_remove(F.split("__t", SPACE), ""))
    lines = F.filter(F.split("__t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    x = x.select(
        *keep,
        "__w",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("__l"),
    )
    windows = F.transform("__w", lambda w, i: F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2)))
    x = x.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("__w") >= 3, F.slice(windows, F.lit(1), F.size("__w") - 2)).alias("__h"),
    )
    x = x.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.transform("__s", lambda s, k: F.when((s["h"] == F.get("__s", k - 1)["h"]) | (s["h"] == F.get("__s", k + 1)["h"]), s["i"]))
    x = x.drop("__h").withColumn("__p", F.sort_array(F.filter(twice, lambda p: p.isNotNull())))
    covered = F.aggregate(F.transform("__p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("__p", k + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, b: a + b)
    x = x.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__s", "__p")
    return x.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "symbol_share": _share("n_symbols", "word_chars"),
            "dup_line_share": _share("n_dup_lines", "n_lines"),
            "repeat_share": _share("n_repeat_words", "n_words"),
            "word_length": _share("word_chars", "n_words"),
        }
    )


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """log P(X <= k) of a binomial X(n, p), summed exactly term by term. Above the mean the
    value does not matter for the test and is 0."""
    odds = math.log(p / (1 - p))
    first = n * math.log1p(-p)
    step = lambda acc, j: F.struct(
        (acc["term"] + F.log((n - j + 1) / j) + odds).alias("term"),
        acc["all"].alias("all"),
    )
    add = lambda acc: F.struct(
        acc["term"].alias("term"),
        (F.greatest(acc["all"], acc["term"]) + F.log1p(F.exp(-F.abs(acc["all"] - acc["term"])))).alias("all"),
    )
    start = F.struct(first.alias("term"), first.alias("all"))
    total = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")), start, lambda acc, j: add(step(acc, j)))["all"]
    return F.when(k.cast("double") <= n * p, total).otherwise(0.0)


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """(lang, one cutoff for each rule): null where no cutoff is safe. ``measured`` holds doc_id,
    lang and the measures; labelled good documents that pass the base rules are the holdout.
    A document with several labels is good if all of them say so."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = measured.where("not base_failed").join(good, "doc_id", "left_semi")
    counts = held.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.array(*(F.count_if(F.col(rule) > c) for c in grid)).alias(rule) for rule, grid in RULES.items()),
    )
    strata = counts.count()
    level = math.log(delta / (len(RULES) * max(1, strata)))
    out = counts
    for rule, grid in RULES.items():
        passed = F.transform(rule, lambda k: log_binomial_tail(k, F.col("n"), alpha / len(RULES)) <= level)
        first_no = F.array_position(F.concat(passed, F.array(F.lit(False))), F.lit(False)).cast("int")
        out = out.withColumn(f"{rule}_cut", F.when(first_no > 1, F.get(F.array(*map(F.lit, grid)), first_no - 2)))
    return out.select("lang", *(f"{rule}_cut" for rule in RULES))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Measures, base_failed and kept for every row of ``docs``. A null lang is a stratum of its
    own. An empty table gives no rows; without labels only the base rules reject."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    measured = materialize(features(kept, ["doc_id", "lang"]), shared_dir(docs.sparkSession), "measures")
    cuts = cutoffs(measured, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), alpha, delta)
    broken = F.lit(False)
    for rule in RULES:
        broken = broken | F.coalesce(F.col(rule) > F.col(f"{rule}_cut"), F.lit(False))
    return measured.join(cuts, "lang", "left").withColumn("kept", ~F.col("base_failed") & ~broken)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir), load(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def sql(alpha: float = 0.02, delta: float = 0.05) -> str:
    """The query in DuckDB's SQL: windows found by their words, binomial tails summed from their definition."""
    words = r"[\x20\x09-\x0D]+"
    cases, cuts, broken = [], [], []
    share = {"symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
    p = alpha / len(RULES)
    for rule, grid in RULES.items():
        a, b = share[rule]
        cases.append(f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END AS {rule}")
        values = ", ".join(f"({i}, CAST({c} AS DOUBLE))" for i, c in enumerate(grid))
        cuts.append(f"""{rule}_c AS (SELECT lang, i, cut, count(*) AS n, count(*) FILTER ({rule} > cut) AS k FROM held, (VALUES {values}) v(i, cut) GROUP BY lang, i, cut),
{rule}_t AS (SELECT lang, i, cut, k <= n * CAST({p} AS DOUBLE) AND (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(CAST({p} AS DOUBLE)) + (n - j) * ln(1 - CAST({p} AS DOUBLE)))) FROM range(k + 1) r(j)) <= CAST({delta} AS DOUBLE) / ({len(RULES)} * (SELECT greatest(count(DISTINCT lang), 1) FROM held)) AS passed FROM {rule}_c),
{rule}_k AS (SELECT lang, min(cut) AS cut FROM {rule}_t t WHERE NOT EXISTS (SELECT 1 FROM {rule}_t u WHERE u.lang = t.lang AND u.i <= t.i AND NOT u.passed) GROUP BY lang)""")
        broken.append(f"coalesce({rule} > {rule}_k.cut, false)")
    joins = " ".join(f"LEFT JOIN {rule}_k ON {rule}_k.lang = m.lang" for rule in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{words}'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
q AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
c AS (SELECT r, sum(least(3, coalesce(s, 3))) AS n FROM (SELECT r, lead(i) OVER (PARTITION BY r ORDER BY i) - i AS s FROM q) GROUP BY r),
f AS (SELECT w.r, doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
      len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c ON c.r = w.r),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(cases)} FROM f),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT * FROM m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
{", ".join(cuts)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(broken)}) AS kept FROM m {joins}
"""
