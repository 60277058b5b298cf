"""Personal data: candidate spans, boosted trees, calibrated redaction; DataFrame expressions only.

Base spans come from the fixed formats below, checked after matching. High-recall
generators propose further spans that may overlap. Each candidate is described by binary
format and context features, so a corpus has at most 2**len(FEATURES) different
descriptions, whatever its size. Candidates are counted by description over all documents;
gradient boosting with depth-two trees is fitted on these counts, against weak labels:
spans that equal a checked base span, or values that an assignment names as secret, are
positive. A threshold is calibrated on the documents of a held-out fold; candidates above
it are added where no base span lies.

Positions are in code points. They come from the gaps between matches: the text is split
at the matches of a pattern, and the lengths of gaps and matches are summed by a window
over the matches of a document, so the work is linear in the text.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import fold, free_name, load, materialize, shared_dir

#: Kinds in the order of the result. The forms below find the same leftmost matches as the
#: plain ones (in the comments), but never start inside a run that cannot match, never
#: backtrack over a repeated group, and so stay linear in long runs.
BASE: dict[str, str] = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    # [0-9]([\x20-]?[0-9])+ of 13 digits or more
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS: dict[str, str] = {
    "number": r"(?<![0-9A-Za-z])\+?[0-9]++(?:[\x20().-]{1,3}+[0-9]++)*+",
    "mixed": r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*+[0-9])[A-Za-z0-9_/+=-]{12,}+",
    "address": r"(?<![^\s@])[^\s@]++@[^\s@]++",
}
#: A text without a match of the hint has none of the pattern.
HINTS = {"email": "@", "address": "@", "phone": "+"}
CONTEXT = 24
OTHER = "other"
ORDER = {kind: i for i, kind in enumerate([*BASE, OTHER])}
SECRET = r"(?i)(?:token|key|secret|passw(?:or)?d|credential)[\x22']?\s*[=:]\s*[\x22']?$"

FEATURES = ["at", "plus", "digits", "many_digits", "long", "letters", "upper", "hex", "dots", "separators", "assigned", "quoted"]


def features() -> dict[str, Column]:
    """Binary features of a candidate from its text ``hit`` and the CONTEXT characters before it."""
    return {
        "at": F.col("hit").contains("@"),
        "plus": F.col("hit").startswith("+"),
        "digits": F.length(F.regexp_replace("hit", "[^0-9]", "")) * 2 >= F.length("hit"),
        "many_digits": F.length(F.regexp_replace("hit", "[^0-9]", "")) >= 9,
        "long": F.length("hit") >= 24,
        "letters": F.col("hit").rlike("[A-Za-z]"),
        "upper": F.col("hit").rlike("[A-Z]"),
        "hex": F.col("hit").rlike("^[0-9a-f]+$"),
        "dots": F.length(F.regexp_replace("hit", r"[^.]", "")) >= 3,
        "separators": F.col("hit").rlike(r"[\x20()-]"),
        "assigned": F.col("before").rlike(r"[=:]\s*[\x22']?$"),
        "quoted": F.col("before").rlike(r"[\x22']$"),
    }


def _found(text: Column, kind: str, pattern: str) -> Column:
    """Gap before each match of a pattern, its length and text, and what stands before it."""
    p = F.lit(pattern)
    pieces, hits = F.split(text, p, -1), F.regexp_extract_all(text, p, F.lit(0))
    rows = F.transform(
        F.arrays_zip(pieces.alias("gap"), hits.alias("hit")),
        lambda z: F.struct(F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("length"), z["hit"].alias("hit"), F.right(z["gap"], F.lit(CONTEXT)).alias("before")),
    )
    rows = F.filter(rows, lambda z: z["hit"].isNotNull())
    hint = text.contains(HINTS[kind]) if kind in HINTS else text.rlike("[0-9]")
    return F.when(hint, rows)


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + doubled(i)) % 10 == 0


def _valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", hit.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
        .when(kind == "card", F.length(digits).between(13, 19) & F.coalesce(luhn(F.when(F.length(digits).between(13, 19), digits)), F.lit(False)))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .otherwise(False)
    )


def candidates(docs: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Table of all rows (row, key), and table of the matches of all patterns with positions:
    (row, held_out, kind, start, end, hit, before, base). Texts are read once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    patterns = BASE | GENERATORS
    x = docs.select(*key, text.alias("__t")).withColumn("__row", F.monotonically_increasing_id())
    x = x.select("__row", *key, *(_found(F.col("__t"), k, p).alias(k) for k, p in patterns.items()))
    x = materialize(x, shared_dir(docs.sparkSession), "matches")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("found")) for k in patterns))
    some = F.lit(False)
    for k in patterns:
        some = some | (F.size(k) > 0)
    each = x.where(some).select("__row", fold(F.col("doc_id"), 5).alias("fold"), F.explode(kinds).alias("k"))
    each = each.select("__row", "fold", F.col("k.kind").alias("kind"), F.posexplode("k.found").alias("i", "m"))
    upto = Window.partitionBy("__row", "kind").orderBy("i")
    end = F.sum(F.col("m.gap") + F.col("m.length")).over(upto).cast("long")
    spans = each.select("__row", (F.col("fold") == 0).alias("held_out"), "kind", (end - F.col("m.length")).alias("start"), end.alias("end"), F.col("m.hit").alias("hit"), F.col("m.before").alias("before"))
    spans = spans.withColumn("base", _valid(F.col("kind"), F.col("hit"))).where(F.col("base") | F.col("kind").isin(*GENERATORS))
    return x.select("__row", *key), spans


def described(spans: DataFrame) -> DataFrame:
    """Candidates with their cell (the features as bits) and weak label."""
    cell = F.lit(0)
    for i, feature in enumerate(features().values()):
        cell = cell + F.when(feature, 1 << i).otherwise(0)
    same = F.max(F.col("base").cast("int")).over(Window.partitionBy("__row", "start", "end"))
    secret = F.col("before").rlike(SECRET) & (F.length("hit") >= 12)
    return spans.withColumn("cell", cell).withColumn("label", F.greatest(same, secret.cast("int")))


def boost(cells: list[tuple[int, int, int]], rounds: int, rate: float) -> list[tuple[int, int, list[float]]]:
    """Gradient boosting for log loss on counted descriptions (cell, positives, all). Each tree asks
    two features and has four leaves, found by the gain of the gradient sums."""
    value = {c: 0.0 for c, _, _ in cells}
    trees = []
    for _ in range(rounds):
        best = None
        grads = []
        for c, pos, n in cells:
            p = 1 / (1 + math.exp(-value[c]))
            grads.append((c, pos - n * p, n * p * (1 - p)))
        for a, b in combinations(range(len(FEATURES)), 2):
            g, h = [0.0] * 4, [0.0] * 4
            for c, gc, hc in grads:
                leaf = (c >> a & 1) * 2 + (c >> b & 1)
                g[leaf] += gc
                h[leaf] += hc
            gain = sum(x * x / (y + 1.0) for x, y in zip(g, h, strict=True))
            if best is None or gain > best[0] + 1e-9:
                best = (gain, a, b, [rate * x / (y + 1.0) for x, y in zip(g, h, strict=True)])
        if best is None or best[0] < 1e-6:
            break
        trees.append(best[1:])
        for c in value:
            value[c] += best[3][(c >> best[1] & 1) * 2 + (c >> best[2] & 1)]
    return trees


def score_of(trees, cell: int) -> float:
    return sum(leaves[(cell >> a & 1) * 2 + (cell >> b & 1)] for a, b, leaves in trees)


def score_column(trees) -> Column:
    names = list(features().values())
    out = F.lit(0.0)
    for a, b, leaves in trees:
        out = out + F.when(names[a], F.when(names[b], leaves[3]).otherwise(leaves[2])).otherwise(F.when(names[b], leaves[1]).otherwise(leaves[0]))
    return out


def threshold(trees, held: list[tuple[int, int, int]], precision: float, least: int) -> float | None:
    """Lowest score above which the held-out candidates reach the precision; None if none does."""
    scored = sorted(((score_of(trees, c), pos, n) for c, pos, n in held), reverse=True)
    cut, good, total = None, 0, 0
    for i, (s, pos, n) in enumerate(scored):
        good, total = good + pos, total + n
        if i + 1 < len(scored) and scored[i + 1][0] == s:
            continue
        if total >= least and good >= precision * total:
            cut = s
    return cut


def detect(docs: DataFrame, key: list[str], rounds: int = 24, rate: float = 0.4, precision: float = 0.995, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """All rows (__row, key) and their spans (__row, kind, start, end, score): base spans, and
    candidates that the model adds under the kind ``other``.

    Base spans stay, all of them. Candidates are taken by score, then the longest, then the
    first; one goes when it overlaps a base span or a candidate taken before it. With too few
    held-out candidates nothing is added."""
    rows, spans = candidates(docs, key)
    spans = materialize(described(spans), shared_dir(docs.sparkSession), "spans")
    proposed = spans.where(F.col("kind").isin(*GENERATORS))
    counts = proposed.groupBy("held_out", "cell").agg(F.sum("label").cast("long").alias("pos"), F.count(F.lit(1)).alias("n")).collect()
    split = {h: sorted((r["cell"], r["pos"], r["n"]) for r in counts if r["held_out"] == h) for h in (False, True)}
    trees = boost(split[False], rounds, rate)
    cut = threshold(trees, split[True], precision, least)
    chosen = spans.where("base").select("__row", "kind", "start", "end", F.lit(None).cast("double").alias("score"))
    if cut is not None:
        added = proposed.withColumn("score", score_column(trees)).where(F.col("score") >= cut - 1e-9)
        chosen = chosen.unionByName(added.select("__row", F.lit(OTHER).alias("kind"), "start", "end", "score"))
    return rows, without_overlaps(chosen)


def without_overlaps(chosen: DataFrame) -> DataFrame:
    """(__row, kind, start, end, score): all base spans, and of the others those that a greedy choice
    by score takes. The choice runs within islands, chains of spans that overlap."""
    by_start = Window.partitionBy("__row").orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") >= F.coalesce(F.col("reach"), F.lit(0)), 1).otherwise(0)).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    one = F.struct((F.col("kind") == OTHER).alias("added"), (-F.col("score")).alias("low"), (F.col("start") - F.col("end")).alias("short"), "start", "end", "kind", "score")
    islands = chosen.withColumn("reach", reach).withColumn("island", island).groupBy("__row", "island").agg(F.sort_array(F.collect_list(one)).alias("s"))
    none = F.filter("s", lambda s: F.lit(False))
    apart = lambda s: lambda t: (t["end"] <= s["start"]) | (t["start"] >= s["end"])
    taken = F.aggregate("s", none, lambda a, s: F.when(~s["added"] | F.forall(a, apart(s)), F.concat(a, F.array(s))).otherwise(a))
    return islands.select("__row", F.explode(taken).alias("t")).select("__row", "t.kind", "t.start", "t.end", "t.score")


def is_kind(kind: str):
    return lambda k: k == kind


def summaries(docs: DataFrame) -> DataFrame:
    """For every row: spans by kind as text, counts of the base kinds, and the SHA-256 of the
    base spans. A null or empty text has none; rows with null or repeated ids each have their own;
    very long texts are read whole. An empty table gives no row."""
    rows, spans = detect(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    order = F.create_map(*(F.lit(x) for pair in ORDER.items() for x in pair))
    listed = spans.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct(order[F.col("kind")].alias("o"), "start", "end", "kind"))).alias("s"))
    joined = rows.join(listed, "__row", "left")
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    none = F.coalesce(F.col("s"), F.filter("s", lambda s: F.lit(False)), F.array().cast("array<struct<o:int,start:bigint,end:bigint,kind:string>>"))
    joined = joined.withColumn("s", none)
    base = F.filter("s", lambda s: s["kind"] != OTHER)
    return joined.select(
        "doc_id",
        *(F.size(F.filter(F.transform("s", lambda s: s["kind"]), is_kind(k))).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("s", text), ",").alias("spans"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(load(spark, sf_dir))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans are replaced
    together under the kind that starts first. Other columns, and texts without spans, stay.
    Null, empty, repeated and very long texts are as in ``summaries``."""
    columns = docs.columns
    own, text_hash, found_id, found_hash, cuts = (free_name(docs, x) for x in ("row_id", "text_hash", "found_id", "found_hash", "cuts"))
    keyed = docs.withColumns({own: F.col("doc_id").cast("long"), text_hash: F.xxhash64("text")})
    found, spans = detect(keyed.select(F.col(own).alias("doc_id"), F.col(text_hash).alias("hash"), "text"), ["doc_id", "hash"])
    listed = spans.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))
    by_text = found.join(listed, "__row").groupBy("doc_id", "hash").agg(F.min("cuts").alias(cuts)).select(F.col("doc_id").alias(found_id), F.col("hash").alias(found_hash), cuts)
    joined = keyed.join(by_text, F.col(own).eqNullSafe(F.col(found_id)) & (F.col(text_hash) == F.col(found_hash)), "left")
    done = F.aggregate(
        cuts,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.when(s["start"] >= a["at"], F.struct(F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text"))),
    )
    return joined.withColumn("text", F.when(F.col(cuts).isNull(), F.col("text")).otherwise(done)).select(*columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the personal data in their texts redacted and n_chars brought up to date."""
    out = redact(docs)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind)).select(*docs.columns)
    return out
