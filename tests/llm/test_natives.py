"""Mixing, personal data, quality rules against plain versions."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing, pii, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FORMS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def plain_spans(text):
    out = []
    for kind, form in FORMS:
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=digits: 13 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def odd_texts(n, seed=1):
    r = random.Random(seed)
    parts = ["1", "4", "0", "255", "256", " ", "-", ".", "+", "(", ")", "@", "a", "b_", "%", "é", "日", "\n", "x.com", "4111111111111111", "+1 (988) 555-2485", "1.2.3.4", "a@b.co", "😀"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_base_spans_equal_the_plain_forms(spark):
    texts = [*odd_texts(1500), None, "", "1" * 5000, "a@" + "b." * 3000 + "c", "(+" * 3000, "a" * 100_000, "+" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.summaries(df).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        spans = plain_spans(text or "")
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        count = collections.Counter(k for k, _, _ in spans)
        assert got[i].base_sha256 == hashlib.sha256(shown.encode()).hexdigest(), (text, got[i])
        assert [got[i][f"n_{k}"] for k, _ in FORMS] == [count[k] for k, _ in FORMS]


def test_model_adds_named_secrets_and_leaves_clean_texts(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    rows = []
    for i in range(600):
        text = " ".join(word() for _ in range(30))
        if i % 3 == 0:
            text += f' token = "{hashlib.sha1(str(i).encode()).hexdigest()}" ' + word()
        if i % 3 == 1:
            text += f" version 2.0 of 2024-01-{i % 28 + 1:02d} and item12 "
        rows.append((i, text))
    got = {x.doc_id: x.spans for x in pii.summaries(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        if i % 3 == 0:
            at = text.index('"') + 1
            assert got[i] == f"other:{at}:{at + 40}"
        else:
            assert got[i] == ""


def test_redaction(spark):
    rows = [(1, "é a@b.co and 1.2.3.4!", "en", "s", 21), (2, None, None, None, None), (3, "clean", "en", "s", 5), (3, "clean", "en", "s", 5), (None, "x@y.zz", "en", "s", 6)]
    df = spark.createDataFrame(rows, DOCS).withColumn("__row", F.lit(1)).withColumnRenamed("__row", "score")
    got = pii.pii_stage(spark, df, "").collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.n_chars) for r in got))) == sorted(map(str, [(1, "é [email] and [ip]!", 19), (2, None, None), (3, "clean", 5), (3, "clean", 5), (None, "[email]", 7)]))


def plain_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["a ", "b ", "c ", "é\n", "# ", "\t", "\n", "日x ", "\x1c", "\xa0"]) for _ in range(r.randint(0, 120))) for _ in range(500)] + [None, "", " \n ", "a b c " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.judge(df, labels).collect()}
    for i, text in enumerate(texts):
        want = plain_features(text or "")
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got[i].base_failed == failed and got[i].kept == (not failed)


def test_cutoffs_keep_the_guarantee(spark):
    prose = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    noisy = lambda i: " ".join(f"w{i}x{j}###&&" for j in range(60))
    good = [(i, prose(i), "en", 1) for i in range(3000)] + [(5000 + i, noisy(i), "en", 0) for i in range(50)] + [(9000 + i, noisy(i), "few", 1) for i in range(5)]
    df = spark.createDataFrame([g[:3] for g in good], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(g[0], g[3]) for g in good] + [(None, 1), (1, None)], "doc_id long, quality int")
    got = {x.doc_id: x.kept for x in quality.judge(df, labels).collect()}
    assert all(got[i] for i in range(3000)) and not any(got[5000 + i] for i in range(50))
    assert all(got[9000 + i] for i in range(5))  # too few labels for a cutoff


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.1), (3, 1000, 0.005), (2, 50, 0.2), (40, 20_000, 0.005), (9, 10, 0.1)])
def test_binomial_tail(spark, k, n, p):
    got = spark.range(1).select(quality.log_binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
    want = math.log(sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))) if k <= n * p else 0.0
    assert math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-12)


def test_mixing_rakes_to_the_targets(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.randint(1, 50) + ("\nx" if r.random() < 0.5 else ""), r.choice("ab"), "big" if r.random() < 0.7 else r.choice("cde"), 0) for i in range(4000)]
    df = spark.createDataFrame(rows, DOCS)
    x = mixing.mix(df, share=0.3, sweeps=12)
    kept = x.agg(F.sum(F.col("prob") * F.col("n_tokens")) / F.sum("n_tokens")).first()[0]
    assert abs(kept - 0.3) < 1e-3
    by = {c.source: c.m for c in x.groupBy("source").agg(F.sum(F.col("prob") * F.col("n_tokens")).alias("m")).collect()}
    have = {c.source: c.m for c in x.groupBy("source").agg(F.sum("n_tokens").alias("m")).collect()}
    for s in have:
        want = math.sqrt(have[s]) / sum(map(math.sqrt, have.values()))
        assert abs(by[s] / sum(by.values()) - want) < 0.01
    drawn = x.where("kept").agg(F.sum("n_tokens")).first()[0] / sum(have.values())
    assert abs(drawn - 0.3) < 0.03


def test_mixing_meets_the_targets_of_the_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fitted = mixing.fit(mixing.mass_rows(docs), mixing.POWERS, 0.7, 12, 6)
    assert fitted.where("expected > mass * (1 + 1e-9)").count() == 0
    left = mixing.residuals(fitted).collect()
    total = sum(r.target for r in left if r.margin == "lang")
    assert {r.margin for r in left} == set(mixing.MARGINS)
    assert abs(total - 0.7 * fitted.agg(F.sum("mass")).first()[0]) < 1e-6 * total
    assert max(abs(r.expected - r.target) for r in left) < 0.01 * total


def test_candidates_are_taken_greedily(spark):
    r = random.Random(11)
    rows = []
    for row in range(40):
        for _ in range(r.randint(1, 12)):
            a, n, base = r.randint(0, 40), r.randint(1, 12), r.random() < 0.2
            rows.append((row, "ip" if base else pii.OTHER, a, a + n, None if base else r.choice([0.5, 1.0, 1.5])))
    rows = list({x[:4]: x for x in rows}.values())
    want = set()
    for row in range(40):
        taken = [x for x in rows if x[0] == row and x[1] != pii.OTHER]
        for x in sorted((x for x in rows if x[0] == row and x[1] == pii.OTHER), key=lambda x: (-x[4], x[2] - x[3], x[2])):
            if all(x[3] <= y[2] or x[2] >= y[3] for y in taken):
                taken.append(x)
        want |= set(taken)
    got = pii.without_overlaps(spark.createDataFrame(rows, "__row long, kind string, start long, end long, score double"))
    assert {tuple(x) for x in got.select("__row", "kind", "start", "end", "score").collect()} == want


def test_pii_of_an_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "mail a@b.co", 7)], "doc_id long, text string, __id int").withColumn("row_id", F.lit(3))
    assert [tuple(x) for x in pii.redact(df).collect()] == [(1, "mail [email]", 7, 3)]
    assert pii.summaries(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0


def test_quality_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b", "en"), (1, "a b", None), (1, "a b", None)], "doc_id long, text string, lang string").withColumn("kept", F.lit(2))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.judge(df, labels).count() == 3 and quality.judge(df.limit(0), labels.limit(0)).count() == 0


def test_mixing_odd_rows(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("prob", F.lit(5))
    assert mixing.mix(df, share=1.0).where("kept").count() == 4
    assert mixing.mix(df.limit(0)).count() == 0
    assert set(mixing.mixing_stage(spark, df, "").columns) == set(df.columns)
