"""Top-k search, Jaccard join and the pipeline against plain versions."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import common, jaccard, queries, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, sf_dir).toPandas(), c.execute(queries.ORACLES[name]).df()
    a, b = (x[sorted(x.columns)].sort_values(sorted(x.columns)).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def plain_top(rows, every, k):
    vectors = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for i in sorted(vectors):
        if i % every == 0:
            scores = sorted(((-int((vectors[i][: len(v)] * v[: len(vectors[i])]).sum()), j) for j, v in vectors.items() if j != i))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)}
    return out


@pytest.mark.parametrize("size", [64, 7])
def test_top_k(spark, size):
    r = np.random.default_rng(size)
    rows = [(i, r.normal(size=20).tolist()) for i in range(300)] + [(400 + i, [0.5] * 20) for i in range(40)] + [(500, None), (501, [None] * 20), (502, [float("inf")] * 20), (503, []), (504, [1.0]), (600, [0.5] * 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = topk.top_k(df.union(df.limit(5)), every=20, k=6, dims_at_once=4, candidate_block=size, query_block=5)
    assert {tuple(x) for x in got.collect()} == plain_top(rows, 20, 6)
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [10, 10**8])
def test_bound_goes_from_block_to_block(scale):
    r = np.random.default_rng(scale)
    dims, k, cuts = 12, 5, [0, 4, 8, 12]
    blocks = [(np.arange(50 * b, 50 * b + 50), (r.normal(size=(dims, 50)) * scale * 10.0 ** (1 - b)).astype(np.int64)) for b in range(4)]
    w = (r.normal(size=dims) * scale).astype(np.int64)
    tail = topk._tails(w[:, None], cuts)[:, 0]
    best, rows, left = topk.Best(k), [], []
    best.turn_to(np.array([3]))
    for ids, m in blocks:
        found = topk.search(w, tail, 3, ids, m, topk._tails(m, cuts), cuts, k, best.bound(0))
        best.add(0, found[1])
        left.append(len(found[0]))
        rows += zip(*(x.tolist() for x in found), strict=True)
    every = [(i, int(w @ m[:, j])) for ids, m in blocks for j, i in enumerate(ids.tolist()) if i != 3]
    assert sorted(rows, key=lambda x: (-x[1], x[0]))[:k] == sorted(every, key=lambda x: (-x[1], x[0]))[:k]
    assert left[0] == k and left[-1] == 0  # the last block is too short to reach the bound of the first
    best.turn_to(np.array([4]))
    assert best.bound(0) == -1e300


def plain_components(rows, k, percent):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        n = min(k, len(words))
        sets[i] = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} if words else set()
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = sorted((root(a), root(b)))
                    comp[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def family(seed, n=220):
    r = random.Random(seed)
    bases = [[f"w{r.randint(0, 400)}" for _ in range(r.choice([1, 2, 3, 8, 40, 90]))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            words[r.randrange(len(words))] = f"e{r.randint(0, 10**6)}"
        rows.append((i * 3 % n + (i // n) * n, " ".join(words).upper() if i % 9 == 0 else "\n".join(words)))
    return list({i: t for i, t in rows}.items())


def test_jaccard_links(spark):
    rows = family(7, 120)
    links, members = jaccard.link_tables(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 80)
    sets = {}
    for i, text in rows:
        words = text.encode().lower().split()
        n = min(3, len(words))
        sets[i] = frozenset(tuple(words[j : j + n]) for j in range(len(words) - n + 1))
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    comps = plain_components(rows, 3, 80)
    want = {(i, first[s], sum(i in p for p in near), comps[i][1]) for i, s in sets.items()}
    assert {tuple(r) for r in members.collect()} == want
    got = [tuple(r) for r in links.collect()]
    between = {(min(p), max(p)) for a, b in near if sets[a] != sets[b] for p in [(first[sets[a]], first[sets[b]])]}
    assert set(got) == between and len(got) == len(between) > len({first[s] for s in sets.values()}) - len({c for _, c in comps.values()})


@pytest.mark.parametrize("k,percent,small,salt,rounds", [(3, 90, 4, 512, 2), (3, 90, 1, 3, 1), (5, 80, 2, 2, 1), (1, 70, 2, 512, 1)])
def test_jaccard_components(spark, monkeypatch, k, percent, small, salt, rounds):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "SALT", salt)
    monkeypatch.setattr(jaccard, "BLOCK", 5 * salt)
    rows = family(k + salt)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(df, k, percent, rounds).collect()}
    assert got == plain_components(rows, k, percent)


@pytest.mark.parametrize("size", [100, 20_000])
def test_jaccard_over_many_ranges_of_hashes(spark, monkeypatch, size):
    rows = family(11)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "_ranges", lambda texts: size * 50)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(df, 3, 90).collect()}
    assert got == plain_components(rows, 3, 90)


def test_jaccard_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "a b"), (3, "a b"), (4, "A  b"), (5, "a b c"), (6, " \n"), (7, "x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("comp", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(df).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (0, 6), 7: (1, 7)}
    assert jaccard.similar(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150)] + [(300, 300 + r.randint(1, 50)) for _ in range(30)]
    got = {x.id: x.comp for x in jaccard.components(spark.createDataFrame(edges, "a long, b long"), common.shared_dir(spark), "t").collect()}
    assert all(got[i] == 0 for i in range(61)) and got[150] == got[200] == 100 and all(c == 300 for i, c in got.items() if i >= 300)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now = docs.withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialize(stage(spark, now, sf_dir), common.shared_dir(spark), name)
        assert after.columns == now.columns and 0 < after.count() <= now.count()
        now = after
    kept = {r.doc_id for r in now.collect()}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} == kept and len(out) == len(kept)
    assert all(len(r.ids) == r.n_tokens for r in out)


def test_pipeline_odd_rows(spark):
    r = random.Random(1)
    prose = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    rows = [(i, prose(), "en" if i % 2 else "de", "s", 240) for i in range(40)] + [(50, None, "en", "s", 0), (51, "", None, None, None), (None, prose(), "en", "s", 1), (52, "12 34", "en", "s", 5)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, DOCS)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "")
    assert df.count() > 0
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0


def test_near_duplicates_leave_one(spark):
    words = [f"w{i}" for i in range(200)]
    near = [*words[:100], "edit", *words[101:]]
    rows = [(3, " ".join(words), "en", "s", 1), (1, " ".join(near), "en", "s", 1), (2, " ".join(words), "en", "s", 1), (9, "another text of its own", "en", "s", 1)]
    got = jaccard.jaccard_stage(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 9]
