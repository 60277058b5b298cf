"""Exact deduplication, hard negatives and whitening against plain versions on small tables."""

import hashlib
import os
import string
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import exactdedup, hardnegatives, whitening
from quarry.llm.common import materialize, shared_dir

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
RESULT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def plain_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        for n, i in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0))):
            out.append((i, keep, len(ids), n == len(ids) - 1, sha))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


TEXTS = [
    (1, "Same Text"), (2, "same text"), (9, "SAME TEXT"), (4, "same text "), (5, None), (6, ""), (None, "same text"), (None, None), (None, "alone"), (None, "Alone"),
    (7, "Ünder"), (8, "ünder"), (10, "x" * 3_000_000), (11, "X" * 3_000_000), (12, "x" * 2_999_999), (13, "twice"), (13, "twice"), (13, "other"), (14, "a\x00b"), (15, "A\x00B"),
]


def documents(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def got_groups(df):
    return ordered(tuple(r) for r in df.select(*RESULT).collect())


def test_copies_with_nulls_ties_repeated_rows_and_long_texts(spark):
    docs = documents(spark, TEXTS).withColumns({"digest": F.lit("x"), "kept": F.lit(1), "path": F.lit("y"), "sha": F.lit(0)})
    assert got_groups(exactdedup.deduplicate(docs)) == ordered(plain_groups(TEXTS))


def test_copies_of_no_documents(spark):
    out = exactdedup.deduplicate(documents(spark, []))
    assert out.columns[:5] == RESULT and out.count() == 0


@pytest.mark.parametrize("bits", [6, 26])
def test_texts_that_share_a_digest_are_parted_by_their_bytes(spark, bits):
    rows = [(i, f"Text {i % 40}" if i % 3 else f"text {i % 40}") for i in range(600)] + TEXTS
    out = exactdedup.deduplicate(documents(spark, rows), digest=lambda sha: F.unhex(F.substring(F.hex(sha), 1, 1)), sieve_bits=bits)
    assert got_groups(out) == ordered(plain_groups(rows))


def test_state_goes_on_over_batches_and_runs(spark):
    """Three runs over one folder, many batches each: the state never forgets a digest."""
    where, rows = shared_dir(spark), []
    for part in range(3):
        rows += [(part * 100 + i, f"t{i % 30}") for i in range(100)]
        fresh = documents(spark, rows[-100:], 4)
        located = exactdedup.located(fresh, f"{where}/part{part}")
        exactdedup.record(located, where, lambda sha: sha)
        assert exactdedup.absorb(spark, where, batch_bytes=1) >= 4
        state = {r["n"]: r["groups"] for r in exactdedup.state(spark, where).groupBy("n").agg(F.count("digest").alias("groups")).collect()}
        want = defaultdict(int)
        for n in [sum(1 for _, t in rows if t == f"t{k}") for k in range(30)]:
            want[n] += 1
        assert state == dict(want)
    assert exactdedup.absorb(spark, where) == 0
    best = {r["best"]["doc_id"] for r in exactdedup.state(spark, where).collect()}
    assert best == {max(i for i, t in rows if t == f"t{k}") for k in range(30)}


def test_kept_texts_are_fetched_by_their_locators(spark):
    where = shared_dir(spark)
    docs = materialize(documents(spark, TEXTS), where, "docs")
    kept = exactdedup.kept_texts(docs, exactdedup.deduplicate(docs, where), where)
    groups = {(t or "").translate(LOWER) for _, t in TEXTS}
    texts = [(r["text"] or "").translate(LOWER) for r in kept.collect()]
    assert sorted(texts) == sorted(groups)


def test_copies_use_no_python_in_tasks(spark, sf_dir):
    plan = exactdedup.op11_exact_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_negatives(rows, every=100, k=5, share=80):
    keep = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        if i not in keep or (v, label) < keep[i]:
            keep[i] = (v, label)
    dims = max((len(v) for v, _ in keep.values()), default=0)
    q = {i: [int(np.floor(256 * float(x))) for x in v] + [0] * (dims - len(v)) for i, (v, _) in keep.items()}
    label = {i: (c + 1) % 10 if i % 7 == 0 else c for i, (_, c) in keep.items()}
    out = []
    for a in (i for i in keep if i % every == 0):
        scored = sorted((-sum(x * y for x, y in zip(q[a], q[b], strict=True)), b) for b in keep if b != a)
        for s, p in [(s, b) for s, b in scored if label[b] == label[a]][:k]:
            fit = [(t, b) for t, b in scored if label[b] != label[a] and share * -s <= 100 * -t <= 100 * -s]
            out += [(a, p, r + 1, b, -s, -t) for r, (t, b) in enumerate(fit[:k])]
    return out


VECTORS = "vec_id long, embedding array<float>, label int"


def clusters(seed, n=500, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    x = (centres[rng.integers(0, 5, n)] + 0.2 * rng.normal(size=(n, dims))).astype(np.float32).round(1)
    return [(i, [float(c) for c in v], int(k)) for i, v, k in zip(range(n), x, rng.integers(0, 4, n), strict=True)]


@pytest.mark.parametrize("seed,candidates,anchors", [(0, 32, 4), (1, 500, 64)])
def test_negatives_equal_the_plain_version(spark, seed, candidates, anchors):
    rows = clusters(seed)
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(40)]  # many equal vectors: ties everywhere
    got = hardnegatives.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3), every=20, candidate_block=candidates, anchor_block=anchors)
    assert sorted(map(tuple, got.collect())) == sorted(plain_negatives(rows, every=20))


def test_negatives_with_odd_rows(spark):
    rows = clusters(2, 120) + [(None, [1.0], 1), (200, None, 1), (300, [1.0, None], 1), (400, [float("nan")], 1), (500, [float("inf")], 2), (600, [1.0], None), (700, [], 1), (800, [0.5, 0.5], 1), (801, [0.5], 2), (20, [0.1], 3), (40, [9.0] * 6, 0), (900, [-1.0] * 6, 77)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"q": F.lit(1), "first": F.lit(2), "share": F.lit(3)})
    got = hardnegatives.hard_negatives(df, every=20, candidate_block=50, anchor_block=3)
    assert sorted(map(tuple, got.collect())) == sorted(plain_negatives(rows, every=20))


def test_negatives_of_no_rows_and_too_large_scores(spark):
    assert hardnegatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    wide = spark.createDataFrame([(i, [1e7, 1e7], i % 2) for i in range(0, 40)], VECTORS)
    with pytest.raises(Exception, match="does not fit"):
        hardnegatives.hard_negatives(wide, every=10).collect()


def test_bounds_along_the_tree_leave_candidates_out():
    """Near anchors and a high window: most candidates are not scored below the root."""
    rng = np.random.default_rng(3)
    anchors = np.round(256 * (np.eye(16)[0] + 0.02 * rng.normal(size=(40, 16))))
    candidates = np.round(256 * rng.normal(size=(16, 2000)) / 4)
    tree = hardnegatives.spanning_tree(anchors, np.zeros(40))
    exact = anchors @ candidates
    least, scored_below, seen = np.quantile(exact, 0.99, axis=1), 0, set()
    window = lambda level: (least[level], np.full(len(level), np.inf))
    for level, columns, scores, scored in hardnegatives.walk(anchors, tree, np.arange(40), candidates, np.linalg.norm(candidates, axis=0) * (1 + 1e-9), window):
        for j, i in enumerate(level):
            assert (scores[j, scored[j]] == exact[i, columns[scored[j]]]).all()
            assert set(np.flatnonzero(exact[i] >= least[i])) <= set(columns[scored[j]])
            scored_below += int(scored[j].sum()) if tree[0][i] >= 0 else 0
            seen.add(int(i))
    assert seen == set(range(40)) and scored_below < 0.5 * 39 * 2000


def test_inertia_counts_and_leading_eigenvalues():
    rng = np.random.default_rng(4)
    for _ in range(60):
        d = int(rng.integers(1, 25))
        m = rng.integers(-3, 4, size=(d, d)).astype(float)
        m, s = m + m.T, float(rng.integers(-4, 4)) + 0.37
        assert whitening.positives(m, s) == (np.linalg.eigvalsh(m) > s).sum()
    near = np.r_[[1.0, 1 + 1e-9, 1 - 1e-9, 1 + 1e-14, 0.5, 0.5], np.linspace(0.4, 0.1, 26)]
    basis = np.linalg.qr(rng.normal(size=(32, 32)))[0]
    cases = [np.eye(7), np.diag([3.0, 3, 3, 2, 2, 1, 0]), np.zeros((3, 3)), basis @ np.diag(near) @ basis.T, np.cov(rng.normal(size=(50, 200))), np.array([[2.0]])]
    for v in cases:
        v = (v + v.T) / 2
        values, axes = whitening.leading(v, 16)
        want = np.linalg.eigvalsh(v)[::-1][:16]
        assert np.allclose(values, want, rtol=0, atol=1e-13 * max(1, want[0]))
        assert np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-13)
        assert np.abs(v @ axes - axes * values).max() < 1e-13 * max(1, want[0])


def plain_whitening(vectors, k=16):
    dims = max(map(len, vectors))
    x = np.array([np.r_[np.floor(64 * np.array(v, float)), np.zeros(dims - len(v))] + 1_000_000 for v in vectors]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * fit - s) / n
    v = y.T @ y / n
    e, a = np.linalg.eigh(v)
    e, a = e[::-1][:k], a[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), ((n * x - s) / n) @ a / np.sqrt(e), e / np.trace(v)


def whitened(df):
    out = sorted(map(tuple, df.collect()))
    ids = sorted({r[0] for r in out})
    return ids, {r[0]: r[2:4] for r in out}, np.array([[r[4] for r in out if r[0] == i] for i in ids]), np.array([r[5] for r in out if r[0] == ids[0]]), {r[6] for r in out}


@pytest.mark.parametrize("dims", [3, 40])
def test_whitening_equals_the_plain_version(spark, dims):
    rng = np.random.default_rng(dims)
    x = (rng.normal(size=(300, dims)) * np.linspace(1, 3, dims) + 5).astype(np.float32)
    rows = [(i, [float(c) for c in v], None) for i, v in enumerate(x)] + [(300 + i, [float(c) for c in x[0]], 1) for i in range(200)]
    ids, facts, got, explained, errors = whitened(whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3)))
    n, deviation, want, share = plain_whitening([r[1] for r in rows])
    assert [facts[i] for i in ids] == [(n, int(d)) for d in deviation]
    assert np.allclose(got * np.sign((got * want).sum(axis=0)), want, atol=1e-9) and np.allclose(explained, share, rtol=1e-9)
    assert len(errors) == 1 and errors.pop() < 1e-10


def test_whitening_with_odd_rows(spark):
    rng = np.random.default_rng(9)
    good = [[float(c) for c in v] for v in rng.normal(size=(30, 4)).astype(np.float32)] + [[0.5, 0.25], []]
    rows = [(i % 7 if i % 5 else None, v, 1) for i, v in enumerate(good)] + [(90, None, 1), (91, [None, 1.0], 1), (92, [float("nan")], 1), (93, [float("-inf")], 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"x": F.lit(1), "component": F.lit(2), "n": F.lit(3)})
    out = whitening.whiten(df).collect()
    n, deviation, want, share = plain_whitening(good)
    assert len(out) == len(good) * 4 and {r["n"] for r in out} == {n}
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"]) for r in out if r["component"] == 1) == sorted((v is None, v or 0, int(d)) for (v, *_), d in zip(rows, deviation, strict=False))
    assert np.allclose(sorted(abs(r["whitened"]) for r in out if r["component"] == 1), sorted(np.abs(want[:, 0])), atol=1e-9)


def test_whitening_of_tables_without_spread(spark):
    for rows in ([], [(1, [1.0, 2.0], 1)], [(1, [1.0], 1), (2, [1.0], 1)], [(1, [], 1), (2, [], 1)], [(1, None, 1)]):
        assert whitening.whiten(spark.createDataFrame(rows, VECTORS)).count() == 0
    flat = [(i, [float(i), 1.0, 1.0], 1) for i in range(20)]  # one direction only
    assert {r["component"] for r in whitening.whiten(spark.createDataFrame(flat, VECTORS)).collect()} == {1}


def test_large_entries_stay_exact(spark):
    rows = [(i, [float((i * 7919) % 1000) * 2.0**30, float(i)], 1) for i in range(50)]
    out = whitening.whiten(spark.createDataFrame(rows, VECTORS), components=1)
    with pytest.raises(Exception, match="does not fit"):
        out.collect()
    assert os.environ.get("PYTHONPATH")  # tasks import the package from there


def test_numerals_are_no_letters(spark):
    from quarry.llm import langid

    rows = [(i, t, "en", "s", 1) for i, t in enumerate(["½ ² ①", "Ⅷ ٣ 12_", "one two"] + [f"the word {i} of it" for i in range(40)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert got[0] == got[1] == ("und", 0.0) and got[2][0] == "en"


def test_windows_and_scores_beyond_their_bounds_are_refused(spark):
    from quarry.llm import substrings, topk

    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError, match="at most 20"):
        substrings.without_repeats(docs, window=21)
    wide = spark.createDataFrame([(i, [3e15, 1.0]) for i in range(0, 300, 50)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit"):
        topk.top_k(wide).collect()
