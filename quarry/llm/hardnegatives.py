"""Hard negatives of anchors, by bounds along spanning trees of the anchors.

Anchors lie in blocks, near ones together, and each block has a least spanning tree over its
anchors. A candidate's score at a child anchor differs from its score at the parent by at most
the edge's length times the candidate's norm. Walking down from the root, whose scores are
exact, gives every candidate an interval at every anchor; only candidates whose interval meets
the anchor's window of wanted scores are scored again there, which also renews the interval for
the anchors below.

Two passes: positives (the window is all above the k-th best so far, among rows of the anchor's
label), then negatives (the window spans from the least share of a positive's score that still
counts to the greatest positive's score, among rows of other labels). The windows shrink as
better rows are found and travel from one candidate block of a share to the next. Results are
exact.

Anchor blocks meet candidate blocks in a block nested loop over ``groups`` shares of the
candidates, as the query set against all rows asks for: each anchor block goes once to every
share (its bytes times the number of shares is what is shuffled), and a task holds one anchor
block with its trees, a few opened candidate blocks, and k rows for each of the block's
windows. Only these rows leave it.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import load, materialize, pack, shared_dir, shuffle_partitions, unpack

#: Opened candidate blocks that a task keeps.
OPEN_BLOCKS = 8
#: Fixed hyperplanes that tell which anchors are near: anchors on the same sides lie together.
PLANES = 12


def labelled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, q): floor(scale * x) of each component as a 64-bit integer.

    Rows whose id, label or vector is null, or whose vector holds a null or non-finite component,
    take no part. Where the id is divisible by 7 the label becomes (label + 1) % 10. Of rows that
    share an id, the one with the least vector, then label, stands."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    one = kept.groupBy("vec_id").agg(F.min(F.struct("embedding", "label")).alias("r"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("r.label") + 1) % 10).otherwise(F.col("r.label"))
    return one.select("vec_id", label.alias("label"), F.transform("r.embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Dimensions x vectors; shorter ones are filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    dims = int(sizes.max(initial=0))
    m = np.zeros((len(vectors), dims), np.int64)
    m[np.arange(dims) < sizes[:, None]] = vectors.flatten().to_numpy()
    return m.T


def candidate_blocks(rows: DataFrame, size: int) -> DataFrame:
    """(first, block) of rows (vec_id, label, q): at most ``size`` vectors in each, by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids, labels, m = part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2))
                order = np.lexsort((ids, labels))
                block = pack(ids[order], labels[order], np.array([len(m)], np.int64), np.ascontiguousarray(m[:, order]).reshape(-1))
                yield pa.RecordBatch.from_pydict({"first": pa.array([int(ids[0])], pa.int64()), "block": pa.array([block], pa.binary())})

    return rows.select("vec_id", "label", "q").mapInArrow(run, "first long, block binary")


def spanning_tree(points: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, length of the edge to it) of the least spanning tree of each kind, by Prim's method;
    parent -1 and length 0 at the roots. Lengths are never below the exact ones."""
    n = len(points)
    square = (points * points).sum(axis=1)
    parent, length = np.full(n, -1), np.zeros(n)
    for kind in np.unique(kinds):
        todo = np.flatnonzero(kinds == kind)
        at, todo = todo[0], todo[1:]
        near, via = np.full(len(todo), np.inf), np.full(len(todo), at)
        while len(todo):
            d = np.maximum(square[todo] + square[at] - 2 * (points[todo] @ points[at]), 0)
            closer = d < near
            near[closer], via[closer] = d[closer], at
            j = int(near.argmin())
            at = todo[j]
            parent[at] = via[j]
            length[at] = np.linalg.norm(points[at] - points[via[j]]) * (1 + 1e-9)
            todo, near, via = np.delete(todo, j), np.delete(near, j), np.delete(via, j)
    return parent, length


def anchor_blocks(anchors: DataFrame, size: int) -> DataFrame:
    """(first, block) of anchors (vec_id, label, q, positives), near ones of a label together, with
    the spanning trees of the labels and of the block."""
    n = anchors.count()

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(2)).astype(float)
            planes = np.cos(np.outer(np.arange(1, PLANES + 1) ** 2.0, np.arange(1, len(m) + 1)))
            codes = ((planes @ m >= 0) * (1 << np.arange(PLANES))[:, None]).sum(axis=0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.astype(np.int64))], names=[*batch.schema.names, "side"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids, labels, m = part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2))
                points = m.T.astype(float)
                known = [[(p["id"], p["score"]) for p in row] for row in part.column(3).to_pylist()]
                flat = np.array([x for row in known for x in row], np.int64).reshape(-1, 2)
                own, own_length = spanning_tree(points, labels)
                parent, length = spanning_tree(points, np.zeros(len(ids)))
                block = pack(ids, labels, np.array([len(m)], np.int64), np.ascontiguousarray(m).reshape(-1), np.array([len(r) for r in known], np.int64), flat[:, 0].copy(), flat[:, 1].copy(), own.astype(np.int64), own_length, parent.astype(np.int64), length)
                yield pa.RecordBatch.from_pydict({"first": pa.array([int(ids[0])], pa.int64()), "block": pa.array([block], pa.binary())})

    schema = "vec_id long, label long, q array<long>, positives array<struct<id: long, score: long>>"
    placed = anchors.select("vec_id", "label", "q", "positives").mapInArrow(sides, f"{schema}, side long")
    placed = placed.repartitionByRange(max(1, -(-n // size)), "label", "side", "vec_id").sortWithinPartitions("label", "side", "vec_id")
    return placed.mapInArrow(run, "first long, block binary")


class Candidates:
    """An opened candidate block."""

    def __init__(self, block: bytes):
        self.ids, self.labels, dims, flat = unpack(block)
        self.m = flat.reshape(int(dims[0]), len(self.ids))
        self.top = float(np.abs(self.m.astype(float)).max(initial=0))
        self.norms = np.sqrt((self.m.astype(float) ** 2).sum(axis=0)) * (1 + 1e-9)


class Anchors:
    """An opened anchor block, with the best rows that were found for each of its windows."""

    def __init__(self, block: bytes, k: int):
        self.ids, self.labels, dims, flat, counts, positive, score, own, own_length, parent, length = unpack(block)
        self.m = flat.reshape(int(dims[0]), len(self.ids)).T
        self.top = float(np.abs(self.m.astype(float)).max(initial=0))
        self.trees = {"labels": (own, own_length), "block": (parent, length)}
        at = np.concatenate([[0], np.cumsum(counts)])
        self.positives = [list(zip(positive[a:b].tolist(), score[a:b].tolist(), strict=True)) for a, b in zip(at[:-1], at[1:], strict=True)]
        self.k, self.best = k, {}

    def keep(self, window: tuple, ids: np.ndarray, scores: np.ndarray) -> None:
        if window in self.best:
            ids, scores = np.concatenate([self.best[window][0], ids]), np.concatenate([self.best[window][1], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.best[window] = ids[order], scores[order]

    def least(self, window: tuple) -> float:
        """What a row has to score to be among the best, ties included."""
        found = self.best.get(window)
        return found[1][-1] if found is not None and len(found[1]) == self.k else -np.inf


def _scores(anchors: np.ndarray, top: float, candidates: Candidates) -> tuple[np.ndarray, np.ndarray]:
    """Both sides in a type in which products add up exactly, also a hundredfold."""
    dims = max(anchors.shape[1], len(candidates.m))
    a, c = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (anchors, candidates.m.T))
    bound = top * candidates.top * max(1, dims) * 100
    if bound >= 2**62:
        raise ArithmeticError("a hundredfold score does not fit into 64 bits")
    kind = float if bound < 2**52 else np.int64
    return a.astype(kind), np.ascontiguousarray(c.T.astype(kind))


def walk(anchors: np.ndarray, tree: tuple[np.ndarray, np.ndarray], members: np.ndarray, candidates: np.ndarray, norms: np.ndarray, window: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Goes down the trees of ``members`` (rows of ``anchors``, each with its whole tree), level by level.
    Yields (members of the level, columns, scores, scored): ``scored`` tells which members' windows
    a column's interval meets; only there the score counts. ``window`` gives (low, high) of
    members when their level is reached."""
    parent, length = tree
    row = np.full(len(anchors), -1)
    row[members] = np.arange(len(members))
    low = np.empty((len(members), candidates.shape[1]))
    high = np.empty_like(low)
    level = members[parent[members] < 0]
    below = members[parent[members] >= 0]
    while len(level):
        at = row[level]
        if parent[level[0]] < 0:
            meets = np.ones((len(level), candidates.shape[1]), bool)
        else:
            slack = length[level][:, None] * norms + 1
            low[at], high[at] = low[row[parent[level]]] - slack, high[row[parent[level]]] + slack
            least, most = window(level)
            meets = (high[at] >= least[:, None]) & (low[at] <= most[:, None])
        columns = np.flatnonzero(meets.any(axis=0))
        scores = anchors[level] @ (candidates if len(columns) == candidates.shape[1] else candidates[:, columns])
        scored = meets[:, columns]
        for edge in (low, high):
            edge[at[:, None], columns] = np.where(scored, scores, edge[at[:, None], columns])
        yield level, columns, scores, scored
        reached = np.isin(parent[below], level)
        level, below = below[reached], below[~reached]


def find_positives(a: Anchors, c: Candidates) -> None:
    """The k best other rows of each anchor's own label."""
    rows, columns = _scores(a.m, a.top, c)
    for label in np.unique(a.labels):
        begin, end = np.searchsorted(c.labels, [label, label + 1])
        if begin == end:
            continue
        ids, members = c.ids[begin:end], np.flatnonzero(a.labels == label)
        least = lambda level: np.array([a.least((int(i), 0)) for i in level], float)
        for level, at, scores, scored in walk(rows, a.trees["labels"], members, np.ascontiguousarray(columns[:, begin:end]), c.norms[begin:end], lambda level: (least(level), np.full(len(level), np.inf))):
            good = scored & (scores >= least(level)[:, None]) & (ids[at] != a.ids[level][:, None])
            for j, i in enumerate(level.tolist()):
                take = np.flatnonzero(good[j])
                if len(take):
                    a.keep((i, 0), ids[at[take]], scores[j, take].astype(np.int64))


def find_negatives(a: Anchors, c: Candidates, share: int) -> None:
    """For each positive of an anchor the k best rows of other labels that score at least ``share``
    per cent of it and at most as much."""
    rows, columns = _scores(a.m, a.top, c)
    windows = [[(p, -(-share * s // 100), s) for p, s in known if s >= 0] for known in a.positives]

    def window(level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = [min((max(low, a.least((int(i), p))) for p, low, _ in windows[i]), default=np.inf) for i in level]
        return np.array(least, float), np.array([max((s for *_, s in windows[i]), default=-np.inf) for i in level], float)

    for level, at, scores, scored in walk(rows, a.trees["block"], np.arange(len(a.ids)), columns, c.norms, window):
        least, most = window(level)
        good = scored & (scores >= least[:, None]) & (scores <= most[:, None]) & (c.labels[at] != a.labels[level][:, None])
        for j, i in enumerate(level.tolist()):
            take = np.flatnonzero(good[j])
            if len(take):
                ids, found = c.ids[at[take]], scores[j, take].astype(np.int64)
                for p, low, s in windows[i]:
                    inside = (found >= max(low, a.least((i, p)))) & (found <= s)
                    if inside.any():
                        a.keep((i, p), ids[inside], found[inside])


def _meet(anchors: DataFrame, candidates: DataFrame, find: Callable[[Anchors, Candidates], None], k: int) -> DataFrame:
    """(anchor_id, positive_id, vec_id, score): the k best of each window in each share of the
    candidates; positive_id is 0 where the windows are the anchors' own."""
    groups = shuffle_partitions(anchors.sparkSession)
    dealt = candidates.select(F.pmod(F.xxhash64("first"), F.lit(groups)).alias("share"), F.col("first").alias("c"), F.col("block").alias("candidates"))
    every = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("share"), F.col("first").alias("a"), F.col("block").alias("anchors"))

    def rows(a: Anchors | None) -> Iterator[pa.RecordBatch]:
        if a is not None and a.best:
            sizes = [len(ids) for ids, _ in a.best.values()]
            owner = np.repeat(np.array([a.ids[i] for i, _ in a.best], np.int64), sizes)
            positive = np.repeat(np.array([p for _, p in a.best], np.int64), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(positive), pa.array(np.concatenate([x for x, _ in a.best.values()])), pa.array(np.concatenate([s for _, s in a.best.values()]))], names=["anchor_id", "positive_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: OrderedDict[int, Candidates] = OrderedDict()
        name, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                a, c = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                if a != name:  # pairs of an anchor block come together; if not, more rows leave the task
                    yield from rows(held)
                    name, held = a, Anchors(batch.column(1)[i].as_py(), k)
                if c not in opened:
                    opened[c] = Candidates(batch.column(3)[i].as_py())
                    if len(opened) > OPEN_BLOCKS:
                        opened.popitem(last=False)
                find(held, opened[c])
        yield from rows(held)

    pairs = every.hint("merge").join(dealt, "share").select("a", "anchors", "c", "candidates")
    return pairs.mapInArrow(run, "anchor_id long, positive_id long, vec_id long, score long")


def hard_negatives(vectors: DataFrame, every: int = 100, k: int = 5, share: int = 80, candidate_block: int = 4096, anchor_block: int = 512, where: str | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors, the
    rows whose id is divisible by ``every``.

    An anchor's positives are the k best-scoring other rows of its label; for each of them the k
    best rows of other labels come back whose score is at least ``share`` per cent of the
    positive's and not above it. Scores are inner products of the whole numbers floor(256 * x);
    ties go to the smaller id. Which rows take part is told in ``labelled``. Vectors of different
    lengths are filled up with zeros; an empty vector scores 0 with all. An anchor that is alone
    with its label, a positive of negative score and a window without rows give nothing, and so
    does an empty table. Scores whose hundredfold is beyond 64 bits raise an ArithmeticError.
    Other columns are not read."""
    spark = vectors.sparkSession
    where = where or shared_dir(spark)
    rows = materialize(labelled(vectors), where, "rows")
    candidates = materialize(candidate_blocks(rows, candidate_block), where, "candidates")
    anchors = rows.where(F.col("vec_id") % every == 0)
    none = F.array().cast("array<struct<id: long, score: long>>")
    first = anchor_blocks(anchors.withColumn("positives", none), anchor_block)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    positives = _meet(first, candidates, find_positives, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    positives = materialize(positives.select("anchor_id", F.col("vec_id").alias("id"), "score"), where, "positives")
    known = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("id", "score")).alias("positives"))  # k at most
    second = anchor_blocks(materialize(anchors.join(known, "vec_id"), where, "anchors"), anchor_block)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = _meet(second, candidates, lambda a, c: find_negatives(a, c, share), k).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.join(positives.withColumnsRenamed({"id": "positive_id", "score": "positive_score"}), ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(load(spark, sf_dir, "embeddings"))


SQL = """
WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
                  CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
           FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
     p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
     n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
           FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
