"""Exact top-k search by columnar branch and bound.

Candidates lie in blocks in vertical layout: one row for each dimension. A query adds up
its inner products one group of dimensions after another. What the remaining dimensions
can add is bounded by the product of the remaining norms; a candidate whose upper bound is
below the k-th best lower bound is dropped, and the survivors are moved together before
the next group. The result is exact.

Query blocks meet candidate blocks in a block nested loop over ``groups`` shares of the
candidates: each query block goes once to every share, that is ``groups`` copies of the query
set are shuffled. A sort-merge join gives each query block the candidate blocks of a share one
after another, so the k best scores of its queries go from block to block: a later block
starts with the bound of the earlier ones and drops candidates before their first product.
Only the queries of one block are held, and at most k rows for each query and candidate block
leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import load, pack, unpack


#: More than what a double loses of a 64-bit score, in proportion to it.
ROUNDING = 2.0**-50


def quantized(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, q): floor(scale * x) of each component as a 64-bit integer.

    Vectors that are null or hold a null or non-finite component, and rows without an id,
    take no part; an empty vector scores 0 against all. Of rows that share an id, the least
    vector stands."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return kept.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Packs rows into blocks of ``size`` vectors: ids, number of dimensions, values dimension
    by dimension. Shorter vectors are filled up with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids = part.column(0).to_numpy()
                vectors = part.column(1).to_pylist()
                dims = max(map(len, vectors), default=0)
                m = np.zeros((dims, len(ids)), np.int64)
                for j, v in enumerate(vectors):
                    m[: len(v), j] = v
                yield pa.RecordBatch.from_pydict({"first": pa.array([int(ids[0])], pa.int64()), "block": pa.array([pack(ids.astype(np.int64), np.array([dims], np.int64), m.reshape(-1))], pa.binary())})

    return rows.select("vec_id", "q").mapInArrow(run, "first long, block binary")


def _open(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids, dims, flat = unpack(block)
    return ids, flat.reshape(int(dims[0]), len(ids))


def _tails(m: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norm of what lies beyond each cut, slightly raised so that rounding never lowers it."""
    squares = m.astype(float) ** 2
    return np.stack([np.sqrt(squares[c:].sum(axis=0)) for c in cuts]) * (1 + 1e-9)


def search(query: np.ndarray, tail: np.ndarray, own: int, ids: np.ndarray, m: np.ndarray, tails: np.ndarray, cuts: list[int], k: int, bound: float = -1e300) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of one candidate block for one query, ties to the smaller id.
    Candidates that cannot reach ``bound``, a score that k others have reached, are left out.
    ``cuts`` begins with 0: the first bound is that of the whole norms."""
    alive = np.flatnonzero(ids != own)
    total = np.zeros(len(alive), m.dtype)
    start = 0
    for step, cut in enumerate(cuts):
        total = total + query[start:cut] @ m[start:cut][:, alive]
        start = cut
        rest = tail[step] * tails[step, alive] + 1 + np.abs(total) * ROUNDING
        least = max(bound - abs(bound) * ROUNDING, np.partition(total - rest, -k)[-k] if len(alive) > k else -np.inf)
        stay = total + rest >= least
        if not stay.all():
            alive, total = alive[stay], total[stay]
    order = np.lexsort((ids[alive], -total))[:k]
    return ids[alive[order]], total[order].astype(np.int64)


class Best:
    """The k best scores so far of each query of the block at hand."""

    def __init__(self, k: int):
        self.k, self.own, self.scores = k, np.zeros(0, np.int64), []

    def turn_to(self, own: np.ndarray) -> None:
        """Begins anew unless the block is the one before."""
        if not np.array_equal(own, self.own):
            self.own, self.scores = own, [np.zeros(0, np.int64)] * len(own)

    def bound(self, j: int) -> float:
        return float(self.scores[j][0]) if len(self.scores[j]) == self.k else -1e300

    def add(self, j: int, scores: np.ndarray) -> None:
        if len(scores):
            self.scores[j] = np.sort(np.concatenate([self.scores[j], scores]))[-self.k :]


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, dims_at_once: int = 16, candidate_block: int = 4096, query_block: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest inner products of every vector whose id
    is divisible by ``every`` with all other vectors; ties go to the smaller id. Scores that may not
    fit into 64 bits raise an ArithmeticError; an empty table gives no rows."""
    spark = vectors.sparkSession
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = quantized(vectors)
    candidates = blocks(q, candidate_block).select(F.pmod(F.xxhash64("first"), F.lit(groups)).alias("share"), F.col("block").alias("candidates"))
    queries = blocks(q.where(F.col("vec_id") % every == 0), query_block).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("share"), F.col("block").alias("queries"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                ids, m = _open(a.as_py())
                own, w = _open(b.as_py())
                dims = max(len(m), len(w))
                m, w = (np.concatenate([x, np.zeros((dims - len(x), x.shape[1]), np.int64)]) for x in (m, w))
                cuts = [*range(0, dims, dims_at_once), dims]
                top = float(np.abs(m.astype(float)).max(initial=0)) * float(np.abs(w.astype(float)).max(initial=0)) * max(1, dims)
                if top >= 2**62:
                    raise ArithmeticError("a score does not fit into 64 bits")
                if top < 2**52:  # then sums of products are exact in doubles
                    m, w = m.astype(float), w.astype(float)
                mt, wt = _tails(m, cuts), _tails(w, cuts)
                best.turn_to(own)
                found = []
                for j in range(len(own)):
                    found.append(search(w[:, j], wt[:, j], int(own[j]), ids, m, mt, cuts, k, best.bound(j)))
                    best.add(j, found[-1][1])
                sizes = [len(x) for x, _ in found]
                if sum(sizes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, sizes)), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([s for _, s in found]))], schema=schema)

    near = queries.join(candidates.hint("merge"), "share").select("candidates", "queries").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(load(spark, sf_dir, "embeddings"))


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
                  CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
           FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
