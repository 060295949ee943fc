"""Approximate nearest neighbours by stable projections and kd-trees.

Largest inner product becomes least distance by one more coordinate, sqrt(M^2 - |x|^2)
with M the greatest norm.  A Gaussian (2-stable) projection to DIMS dimensions keeps
squared distances as a chi-square multiple: |Px - Pq|^2 / |x - q|^2 ~ chi2(DIMS).  A
kd-tree holds the projections.  A query takes its leaves in the order of their distance,
and from these the vectors in the order of their own projected distances (a vector's turn
comes when no leaf still closed can hold a nearer one), and verifies them exactly, until
for the k-th distance d found and the next projected distance r,
chi2_DIMS(r^2 / d^2) >= CONFIDENCE: then a vector still unseen is a true neighbour with
probability below 1 - CONFIDENCE.

Rows are dealt to shards of about SHARD_ROWS by a hash of the id.  Each shard's tree is
built once and written; queries come in blocks of QUERY_ROWS at most, each (shard, block)
is one bounded task, and the shards' lists are merged by a window that keeps k rows a
query before it shuffles.

Null ids, and vectors that are null, zero, or hold null or non-finite components, take
no part.  Vectors of different lengths have no inner product: a query is answered from
those of its own length.  Rows of one id never answer each other; of several rows of one
query id the shortest and then least vector asks.  Equal scores go to the smaller id.  An
empty table gives no rows.
"""
from __future__ import annotations

import math
import pickle
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import staged

K = 20
DIMS = 24
CONFIDENCE = 0.88
SHARD_ROWS = 1 << 16
QUERY_ROWS = 16384
#: Queries of a block at least, before blocks are made smaller to keep all cores busy.
LEAST_ROWS = 512
LEAF = 64
#: Vectors verified between two stopping tests, at first and later.
FIRST, STEP = 64, 512
#: Bound of the error of a float32 product of vectors of norm 1 or less.
COARSE = 1e-5


def chi_square(x: np.ndarray | float, dims: int = DIMS) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for j in range(1, dims // 2):
        term = term * half / j
        total = total + term
    return 1 - np.exp(-half) * total


@cache
def quantile(confidence: float, dims: int = DIMS) -> float:
    """Where the distribution function reaches confidence, by bisection."""
    low, high = 0.0, 64.0 * dims
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < confidence else (low, mid)
    return high


def projection(width: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((width + 1, DIMS))


class Tree:
    """kd-tree by median splits: leaves are runs of self.order with bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        runs = [np.arange(len(points))]
        done = []
        while runs:
            run = runs.pop()
            if len(run) <= leaf:
                done.append(run)
                continue
            p = points[run]
            axis = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
            half = len(run) // 2
            cut = np.argpartition(p[:, axis], half)
            runs += [run[cut[half:]], run[cut[:half]]]
        self.order = np.concatenate(done)
        self.size = np.array([len(r) for r in done])
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.low = np.array([points[r].min(axis=0) for r in done])
        self.high = np.array([points[r].max(axis=0) for r in done])

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Least squared projected distance from q to each leaf's box."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return np.einsum("ij,ij->i", gap, gap)


class Shard:
    """Vectors in the order of their tree's leaves, with their projections."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, top: float):
        """top: the greatest norm of all shards."""
        self.top = top
        p = projection(x.shape[1])
        wide = x.astype(np.float64)
        lift = np.sqrt(np.maximum(top * top - (wide * wide).sum(axis=1), 0))
        points = wide @ p[:-1] + lift[:, None] * p[-1]
        self.tree = Tree(points)
        self.ids, self.x = ids[self.tree.order], x[self.tree.order]
        self.points = points[self.tree.order]
        self.norms = (self.points * self.points).sum(axis=1)
        self.rough = (self.x / top).astype(np.float32)
        self.p = p
        self.seen = 0

    def search(self, own: int, q: np.ndarray, k: int, confidence: float) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best found, best first."""
        tree, stop = self.tree, quantile(confidence)
        at = q @ self.p[:-1]
        low = tree.bounds(at)
        leaves = np.argsort(low, kind="stable")
        norm = float(np.sqrt(q @ q))
        fixed, own_norm, rough = self.top ** 2 + norm * norm, float(at @ at), (q / norm).astype(np.float32)
        ids, score = np.zeros(0, np.int64), np.zeros(0)
        rows, away = np.zeros(0, np.int64), np.zeros(0)
        # squared projected distance from which on chi2(r^2 / d^2) >= confidence
        end, opened = np.inf, 0
        while opened < len(leaves) and low[leaves[opened]] < end:
            some = leaves[opened:opened + max(8, opened)]
            opened += len(some)
            size = tree.size[some]
            new = np.repeat(tree.start[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
            far = np.maximum(self.norms[new] - 2 * (self.points[new] @ at) + own_norm, 0)
            rows, away = np.concatenate([rows, new]), np.concatenate([away, far])
            reach = low[leaves[opened]] if opened < len(leaves) else np.inf
            due = np.flatnonzero(away <= min(reach, end))
            due = due[np.argsort(away[due], kind="stable")]
            i = 0
            while i < len(due) and away[due[i]] < end:
                part = due[i:i + (FIRST if len(ids) < k else STEP)]
                part = rows[part[away[part] < end]]
                i += len(part)
                self.seen += len(part)
                if len(ids) >= k:  # single precision rules out what cannot be among the k best
                    part = part[self.rough[part] @ rough >= score[k - 1] / (self.top * norm) - COARSE]
                part = part[self.ids[part] != own]
                # summed in one fixed order, so that equal vectors get equal scores
                exact = (self.x[part].astype(np.float64) * q).sum(axis=1)
                ids, score = np.concatenate([ids, self.ids[part]]), np.concatenate([score, exact])
                best = np.lexsort((ids, -score))[:k]
                ids, score = ids[best], score[best]
                if len(ids) >= k:
                    # equal vectors, at distance zero, are all looked at
                    end = max(max(fixed - 2 * score[k - 1], 0.0) * stop, 1e-9)
            rest = (away > reach) & (away < end)
            rows, away = rows[rest], away[rest]
        return ids, score


def _usable(df: DataFrame, vector: str) -> DataFrame:
    fine = F.forall(vector, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return (df.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & fine & F.exists(vector, lambda c: c != 0))
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("x"), F.size(vector).alias("width")))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _build(table: pa.Table) -> pa.Table:
    """A shard's rows as one pickled Shard."""
    width = table["width"][0].as_py()
    shard = Shard(table["vec_id"].to_numpy(), _matrix(table["x"], width), table["top"][0].as_py())
    return pa.table({"width": pa.array([width], pa.int32()), "shard": pa.array([table["shard"][0].as_py()], pa.int32()), "index": pa.array([pickle.dumps(shard)], pa.binary())})


def index(vectors: DataFrame, vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """width, shard, index: the trees, built once and written to the shared folder."""
    v = _usable(vectors, vector)
    wide = F.transform("x", lambda c: c.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, c: a + c * c))
    sizes = v.groupBy("width").agg(F.max(norm).alias("top"), F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = v.join(F.broadcast(sizes), "width").select("width", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int").alias("shard"), "top", "vec_id", "x")
    return staged(dealt.groupBy("width", "shard").applyInArrow(_build, "width int, shard int, index binary"), "kd-trees")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, confidence: float = CONFIDENCE, vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of queries among
    the rows of vectors.  Both have (vec_id, vector)."""
    spark = vectors.sparkSession
    trees = index(vectors, vector, shard_rows)
    asked = _usable(queries, vector).groupBy("vec_id").agg(F.min(F.struct("width", "x")).alias("q")).select("vec_id", "q.width", "q.x")
    n = asked.count()
    busy = spark.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n / QUERY_ROWS), min(busy, math.ceil(n / LEAST_ROWS)))
    left = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    names = trees.select(F.col("width").alias("_width"), F.col("shard").alias("_shard"))
    right = (asked.join(names, F.col("width") == F.col("_width"))
             .select("width", F.col("_shard").alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int").alias("block"), "vec_id", "x"))
    kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        shard = pickle.loads(a["index"][0].as_py())
        got = [(own, *shard.search(own, q, k, confidence)) for own, q in zip(b["vec_id"].to_pylist(), _matrix(b["x"], b["width"][0].as_py()).astype(np.float64))]
        return pa.table({"query_id": pa.array(np.repeat([g[0] for g in got], [len(g[1]) for g in got]), pa.int64()),
                         "vec_id": pa.array(np.concatenate([g[1] for g in got])), "score": pa.array(np.concatenate([g[2] for g in got]))})

    key = ["width", "shard", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
