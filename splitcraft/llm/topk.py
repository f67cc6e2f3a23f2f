"""Exact top-k search by inner product: a ball tree per shard, branch and bound.

Candidates are dealt to shards of about ``SHARD_ROWS`` rows, queries to blocks
of about ``BLOCK_ROWS``.  A task holds one shard and one block: it builds the
shard's ball tree, bounds the inner product of every query with everything in a
node by ``q.c + |q| r``, opens nodes from the top as long as their bound reaches
the query's k-th score so far, and takes the leaves in the order of their
bounds.  Every block first searches one shard; the k-th scores found there go
along to all other shards, which return only what reaches them.  A node whose
bound ties with the k-th score is still opened, because ties go to the smaller
id.  So the result is exact, whatever the bounds can prune.

Components are taken as ``floor(scale * x)``.  Vectors that are null or hold a
null or non-finite component take no part.  Vectors of different length have no
score.  Equal rows count once; several vectors with one id are one query or one
candidate with the best of their scores.  Scores beyond the range of a long are
held at its ends.  A query without any other vector has no rows.
"""
from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from splitcraft.llm.common import ship, stored, table

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8192, 2048, 128
EXACT = float(1 << 53)


class BallTree:
    """Nodes in arrays; the rows of a node lie side by side."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.arange(len(vectors))
        self.start, self.stop, self.left, self.right, centers, radii = [], [], [], [], [], []

        def grow(start: int, stop: int) -> int:
            node = len(self.start)
            rows = vectors[self.order[start:stop]]
            center = rows.mean(axis=0)
            self.start.append(start), self.stop.append(stop), self.left.append(-1), self.right.append(-1)
            centers.append(center)
            radii.append(float(np.sqrt(((rows - center) ** 2).sum(axis=1).max())))
            spread = rows.max(axis=0) - rows.min(axis=0)
            if stop - start > LEAF_ROWS and spread.max() > 0:
                middle = (stop - start) // 2
                by = np.argpartition(rows[:, int(spread.argmax())], middle)
                self.order[start:stop] = self.order[start:stop][by]
                self.left[node] = grow(start, start + middle)
                self.right[node] = grow(start + middle, stop)
            return node

        grow(0, len(vectors))
        self.center, self.radius = np.array(centers), np.array(radii)

    def bounds(self, queries: np.ndarray, norms: np.ndarray, nodes: list[int]) -> np.ndarray:
        """Upper bounds (queries x nodes), with room for rounding."""
        center, radius = self.center[nodes], self.radius[nodes]
        reach = norms[:, None] * (np.sqrt((center ** 2).sum(axis=1)) + radius)[None, :]
        return queries @ center.T + norms[:, None] * radius[None, :] + 1e-9 * reach + 1e-6


class Best:
    """The k best (score, id) of each query, an id once with its best score;
    ties to the smaller id."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.rows, self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.new: list[tuple] = []
        self.waiting = 0

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(rows):
            self.new.append((rows, scores, ids))
            self.waiting += len(rows)
        if self.waiting > max(256, len(self.floor) * self.k // 4):
            self.settle()

    def settle(self) -> None:
        if not self.new:
            return
        rows, scores, ids = (np.concatenate([x, *y]) for x, y in zip((self.rows, self.scores, self.ids), zip(*self.new)))
        self.new, self.waiting = [], 0
        order = np.lexsort((-scores, ids, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        again = np.concatenate(([False], (rows[1:] == rows[:-1]) & (ids[1:] == ids[:-1])))
        rows, scores, ids = rows[~again], scores[~again], ids[~again]
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        first = np.searchsorted(rows, rows)
        place = np.arange(len(rows)) - first
        kept = place < self.k
        self.rows, self.scores, self.ids = rows[kept], scores[kept], ids[kept]
        last = place == self.k - 1
        self.floor[rows[last]] = np.maximum(self.floor[rows[last]], scores[last])


def search(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Best:
    """Every query's ``k`` best among the vectors that reach its ``floor``."""
    best = Best(k, floor)
    tree = BallTree(vectors)
    vectors, ids = vectors[tree.order], ids[tree.order]
    norms = np.sqrt((queries ** 2).sum(axis=1))
    # branch: from the top, only where some query's bound still reaches its floor
    leaves, level = [], [0]
    while level:
        bound = tree.bounds(queries, norms, level)
        live = [n for n, b in zip(level, (bound >= best.floor[:, None]).any(axis=0)) if b]
        leaves += [n for n in live if tree.left[n] < 0]
        level = [c for n in live if tree.left[n] >= 0 for c in (tree.left[n], tree.right[n])]
    if not leaves:
        return best
    bound = tree.bounds(queries, norms, leaves)

    def visit(leaf: int, rows: np.ndarray) -> None:
        start, stop = tree.start[leaves[leaf]], tree.stop[leaves[leaf]]
        score = queries[rows] @ vectors[start:stop].T
        row, col = np.nonzero(score >= best.floor[rows][:, None])
        other = query_ids[rows[row]] != ids[start + col]
        row, col = row[other], col[other]
        best.add(rows[row], score[row, col], ids[start + col])

    # each query's most promising leaf, then all in the order of their bounds
    first = bound.argmax(axis=1)
    for leaf in np.unique(first):
        visit(int(leaf), np.flatnonzero(first == leaf))
    best.settle()
    for leaf in np.argsort(-bound.max(axis=0), kind="stable"):
        rows = np.flatnonzero((bound[:, leaf] >= best.floor) & (first != leaf))
        if len(rows):
            visit(int(leaf), rows)
            if best.waiting > len(best.floor):
                best.settle()
    best.settle()
    return best


def whole(vector: np.ndarray, scale: float) -> list[int]:
    """``floor(scale * x)`` of each component, also where the product is beyond
    the range of doubles."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vector * scale)
    return [int(s) if np.isfinite(s) else math.floor(Fraction(float(x)) * Fraction(scale)) for s, x in zip(scaled, vector)]


def search_exactly(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, scale: float = 1.0) -> pd.DataFrame:
    """The same in whole numbers of any size, for components so large that
    doubles can't hold the scores; components are not scaled yet."""
    out = []
    vectors = [whole(v, scale) for v in vectors]
    for q, i in zip(queries, query_ids):
        q = whole(q, scale)
        best: dict[int, int] = {}
        for v, j in zip(vectors, ids):
            if j != i:
                score = max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v))))
                best[int(j)] = max(best.get(int(j), score), score)
        out += [(int(i), j, s) for j, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query, k: int, scale: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other vectors of every
    row for which the condition ``is_query`` holds."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where(v.isNotNull() & (F.size(v) > 0) & ~odd & F.col(id_col).isNotNull())
    good = stored(good.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"),
                              F.size(v).alias("dim"), is_query.alias("is_query")).distinct(), "vectors")
    rows, asked = good.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    shards, blocks = max(1, -(-rows // SHARD_ROWS)), max(1, -(-asked // BLOCK_ROWS))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    numbers = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    candidates = good.select(F.col("id").alias("vec_id"), F.col("v").alias("vector"), F.col("dim").alias("length"),
                             shard.alias("of_shard"), numbers(blocks, "for_block"))
    queries = good.where("is_query").select("id", "v", "dim", block.alias("block"))
    schema = "query_id long, vec_id long, score long"

    def in_shard(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        raw_q, raw_x = np.stack(left["v"].to_numpy()), np.stack(right["vector"].to_numpy())
        with np.errstate(over="ignore", invalid="ignore"):
            q, x = np.floor(raw_q * scale), np.floor(raw_x * scale)
            exact = np.abs(q).max() * np.abs(x).max() * q.shape[1] < EXACT
        qi, xi = left["id"].to_numpy(), right["vec_id"].to_numpy()
        if not exact:
            return search_exactly(raw_q, qi, raw_x, xi, k, scale)
        floor = left["floor"].fillna(-np.inf).to_numpy(np.float64)
        best = search(q, qi, floor, x, xi, k)
        return pd.DataFrame({"query_id": qi[best.rows], "vec_id": best.ids, "score": best.scores.astype("int64")})

    def searched(asking: DataFrame) -> DataFrame:
        mine, theirs = asking.groupBy("dim", "block", "shard"), candidates.groupBy("length", "for_block", "of_shard")
        return mine.cogroup(theirs).applyInPandas(in_shard, schema)

    # one shard first; its k-th scores go along to the others
    home = F.pmod(F.col("block"), F.lit(shards))
    found = stored(searched(queries.select("id", "v", "dim", "block", home.alias("shard"), F.lit(None).cast("double").alias("floor"))), "found")
    if shards > 1:
        # of repeated ids only one vector's best count, so that the floor holds
        floors = (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).groupBy("query_id")
                  .agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
                  .select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.element_at("scores", k)).cast("double").alias("floor")))
        others = (queries.join(floors, "id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
                  .where(F.col("shard") != home))
        found = found.unionByName(searched(others.select(*[F.col(c).alias(c) for c in ("id", "v", "dim", "block", "shard", "floor")])))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Parameters of the registered query.
K, SCALE, EVERY = 20, 64.0, 20


def op8_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every vector whose id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(EVERY)) == 0, K, SCALE)


ORACLE = f"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
