"""Exact top-k search by inner product: M-trees searched best first.

Inner product becomes a metric by one more coordinate: with M the largest
squared length among a tree's vectors, x gets sqrt(M - |x|^2) and a query 0,
so that |q - x|^2 = |q|^2 + M - 2 <q, x>.  The nearest vectors are then those
of the highest scores.  Components are integers, hence scores are exact;
distances only prune, with a margin over their rounding.

Vectors are dealt by hash into blocks of bounded size; each block is one
M-tree: nodes are pages with a routing vector, a covering radius and every
entry's distance to its parent.  A query descends best first and skips
entries for which the stored distances and the triangle inequality already
show that they cannot beat the k-th best (no distance is computed for them).
Queries are the stated set, in blocks; every tree sees every block of queries
of its dimension, and each tree returns at most k rows a query, merged by rank.

Edge cases: vectors that are NULL or hold NULL, NaN or infinite components,
and rows without an id, take no part; vectors are compared with those of the
same dimension only; ties go to the smaller id; of repeated ids every row
counts, and a query leaves out all rows of its own id; fewer than k
candidates give all of them; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

TREE_ROWS = 8192       # vectors of a tree, on average
PAGE = 256             # entries of a page
QUERY_BLOCK = 1024     # queries of a block, on average
SEED = 7


class Node:
    """A page: entries' routing vectors with their distances to this page's own, radii and children."""

    __slots__ = ("at", "parent", "radius", "children")

    def __init__(self, at, parent, radius, children):
        self.at, self.parent, self.radius, self.children = at, parent, radius, children


class MTree:
    """M-tree over the rows of ``x`` (integers as doubles, or Python integers if they are too large)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, page: int = PAGE):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.page = ids[order], x[order], page
        self.squares = (self.x * self.x).sum(axis=1)
        self.most = self.squares.max()
        self.extra = np.sqrt(np.maximum(self.most - self.squares, 0).astype(float))
        self.full = np.column_stack([self.x.astype(float), self.extra])
        # well above the rounding of a distance of this size
        self.margin = 1e-6 * (1 + float(np.sqrt(float(self.most))))
        self.rng = np.random.default_rng(SEED)
        self.root_at = 0
        self.root = self._build(np.arange(len(ids)), 0)

    def _distance(self, rows: np.ndarray, to: int) -> np.ndarray:
        return np.sqrt(((self.full[rows] - self.full[to]) ** 2).sum(axis=1))

    def _build(self, rows: np.ndarray, own: int) -> Node:
        """Bulk load: route rows to the nearest of some seeds, each seed's rows below it."""
        if len(rows) <= self.page:
            return Node(rows, self._distance(rows, own), None, None)
        n = int(min(self.page, max(2, -(-len(rows) // (self.page // 2)))))
        seeds = self._seeds(rows, n)
        squares = (self.full[rows] ** 2).sum(axis=1)[:, None] + (self.full[seeds] ** 2).sum(axis=1)[None]
        near = (squares - 2 * self.full[rows] @ self.full[seeds].T).argmin(axis=1)
        parts = [(s, rows[near == i]) for i, s in enumerate(seeds) if (near == i).any()]
        if len(parts) == 1:                      # equal vectors: nothing tells them apart
            cut = range(0, len(rows), self.page)
            parts = [(int(rows[i]), rows[i:i + self.page]) for i in cut]
            if len(parts) > self.page:
                half = len(rows) // 2
                parts = [(int(rows[0]), rows[:half]), (int(rows[half]), rows[half:])]
        at = np.array([s for s, _ in parts])
        radius = np.array([self._distance(r, s).max() for s, r in parts])
        return Node(at, self._distance(at, own), radius, [self._build(r, s) for s, r in parts])

    def _seeds(self, rows: np.ndarray, n: int) -> np.ndarray:
        """Farthest-first among a few times as many random rows."""
        some = self.rng.choice(rows, size=min(len(rows), 4 * n), replace=False)
        chosen = [int(some[0])]
        far = self._distance(some, chosen[0])
        while len(chosen) < n and far.max() > 0:
            chosen.append(int(some[far.argmax()]))
            far = np.minimum(far, self._distance(some, chosen[-1]))
        return np.array(chosen)

    def search(self, q: np.ndarray, own, k: int) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id, without rows of id ``own``."""
        q2 = (q * q).sum()
        base = float(q2) + float(self.most)
        best: list[tuple] = []                   # heap of (score, -row): the worst on top
        self.visited = self.computed = 0

        def distances(rows):
            scores = self.x[rows] @ q
            return scores, np.sqrt(np.maximum(base - 2 * scores.astype(float), 0))

        margin = self.margin + 1e-6 * float(np.sqrt(float(q2)))
        reach = np.inf                           # distance of the k-th best
        to_root = distances(np.array([self.root_at]))[1][0]
        queue = [(0.0, 0, self.root, to_root)]
        n = 0
        while queue:
            low, _, node, to_parent = heapq.heappop(queue)
            if low > reach + margin:
                break
            self.visited += 1
            gap = np.abs(to_parent - node.parent)
            if node.children is None:
                # |d(q, p) - d(x, p)| <= d(q, x): no need to compute what is too far
                rows = node.at[gap <= reach + margin]
                rows = rows[self.ids[rows] != own]
                self.computed += len(rows)
                if not len(rows):
                    continue
                scores = self.x[rows] @ q
                if len(best) == k:
                    keep = scores >= best[0][0]
                    rows, scores = rows[keep], scores[keep]
                if len(rows) > k:                # at most k of a page can matter
                    top = np.lexsort((rows, -scores))[:k]
                    rows, scores = rows[top], scores[top]
                for s, r in zip(scores.tolist(), rows.tolist()):
                    if len(best) < k:
                        heapq.heappush(best, (s, -r))
                    elif (s, -r) > best[0]:
                        heapq.heapreplace(best, (s, -r))
                if len(best) == k:
                    reach = float(np.sqrt(max(base - 2 * float(best[0][0]), 0)))
            else:
                open_ = np.flatnonzero(gap - node.radius <= reach + margin)
                self.computed += len(open_)
                if not len(open_):
                    continue
                _, d = distances(node.at[open_])
                lows = np.maximum(d - node.radius[open_], 0)
                for i, dist, lo in zip(open_.tolist(), d.tolist(), lows.tolist()):
                    if lo <= reach + margin:
                        n += 1
                        heapq.heappush(queue, (lo, n, node.children[i], dist))
        # rows are in order of id
        return [(int(s), int(self.ids[-r])) for s, r in sorted(best, reverse=True)]


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Rows of integers: as doubles if their inner products are exact that way."""
    x = np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, 0))
    most = float(np.abs(x).max()) if x.size else 0.0
    if x.size and most * most * x.shape[1] * 4 >= 2 ** 53:
        return np.array([[int(v) for v in row] for row in x], dtype=object)
    return x


def integer_vectors(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """vec_id, dim and ``v``: floor(scale * component) as doubles; only vectors that take part."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(~odd & (F.size("v") > 0))
    floored = F.transform("v", lambda c: F.floor(c * scale).cast("double"))
    return rows.select("vec_id", F.size("v").alias("dim"), floored.alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, tree_rows: int = TREE_ROWS,
          query_block: int = QUERY_BLOCK, page: int = PAGE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best vectors; inputs as ``integer_vectors`` makes them."""
    trees = vectors.groupBy("dim").count().collect()  # one row a dimension
    blocks = {r["dim"]: max(1, -(-r["count"] // tree_rows)) for r in trees}
    if not blocks:
        blocks = {0: 1}
    spark = vectors.sparkSession
    sizes = F.broadcast(spark.createDataFrame(list(blocks.items()), "dim int, trees int"))
    n_queries = queries.count()
    parts = max(1, -(-n_queries // query_block))
    dealt = vectors.join(sizes, "dim").select(
        "dim", F.pmod(F.xxhash64("vec_id"), F.col("trees")).cast("int").alias("tree"),
        F.col("vec_id").alias("id"), "v", F.lit(0).alias("kind"))
    # fresh columns: both sides may come from one table
    asked = queries.select(*[F.col(c).alias(c) for c in ("vec_id", "dim", "v")]).join(sizes, "dim").select(
        F.col("dim").alias("dim"), F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"),
        F.col("vec_id").alias("id"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"))

    def answer(rows: pd.DataFrame, asked_rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked_rows):
            tree = MTree(rows["id"].to_numpy("int64"), _matrix(rows["v"]), page)
            q = _matrix(asked_rows["v"])
            if q.dtype == object and tree.x.dtype != object:
                tree = MTree(rows["id"].to_numpy("int64"), np.array(tree.x.astype(int).tolist(), dtype=object), page)
            for own, vector in zip(asked_rows["id"].tolist(), q):
                out += [(own, vec, score) for score, vec in tree.search(vector, own, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    # the rows of a tree go to each of its blocks of queries, whose size is bounded as the tree's is
    trees_by_part = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = trees_by_part.groupBy("dim", "tree", "part").cogroup(asked.groupBy("dim", "tree", "part")).applyInPandas(
        answer, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def search_embeddings(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64,
                      every: int = 20, k: int = 20) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``; candidates all other rows."""
    rows = written(integer_vectors(embeddings, vec_id, vector, scale), "vectors")
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    return top_k(rows, queries, k)
