"""Approximate nearest neighbours by inner product: vantage-point trees per shard.

Inner product becomes a metric by one more coordinate: with M the largest
squared length among a tree's vectors, x gets sqrt(M - |x|^2) and a query 0,
so |q - x|^2 = |q|^2 + M - 2 <q, x>, and the nearest vectors are those of the
largest inner products.

An inner node holds a vantage point and, for its near and its far half, the
least and the largest distance to that point.  If a query is at distance d of
the point, no vector of a half whose distances lie in [lo, hi] is nearer than
``low = max(lo - d, d - hi)`` (triangle inequality).  A half is left out if
``factor * low`` exceeds the distance of the k-th best found so far: factor 1
loses nothing (the search is exact), larger factors skip halves whose bound
comes close.  A block of queries goes down a tree together; each query visits
the half first in which it lies.

On Spark: vectors are dealt row by row into shards of bounded size; each
shard's tree is built once and written as one row of bytes to the shared
folder (the index; it holds every vector).  Queries are dealt into blocks and
every tree meets every block: a stated set of queries against all rows, in
blocks.  A tree's bytes go to each block of queries, and a group holds one tree
and one block.  Each pair sends back at most k rows a query, merged by rank.

``FACTOR`` is 4.  ``recall`` measures what it costs, against brute force; on
vectors spread evenly over a sphere of 64 dimensions 0.996 or more of the 20
nearest are found at 4, 0.86 at 8 and 0.6 at 12, and few halves can be left out
at any factor (their bounds tell little); tight clusters are what it prunes.

Edge cases: vectors that are NULL, zero or hold NULL, NaN or infinite
components, and rows without an id, take no part; vectors meet those of the
same dimension only; equal vectors are one place in a tree with their smallest
ids (no more than 2k rows can be among a query's k nearest); ties go to
the smaller id; of repeated ids every row counts, a query asks once and leaves
out all rows of its own id; fewer than k candidates give all of them; a table
without vectors gives no rows; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

SHARD_ROWS = 8192      # vectors of a tree, on average
QUERY_BLOCK = 4096     # queries of a block, on average
LEAF = 128             # vectors of a leaf, at most
FACTOR = 4.0           # 1: exact
SEED = 11
FOUND = "query_id long, vec_id long, score double"


class VPTree:
    """Tree over the distinct rows of ``x``; ``groups`` are the ids of each row, ascending."""

    FIELDS = ("x", "starts", "ids", "place", "node")

    def __init__(self, x, starts, ids, place, node):
        # x: distinct vectors in leaf order; ids[starts[i]:starts[i + 1]] belong to row i
        # node rows: vantage row (-1: leaf), near child, far child, first and end place, lo and hi of both halves
        self.x, self.starts, self.ids, self.place, self.node = x, starts, ids, place, node
        squares = (x * x).sum(axis=1)
        self.most = float(squares.max(initial=0.0))
        self.extra = np.sqrt(np.maximum(self.most - squares, 0))
        # above the rounding of a distance that comes from a difference of squares
        self.margin = 1e-6 * (1 + self.most ** 0.5)

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, k: int, leaf: int = LEAF) -> VPTree:
        """Of equal vectors the 2k smallest ids are held, of repeated ids k: what a query's own id leaves is enough."""
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]).any(axis=1)
        new_id = new.copy()
        new_id[1:] |= ids[1:] != ids[:-1]
        some = cls._rank(new_id) < k
        ids, x, new = ids[some], x[some], new[some]
        some = cls._rank(new) < 2 * k
        ids, x, new = ids[some], x[some], new[some]
        starts = np.append(np.flatnonzero(new), len(x))
        x = x[new]
        squares = (x * x).sum(axis=1)
        full = np.column_stack([x, np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0))])
        rng = np.random.default_rng(SEED)
        place = np.arange(len(x))
        node: list[list[float]] = []
        todo = [(0, len(x), -1, 0)]               # first and end place, parent and which child
        while todo:
            a, b, parent, side = todo.pop()
            me = len(node)
            if parent >= 0:
                node[parent][1 + side] = me
            node.append([-1, -1, -1, a, b, 0, 0, 0, 0])
            if b - a <= leaf:
                continue
            rows = place[a:b]
            point = cls._vantage(full, rows, rng)
            d = np.sqrt(np.maximum(((full[rows] - full[point]) ** 2).sum(axis=1), 0))
            half = (b - a) // 2
            by = np.argpartition(d, half)
            place[a:b], d = rows[by], d[by]
            node[me][0] = point
            node[me][5:] = [d[:half].min(), d[:half].max(), d[half:].min(), d[half:].max()]
            todo += [(a, a + half, me, 0), (a + half, b, me, 1)]
        return cls(x, starts, ids, place, np.array(node))

    @staticmethod
    def _rank(new: np.ndarray) -> np.ndarray:
        """Place of each row in its run; ``new`` marks the first rows of runs."""
        at = np.arange(len(new))
        return at - np.maximum.accumulate(np.where(new, at, 0))

    @staticmethod
    def _vantage(full: np.ndarray, rows: np.ndarray, rng) -> int:
        """Of a few rows the one whose distances to some others differ most."""
        some = rng.choice(rows, size=min(len(rows), 8), replace=False)
        others = rng.choice(rows, size=min(len(rows), 48), replace=False)
        d = np.sqrt(((full[some][:, None] - full[others][None]) ** 2).sum(axis=2))
        return int(some[d.std(axis=1).argmax()])

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> VPTree:
        with np.load(io.BytesIO(raw)) as held:
            return cls(*[held[f] for f in cls.FIELDS])

    def search(self, own: np.ndarray, q: np.ndarray, k: int,
               factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, ids and scores: each query's k nearest found, without its own id."""
        n = len(q)
        q2 = (q * q).sum(axis=1)
        base = q2 + self.most
        margin = self.margin + 1e-6 * np.sqrt(q2)
        # k + 1 distinct vectors (one may be the query's own) and some more: scores differ in their last digits here
        wide = k + 9
        best = np.full((n, wide), -np.inf)
        rows = np.full((n, wide), -1)
        reach = np.full(n, np.inf)
        self.computed = 0

        def look(at: int, who: np.ndarray) -> None:
            """Queries ``who`` go down from node ``at``."""
            point, near, far, a, b, *edges = self.node[at]
            if point < 0:
                here = self.place[int(a):int(b)]
                self.computed += len(here) * len(who)
                scores = q[who] @ self.x[here].T
                both = np.concatenate([best[who], scores], axis=1)
                at_row = np.concatenate([rows[who], np.broadcast_to(here, scores.shape)], axis=1)
                top = np.argpartition(-both, wide - 1, axis=1)[:, :wide]
                best[who] = np.take_along_axis(both, top, axis=1)
                rows[who] = np.take_along_axis(at_row, top, axis=1)
                # one of k + 1 may be the query's own vector
                kth = np.partition(best[who], wide - k - 1, axis=1)[:, wide - k - 1]
                reach[who] = np.where(np.isinf(kth), np.inf, np.sqrt(np.maximum(base[who] - 2 * kth, 0)))
                return
            self.computed += len(who)
            d = np.sqrt(np.maximum(base[who] - 2 * (q[who] @ self.x[int(point)]), 0))
            lows = [np.maximum(edges[0] - d, d - edges[1]), np.maximum(edges[2] - d, d - edges[3])]
            first_near = lows[0] <= lows[1]
            child = (int(near), int(far))
            for side, mine in ((0, first_near), (1, ~first_near)):
                for half in (side, 1 - side):
                    if mine.any():
                        ask = mine & (factor * lows[half] <= reach[who] + margin[who])
                        if ask.any():
                            look(child[half], who[ask])

        if len(self.x):
            look(0, np.arange(n))
        who, col = np.nonzero(rows >= 0)
        row = rows[who, col]
        # a row's products are added up alike wherever it lies, so equal vectors tie
        scores = np.concatenate([(self.x[row[i:i + 65536]] * q[who[i:i + 65536]]).sum(axis=1)
                                 for i in range(0, len(row), 65536)] or [np.zeros(0)])
        copies = self.starts[row + 1] - self.starts[row]
        again = np.repeat(np.arange(len(row)), copies)
        ids = self.ids[np.repeat(self.starts[row] - np.cumsum(copies) + copies, copies) + np.arange(len(again))]
        who, scores = who[again], scores[again]
        other = ids != own[who]
        who, scores, ids = who[other], scores[other], ids[other]
        order = np.lexsort((ids, -scores, who))
        who, scores, ids = who[order], scores[order], ids[order]
        new = np.ones(len(who), bool)
        new[1:] = who[1:] != who[:-1]
        top = self._rank(new) < k
        return own[who[top]], ids[top], scores[top]


def vectors_of(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, dim and ``v`` as doubles: only vectors that take part."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.where(~odd & F.exists("v", lambda c: c != 0)).select("vec_id", F.size("v").alias("dim"), "v")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks().flatten() if len(column) else pa.array([], pa.float64())
    return values.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def build_index(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS, leaf: int = LEAF) -> DataFrame:
    """dim, tree and its bytes: one row per shard, every vector in one; ``rows`` a written table."""
    sizes = {r["dim"]: max(1, -(-r["count"] // shard_rows)) for r in rows.groupBy("dim").count().collect()}
    shards = F.coalesce(*[F.when(F.col("dim") == d, F.lit(n)) for d, n in sizes.items()], F.lit(1))
    # by row, not by id or vector, so that nothing repeated makes a shard large
    row = F.xxhash64(F.monotonically_increasing_id())
    dealt = rows.select("dim", F.pmod(row, shards).cast("int").alias("tree"), "vec_id", "v")

    def tree(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        made = VPTree.build(held["vec_id"].to_numpy(), _matrix(held["v"]), k, leaf)
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "tree": pa.array([key[1].as_py()], pa.int32()),
                         "held": pa.array([made.to_bytes()], pa.binary())})

    return written(dealt.groupBy("dim", "tree").applyInArrow(tree, "dim int, tree int, held binary"), "vp-trees")


def nearest(index: DataFrame, queries: DataFrame, k: int, factor: float = FACTOR,
            query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found; queries as ``vectors_of`` makes them."""
    if factor < 1:
        raise ValueError(f"factor must be at least 1 (exact), got {factor}")
    blocks = max(1, -(-queries.count() // query_block))
    trees = index.groupBy("dim").agg(F.max("tree").alias("last")).collect()          # one row a dimension
    last = F.coalesce(*[F.when(F.col("dim") == r["dim"], F.lit(r["last"])) for r in trees], F.lit(-1))
    by = ["dim", "tree", "block"]
    asked = queries.select("dim", "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
                           last.alias("last")).where("last >= 0")
    asked = asked.withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    sent = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def answer(held: pa.Table, queries_: pa.Table) -> pa.Table:
        found = ([], [], [])
        if held.num_rows and queries_.num_rows:
            tree = VPTree.from_bytes(held["held"][0].as_py())
            found = tree.search(queries_["vec_id"].to_numpy(), _matrix(queries_["v"]), k, factor)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()),
                         "score": pa.array(found[2], pa.float64())})

    found = sent.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(answer, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def search_embeddings(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 20,
                      k: int = 20, factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``; candidates all other rows."""
    rows = written(vectors_of(embeddings, vec_id, vector), "vp-vectors")
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    return nearest(build_index(rows, k, shard_rows), queries, k, factor)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact answers (query_id, vec_id) that were found."""
    asked = exact.count()
    return found.join(exact, ["query_id", "vec_id"], "left_semi").count() / asked if asked else 1.0
