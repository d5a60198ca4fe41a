"""Sharding: best-fit-decreasing bin packing of indivisible groups into fixed-capacity shards.

Rows with equal texts form a group that must not be split.  Groups are sized
by a distributed aggregation.  A group larger than the grain (a fixed share
of all bytes) is an item of its own; there can be only ``1 / share`` of them.
All smaller groups are dealt by hash into ``buckets`` buckets, each an item
too, so the number of items has a bound that does not depend on the data.

Items enter in order of decreasing size the tightest shard that still has
room, found in a balanced search tree (here a treap) keyed by remaining
capacity.  ``best_fit_decreasing`` minimises the number of shards of a given
capacity; ``near_equal`` looks for the smallest capacity for which a given
number of shards is enough, which makes their sizes near equal.

Slots are gapless positions inside a shard.  Rows are numbered inside
hash parts of equal size, never inside a whole shard or group.

Edge cases: NULL text is an empty one (size 1, same group as "" texts); no
rows give no rows; one group over its fair share makes its shard larger than
the others, as groups are indivisible; repeated rows stay, each with a slot of
its own; other columns of the input are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_partitions, text_bytes, written

GRAIN_SHARE = 1 / 65_536
BUCKETS = 65_536
SEARCH_STEPS = 24


class FreeTree:
    """A treap of (remaining capacity, shard), to find the least remainder that is enough."""

    __slots__ = ("root", "rng")

    def __init__(self, seed: int = 0):
        self.root = None
        self.rng = random.Random(seed)

    def insert(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        node = [key, self.rng.random(), None, None]
        self.root = self._join(self._join(low, node), high)

    def pop_tightest(self, need: int) -> tuple[int, int] | None:
        """Remove and return the least key whose remainder is at least ``need``."""
        low, rest = self._split(self.root, (need, -1))
        if rest is None:
            self.root = low
            return None
        first = rest
        while first[2] is not None:
            first = first[2]
        key = first[0]
        _, rest = self._split(rest, (key[0], key[1] + 1))
        self.root = self._join(low, rest)
        return key

    def _split(self, node, key):
        """Nodes below ``key`` and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def _join(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            return [low[0], low[1], low[2], self._join(low[3], high)]
        return [high[0], high[1], self._join(low, high[2]), high[3]]


def best_fit_decreasing(sizes: list[int], capacity: int, at_most: int | None = None) -> list[int] | None:
    """Shard of each size (sizes descending, none over ``capacity``); None if over ``at_most`` shards."""
    free = FreeTree()
    n = 0
    out = []
    for size in sizes:
        found = free.pop_tightest(size)
        if found is None:
            if n == at_most:
                return None
            found, n = (capacity, n), n + 1
        left, shard = found
        out.append(shard)
        free.insert((left - size, shard))
    return out


def near_equal(sizes: list[int], shards: int) -> list[int]:
    """Shards of sizes (descending) under the least capacity found that needs at most ``shards``."""
    if not sizes:
        return []
    low = max(sizes[0], -(-sum(sizes) // shards))
    best = best_fit_decreasing(sizes, low, shards)
    if best is not None:
        return best
    # ``low - 1 + max(sizes)`` always suffices: a shard is passed over only when it is that full
    bad, good = low, low + sizes[0]
    best = best_fit_decreasing(sizes, good, shards)
    for _ in range(SEARCH_STEPS):
        if good - bad <= 1:
            break
        mid = (bad + good) // 2
        found = best_fit_decreasing(sizes, mid, shards)
        if found is None:
            bad = mid
        else:
            best, good = found, mid
    return best


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the text's group hash."""
    raw = docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("b"))
    return raw.select("doc_id", (F.octet_length("b") + 1).cast("long").alias("size"),
                      F.crc32("b").alias("text_crc32"), F.xxhash64("b").alias("grp"))


def assign(rows: DataFrame, shards: int, grain_share: float = GRAIN_SHARE, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` (with ``size`` and the group ``grp``) with ``shard``; a group's rows stay together.

    ``rows`` should be written: it is read more than once.
    """
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    grain = max(1, int(total * grain_share))
    bucket = F.pmod("grp", F.lit(buckets))
    own = F.col("bytes") > grain
    # at most 1 / grain_share groups exceed the grain, and ``buckets`` buckets hold the rest
    items = groups.groupBy(F.when(own, F.col("grp")).otherwise(bucket).alias("item"), own.alias("own")).agg(
        F.sum("bytes").alias("bytes")).collect()
    items.sort(key=lambda r: (-r["bytes"], r["own"], r["item"]))
    shard = near_equal([r["bytes"] for r in items], shards)
    spark = rows.sparkSession
    places = [(r["item"], r["own"], s) for r, s in zip(items, shard)]
    schema = "item long, own boolean, shard int"
    found = spark.createDataFrame(places, schema)
    big = F.broadcast(found.where("own").select(F.col("item").alias("grp"), F.col("shard").alias("_big")))
    small = F.broadcast(found.where("not own").select(F.col("item").alias("_bucket"), F.col("shard").alias("_small")))
    out = rows.withColumn("_bucket", bucket).join(big, "grp", "left").join(small, "_bucket", "left")
    return out.withColumn("shard", F.coalesce("_big", "_small")).drop("_bucket", "_big", "_small")


def with_slots(rows: DataFrame) -> DataFrame:
    """``rows`` with ``slot``: gapless positions from 0 inside each ``shard``.

    Rows are numbered inside (part, shard), where parts deal the rows out by
    hash; a count per part and shard gives the offsets.
    """
    n = shuffle_partitions(rows.sparkSession)
    part = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n)).cast("int")
    rows = rows.withColumn("_part", part)
    counts = rows.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy("_part", "shard").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("_at", F.row_number().over(within))
    # one row per part and shard
    out = numbered.join(F.broadcast(offsets), ["shard", "_part"])
    return out.withColumn("slot", F.col("_at") - 1 + F.col("_off")).drop("_part", "_at", "_off")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard under the law ``bytes``."""
    placed = assign(written(sized(docs), "sized"), shards)
    return with_slots(placed).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
