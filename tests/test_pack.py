"""Packing (op 35) against a sequential spec of 'concatenate the batch, cut into L'."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.order import assign_map_batches
from tessera.operators.pack import pack, sort_by_length


def spec_shards(n_rows, workers):
    q, m = divmod(n_rows, workers)
    out, start = [], 0
    for s in range(workers):
        size = q + (1 if s < m else 0)
        out.append(list(range(start, start + size)))
        start += size
    return out


def spec_pack(lists, L, batch, workers, keep_tail=False):
    chunks = []
    for s, rows in enumerate(spec_shards(len(lists), workers)):
        for b in range(0, len(rows), batch):
            flat = list(itertools.chain(*[lists[i] for i in rows[b:b + batch]]))
            total = len(flat)
            if total >= L and not keep_tail:
                total = (total // L) * L
            for c, i in enumerate(range(0, total, L)):
                chunks.append((s, b // batch, c, flat[i:i + L]))
    return sorted(chunks)


def run_pack(spark, lists, L, batch, workers, keep_tail=False):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "pos bigint, input_ids array<int>")
    df = df.withColumn("labels", F.col("input_ids"))
    out = pack(assign_map_batches(df, batch, workers, n_rows=len(lists)), L, keep_tail=keep_tail)
    rows = out.select("shard", "batch", "chunk", "input_ids", "labels").collect()
    for r in rows:
        assert r.input_ids == r.labels
    return sorted((r.shard, r.batch, r.chunk, list(r.input_ids)) for r in rows)


CASES = [
    ([], 4, 3, 1),                                   # nothing
    ([[1, 2, 3]], 4, 3, 1),                          # 0 < T < L: one short chunk
    ([[1, 2], [3, 4]], 4, 3, 1),                     # T = L
    ([[1, 2], [3, 4, 5]], 4, 3, 1),                  # T = L + 1: tail dropped
    ([list(range(14))], 4, 3, 1),                    # one document longer than 3L
    ([[1, 2, 3], [], [], [4, 5, 6, 7, 8]], 4, 2, 1),  # empty documents between full ones
    ([[i] * (i % 5) for i in range(23)], 4, 5, 2),   # last batch shorter, two shards
    ([[1], [2, 3]], 2, 8, 5),                        # more workers than rows
    ([[]], 3, 1, 1),                                 # T = 0 batch
]


@pytest.mark.parametrize("lists,L,batch,workers", CASES)
def test_pack_matches_spec(spark, lists, L, batch, workers):
    assert run_pack(spark, lists, L, batch, workers) == spec_pack(lists, L, batch, workers)


def test_pack_random_and_keep_tail(spark):
    rng = random.Random(7)
    lists = [[rng.randrange(50) for _ in range(rng.randrange(0, 30))] for _ in range(60)]
    for L, batch, workers in [(8, 7, 3), (16, 100, 1), (5, 4, 4)]:
        assert run_pack(spark, lists, L, batch, workers) == spec_pack(lists, L, batch, workers)
    assert run_pack(spark, lists, 8, 7, 3, True) == spec_pack(lists, 8, 7, 3, True)


def test_pack_conserves_tokens(spark):
    rng = random.Random(3)
    lists = [[1] * rng.randrange(0, 40) for _ in range(50)]
    L, batch = 16, 6
    got = sum(len(c[3]) for c in run_pack(spark, lists, L, batch, 1))
    expect = 0
    for b in range(0, 50, batch):
        t = sum(len(x) for x in lists[b:b + batch])
        expect += (t // L) * L if t >= L else t
    assert got == expect


def test_sort_by_length_is_stable(spark):
    rows = [(0, 0, 0, 3), (1, 0, 0, 1), (2, 0, 0, 3), (3, 0, 0, 1), (4, 0, 1, 2), (5, 0, 1, 2)]
    df = spark.createDataFrame(rows, "pos bigint, shard bigint, batch bigint, n bigint")
    out = sort_by_length(df, "n").orderBy("out_pos").select("pos", "rank_in_batch").collect()
    assert [r.pos for r in out] == [1, 3, 0, 2, 4, 5]
    assert [r.rank_in_batch for r in out] == [0, 1, 2, 3, 0, 1]


def test_pack_plan_has_single_exchange_after_encode(spark):
    df = spark.createDataFrame([(i, [1] * i) for i in range(20)], "pos bigint, input_ids array<int>")
    df = df.withColumn("labels", F.col("input_ids"))
    out = pack(assign_map_batches(df, 5, 2, n_rows=20), 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
