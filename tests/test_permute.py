"""Permutations by a keyed bijection (ops 38, 47, 50)."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.permute import FACTORS, PRIME, ROUNDS, grid, keys_column, permuted, round_keys


def spec(x, n, keys):
    a, b = grid(n)

    def f(v, key):
        t = (v * FACTORS[0] + key) % PRIME
        return ((t ^ (t >> 13)) * FACTORS[1] + key) % PRIME

    while True:
        for i, key in enumerate(keys):
            left, right = divmod(x, b)
            if i % 2 == 0:
                left = (left + f(right, key)) % a
            else:
                right = (right + f(left, key)) % b
            x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4096])
def test_every_place_is_taken_once(spark, n):
    keys = round_keys("s%d" % n)
    got = {r.id: r.p for r in spark.range(n).select("id", permuted("id", n, keys).alias("p")).collect()}
    assert sorted(got.values()) == list(range(n)) and got == {i: spec(i, n, keys) for i in range(n)}
    by_row = spark.range(n).select("id", permuted("id", F.lit(n), keys_column("s%d" % n)).alias("p")).collect()
    assert {r.id: r.p for r in by_row} == got


def test_large_numbers_seeds_and_spread(spark):
    rng = random.Random(1)
    n = 3 * 10 ** 14 + 7
    places = [0, 1, n - 1] + [rng.randrange(n) for _ in range(300)]
    df = spark.createDataFrame([(p,) for p in places], "x bigint")
    for seed in (1, 2):
        keys = round_keys(seed)
        assert [r.p for r in df.select(permuted("x", n, keys).alias("p")).collect()] == [spec(p, n, keys) for p in places]
    m = 20000
    a = [r.p for r in spark.range(m).select(permuted("id", m, round_keys(1)).alias("p")).collect()]
    b = [r.p for r in spark.range(m).select(permuted("id", m, round_keys(2)).alias("p")).collect()]
    assert sum(x == y for x, y in zip(a, b)) < 20 and sum(x == i for i, x in enumerate(a)) < 20
    mean = sum(a[: m // 10]) / (m // 10)                     # a tenth of the rows lies everywhere
    assert abs(mean - m / 2) < m / 50 and len(round_keys(1)) == ROUNDS
    neighbours = sum(abs(x - y) < m / 10 for x, y in zip(a, a[1:])) / m
    assert abs(neighbours - 0.19) < 0.03


def test_outside_and_null(spark):
    df = spark.createDataFrame([(None, 5), (2, None)], "x bigint, n bigint")
    assert [r.p for r in df.select(permuted("x", F.col("n"), round_keys(1)).alias("p")).collect()] == [None, None]
    with pytest.raises(Exception, match="no place"):
        spark.range(3).select(permuted("id", 2, round_keys(1)).alias("p")).collect()
