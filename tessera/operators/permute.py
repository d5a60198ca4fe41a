"""Seeded permutations without a sort: a keyed bijection on 0..n-1 (ops 38, 47, 50).

A place is written as a pair (left, right) on a grid of ``a`` x ``b`` cells with
a = ceil(sqrt(n)), b = ceil(n / a), so fewer than ``a`` cells are too many.
Rounds of a Feistel network move the pair: by turns the left part is shifted
by a keyed function of the right one, modulo ``a``, and the right part by one
of the left, modulo ``b``; each round can be undone, so all of them are a
bijection of the grid.  A place that lands on a cell beyond n - 1 walks on
until it is inside (the cycle it lies on comes back to a place inside), which
makes the walk a bijection of 0..n-1.

Everything is integer arithmetic on columns, row by row: a shuffle costs no
exchange, and a place's new position can be had without the other rows.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.exprs import col

ROUNDS = 6
PRIME = (1 << 31) - 1
FACTORS = (1_103_515_245, 1_566_083_941)      # below the prime, so products of parts below 2^31 fit a long
MAX_WALK = 64


def round_keys(seed) -> list[int]:
    """A key of 28 bits for every round: the first seven hex digits of md5(seed:perm:round)."""
    return [int(hashlib.md5(f"{seed}:perm:{i}".encode()).hexdigest()[:7], 16) for i in range(ROUNDS)]


def _scrambled(v: Column, key: Column) -> Column:
    first = (v * FACTORS[0] + key) % PRIME
    return (first.bitwiseXOR(F.shiftright(first, 13)) * FACTORS[1] + key) % PRIME


def permuted(place, n, keys) -> Column:
    """New place of ``place`` (0-based) among ``n``; ``n`` a column or number up to 2^62 / 4.

    ``keys``: round keys (``round_keys``), numbers or an array column of them.
    Fails if a place does not come back in ``MAX_WALK`` walks: never for n up to
    4,096, and for larger n less likely than 1 in 64 to the 64th.
    """
    x = col(place).cast("bigint")
    n = (n if isinstance(n, Column) else F.lit(int(n))).cast("bigint")
    k = keys if isinstance(keys, Column) else F.array(*[F.lit(int(v)).cast("bigint") for v in keys])
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("bigint"), F.lit(1))
    b = F.greatest(F.ceil(n / a).cast("bigint"), F.lit(1))

    def walk(here: Column, a: Column, b: Column) -> Column:
        steps = F.transform(k, lambda key, i: F.struct(key.alias("key"), i.alias("i")))

        def turn(p: Column, step: Column) -> Column:
            left, right = F.floor(p / b).cast("bigint"), p % b
            return F.when(step["i"] % 2 == 0, ((left + _scrambled(right, step["key"])) % a) * b + right).otherwise(
                left * b + (right + _scrambled(left, step["key"])) % b)

        return F.aggregate(steps, here, turn)

    # bound once: a, b and n come in as one struct, which every step of the walk reads
    sizes = F.array(F.struct(a.alias("a"), b.alias("b"), n.alias("n"), x.alias("x")))

    def whole(z: Column) -> Column:
        first = walk(z["x"], z["a"], z["b"])
        return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_WALK)), first,
                           lambda p, _: F.when(p < z["n"], p).otherwise(walk(p, z["a"], z["b"])))

    out = F.transform(sizes, whole)[0]
    inside = F.when((x >= 0) & (x < n), out)
    return F.when(inside < n, inside).when(x.isNotNull() & n.isNotNull(), F.raise_error(
        F.concat(F.lit("no place for "), x.cast("string"), F.lit(" among "), n.cast("string"))).cast("bigint"))


def keys_column(*parts) -> Column:
    """Round keys of a seed that differs by row: ``parts`` joined by ':' (columns or constants)."""
    pieces = []
    for p in parts:
        pieces += [F.lit(":"), (p if isinstance(p, Column) else F.lit(str(p))).cast("string")]
    seed = F.concat(*pieces[1:])
    return F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda i: F.conv(F.substring(
        F.md5(F.concat(seed, F.lit(":perm:"), i.cast("string"))), 1, 7), 16, 10).cast("bigint"))


def grid(n: int) -> tuple[int, int]:
    """The grid of ``permuted`` for a number, for tests: (a, b)."""
    a = max(1, math.ceil(math.sqrt(n)))
    return a, max(1, math.ceil(n / a))
