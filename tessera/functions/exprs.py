"""Small column-expression helpers shared by operators and queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ids_text(c) -> Column:
    """Integer array -> 'a b c' (the portable way to compare lists across engines)."""
    return F.array_join(F.transform(col(c), lambda x: x.cast("string")), " ")


def ids_digest(c) -> Column:
    return F.md5(ids_text(c))


def tokens_digest(c) -> Column:
    return F.md5(F.array_join(col(c), " "))


def seeded_hash(seed, *parts) -> Column:
    """md5 of 'seed:part1:part2…' — the portable, reproducible random key."""
    pieces = [F.lit(str(seed))]
    for p in parts:
        pieces.append(F.lit(":"))
        pieces.append(col(p).cast("string"))
    return F.md5(F.concat(*pieces))


def rounded(c, places: int = 6) -> Column:
    return F.round(col(c).cast("double"), places)
