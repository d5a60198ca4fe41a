"""Proportion-controlled, cyclic, seeded multi-source mixing over epochs (ops 46-51).

Skew-safe by construction: a source may hold a third of all rows, so nothing
is partitioned by source.  Rows get a global rank under (source, md5 key) by
a range-partitioned index; the per-source start and size come from a
``groupBy(source)`` whose result has one row per source (the proportion
config, small and bounded), which is the only broadcast side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import col, seeded_hash
from tessera.functions.fixed import DEFAULT_SEED
from tessera.operators.order import dense_index


def concat_datasets(dfs: list[DataFrame], pos_col: str = "pos") -> DataFrame:
    """Union-all in list order (op 46).  ``pos`` becomes dense over the
    concatenation: file k's rows follow all rows of files 0..k-1.

    Each input's ``pos`` has to be dense already (0 to rows - 1); one that is
    not (rows were dropped since it was numbered) fails the job, since its
    rows would get places of the next file's.
    """
    tagged = [d.withColumn("_file", F.lit(i)) for i, d in enumerate(dfs)]
    union = reduce(lambda a, b: a.unionByName(b), tagged)
    # one row per input dataset: the running sum is a tiny single-partition window
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        union.groupBy("_file")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(pos_col).alias("_lo"), F.max(pos_col).alias("_hi"))
        .select("_file", F.when((F.col("_lo") == 0) & (F.col("_hi") == F.col("_n") - 1),
                                F.coalesce(F.sum("_n").over(before), F.lit(0)))
                .otherwise(F.raise_error(F.concat(F.lit("positions of input "), F.col("_file").cast("string"),
                                                  F.lit(" are not dense"))).cast("bigint")).alias("_off"))
    )
    return (
        union.join(F.broadcast(starts), "_file")
        .withColumn(pos_col, (F.col("_off") + F.col(pos_col)).cast("bigint"))
        .drop("_off")
        .withColumnRenamed("_file", "file_index")
    )


def check_proportions(props: DataFrame, ratio: str = "ratio") -> DataFrame:
    """Each ratio must lie in [0, 1] (op 7); a violation raises at run time."""
    ok = (col(ratio) >= 0) & (col(ratio) <= 1)
    return props.withColumn(
        ratio,
        F.when(ok, col(ratio)).otherwise(
            F.raise_error(F.concat(F.lit("invalid ratio for source "), F.col("source")))
        ),
    )


def shuffle_sources(rows: DataFrame, seed: int = DEFAULT_SEED, source: str = "source", key: str = "id") -> DataFrame:
    """Seeded shuffle inside each source (op 47): adds ``r`` in 0..N-1 and ``n_source``."""
    keyed = rows.withColumn("_h", seeded_hash(seed, source, key))
    ranked = dense_index(keyed, [source, "_h", key], "_g").drop("_h")
    from tessera.operators.tokens import lookup

    # one row per source: size-checked broadcast, hot/cold split beyond the bound
    spans = ranked.groupBy(source).agg(F.min("_g").alias("_g0"), F.count(F.lit(1)).alias("n_source"))
    return (
        lookup(ranked, spans, source, ["_g0", "n_source"], freq="n_source")
        .withColumn("r", (F.col("_g") - F.col("_g0")).cast("bigint"))
        .drop("_g", "_g0")
    )


def epoch_quota(n_rows, ratio) -> "F.Column":
    """int(N * ratio) on doubles, truncating (op 48): 100 * 0.29 -> 28."""
    return (col(n_rows).cast("double") * col(ratio).cast("double")).cast("bigint")


def mix_epochs(shuffled: DataFrame, props: DataFrame, epochs: int, source: str = "source") -> DataFrame:
    """Epoch e takes the next ``num`` rows of each shuffled source, cyclically (op 49).

    Row r of a source of size N is in epoch e iff pmod(r - e*num, N) < num.
    Each row is emitted once per epoch it belongs to (no join with an epoch
    table): a ``filter`` over the epoch numbers, then ``explode``.
    """
    from tessera.operators.tokens import lookup

    quota = props.select(source, "ratio")  # the proportion config: size-checked broadcast
    staged = (
        lookup(shuffled, quota, source, ["ratio"], freq=None)
        .where(F.col("ratio").isNotNull())
        .withColumn("num", epoch_quota("n_source", "ratio"))
    )
    last = max(int(epochs) - 1, 0)  # sequence(0, -1) would count down; zero epochs yield nothing
    e_list = F.filter(
        F.sequence(F.lit(0), F.lit(last)),
        lambda e: (e < F.lit(int(epochs)))
        & (F.pmod(F.col("r") - e.cast("bigint") * F.col("num"), F.col("n_source")) < F.col("num")),
    )
    out = staged.where(F.col("num") > 0).withColumn("epoch", F.explode(e_list))
    # the offset after an epoch that ends exactly at the source's end is the end itself, not 0: the next epoch
    # then takes all its rows from the start again
    done = F.col("epoch").cast("bigint") * F.col("num")
    start = F.when(done > 0, F.pmod(done - 1, F.col("n_source")) + 1).otherwise(F.lit(0).cast("bigint"))
    again = start + F.col("num") - F.col("n_source")
    return out.withColumn("epoch", F.col("epoch").cast("bigint")).withColumn("wrapped", F.col("r") < again)


def shuffle_epoch(mixed: DataFrame, seed: int = DEFAULT_SEED, source: str = "source", key: str = "id") -> DataFrame:
    """Shuffle the rows of each epoch; epochs are written back to back (op 50).
    Adds ``out_pos`` (global line number of the output)."""
    keyed = mixed.withColumn("_h", seeded_hash(seed, "epoch", source, key))
    return dense_index(keyed, ["epoch", "_h", source, key], "out_pos").drop("_h")


def mix_report(mixed: DataFrame, source: str = "source") -> DataFrame:
    """Rows and cyclically re-used rows per (epoch, source) (op 51)."""
    return mixed.groupBy("epoch", source).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("wrapped").cast("bigint")).alias("reused"),
    )


def mix_permuted(rows: DataFrame, props: DataFrame, epochs: int, seed: int = DEFAULT_SEED, source: str = "source",
                 place: str = "at") -> DataFrame:
    """Ops 47-50 without a sort or an exchange of rows: (``epoch``, ``out_pos``) for every row an epoch takes.

    ``place`` is the row's dense place in its source (any order).  The shuffle of
    a source is a keyed permutation of its places; an epoch takes the next
    ``num`` of them, cyclically; the rows of an epoch get dense places (sources
    in order of name, then the order they are taken in) and the epoch's own
    permutation of those.  Epochs lie back to back.  What is joined to the rows
    is one line per source: its size, quota and offset, size-checked.
    """
    from tessera.operators.permute import keys_column, permuted
    from tessera.operators.tokens import lookup

    sizes = rows.groupBy(source).agg(F.count(F.lit(1)).alias("n_source"))
    quota = sizes.join(props.select(source, "ratio"), source).withColumn("num", epoch_quota("n_source", "ratio"))
    # one line per source: a small window
    before = Window.orderBy(source).rowsBetween(Window.unboundedPreceding, -1)
    quota = quota.withColumn("_off", F.coalesce(F.sum("num").over(before), F.lit(0)).cast("bigint"))
    quota = quota.withColumn("_all", F.sum("num").over(Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)).cast("bigint"))
    quota = quota.where("num > 0").select(source, "ratio", "n_source", "num", "_off", "_all")
    from tessera.operators.order import materialise_scratch

    quota = materialise_scratch(quota, "mix-quota")
    facts = ["n_source", "num", "_off", "_all"]
    known = lookup(rows, quota, source, facts, freq="num").where(F.col("num").isNotNull())
    known = known.withColumn("r", permuted(place, F.col("n_source"), keys_column(seed, F.col(source))))
    e = F.sequence(F.lit(0), F.lit(max(int(epochs) - 1, 0)))
    turn = lambda i: F.pmod(F.col("r") - i.cast("bigint") * F.col("num"), F.col("n_source"))
    taken = F.filter(e, lambda i: (i < F.lit(int(epochs))) & (turn(i) < F.col("num")))
    out = known.withColumn("epoch", F.explode(taken)).withColumn("epoch", F.col("epoch").cast("bigint"))
    line = F.col("_off") + turn(F.col("epoch"))
    out = out.withColumn("out_pos", F.col("epoch") * F.col("_all") + permuted(
        line, F.col("_all"), keys_column(seed, "epoch", F.col("epoch"))))
    return out.drop("_off", "_all")
