"""Packing token lists into fixed-length chunks (op 35) and length sorting (op 36).

Packing: inside each map batch, concatenate every row's lists in ``pos``
order and cut the stream into ``L``-token chunks.  If the batch holds at least
``L`` tokens the ragged tail is dropped; a batch shorter than ``L`` yields one
short chunk; an empty batch yields nothing.

Plan: one Exchange on (shard, batch).  A running sum of lengths gives each
row its offset in the batch stream; each row emits one (chunk, slice) piece
per chunk it overlaps (built by ``transform`` so only the slice is copied);
the pieces are regrouped by (shard, batch, chunk), which is already satisfied
by the window's partitioning.  No per-token explode, and no group holds more
than one batch (window) or ``L`` tokens (chunk).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.order import index_in_groups


def pack(
    df: DataFrame,
    max_len: int,
    list_cols: tuple[str, ...] = ("input_ids", "labels"),
    group_cols: tuple[str, ...] = ("shard", "batch"),
    pos_col: str = "pos",
    keep_tail: bool = False,
) -> DataFrame:
    if max_len <= 0:
        raise ValueError("max_len must be positive")
    L = F.lit(int(max_len))
    first = list_cols[0]
    ordered = Window.partitionBy(*group_cols).orderBy(pos_col)
    whole = Window.partitionBy(*group_cols)
    staged = (
        df.select(*group_cols, pos_col, *list_cols)
        .withColumn("_n", F.coalesce(F.size(first), F.lit(0)).cast("bigint"))
        .withColumn("_n", F.when(F.col("_n") < 0, F.lit(0)).otherwise(F.col("_n")))
        .withColumn("_end", F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_total", F.sum("_n").over(whole))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )
    if keep_tail:
        kept = F.col("_total")
    else:
        kept = F.when(F.col("_total") >= L, F.floor(F.col("_total") / L) * L).otherwise(F.col("_total"))
    staged = staged.withColumn("_stop", F.least(F.col("_end"), kept))

    def piece(c):
        lo = F.greatest(c * L, F.col("_start"))
        hi = F.least((c + 1) * L, F.col("_stop"))
        fields = [c.alias("chunk"), lo.alias("lo")]
        for name in list_cols:
            fields.append(F.slice(F.col(name), (lo - F.col("_start") + 1).cast("int"), (hi - lo).cast("int")).alias(name))
        return F.struct(*fields)

    chunks = F.when(
        F.col("_stop") > F.col("_start"),
        F.transform(
            F.sequence(F.floor(F.col("_start") / L), F.floor((F.col("_stop") - 1) / L)),
            piece,
        ),
    )
    pieces = staged.select(*group_cols, F.explode(chunks).alias("p")).select(*group_cols, "p.*")
    packed = pieces.groupBy(*group_cols, "chunk").agg(
        F.array_sort(F.collect_list(F.struct("lo", *list_cols))).alias("_s")
    )
    out = packed.select(
        *group_cols,
        F.col("chunk").cast("bigint").alias("chunk"),
        *[F.flatten(F.transform("_s", _field(name))).alias(name) for name in list_cols],
    )
    return out.withColumn("n_tokens", F.size(first).cast("bigint"))


def _field(name: str):
    return lambda x: x[name]


def sort_by_length(
    df: DataFrame,
    length_col: str = "n",
    group_cols: tuple[str, ...] = ("shard", "batch"),
    pos_col: str = "pos",
    out_pos: str | None = "out_pos",
) -> DataFrame:
    """Ascending length inside each batch, ties in arrival order (a stable sort).

    Adds ``rank_in_batch``; with ``out_pos`` also the dense output position
    (batches back to back): the ranked rows are written once and get their
    batch's offset, which comes from the sizes of the batches alone.
    """
    w = Window.partitionBy(*group_cols).orderBy(F.col(length_col), F.col(pos_col))
    ranked = df.withColumn("rank_in_batch", (F.row_number().over(w) - 1).cast("bigint"))
    if out_pos:
        ranked = index_in_groups(ranked, list(group_cols), "rank_in_batch", out_pos)
    return ranked
