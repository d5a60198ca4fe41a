"""Batch collation and sequence bookkeeping (ops 40-45).

Every per-batch quantity is a window partitioned by the batch id, so a group
never exceeds one training batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import col
from tessera.functions.fixed import IGNORE_INDEX


def collate_pad(df: DataFrame, pad_id: int, batch_col: str = "batch_id", ids: str = "input_ids",
                labels: str = "labels") -> DataFrame:
    """Right-pad ids with ``pad_id`` and labels with -100 to the batch maximum (op 40).

    ``attention_mask`` = ids <> pad_id, so genuine tokens equal to the pad id
    are masked too (the reference's behaviour).
    """
    w = Window.partitionBy(batch_col)
    n = F.size(col(ids))
    staged = df.withColumn("_n", n).withColumn("_m", F.max(n).over(w))
    gap = F.col("_m") - F.col("_n")
    return (
        staged.withColumn(ids, F.concat(col(ids), F.array_repeat(F.lit(int(pad_id)), gap)))
        .withColumn(labels, F.concat(col(labels), F.array_repeat(F.lit(IGNORE_INDEX), gap)))
        .withColumn("attention_mask", F.transform(col(ids), lambda x: x != F.lit(int(pad_id))))
        .drop("_n", "_m")
    )


def padding_stats(df: DataFrame, batch_col: str = "batch_id", length_col: str = "n") -> DataFrame:
    """Per batch: rows, real tokens, padded tokens and fill ratio (op 41)."""
    return (
        df.groupBy(batch_col)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(col(length_col)).cast("bigint").alias("real_tokens"),
            (F.count(F.lit(1)) * F.max(col(length_col))).cast("bigint").alias("padded_tokens"),
        )
        .withColumn("fill", F.round(F.try_divide(F.col("real_tokens"), F.col("padded_tokens")), 6))
    )


def fill_ratio(stats: DataFrame) -> DataFrame:
    return stats.agg(F.round(F.try_divide(F.sum("real_tokens"), F.sum("padded_tokens")), 6).alias("fill"))


def unpad_offsets(df: DataFrame, batch_col: str = "batch_id", order_col: str = "order_idx",
                  mask: str = "attention_mask") -> DataFrame:
    """Per row of a padded batch: real length, running offset (where the row
    starts among the batch's real tokens), batch max length and the flat
    indices of real tokens in the row-major batch (op 42).  ``cu_seqlens``
    gives a batch's offsets with their closing total."""
    ordered = Window.partitionBy(batch_col).orderBy(order_col)
    whole = Window.partitionBy(batch_col)
    seqlen = F.size(F.filter(col(mask), lambda x: x))
    width = F.size(col(mask))
    staged = (
        df.withColumn("seqlen", seqlen.cast("bigint"))
        .withColumn("row_in_batch", (F.row_number().over(ordered) - 1).cast("bigint"))
        .withColumn("cu_offset", (F.sum("seqlen").over(ordered) - F.col("seqlen")).cast("bigint"))
        .withColumn("max_seqlen", F.max("seqlen").over(whole).cast("bigint"))
    )
    flat = F.filter(
        F.transform(col(mask), lambda x, j: F.when(x, F.col("row_in_batch") * width + j)),
        lambda v: v.isNotNull(),
    )
    return staged.withColumn("indices", flat)


def cu_seqlens(df: DataFrame, batch_col: str = "batch_id", order_col: str = "order_idx",
               mask: str = "attention_mask") -> DataFrame:
    """Per batch: ``cu_seqlens`` (0, then the running sum of real lengths, so its last entry is the
    batch's number of real tokens), ``max_seqlen`` and ``total`` (op 42)."""
    lens = df.select(batch_col, F.struct(F.col(order_col).alias("o"),
                                         F.size(F.filter(col(mask), lambda x: x)).cast("bigint").alias("n")).alias("_r"))
    rows = lens.groupBy(batch_col).agg(F.array_sort(F.collect_list("_r")).alias("_r"))  # one training batch
    start = F.array(F.lit(0).cast("bigint"))
    cu = F.aggregate("_r", start, lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + r["n"])))
    return rows.select(batch_col, cu.alias("cu_seqlens"), F.array_max(F.transform("_r", lambda r: r["n"])).alias("max_seqlen")) \
        .withColumn("total", F.element_at("cu_seqlens", -1))


def last_token_index(ids, pad_id: int) -> Column:
    """Index of the first pad minus one, modulo the length; no pad -> last index (op 43)."""
    first_pad = F.greatest(F.array_position(col(ids), int(pad_id)) - 1, F.lit(0))
    n = F.size(col(ids))
    # an empty row has no last token (and pmod by 0 raises under ANSI): NULL
    return F.when(n > 0, F.pmod(first_pad - 1, n)).cast("bigint")


def shifted_labels(labels) -> Column:
    """labels[1:] — position i predicts token i+1 (op 44)."""
    n = F.size(col(labels))
    return F.slice(col(labels), 2, F.greatest(n - 1, F.lit(0)))


def supervised_count(labels) -> Column:
    return F.size(F.filter(col(labels), lambda x: x != F.lit(IGNORE_INDEX))).cast("bigint")


def supervision_stats(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Per sample: length, supervised tokens (raw and shifted), fully-masked flag (op 45)."""
    shifted = shifted_labels(labels)
    return (
        df.withColumn("n_tokens", F.size(col(labels)).cast("bigint"))
        .withColumn("n_supervised", supervised_count(labels))
        .withColumn("n_supervised_shifted", supervised_count(shifted))
        .withColumn("fully_masked", F.col("n_supervised_shifted") == 0)
    )
