"""Row order as data: the dense ``pos`` index and batch planning (ops 34, 37-39).

DataFrames are unordered, so every ordered operator works on an explicit
0-based dense position.  A global ``row_number()`` with no partition runs in a
single task; ``dense_index`` instead range-partitions by the sort key, numbers
rows inside each partition, and adds per-partition offsets (a table with one
row per partition, the only thing broadcast).  The numbered rows are written
as parquet to the session's checkpoint folder first, so both passes see the
same partitioning even when a task is retried.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.exprs import col, seeded_hash
from tessera.functions.fixed import DEFAULT_SEED, MAP_BATCH_SIZE
from tessera.session import checkpoint_dir

# tables of groups or scan splits up to this many rows are broadcast (a path and four numbers a row)
BROADCAST_GROUPS = 200_000

_LOCAL_BITS = 33  # monotonically_increasing_id = (partition << 33) + row-in-partition


def dense_index(df: DataFrame, order: list, name: str = "idx", partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based rank of each row under ``order`` (which must be a total order)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    keys: list[Column] = [col(c) for c in order]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_ix_part", F.spark_partition_id())
        .withColumn("_ix_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
    )
    numbered = materialise_scratch(numbered, "dense-index")
    offsets = (
        numbered.groupBy("_ix_part")
        .agg(F.count(F.lit(1)).alias("_ix_n"))
        .withColumn(
            "_ix_off",
            F.coalesce(
                F.sum("_ix_n").over(Window.orderBy("_ix_part").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .select("_ix_part", "_ix_off")
    )
    # one row per partition: bounded by the partition count, safe to broadcast
    return (
        numbered.join(F.broadcast(offsets), "_ix_part")
        .withColumn(name, (F.col("_ix_off") + F.col("_ix_local")).cast("bigint"))
        .drop("_ix_part", "_ix_local", "_ix_off")
    )


def running_sum(df: DataFrame, order: list[str], value: str, out: str = "cum_before",
                partitions: int | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value`` over all rows before this one under
    ``order`` (a total order on plain columns).  Skew-proof: no group key.

    Range-partition and sort by ``order``; one pass per partition keeps a
    running total across its Arrow batches (``mapInPandas`` — an ordered scan
    has no built-in form that avoids a single-key window); the rows, with
    their partition id, are written once to the checkpoint folder; partition
    totals (one row per partition, the only broadcast) give the offsets.
    """
    import pandas as pd

    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = [f for f in df.schema.fields]
    schema = T.StructType(fields + [T.StructField("_rs_part", T.IntegerType()),
                                    T.StructField("_rs_local", T.LongType())])

    def scan(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        total = 0
        for pdf in batches:
            vals = pdf[value].fillna(0).astype("int64")
            before = vals.cumsum() - vals + total
            total += int(vals.sum())
            yield pdf.assign(_rs_part=part, _rs_local=before.astype("int64"))

    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(scan, schema)
    ranged = materialise_scratch(ranged, "running-sum")
    totals = ranged.groupBy("_rs_part").agg(F.sum(F.col(value)).alias("_rs_n"))
    offsets = totals.select(
        "_rs_part",
        F.coalesce(F.sum("_rs_n").over(Window.orderBy("_rs_part").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_rs_off"),
    )
    return (
        ranged.join(F.broadcast(offsets), "_rs_part")
        .withColumn(out, (F.col("_rs_off") + F.col("_rs_local")).cast("bigint"))
        .drop("_rs_part", "_rs_local", "_rs_off")
    )


def materialise_scratch(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Cuts lineage (a lost executor re-reads files instead of recomputing the
    upstream shuffle) and computes the upstream plan exactly once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    # the written schema, not inference: an empty result has no data files
    return spark.read.schema(df.schema).parquet(path)


def index_in_groups(df: DataFrame, group_cols: list[str], rank_col: str, name: str, first: int | None = 0) -> DataFrame:
    """Add ``name`` = dense position of each row when the groups, in order of
    ``group_cols``, lie back to back; ``rank_col`` is the row's dense place in its group,
    counted from ``first`` (None: from the group's smallest).

    ``df`` is written once.  What is ordered is one row per group (its size);
    the rows themselves get their group's offset by a join, a broadcast one
    where the number of groups is within the checked bound.
    """
    rows = materialise_scratch(df, "group-rows")
    low = F.min(rank_col) if first is None else F.lit(first)
    sizes = rows.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_g_n"), low.cast("bigint").alias("_g_low"))
    offsets = running_sum(sizes, list(group_cols), "_g_n", "_g_off").drop("_g_n")
    if sizes.count() <= BROADCAST_GROUPS:
        offsets = F.broadcast(offsets)
    return rows.join(offsets, list(group_cols)).withColumn(name, (F.col("_g_off") + F.col(rank_col) - F.col("_g_low")).cast("bigint")) \
        .drop("_g_off", "_g_low")


def number_lines(df: DataFrame, file_col: str = "_file", start_col: str = "_start") -> DataFrame:
    """Add ``pos`` (dense over all files, in order of file and line), ``in_file`` (line in
    the file), ``n_file`` (lines of the file) and, unless ``file_col`` is that already,
    ``file_index`` (rank of the file among those with rows).

    Rows are written where they were read and never exchanged: a scan reads a
    split's lines in order, so a line's place is its split's offset plus its
    place in the split.  Only the splits (file, block start, lines) are
    gathered, and ordered.
    """
    rows = materialise_scratch(df.withColumn("_row", F.monotonically_increasing_id()), "lines")
    splits = rows.groupBy(file_col, start_col).agg(F.count(F.lit(1)).cast("bigint").alias("_c"), F.min("_row").alias("_base"))
    # a row per scan split
    before = Window.orderBy(file_col, start_col).rowsBetween(Window.unboundedPreceding, -1)
    of_file = Window.partitionBy(file_col)
    splits = splits.select(
        file_col, start_col, "_base", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
        F.sum("_c").over(of_file).cast("bigint").alias("n_file"))
    splits = splits.withColumn("_first", F.min("_off").over(of_file))
    if file_col != "file_index":
        splits = splits.withColumn("file_index", (F.dense_rank().over(Window.orderBy(file_col)) - 1).cast("int"))
    splits = materialise_scratch(splits, "splits")
    side = F.broadcast(splits) if splits.count() <= BROADCAST_GROUPS else splits
    pos = F.col("_off") + F.col("_row") - F.col("_base")
    numbered = rows.join(side, [file_col, start_col])
    return numbered.withColumns({"pos": pos.cast("bigint"), "in_file": (pos - F.col("_first")).cast("bigint")}).drop(
        "_row", "_base", "_off", "_first")


def with_pos(df: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """Dense arrival position from the given ordering columns (e.g. file path, line number)."""
    return dense_index(df, order, name)


def task_slots(spark) -> int:
    """Tasks that can run at once."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - Spark Connect
        return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` itself where it is read in at least as many partitions as there are task slots;
    a small input (one file, a few splits) is dealt out by ``keys`` first."""
    return df if df.rdd.getNumPartitions() >= task_slots(df.sparkSession) else df.repartition(*keys)


def row_count(df: DataFrame) -> int:
    return int(df.count())


# --- op 34: contiguous worker shards, then fixed-size map batches ------------

def _positive(name: str, value: int) -> int:
    if int(value) < 1:
        raise ValueError(f"{name} must be at least 1, got {value}")
    return int(value)


def shard_of(pos: Column, n_rows: int, workers: int) -> tuple[Column, Column]:
    """(shard, offset inside shard) for contiguous sharding of ``n_rows`` rows.

    The first ``n_rows % workers`` shards hold one extra row.
    """
    q, m = divmod(n_rows, workers)
    big = m * (q + 1)
    if q == 0:
        shard = pos
        start = pos
    else:
        shard = F.when(pos < F.lit(big), F.floor(pos / F.lit(q + 1))).otherwise(
            F.lit(m) + F.floor((pos - F.lit(big)) / F.lit(q))
        )
        start = F.when(shard < F.lit(m), shard * F.lit(q + 1)).otherwise(F.lit(big) + (shard - F.lit(m)) * F.lit(q))
    return shard.cast("bigint"), (pos - start).cast("bigint")


def assign_map_batches(
    df: DataFrame,
    batch_size: int = MAP_BATCH_SIZE,
    workers: int | None = None,
    pos_col: str = "pos",
    n_rows: int | None = None,
) -> DataFrame:
    """Add ``shard``, ``batch`` (inside the shard) and ``in_shard`` (row inside the shard)."""
    batch_size = _positive("batch_size", batch_size)
    workers = max(int(workers or 1), 1)
    if n_rows is None:
        n_rows = row_count(df)
    shard, inner = shard_of(F.col(pos_col), n_rows, workers)
    return (
        df.withColumn("shard", shard)
        .withColumn("in_shard", inner)
        .withColumn("batch", F.floor(F.col("in_shard") / F.lit(batch_size)).cast("bigint"))
    )


def assign_file_batches(df: DataFrame, batch_size: int = MAP_BATCH_SIZE, workers: int | None = None) -> DataFrame:
    """``assign_map_batches`` for every file of ``number_lines`` at once: contiguous worker shards
    of each file's ``n_file`` lines, map batches inside them.

    ``shard`` counts on over the files (file_index * workers + shard in the
    file), so one job batches, sorts or packs all files apart.
    """
    batch_size, w = _positive("batch_size", batch_size), max(int(workers or 1), 1)
    n, at = F.col("n_file"), F.col("in_file")
    q, m = F.floor(n / w), n % w
    big = m * (q + 1)
    shard = F.when(at < big, F.floor(at / (q + 1))).otherwise(m + F.floor((at - big) / F.greatest(q, F.lit(1))))
    start = F.when(shard < m, shard * (q + 1)).otherwise(big + (shard - m) * q)
    inner = (at - start).cast("bigint")
    return (
        df.withColumn("in_shard", inner)
        .withColumn("batch", F.floor(inner / F.lit(batch_size)).cast("bigint"))
        .withColumn("shard", (F.col("file_index") * F.lit(w) + shard).cast("bigint"))
    )


def file_batch_count(df: DataFrame, batch_size: int, workers: int | None = None) -> int:
    """Number of (shard, batch) groups ``assign_file_batches`` produces for ``number_lines`` rows."""
    w, b = max(int(workers or 1), 1), int(batch_size)
    q, m = F.floor(F.col("n_file") / w), F.col("n_file") % w
    files = df.groupBy("file_index").agg(F.max("n_file").alias("n_file"))
    return int(files.agg(F.sum(m * F.ceil((q + 1) / b) + (w - m) * F.ceil(q / b))).first()[0] or 0)


def map_batch_count(n_rows: int, batch_size: int, workers: int | None = None) -> int:
    """Number of (shard, batch) groups ``assign_map_batches`` produces."""
    workers = max(int(workers or 1), 1)
    q, m = divmod(n_rows, workers)
    sizes = [q + 1] * m + [q] * (workers - m)
    return sum(-(-s // batch_size) for s in sizes if s > 0)


def batch_partitioning_pays(spark, n_rows: int, batch_size: int, workers: int | None = None) -> bool:
    """Partition raw rows by (shard, batch) up front when there are at least as
    many map batches as task slots: every later per-batch step then reuses that
    one exchange.  With fewer batches, partition by ``pos`` for parallel
    tokenising and shuffle once more by batch."""
    return map_batch_count(n_rows, batch_size, workers) >= task_slots(spark)


# --- ops 37-39: training-order plans -----------------------------------------

def plan_sequential(df: DataFrame, batch_size: int, pos_col: str = "pos") -> DataFrame:
    """Training order = dataset order."""
    batch_size = _positive("batch_size", batch_size)
    return df.withColumn("order_idx", F.col(pos_col)).withColumn(
        "batch_id", F.floor(F.col(pos_col) / F.lit(batch_size)).cast("bigint")
    )


def plan_random(df: DataFrame, batch_size: int, seed: int = DEFAULT_SEED, pos_col: str = "pos") -> DataFrame:
    """Seeded uniform permutation (md5 of seed:pos), then consecutive batches.

    What is sorted are positions; further columns of ``df`` join back (``attach_payload``).
    """
    batch_size = _positive("batch_size", batch_size)

    def plan(keys: DataFrame) -> DataFrame:
        keyed = keys.withColumn("_rk", seeded_hash(seed, pos_col))
        ranked = dense_index(keyed, ["_rk", pos_col], "order_idx").drop("_rk")
        return ranked.withColumn("batch_id", F.floor(F.col("order_idx") / F.lit(batch_size)).cast("bigint"))

    return _plan_on_keys(df, [pos_col], plan)


def _plan_on_keys(df: DataFrame, keys: list[str], plan) -> DataFrame:
    """``plan(narrow rows)``, joined back to ``df``'s other columns, which are written once and not sorted."""
    if set(df.columns) <= set(keys):
        return plan(df)
    rows = materialise_scratch(df, "plan-rows")
    return attach_payload(materialise_scratch(plan(rows.select(*keys)), "plan"), rows, keys[0])


def plan_permuted(df: DataFrame, batch_size: int, n_rows: int, seed: int = DEFAULT_SEED, pos_col: str = "pos") -> DataFrame:
    """Seeded permutation of ``n_rows`` dense positions by a keyed bijection, then consecutive batches.

    Every row computes its own place: no sort, no exchange (``plan_random`` sorts a hash).
    """
    from tessera.operators.permute import permuted, round_keys

    batch_size = _positive("batch_size", batch_size)
    planned = df.withColumn("order_idx", permuted(pos_col, n_rows, round_keys(seed)))
    return planned.withColumn("batch_id", F.floor(F.col("order_idx") / F.lit(batch_size)).cast("bigint"))


def attach_payload(plan: DataFrame, payload: DataFrame, pos_col: str = "pos") -> DataFrame:
    """Rows of ``payload`` with their place in a plan of narrow keys, joined once, when they are needed.

    A plan within the checked bound is broadcast (three numbers a row), so the payload is not exchanged.
    """
    side = plan.select(pos_col, "order_idx", "batch_id")
    return payload.join(F.broadcast(side) if side.count() <= BROADCAST_GROUPS else side, pos_col)


def length_group_multiplier(n_rows: int, group_size: int) -> int:
    mult = min(n_rows // (group_size * 4), 50)
    return mult if mult > 0 else 1


def plan_length_grouped(
    df: DataFrame,
    batch_size: int,
    accumulation: int = 1,
    seed: int = DEFAULT_SEED,
    length_col: str = "n",
    pos_col: str = "pos",
    n_rows: int | None = None,
) -> DataFrame:
    """Shuffle, cut into mega-batches, sort each by length (longest first, stable),
    then move the overall longest first element to the very front.

    What is sorted are positions and lengths; further columns of ``df`` join back.
    """
    batch_size, accumulation = _positive("batch_size", batch_size), _positive("accumulation", accumulation)
    return _plan_on_keys(df, [pos_col, length_col], lambda keys: _length_grouped(
        keys, batch_size, accumulation, seed, length_col, pos_col, n_rows))


def _length_grouped(df: DataFrame, batch_size: int, accumulation: int, seed: int, length_col: str, pos_col: str,
                    n_rows: int | None) -> DataFrame:
    if n_rows is None:
        n_rows = row_count(df)
    group = batch_size * accumulation
    mega_size = length_group_multiplier(n_rows, group) * group
    keyed = df.withColumn("_rk", seeded_hash(seed, pos_col))
    ranked = dense_index(keyed, ["_rk", pos_col], "_r").drop("_rk")
    ranked = ranked.withColumn("_mega", F.floor(F.col("_r") / F.lit(mega_size)).cast("bigint"))
    w = Window.partitionBy("_mega").orderBy(F.col(length_col).desc(), F.col("_r"))
    ranked = ranked.withColumn("_k", (F.row_number().over(w) - 1).cast("bigint"))
    # the mega-batch whose first (longest) element is longest; first one on ties
    heads = ranked.where(F.col("_k") == 0)
    best = heads.orderBy(F.col(length_col).desc(), F.col("_mega")).select("_mega").first()
    top = int(best[0]) if best is not None else 0
    idx = F.col("_mega") * F.lit(mega_size) + F.col("_k")
    swapped = (
        F.when((F.col("_k") == 0) & (F.col("_mega") == 0), F.lit(top * mega_size))
        .when((F.col("_k") == 0) & (F.col("_mega") == top), F.lit(0))
        .otherwise(idx)
    )
    return (
        ranked.withColumn("order_idx", swapped.cast("bigint"))
        .withColumn("batch_id", F.floor(F.col("order_idx") / F.lit(batch_size)).cast("bigint"))
        .drop("_r", "_mega", "_k")
    )
