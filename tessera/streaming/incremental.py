"""Incremental preparation with Structured Streaming (op 60).

Each new input file is prepared exactly once: the file source records the
files it has seen in the query checkpoint, ``maxFilesPerTrigger=1`` makes
every micro-batch one file (so packing and batching scope is the file, as
when files are prepared one by one) unless the preparer tells files or
folders apart itself, and ``availableNow`` drains what is there and stops.  ``foreachBatch`` runs the ordinary batch operators on the
micro-batch and overwrites ``<out>/batch_id=<id>`` — a retried micro-batch
rewrites the same folder, so output stays exactly-once as long as the query's
checkpoint is there.

``prepare_stream_once`` does not depend on that: a ledger of commits by file
says what is prepared, where its rows lie and which places they have.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.codec import PortableCodec
from tessera.operators.order import index_in_groups, number_lines
from tessera.plans.tasks import build_pretrain, file_places, pack_files

# input files of one trigger, where the preparer tells files apart (as they lie there, compressed or not)
TRIGGER_BYTES = 1 << 30


def pretrain_preparer(vocab: DataFrame | None, max_seq_len: int, batch_size: int, workers: int | None = None,
                      unk_id: int | None = None, codec=None) -> Callable[[DataFrame], DataFrame]:
    """Micro-batch → packed chunks, with a fixed vocabulary (unseen tokens → ``unk_id``) or a codec's tables."""
    if codec is None:
        codec = PortableCodec(vocab, unk_id, size=int(vocab.count()))

    def prepare(batch: DataFrame) -> DataFrame:
        docs = number_lines(batch).select("pos", "text")
        return build_pretrain(docs, max_seq_len, batch_size, workers, codec=codec)

    return prepare


class StreamLedger:
    """What a stream has prepared: one table per run, and a commit (file, run, first place, rows) per file.

    A run holds the files of one trigger, ``file_index`` and ``at`` saying which
    of its rows are a file's.  They count once the run's commits are written,
    which is one append after its table; a file's places follow those of all
    files committed before, so ``pos`` is dense over files in order of commit.
    A file with a commit is never prepared again, also when the stream's own
    checkpoint is lost.
    """

    SCHEMA = ("file string, length bigint, modified bigint, run string, first_pos bigint, n bigint, "
              "file_index int, at bigint")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = f"{self.root}/commits"

    def commits(self) -> list:
        """One row per prepared file."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return []
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).collect()

    def prepare(self, batch: DataFrame, prepare: Callable[[DataFrame], DataFrame]) -> None:
        """Prepare the batch's files that have no commit, all in one job, and commit them."""
        done = self.commits()
        known = {(r["file"], r["length"], r["modified"]) for r in done}
        first = sum(r["n"] for r in done)
        # the files of one trigger
        files = sorted(tuple(r) for r in batch.select("_file", "_length", "_modified").distinct().collect())
        new = [f for f in files if f not in known]
        if not new:
            return
        rows = batch if len(new) == len(files) else batch.where(F.col("_file").isin([f[0] for f in new]))
        run = uuid.uuid4().hex
        prepare(rows.drop("_length", "_modified")).write.parquet(f"{self.root}/run-{run}")
        held = self.spark.read.parquet(f"{self.root}/run-{run}").groupBy("file_index").agg(
            F.min("pos").alias("at"), F.count(F.lit(1)).alias("n"))
        places = {r["file_index"]: (r["at"], r["n"]) for r in held.collect()}      # a row per file
        commits = []
        for i, file in enumerate(new):
            at, n = places.get(i, (0, 0))
            commits.append((*file, run, first, n, i, at))
            first += n
        self.spark.createDataFrame(commits, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame | None:
        """All committed rows: ``pos`` over all files, ``in_file`` and ``file``; None before any."""
        done = self.commits()
        if not done:
            return None
        # a run of one file that was written without its place holds nothing else
        commits = self.spark.createDataFrame(done, self.SCHEMA).select(
            "file", F.col("run").alias("_run"), "first_pos", F.coalesce("file_index", F.lit(0)).alias("file_index"),
            F.coalesce("at", F.lit(0)).alias("at"))
        runs = list(dict.fromkeys(r["run"] for r in done))
        path = lambda run: f"{self.root}/run-{run}"
        held = self.spark.read.schema(self.spark.read.parquet(path(runs[-1])).schema).parquet(*map(path, runs))
        index = F.coalesce("file_index", F.lit(0)) if "file_index" in held.columns else F.lit(0)
        held = held.withColumns({"_run": F.regexp_extract(F.col("_metadata.file_path"), "/run-([0-9a-f]+)/", 1),
                                 "file_index": index})
        # one commit per prepared file
        return held.join(F.broadcast(commits), ["_run", "file_index"]).withColumn("in_file", F.col("pos") - F.col("at")) \
            .withColumn("pos", F.col("first_pos") + F.col("in_file")).drop("_run", "file_index", "first_pos", "at")


def indexed_pretrain_preparer(max_seq_len: int, batch_size: int, workers: int | None = None,
                              codec=None) -> Callable[[DataFrame], DataFrame]:
    """Lines of some files → each file's packed chunks, with its place among them (``file_index``, in order
    of path) and ``pos``, dense over the files in that order."""
    def prepare(batch: DataFrame) -> DataFrame:
        rows = number_lines(batch).select("pos", "text", "file_index", "in_file", "n_file")
        packed = pack_files(rows, codec, max_seq_len, batch_size, workers)
        return file_places(index_in_groups(packed, ["shard", "batch"], "chunk", "pos"), workers)

    return prepare


def folder_pretrain_preparer(max_seq_len: int, batch_size: int, workers: int | None = None,
                             codec=None) -> Callable[[DataFrame], DataFrame]:
    """Lines of some folders → each folder's packed chunks; its files follow each other in order of path."""
    def prepare(batch: DataFrame) -> DataFrame:
        folders = batch.withColumns({"_file": F.regexp_extract("_file", "^(.*)/[^/]+$", 1),
                                     "_start": F.struct("_file", "_start")})
        rows = number_lines(folders).select("pos", "text", "file_index", "in_file", "n_file")
        return file_places(pack_files(rows, codec, max_seq_len, batch_size, workers), workers)

    return prepare


def prepare_stream_once(
    spark: SparkSession,
    source_dir: str,
    out_dir: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame],
    schema: T.StructType,
    pattern: str = "*.json*",
) -> DataFrame | None:
    """Prepare every file under ``source_dir`` that ``out_dir``'s ledger does not know; all committed rows.

    ``prepare`` gets the lines of a trigger's files and returns rows with ``file_index``, the file's
    place among them in order of path, and ``pos``, dense over the files in that order.
    """
    ledger = StreamLedger(spark, out_dir)
    stream = _file_stream(spark, source_dir, schema, pattern, maxBytesPerTrigger=TRIGGER_BYTES).withColumns(
        {"_length": F.col("_metadata.file_size"), "_modified": F.unix_millis(F.col("_metadata.file_modification_time"))})

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        ledger.prepare(batch, prepare)

    _drain(stream, run_batch, checkpoint)
    return ledger.read()


def _file_stream(spark: SparkSession, source_dir: str, schema: T.StructType, pattern: str, **trigger) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("mode", "FAILFAST")  # a malformed line stops the stream, it never becomes an empty sample
        .options(**trigger)
        .option("pathGlobFilter", pattern)
        .json(source_dir)
        .withColumns({"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start")})
    )


def _drain(stream: DataFrame, run_batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = (
        stream.writeStream.foreachBatch(run_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def prepare_stream(
    spark: SparkSession,
    source_dir: str,
    out_dir: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame],
    schema: T.StructType,
    pattern: str = "*.json*",
    whole: bool = False,
) -> DataFrame:
    """Prepare every not-yet-seen file under ``source_dir``; return the whole prepared table.

    A trigger is one file; with ``whole`` it is all that is there, for a preparer that tells folders apart.
    """
    stream = _file_stream(spark, source_dir, schema, pattern, **({} if whole else {"maxFilesPerTrigger": 1}))

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        prepared = prepare(batch)
        prepared.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}")

    _drain(stream, run_batch, checkpoint)
    return spark.read.parquet(out_dir)
