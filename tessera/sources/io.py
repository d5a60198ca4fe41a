"""Readers and writers (ops 1-9).

JSON / JSON-lines inputs are read with an explicit schema (no inference
pass); outputs are parquet (prepared data) or JSON lines (mixing output).
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- schemas of the inputs -------------------------------------------------------------

PRETRAIN_SCHEMA = T.StructType([T.StructField("text", T.StringType())])
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
SFT_SCHEMA = T.StructType([T.StructField("conversations", T.ArrayType(MESSAGE))])
PREFERENCE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("question", "response_chosen", "response_rejected")]
)


def discover_files(spark: SparkSession, file: str | None = None, directory: str | None = None,
                   pattern: str = "*.json*") -> list[str]:
    """A single file wins; otherwise the non-recursive ``pattern`` matches of
    ``directory``, sorted for determinism (op 2).  Listing goes through the
    Hadoop filesystem of the session, so it works on any cluster store."""
    if file:
        return [file]
    if not directory:
        raise ValueError("either a file or a directory is required")
    jvm = spark.sparkContext._jvm
    hconf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(directory.rstrip("/") + "/" + pattern)
    fs = path.getFileSystem(hconf)
    statuses = fs.globStatus(path) or []
    return sorted(str(s.getPath().toString()) for s in statuses if s.isFile())


CORRUPT = "_corrupt"


def is_array_file(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file holds one array (its first character that is not blank opens it) rather than lines.

    Looks at the file's head through the session's filesystem; no job.
    """
    return bool(array_files(spark, [path]))


def array_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of ``paths`` that ``is_array_file``; what the look-ups share is made once for all files, as there may be many."""
    if not paths:
        return []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop
    path, codecs = hadoop.fs.Path, hadoop.io.compress.CompressionCodecFactory(conf)
    return [p for p in paths if _opens_array(path(p), codecs, conf)]


def _opens_array(p, codecs, conf) -> bool:
    stream = p.getFileSystem(conf).open(p)
    packed = codecs.getCodec(p)
    if packed is not None:
        stream = packed.createInputStream(stream)
    blank = b" \t\r\n\xef\xbb\xbf"           # with the three bytes of a byte-order mark
    try:
        b = stream.read()
        while b >= 0 and b in blank:
            b = stream.read()
        return b == ord("[")
    finally:
        stream.close()


def read_samples(spark: SparkSession, paths, schema: T.StructType, multi_line: bool | None = None,
                 malformed: str = "fail") -> DataFrame:
    """JSON lines or JSON array files → table, with ``_file`` and ``_start`` (the
    scan split a row was read in), from which ``number_lines`` builds ``pos`` (op 1).

    ``multi_line=None`` looks at each file's head to tell arrays from lines; arrays
    are read in splits (``multi_line=True`` has Spark read each file in one task).  A malformed line fails the job; ``malformed="quarantine"`` keeps it
    as a row whose ``_corrupt`` column holds the line (NULL elsewhere).
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if malformed not in ("fail", "quarantine"):
        raise ValueError(f"unknown mode {malformed!r} for malformed lines")
    if multi_line is None:
        arrays = array_files(spark, paths)
        found = set(arrays)
        lines = [p for p in paths if p not in found]
        if arrays and lines:
            return read_samples(spark, lines, schema, False, malformed).unionByName(
                read_arrays(spark, arrays, schema, malformed))
        if arrays:
            return read_arrays(spark, arrays, schema, malformed)
        multi_line = False
    reader = spark.read.option("multiLine", multi_line)
    if malformed == "fail":
        reader = reader.schema(schema).option("mode", "FAILFAST")
    else:
        with_line = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.schema(with_line).option("columnNameOfCorruptRecord", CORRUPT)
    return reader.json(paths).withColumns(
        {"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start")})


def read_arrays(spark: SparkSession, paths: list[str], schema: T.StructType, malformed: str = "fail") -> DataFrame:
    """JSON array files, each read by as many tasks as it has splits (``sources.arrays``)."""
    from tessera.sources.arrays import array_records

    records = array_records(spark, paths)
    if malformed == "fail":
        parsed = records.withColumn("_s", F.from_json("value", schema, {"mode": "FAILFAST"}))
        return parsed.select("_s.*", "_file", "_start")
    with_line = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = records.withColumn("_s", F.from_json("value", with_line, {"columnNameOfCorruptRecord": CORRUPT}))
    return parsed.select("_s.*", "_file", "_start")


def source_name(path_col: str = "_file"):
    """The folder a file lies in; file paths in metadata are percent-encoded."""
    plain = F.url_decode(F.replace(F.col(path_col), F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(plain, r"/([^/]+)/[^/]+$", 1)


def read_sources(spark: SparkSession, root: str, sources: list[str], schema: T.StructType) -> DataFrame:
    """One directory per source holding ``*.json`` files; rows tagged with their
    source (op 3).  One scan over all directories; a source without any file
    or without any row fails the job."""
    dirs = {s: f"{root.rstrip('/')}/{s}" for s in sources}
    files = {s: discover_files(spark, directory=d, pattern="*.json") for s, d in dirs.items()}
    missing = [s for s, fs in files.items() if not fs]
    if missing:
        raise FileNotFoundError(f"no *.json files for sources {missing} under {root}")
    all_files = [f for fs in files.values() for f in fs]
    df = read_samples(spark, all_files, schema).withColumn("source", source_name())
    return check_sources(df, sources)


def check_sources(df: DataFrame, sources: list[str]) -> DataFrame:
    """Fail if one of ``sources`` has no row in ``df``; else return ``df``."""
    config = df.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    counts = df.groupBy("source").count()
    # at most one row: the name of an empty source
    bad = config.join(counts, "source", "left_anti").limit(1).collect()
    if bad:
        raise ValueError(f"no sample data for source {bad[0][0]!r}")
    return df


def select_input(df: DataFrame, cols) -> DataFrame:
    """Keep only the needed input columns (op 4); Catalyst prunes the scan."""
    return df.select(*cols)


def params_fingerprint(path: str, params: dict) -> str:
    """Cache key: basename + a digest of the full path and the parameters."""
    blob = json.dumps({"path": path, "params": params}, sort_keys=True, default=str)
    base = os.path.basename(path).split(".")[0]
    return f"{base}-{hashlib.sha256(blob.encode()).hexdigest()[:16]}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its filesystem's scheme, as the session resolves it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return str(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString())


def with_file_index(df: DataFrame, files: list[str]) -> DataFrame:
    """Add ``file_index``: the place of a row's ``_file`` in the list of qualified paths."""
    local = r"^file:/+"
    plain = F.url_decode(F.replace(F.col("_file"), F.lit("+"), F.lit("%2B")))
    listed = df.sparkSession.createDataFrame(
        [(re.sub(local, "file:/", f), i) for i, f in enumerate(files)], "_path string, file_index int")
    # one row per input file
    return df.withColumn("_path", F.regexp_replace(plain, local, "file:/")).join(F.broadcast(listed), "_path").drop("_path")


class CacheLedger:
    """Prepared files under a cache folder: one table per run, and the commits (key, run).

    A run's rows count only once its commits are written, which is a single
    append after the table, so a run that breaks off leaves nothing behind that
    a later one would read.
    """

    SCHEMA = "key string, run string, file_index int"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = f"{self.root}/commits"

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p))

    def committed(self) -> dict[str, tuple[str, int]]:
        """Key → (run, file_index in it); a row per prepared file."""
        if not self._exists(self.path):
            return {}
        return {r["key"]: (r["run"], r["file_index"])
                for r in self.spark.read.schema(self.SCHEMA).parquet(self.path).collect()}

    def commit(self, prepared: DataFrame, keys: list[str]) -> None:
        """Write ``prepared`` (its ``file_index`` counts through ``keys``), then commit every key."""
        run = uuid.uuid4().hex
        prepared.write.parquet(f"{self.root}/run-{run}")
        rows = [(k, run, i) for i, k in enumerate(keys)]
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def read(self, keys: list[str]) -> DataFrame:
        """The rows of ``keys``, ``file_index`` being the place in the list; one scan per run."""
        known = self.committed()
        runs: dict[str, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            run, at = known[k]
            runs.setdefault(run, []).append((at, i))
        parts = []
        for run, places in runs.items():
            wanted = self.spark.createDataFrame(places, "_at int, _place int")
            held = self.spark.read.parquet(f"{self.root}/run-{run}").withColumnRenamed("file_index", "_at")
            parts.append(held.join(F.broadcast(wanted), "_at").drop("_at").withColumnRenamed("_place", "file_index"))
        return functools.reduce(DataFrame.unionByName, parts)


def file_stamp(spark: SparkSession, path: str) -> list[int]:
    """Length and modification time of a file, for cache keys."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    status = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
    return [int(status.getLen()), int(status.getModificationTime())]


def table_stamp(df: DataFrame) -> list[int]:
    """Row count and order-free checksum of a table, for cache keys."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    return [int(x or 0) for x in df.agg(F.count(F.lit(1)), F.sum(low), F.sum(high)).first()]


def materialise(df_fn, spark: SparkSession, cache_root: str, source_path: str, params: dict) -> DataFrame:
    """Prepared data is written once as parquet and re-read by later runs (op 5).

    Reuse only when ``_SUCCESS`` exists for the same source and parameters;
    ``df_fn()`` builds the plan only on a miss.
    """
    target = f"{cache_root.rstrip('/')}/{params_fingerprint(source_path, params)}"
    jvm = spark.sparkContext._jvm
    hconf = spark.sparkContext._jsc.hadoopConfiguration()
    marker = jvm.org.apache.hadoop.fs.Path(target + "/_SUCCESS")
    if not marker.getFileSystem(hconf).exists(marker):
        df_fn().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def jsonl_lines(df: DataFrame, cols, keep=("id",)) -> DataFrame:
    """One JSON object per row, nulls kept, non-ASCII verbatim (op 6)."""
    keep = [c for c in keep if c in df.columns]
    return df.select(*keep, F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, cols, order_col: str | None = None) -> None:
    """Write JSON lines (op 6); with ``order_col`` the files follow that order."""
    lines = jsonl_lines(df, cols, keep=(order_col,) if order_col else ())
    if order_col:
        lines = lines.repartitionByRange(order_col).sortWithinPartitions(order_col)
        lines = lines.drop(order_col)
    lines.write.mode("overwrite").text(path)


def read_proportions(spark: SparkSession, path: str) -> DataFrame:
    """``{source: ratio}`` JSON object → (source, ratio), each ratio checked in [0, 1] (op 7)."""
    from tessera.operators.mix import check_proportions

    raw = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string,double>")
    # a config that does not parse fails the job instead of mixing nothing
    parsed = F.coalesce(parsed, F.raise_error(F.lit("proportion config is not a JSON object of ratios"))
                        .cast("map<string,double>"))
    pairs = raw.select(F.explode(parsed).alias("source", "ratio"))
    return check_proportions(pairs)


def dataset_counts(df: DataFrame, by: str | None = None) -> DataFrame:
    """Number of prepared samples, overall or per group (op 8)."""
    return df.groupBy(by).count() if by else df.agg(F.count(F.lit(1)).alias("count"))
