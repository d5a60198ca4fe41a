"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "tessera") -> SparkSession:
    """Session for tests and the bench.  On a cluster the launcher owns the session."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage.

    Read from the session (``spark.checkpoint.dir`` or the context's folder).
    Only a local-mode session without one gets a fresh scratch folder; on a
    cluster a missing setting is an error, never a machine-local folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no context
        sc = None
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
        configured = configured or sc.getConf().get("spark.checkpoint.dir", None)
        if configured:
            sc.setCheckpointDir(configured)
            return sc.getCheckpointDir() or configured
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    elif configured:
        return configured
    else:
        master = spark.conf.get("spark.master", "local")
        if not str(master).startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    global _LOCAL_SCRATCH
    if _LOCAL_SCRATCH is None:
        _LOCAL_SCRATCH = tempfile.mkdtemp(prefix="tessera-ckpt-", dir="/tmp")
    if sc is not None:
        sc.setCheckpointDir(_LOCAL_SCRATCH)
        return sc.getCheckpointDir() or _LOCAL_SCRATCH
    return _LOCAL_SCRATCH


_LOCAL_SCRATCH: str | None = None
