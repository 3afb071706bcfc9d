"""SparkSession construction and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: AQE re-plans joins/partition counts at runtime
# (and turns a sort-merge join into a broadcast join only once the *measured*
# shuffle size is under the threshold), splits skewed join partitions, and
# coalesces the tiny post-aggregation partitions typical for panel data.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Remove reliable-checkpoint files once their frames are garbage-collected
    # (long-lived sessions would otherwise accumulate them).
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "regiopanel", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the scale settings applied.

    ``master`` is only used when no session exists yet (local tests); on a
    cluster the launcher decides.  ``shuffle_partitions`` defaults to the
    cluster's setting; tests pass the local core count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    # Runtime-settable SQL confs are applied to an already running session too.
    for k, v in SCALE_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir`` (a shared folder).  Only a
    local-mode session (tests) without it gets a fresh scratch folder; on a
    cluster a missing setting is an error, never a machine-local folder."""
    try:
        sc = spark.sparkContext
    except PySparkException:   # Spark Connect: the server's checkpoint configuration applies
        return ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: point it at a shared folder "
                           "(HDFS/object store) so checkpoints survive executor loss")
    path = tempfile.mkdtemp(prefix="regiopanel-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage of a frame that several outputs reuse.

    Uses a reliable ``checkpoint()`` into the shared checkpoint folder, so a
    lost executor does not force recomputation from the raw scans.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OPEN_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def stage_table(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to a new folder below the shared checkpoint folder and
    read it back: columns and partitions that a reader does not need are not read,
    and a lost executor costs only tasks of the running stage.  Shuffle files of the
    write are freed.  ``partition_by`` has few values: a task keeps a writer open for
    each, so its rows are not sorted for the write."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    set_ = {_FREE_SHUFFLES: "true", _OPEN_WRITERS: "16"}
    old = {k: spark.conf.get(k, None) for k in set_}
    try:
        for k, v in set_.items():
            spark.conf.set(k, v)
        w = df.write
        (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    order = [c for c in df.columns if c != partition_by] + ([partition_by] if partition_by else [])
    return spark.read.schema(df.select(*[f"`{c}`" for c in order]).schema).parquet(path).select(*[f"`{c}`" for c in df.columns])
