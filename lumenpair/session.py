"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split skewed join sides even when that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole texts go to Python in smaller batches; narrow rows come 10,000 at a time as before.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    # Conditions on the shard reach the tar source.
    "spark.sql.python.filterPushdown.enabled": "true",
}

_fallback_dir: str | None = None


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "lumenpair", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; `conf` keys use underscores for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    # Long Column expressions are built several times faster without call-site capture.
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder all executors share, named by the cluster in `spark.checkpoint.dir`.

    Only for a local master, where that is unset (tests), is a folder made here: on a
    cluster each executor would write to its own disk, so there it is an error.
    """
    global _fallback_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _fallback_dir is None:
        _fallback_dir = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(_fallback_dir)
    return _fallback_dir


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage and lets several consumers share one computation; the
    table outlives any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def work_partitions(spark: SparkSession) -> int:
    """Partitions for steps whose rows are small and whose work per row is not.

    Such steps name the number, as adaptive coalescing goes by bytes and would
    put them into one task.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Spread a scan over the cores by its unique `keys` when it has fewer partitions than cores.

    For costly row-wise work on few files or row groups, which cannot be split
    further. A scan with enough partitions is returned as it is, unshuffled.
    Meant for plain scans: their partition count is known without a job.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)
