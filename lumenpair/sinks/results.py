"""Result, summary, quarantine and manifest exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ..sources.benchmarks import union_all

# Columns of the quarantine table.
SKIP_SCHEMA = "benchmark string, source_file string, sample_id string, reason string"


def write_results(rows: DataFrame, path: str, mode: str = "append") -> None:
    """JSON result lines in folders per model and benchmark; every task writes its own files."""
    rows.write.mode(mode).partitionBy("model_name", "benchmark").json(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """All result lines written so far, merged."""
    return spark.read.schema(schema).json(path)


def append_widening(rows: DataFrame, path: str) -> None:
    """Append rows that may bring new columns: older rows read null for them."""
    rows.write.mode("append").parquet(path)


def read_widened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def rewrite_rectangular(old: DataFrame, new: DataFrame, path: str | None = None) -> DataFrame:
    """Old and new rows as one CSV with the columns of both, written to a new place."""
    spark = old.sparkSession
    path = path or scratch_path(spark, "widened")
    both = old.unionByName(new, allowMissingColumns=True)
    both.write.option("header", True).csv(path)
    return spark.read.schema(both.schema).option("header", True).csv(path)


def write_summaries(summaries: Mapping[str, DataFrame], folder: str) -> list[str]:
    """One CSV per named summary. Summaries hold one row per group, so one file each."""
    paths = []
    for name, df in summaries.items():
        path = f"{folder.rstrip('/')}/{name}.csv"
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
        paths.append(path)
    return paths


def ragged_union(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of frames with different columns under the sorted union of their names."""
    both = union_all(frames)
    return both.select(*sorted(both.columns))


def write_metric_rows(frames: Sequence[DataFrame], folder: str) -> None:
    """Metric rows as JSON and as CSV with sorted columns."""
    rows = ragged_union(frames).coalesce(1)
    rows.write.mode("overwrite").json(f"{folder.rstrip('/')}/retrieval_metrics.json")
    rows.write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/retrieval_metrics.csv")


def write_skipped(skipped: DataFrame | None, spark: SparkSession, path: str) -> None:
    """Quarantine rows as CSV; with none, a file that has only the header."""
    empty = spark.createDataFrame([], SKIP_SCHEMA)
    rows = empty if skipped is None else skipped.select(*empty.columns)
    # One typed partition keeps the header even when no row was set aside.
    (rows.coalesce(1) if skipped is None else rows).write.mode("overwrite").option("header", True).csv(path)


def write_manifests(manifest: DataFrame, folder: str) -> None:
    """One JSON folder per data set and one for all."""
    base = folder.rstrip("/")
    manifest.withColumn("data_set", F.col("name")).write.mode("overwrite").partitionBy("data_set").json(f"{base}/by_name")
    manifest.coalesce(1).write.mode("overwrite").json(f"{base}/all")


def write_splits(routed: DataFrame, folder: str) -> None:
    """Routed rows in one folder per split."""
    routed.write.mode("overwrite").partitionBy("route").json(folder)
