"""Running accuracy over result files as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.summaries import accuracy_totals
from ..session import scratch_path

RESULT_SCHEMA = "model_name string, benchmark string, sample_id string, negative_index int, correct int"


# One result row, a sample with one of its negatives: delivered again, it is the same result.
RESULT_KEY = ("model_name", "benchmark", "sample_id", "negative_index")


def first_deliveries(results: DataFrame, keys: Sequence[str] = RESULT_KEY, remember_days: int = 30) -> DataFrame:
    """A stream of results without the rows delivered before; of equal keys the first to arrive counts.

    The state holds the keys that arrived within `remember_days`, spread over the shuffle
    partitions; older ones are forgotten by the watermark. The watermark is on the time
    of arrival, not of the file, so no row is late. A key that comes again after that
    counts again. Null keys equal one another, so results with several negatives for a
    sample need their index.
    """
    arrived = results.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", f"{remember_days} days")
    return arrived.dropDuplicatesWithinWatermark(list(keys)).drop("__arrived")


def running_accuracy(
    spark: SparkSession, path: str, schema: str = RESULT_SCHEMA, files_per_batch: int | None = None, remember_days: int | None = None
) -> DataFrame:
    """Streaming DataFrame of correct, total and accuracy per (model, benchmark).

    State is one row per group and, with `remember_days`, one per key of `first_deliveries`.
    The source passes over files dated more than that many days (seven by default) before
    the newest one it has seen. Use output mode `complete`; without `remember_days` also `update`.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if remember_days is None:
        return accuracy_totals(reader.json(path))
    late = reader.option("maxFileAge", f"{remember_days}d")
    return accuracy_totals(first_deliveries(late.json(path), remember_days=remember_days))


def refresh_accuracy(
    spark: SparkSession,
    path: str,
    out: str,
    checkpoint: str | None = None,
    schema: str = RESULT_SCHEMA,
    files_per_batch: int | None = None,
    remember_days: int | None = None,
) -> DataFrame:
    """Process everything that has arrived, then stop; returns the current totals.

    Each micro-batch replaces the totals under `out`. Called again with the
    same checkpoint it takes in only the files that are new. With `remember_days`
    rows delivered again within that time change nothing (`first_deliveries`).
    """

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    query = (
        running_accuracy(spark, path, schema, files_per_batch, remember_days)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream"))
        .trigger(availableNow=True)
        .foreachBatch(replace)
        .start()
    )
    query.awaitTermination()
    batches = spark.read.parquet(out)
    last = batches.selectExpr("max(batch) AS batch")
    return batches.join(last, "batch").drop("batch")
