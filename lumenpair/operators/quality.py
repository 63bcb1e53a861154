"""Verification, readiness and load reports over data sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import seeded_sample_per_group

REPORT = (
    "name string, status_hint string, checked_files_exist boolean, num_missing_files bigint, "
    "sample_read_success boolean, sampled bigint, passed bigint, messages array<string>"
)
GATED = "gated_or_auth_required"


def missing_required(required: DataFrame, listing: DataFrame) -> DataFrame:
    """Required (name, path) entries that are neither a listed file nor a folder above one."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    # The few required paths filter the listing's folders before anything is shuffled.
    wanted = required.select("path").distinct()
    present = listing.select(F.explode(above).alias("path")).join(wanted, "path", "left_semi").distinct()
    return required.join(present, "path", "left_anti")


def sample_checks(checks: DataFrame, n: int = 8, seed: int = 7) -> DataFrame:
    """Per data set: rows sampled and passed out of (name, row_id, passed)."""
    return (
        seeded_sample_per_group(checks, ["name"], "row_id", n, seed)
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("sampled"), F.sum(F.col("passed").cast("int")).alias("passed"))
    )


def verification_report(names: DataFrame, missing: DataFrame, checks: DataFrame) -> DataFrame:
    """One row per data set of `names` (name, gated, note).

    A set passes when nothing required is missing and every sampled row passed;
    no sampled row is a failure. Gated sets carry their own status.
    """
    lost = missing.groupBy("name").agg(
        F.count(F.lit(1)).alias("num_missing_files"),
        F.array_sort(F.collect_list(F.concat(F.lit("missing: "), "path"))).alias("__lost"),
    )
    gated = F.coalesce(F.col("gated"), F.lit(False))
    sampled = F.coalesce("sampled", F.lit(0))
    passed = F.coalesce("passed", F.lit(0))
    short = F.when(
        (sampled > 0) & (passed < sampled), F.concat(F.lit("sample checks passed "), passed, F.lit("/"), sampled)
    )
    none = F.array().cast("array<string>")
    return (
        names.join(lost, "name", "left")
        .join(checks, "name", "left")
        .select(
            "name",
            F.when(gated, GATED).otherwise("unknown").alias("status_hint"),
            (gated | F.col("num_missing_files").isNull()).alias("checked_files_exist"),
            F.when(gated, 0).otherwise(F.coalesce("num_missing_files", F.lit(0))).cast("bigint").alias("num_missing_files"),
            (~gated & (sampled > 0) & (passed == sampled)).alias("sample_read_success"),
            F.when(gated, 0).otherwise(sampled).cast("bigint").alias("sampled"),
            F.when(gated, 0).otherwise(passed).cast("bigint").alias("passed"),
            F.when(gated, F.array(F.coalesce("note", F.lit(""))))
            .otherwise(F.concat(F.coalesce("__lost", none), F.array_compact(F.array(short))))
            .alias("messages"),
        )
    )


@dataclass
class DatasetCheck:
    """What to verify of one data set; `rows` gives (row_id, passed) when called."""

    name: str
    required: Sequence[str] = ()
    rows: Callable[[], DataFrame] | None = None
    gated: bool = False
    note: str = ""
    sample: int = 8
    problems: list[str] = field(default_factory=list)


def verify_datasets(spark: SparkSession, datasets: Sequence[DatasetCheck], listing: DataFrame) -> DataFrame:
    """`verification_report` per data set, each on its own: one that cannot be read
    is reported with status 'error' and does not stop the others.

    One report row per data set passes the driver.
    """
    out = []
    for item in datasets:
        try:
            names = spark.createDataFrame([(item.name, item.gated, item.note)], "name string, gated boolean, note string")
            required = spark.createDataFrame([(item.name, p) for p in item.required], "name string, path string")
            if item.rows is None or item.gated:
                checks = spark.createDataFrame([], "name string, sampled bigint, passed bigint")
            else:
                checks = sample_checks(item.rows().withColumn("name", F.lit(item.name)), item.sample)
            report = verification_report(names, missing_required(required, listing), checks)
            out.extend(tuple(r) for r in report.collect())
        except Exception as exc:
            reason = str(exc).strip().splitlines()[0] if str(exc).strip() else type(exc).__name__
            out.append((item.name, "error", False, 0, False, 0, 0, [f"verification exception: {reason}"]))
    return spark.createDataFrame(out, REPORT)


def report_state(report: DataFrame) -> DataFrame:
    """Add `state`: ok, needs_attention or gated_or_auth_required."""
    ok = F.col("checked_files_exist") & F.col("sample_read_success")
    return report.withColumn(
        "state", F.when(F.col("status_hint") == GATED, GATED).when(ok, "ok").otherwise("needs_attention")
    )


def readiness(facts: DataFrame, rules: DataFrame, default: str = "failed") -> DataFrame:
    """Status of each data set from counted facts and a table of rules.

    `facts` is (name, fact, value). `rules` is (name, priority, status, fact,
    min_value, max_value): the rows of one (name, priority) must all hold, a
    missing fact counts as 0, and the rule of lowest priority number wins.
    """
    value = F.coalesce("value", F.lit(0))
    held = (
        rules.join(facts, ["name", "fact"], "left")
        .withColumn(
            "__ok",
            (F.col("min_value").isNull() | (value >= F.col("min_value")))
            & (F.col("max_value").isNull() | (value <= F.col("max_value"))),
        )
        .groupBy("name", "priority", "status")
        .agg(F.min("__ok").alias("__all"))
        .where(F.col("__all"))
    )
    first = held.groupBy("name").agg(F.min_by("status", "priority").alias("__status"))
    names = facts.select("name").union(rules.select("name")).distinct()
    return names.join(first, "name", "left").select("name", F.coalesce("__status", F.lit(default)).alias("status"))


def dataset_manifest(facts: DataFrame, statuses: DataFrame, report: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per data set: the named facts as columns, status and verification result."""
    wide = facts.groupBy("name").agg(
        *[F.coalesce(F.max(F.when(F.col("fact") == n, F.col("value"))), F.lit(0)).alias(n) for n in names]
    )
    checked = report.select("name", "checked_files_exist", "num_missing_files", "sample_read_success")
    return (
        statuses.join(wide, "name", "left")
        .join(checked, "name", "left")
        .withColumns(
            {
                "checked_files_exist": F.coalesce("checked_files_exist", F.lit(False)),
                "sample_read_success": F.coalesce("sample_read_success", F.lit(False)),
            }
        )
    )


def load_status(expected: DataFrame, loaded: DataFrame, kept: DataFrame, skipped: DataFrame) -> DataFrame:
    """Per expected benchmark (benchmark, found): ok, empty or missing, with counts.

    `loaded`, `kept` and `skipped` have a `benchmark` column: rows read, rows
    left after limits, rows set aside.
    """

    def tally(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("benchmark").agg(F.count(F.lit(1)).alias(name))

    out = expected
    for df, name in ((loaded, "loaded_count"), (kept, "sample_count"), (skipped, "skipped_count")):
        out = out.join(tally(df, name), "benchmark", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.select(
        "benchmark",
        F.when(~F.col("found"), "missing").when(F.col("sample_count") > 0, "ok").otherwise("empty").alias("status"),
        "loaded_count",
        "sample_count",
        "skipped_count",
    )


def skip_reasons(skipped: DataFrame) -> DataFrame:
    """Rows set aside per benchmark and kind of reason (the text before any ':')."""
    return skipped.groupBy("benchmark", F.regexp_extract("reason", r"^([^:]*)", 1).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )
