"""Dense positions, bounded top-k per group and exact medians without one-task groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_path

# Sketch accuracy for the median bracket: the bracket holds about 4 / ACCURACY of a group.
ACCURACY = 10_000
# Per-group results of up to this many narrow rows are broadcast to the rows; more of them are joined with a shuffle.
BROADCAST_GROUPS = 100_000


def dense_index(df: DataFrame, *keys: str | Column, name: str = "idx") -> DataFrame:
    """Add a 0-based contiguous position in the order of `keys` (unique together).

    The rows are range-sorted and written once to the shared folder; a row's
    position is its row number within its file plus the sizes of the files
    before it. No task ever holds more than one range, and the position cannot
    change when a stage is run again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "index")
    df.orderBy(*keys).write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    file = F.col("_metadata.file_name")
    sizes = stored.groupBy(file.alias("__file")).agg(F.count(F.lit(1)).alias("__size"))
    # One row per written file, so this window stays as small as the task count.
    order = Window.orderBy(
        F.regexp_extract("__file", r"^part-(\d+)", 1).cast("int"),
        F.regexp_extract("__file", r"-c(\d+)", 1).cast("int"),
    ).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__file", F.coalesce(F.sum("__size").over(order), F.lit(0)).alias("__offset"))
    placed = stored.select("*", file.alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return placed.join(F.broadcast(offsets), "__file").select(
        *df.columns, (F.col("__offset") + F.col("__row")).cast("bigint").alias(name)
    )


def key_index(df: DataFrame, keys: Sequence[str], name: str = "idx") -> DataFrame:
    """`dense_index` by named columns that are unique together, of which one may be null.

    Only the key columns are sorted and stored; the rows get their positions in
    one join on the keys, so wide rows are neither sorted nor written.
    """
    placed = dense_index(df.select(*keys), *keys, name=name)
    if set(df.columns) == set(keys):
        return placed.select(*df.columns, name)
    return attach(df, placed, keys, "inner")


def file_order(df: DataFrame) -> DataFrame:
    """Tag rows of a file scan with their place in the input: file, block, row in the block."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__seq"),
    )


FILE_ORDER = ("source_file", "__block", "__seq")


def top_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int | str,
    spread_on: Sequence[str],
    name: str = "rn",
    salts: int = 64,
) -> DataFrame:
    """First `k` rows of each group in a total `order`, numbered from 1.

    `k` is a number or the name of a column that is constant within the group.
    Each group is first cut to its first `k` rows within `salts` slices chosen
    by `spread_on`, so that a group holding a third of the table is sorted by
    many tasks and the last sort sees at most `salts * k` rows of it.
    """
    limit = F.col(k) if isinstance(k, str) else F.lit(k)
    slice_id = F.pmod(F.xxhash64(*spread_on), F.lit(salts))
    within = Window.partitionBy(*group, "__slice").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    cut = (
        df.withColumn("__slice", slice_id)
        .withColumn("__local", F.row_number().over(within))
        .where(F.col("__local") <= limit)
        .drop("__slice", "__local")
    )
    return cut.withColumn(name, F.row_number().over(whole)).where(F.col(name) <= limit)


def per_group_side(groups: DataFrame) -> DataFrame:
    """One row per group, stored; broadcast while the counted rows are few, so that rows are not shuffled on a few keys."""
    stored = materialize(groups, "groups")
    return F.broadcast(stored) if stored.count() <= BROADCAST_GROUPS else stored


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", lower: bool = False) -> DataFrame:
    """Exact median of the non-null values per group; the middle two are averaged,
    or the lower one taken where `lower`.

    A quantile sketch gives each group a bracket that must hold the median. A
    second pass counts what lies below it and keeps only the bracket's distinct
    values with their counts, so neither a hot group nor a hot value gathers in
    one task. Small groups use their whole range as the bracket.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).alias("__v")).where(F.col("__v").isNotNull())
    slack = 2.0 / ACCURACY
    bounds = F.percentile_approx("__v", F.array(F.lit(0.5 - slack), F.lit(0.5 + slack)), F.lit(ACCURACY))
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), bounds.alias("__b")
    )
    small = F.col("__n") <= ACCURACY
    bracket = stats.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__n"),
        F.when(small, F.col("__min")).otherwise(F.get("__b", F.lit(0))).alias("__lo"),
        F.when(small, F.col("__max")).otherwise(F.get("__b", F.lit(1))).alias("__hi"),
    )
    if keys:
        bracket = per_group_side(bracket)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    # Values under the bracket fold into one "below" row per group (null value).
    joined = rows.join(bracket, cond, "inner") if keys else rows.join(F.broadcast(bracket))  # one row
    counted = (
        joined.where(F.col("__v") <= F.col("__hi"))
        .groupBy(*keys, "__n", F.when(F.col("__v") >= F.col("__lo"), F.col("__v")).alias("__x"))
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    order = Window.partitionBy(*keys).orderBy(F.col("__x").asc_nulls_first())
    upto = F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.floor((F.col("__n") + 1) / 2)
    last = first if lower else F.floor(F.col("__n") / 2) + 1
    ranked = counted.withColumn("__upto", upto).where(F.col("__x").isNotNull())
    hits = lambda rank: (F.col("__upto") >= rank) & (F.col("__upto") - F.col("__c") < rank)
    return ranked.groupBy(*keys).agg(
        F.coalesce(
            (F.max(F.when(hits(first), F.col("__x"))) + F.max(F.when(hits(last), F.col("__x")))) / 2.0
            if not lower
            else F.max(F.when(hits(first), F.col("__x"))),
            F.raise_error(F.lit("the quantile sketch missed the median of a group")),
        ).alias(name)
    )


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-group results on keys that may be null, keeping one copy of the keys."""
    keys = list(keys)
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    if not keys:
        return left.join(F.broadcast(renamed))  # one row
    cond = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = term if cond is None else cond & term
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def one_row(*frames: DataFrame) -> DataFrame:
    """The columns of several one-row results in one row."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


__all__ = ["ACCURACY", "FILE_ORDER", "attach", "dense_index", "exact_median", "file_order", "key_index", "one_row", "per_group_side", "top_per_group"]
