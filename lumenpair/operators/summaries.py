"""Grouped summaries, leaderboard, failure reports and histograms of score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import attach, exact_median, per_group_side

OVERALL = "overall"
# Fixed value: bins of the margin distribution.
HISTOGRAM_BINS = 30


def summarize(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[Sequence[str]],
    aggregates: Sequence[Column],
    medians: dict[str, str] | None = None,
    overall: str | None = None,
) -> DataFrame:
    """Aggregates and exact medians at several grouping levels in one result.

    `level` numbers the levels, so a summary row is told apart from a group
    whose key is genuinely null. Below the first level the column `overall` is
    labelled 'overall' and other absent keys are null. `medians` maps result
    names to value columns; nulls are passed over.
    """
    sets = [
        F.struct(
            F.lit(i).alias("level"),
            *[
                (
                    F.col(k)
                    if k in level
                    else F.lit(OVERALL if k == overall else None).cast(df.schema[k].dataType)
                ).alias(k)
                for k in keys
            ],
        )
        for i, level in enumerate(levels)
    ]
    rest = [c for c in df.columns if c not in keys]
    rows = df.select(F.inline(F.array(*sets)), *rest) if len(sets) > 1 else df.withColumn("level", F.lit(0))
    by = ["level", *keys]
    base = rows.groupBy(*by).agg(*aggregates)
    if medians:
        long = rows.select(
            *by, F.inline(F.array(*[F.struct(F.lit(n).alias("__m"), F.col(c).alias("__x")) for n, c in medians.items()]))
        )
        found = exact_median(long, [*by, "__m"], "__x", "__median")
        wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("__m") == n, F.col("__median"))).alias(n) for n in medians])
        base = attach(base, wide, by)
    return base


def _pairwise() -> list[Column]:
    return [
        F.avg("correct").alias("accuracy"),
        F.avg("hard_margin").alias("mean_margin"),
        F.stddev_samp("hard_margin").alias("margin_std"),
        F.avg((F.col("score_neg") >= F.col("score_pos")).cast("int")).alias("negative_win_rate"),
        F.count(F.lit(1)).alias("sample_count"),
    ]


PAIRWISE_MEDIAN = {"median_margin": "hard_margin"}
PAIRWISE_COLUMNS = (
    "accuracy",
    "mean_margin",
    "median_margin",
    "margin_std",
    "negative_win_rate",
    "sample_count",
)
TWO_BY_TWO_COLUMNS = (
    "text_score",
    "image_score",
    "group_score",
    "group_min_margin_mean",
    "group_min_margin_median",
    "sample_count",
)


def summarize_by_category(pairwise: DataFrame, benchmark: str = "aro") -> DataFrame:
    """(model, category) and overall rows of one benchmark."""
    rows = pairwise.where(F.col("benchmark") == benchmark)
    keys = ["model_name", "category"]
    out = summarize(rows, keys, [keys, ["model_name"]], _pairwise(), PAIRWISE_MEDIAN, "category")
    return out.select("level", *keys, *PAIRWISE_COLUMNS)


def summarize_by_subcategory(pairwise: DataFrame, benchmark: str = "sugarcrepe") -> DataFrame:
    """(model, category, subcategory) and overall rows of one benchmark."""
    rows = pairwise.where(F.col("benchmark") == benchmark)
    keys = ["model_name", "category", "subcategory"]
    out = summarize(rows, keys, [keys, ["model_name"]], _pairwise(), PAIRWISE_MEDIAN, "category")
    return out.select("level", *keys, *PAIRWISE_COLUMNS)


def summarize_by_benchmark(pairwise: DataFrame) -> DataFrame:
    """(model, benchmark, category, subcategory) and (model, benchmark) rows."""
    keys = ["model_name", "benchmark", "category", "subcategory"]
    out = summarize(pairwise, keys, [keys, keys[:2]], _pairwise(), PAIRWISE_MEDIAN, "category")
    return out.select("level", *keys, *PAIRWISE_COLUMNS)


def _two_by_two() -> list[Column]:
    return [
        F.avg("text_score").alias("text_score"),
        F.avg("image_score").alias("image_score"),
        F.avg("group_score").alias("group_score"),
        F.avg("group_min_margin").alias("group_min_margin_mean"),
        F.count(F.lit(1)).alias("sample_count"),
    ]


TWO_BY_TWO_MEDIAN = {"group_min_margin_median": "group_min_margin"}


def summarize_2x2(scores: DataFrame, benchmark: str = "winoground") -> DataFrame:
    """One row per model."""
    rows = scores.where(F.col("benchmark") == benchmark)
    out = summarize(rows, ["model_name"], [["model_name"]], _two_by_two(), TWO_BY_TWO_MEDIAN)
    return out.select("model_name", *TWO_BY_TWO_COLUMNS)


def summarize_2x2_by_benchmark(scores: DataFrame) -> DataFrame:
    """(model, benchmark, category) and (model, benchmark) rows."""
    keys = ["model_name", "benchmark", "category"]
    out = summarize(scores, keys, [keys, keys[:2]], _two_by_two(), TWO_BY_TWO_MEDIAN, "category")
    return out.select("level", *keys, *TWO_BY_TWO_COLUMNS)


def summarize_margins(pairwise: DataFrame) -> DataFrame:
    """Hard and random margins per (model, benchmark, category) and the gap of their means."""
    keys = ["model_name", "benchmark", "category"]
    out = summarize(
        pairwise,
        keys,
        [keys],
        [
            F.avg("hard_margin").alias("hard_margin_mean"),
            F.avg("random_margin").alias("random_margin_mean"),
            F.count(F.lit(1)).alias("sample_count"),
        ],
        {"hard_margin_median": "hard_margin", "random_margin_median": "random_margin"},
    )
    return out.select(
        *keys,
        "hard_margin_mean",
        "hard_margin_median",
        "random_margin_mean",
        "random_margin_median",
        (F.col("random_margin_mean") - F.col("hard_margin_mean")).alias("hard_vs_random_gap"),
        "sample_count",
    )


def summarize_ssr(pairwise: DataFrame) -> DataFrame:
    """Sensitivity ratio per (model, benchmark, category); rows without a random
    margin stay in the denominator of the invalid ratio."""
    keys = ["model_name", "benchmark", "category"]
    invalid = F.coalesce((F.col("random_margin") <= 0).cast("int"), F.lit(0))
    out = summarize(
        pairwise,
        keys,
        [keys],
        [
            F.avg("ssr").alias("SSR_mean"),
            F.avg(invalid).alias("invalid_random_margin_ratio"),
            F.count(F.lit(1)).alias("sample_count"),
        ],
        {"SSR_median": "ssr"},
    )
    return out.select(*keys, "SSR_mean", "SSR_median", "invalid_random_margin_ratio", "sample_count")


def leaderboard(
    models: DataFrame,
    attribution: DataFrame,
    subcategories: DataFrame,
    two_by_two: DataFrame,
    margins: DataFrame,
    ssr: DataFrame,
    by_benchmark: DataFrame,
    two_by_two_by_benchmark: DataFrame,
) -> DataFrame:
    """One row per registered model (model_name, model_type); null where a summary lacks it.

    The inputs are summary tables. Margins and ratios are means over category
    means, SSR_median is the median over category medians.
    """

    def pick(df: DataFrame, where: Column, value: str, name: str) -> Column:
        return F.max(F.when(where, F.col(value))).alias(name)

    category = F.col("category")
    top = (F.col("level") == 1) & (category == OVERALL)
    one = (F.col("level") == 0) & (F.lit(True))
    parts = [
        attribution.groupBy("model_name").agg(
            pick(attribution, top, "accuracy", "ARO_overall_acc"),
            *[pick(attribution, one & (category == c), "accuracy", f"ARO_{c}_acc") for c in ("attr", "rel", "order")],
            pick(attribution, top, "mean_margin", "ARO_mean_margin"),
        ),
        subcategories.groupBy("model_name").agg(
            pick(subcategories, top, "accuracy", "SugarCrepe_overall_acc"),
            pick(subcategories, top, "mean_margin", "SugarCrepe_mean_margin"),
        ),
        by_benchmark.where((F.col("benchmark") == "sugarcrepe_pp") & top)
        .groupBy("model_name")
        .agg(F.max("accuracy").alias("SugarCrepePP_overall_acc"), F.max("mean_margin").alias("SugarCrepePP_mean_margin")),
        two_by_two.select(
            "model_name",
            F.col("text_score").alias("Winoground_text_score"),
            F.col("image_score").alias("Winoground_image_score"),
            F.col("group_score").alias("Winoground_group_score"),
            F.col("group_min_margin_mean").alias("Winoground_group_min_margin"),
        ),
        two_by_two_by_benchmark.where((F.col("benchmark") == "bivlc") & top).select(
            "model_name",
            F.col("text_score").alias("BiVLC_i2t_score"),
            F.col("image_score").alias("BiVLC_t2i_score"),
            F.col("group_score").alias("BiVLC_group_score"),
            F.col("group_min_margin_mean").alias("BiVLC_group_min_margin"),
        ),
        margins.groupBy("model_name").agg(
            F.avg("hard_margin_mean").alias("Hard_margin_mean"), F.avg("random_margin_mean").alias("Random_margin_mean")
        ),
        # Summary rows: one per benchmark and category of a model.
        ssr.groupBy("model_name").agg(F.avg("SSR_mean").alias("SSR_mean"), F.median("SSR_median").alias("SSR_median")),
    ]
    out = models.select("model_name", "model_type")
    for part in parts:
        out = out.join(part, "model_name", "left")
    return out.orderBy("model_name")


def largest_gaps(margins: DataFrame, n: int = 12) -> DataFrame:
    """Groups in which random negatives are much easier than hard ones."""
    keys = ["model_name", "benchmark", "category"]
    return margins.orderBy(F.desc_nulls_last("hard_vs_random_gap"), *keys).limit(n)


def weakest_slices(summary: DataFrame, n: int = 10) -> DataFrame:
    """Slices of lowest accuracy, overall rows left out."""
    keys = [c for c in ("model_name", "category", "subcategory") if c in summary.columns]
    return summary.where(F.col("level") == 0).orderBy(F.asc_nulls_last("accuracy"), *keys).limit(n)


def lowest_ssr(ssr: DataFrame, n: int = 12) -> DataFrame:
    keys = ["model_name", "benchmark", "category"]
    return ssr.orderBy(F.asc_nulls_last("SSR_mean"), *keys).limit(n)


def model_margin_means(margins: DataFrame) -> DataFrame:
    """Means over the category means of a model."""
    return margins.groupBy("model_name").agg(
        F.avg("hard_margin_mean").alias("hard_margin_mean"), F.avg("random_margin_mean").alias("random_margin_mean")
    )


def margin_histogram(
    pairwise: DataFrame, value: str = "hard_margin", key: str = "model_name", bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """Density over `bins` equal-width bins from minimum to maximum per key, empty bins included.

    The last bin is closed; a constant column gets a range of one around it.
    """
    rows = pairwise.select(key, F.col(value).alias("__v")).where(F.col("__v").isNotNull())
    span = rows.groupBy(key).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count(F.lit(1)).alias("__n"))
    flat = F.col("__lo") == F.col("__hi")
    span = span.select(
        key,
        "__n",
        F.when(flat, F.col("__lo") - 0.5).otherwise(F.col("__lo")).alias("__lo"),
        F.when(flat, F.col("__hi") + 0.5).otherwise(F.col("__hi")).alias("__hi"),
    ).withColumn("__w", (F.col("__hi") - F.col("__lo")) / bins)
    place = F.least(F.floor((F.col("__v") - F.col("__lo")) / F.col("__w")), F.lit(bins - 1)).cast("int")
    span = per_group_side(span)
    counts = attach(rows, span, [key], "inner").groupBy(key, place.alias("bin")).agg(F.count(F.lit(1)).alias("__c"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return attach(grid, counts, [key, "bin"]).select(
        key,
        "bin",
        (F.col("__lo") + F.col("bin") * F.col("__w")).alias("bin_start"),
        F.coalesce("__c", F.lit(0)).alias("count"),
        (F.coalesce("__c", F.lit(0)) / (F.col("__n") * F.col("__w"))).alias("density"),
    )


def names_by_status(items: DataFrame, status: str = "status", name: str = "name") -> DataFrame:
    """Names per status in alphabetical order. `items` has one row per data set."""
    return items.groupBy(status).agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(name)).alias("names")
    )


def accuracy_totals(pairwise: DataFrame) -> DataFrame:
    """Correct answers, rows and accuracy per (model, benchmark)."""
    return pairwise.groupBy("model_name", "benchmark").agg(
        F.sum("correct").alias("correct"),
        F.count(F.lit(1)).alias("total"),
        (F.sum("correct") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("accuracy"),
    )


def two_by_two_totals(scores: DataFrame) -> DataFrame:
    """Sums of the three scores and rows per (model, benchmark)."""
    return scores.groupBy("model_name", "benchmark").agg(
        F.sum("text_score").alias("text"),
        F.sum("image_score").alias("image"),
        F.sum("group_score").alias("group"),
        F.count(F.lit(1)).alias("total"),
    )


def perf_rollup(events: DataFrame, keys: Sequence[str] = ("model", "benchmark", "rank")) -> DataFrame:
    """Pairs, times and pairs per second over all logged steps: sum of pairs over sum of time."""
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("pairs").alias("pairs"),
        F.sum("h2d_time").alias("h2d_time"),
        F.sum("gpu_time").alias("gpu_time"),
        (F.sum("pairs") / F.greatest(F.sum("gpu_time"), F.lit(1e-9))).alias("pairs_per_s"),
    )


def windowed_means(log: DataFrame, step: str, value: str, weight: str, window: int, keys: Sequence[str]) -> DataFrame:
    """Weighted mean per log window, and its running form from the first window on.

    Meters of times restart at each window (`window_mean`), meters of losses
    run on (`running_mean`). Rows are summed per window first; the running sum
    is then taken over windows.
    """
    keys = list(keys)
    per = log.groupBy(*keys, F.floor(F.col(step) / window).alias("log_window")).agg(
        F.sum(F.col(value) * F.col(weight)).alias("__s"), F.sum(weight).alias("__n")
    )
    order = Window.partitionBy(*keys).orderBy("log_window").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = lambda c: F.greatest(c, F.lit(1))
    return per.select(
        *keys,
        "log_window",
        (F.col("__s") / one(F.col("__n"))).alias("window_mean"),
        (F.sum("__s").over(order) / one(F.sum("__n").over(order))).alias("running_mean"),
        F.col("__n").alias("weight"),
    )
