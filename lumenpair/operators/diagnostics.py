"""Statistics of stored feature tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double, cosine, dot, l2_normalize, norm
from .ordering import one_row

# Fixed value: added inside the logarithm and used as a floor.
EPS = 1e-12


def feature_stats(df: DataFrame, feature: str = "feature") -> DataFrame:
    """Mean and population std of the row norms, mean |column mean|, mean column variance."""
    vec = as_double(F.col(feature))
    norms = df.select(norm(vec).alias("__n")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("__n").alias("norm_mean"), F.stddev_pop("__n").alias("norm_std")
    )
    dims = (
        df.select(F.posexplode(vec).alias("__d", "__x"))
        .groupBy("__d")
        .agg(F.avg("__x").alias("__m"), F.var_pop("__x").alias("__v"))
        .agg(F.avg(F.abs("__m")).alias("feature_mean_abs"), F.avg("__v").alias("feature_variance_mean"))
    )
    return one_row(norms, dims)


def _moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(pos, value, width): row count, sums and second moments of the concatenated columns,
    and the width of the first one.

    Each task adds up its batches and emits one set of (p + 1)^2 numbers for
    z = [1, x, y]; Spark sums them by position. A task needs 16 (p + 1)^2 bytes,
    whatever the row count: 420 MB at p = 5120.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, width = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            parts = [np.ones((n, 1))]
            for name in columns:
                parts.append(batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1))
            z, width = np.hstack(parts), parts[1].shape[1]
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(total.size), pa.int64()),
                    pa.array(total.ravel(), pa.float64()),
                    pa.array(np.full(total.size, width), pa.int32()),
                ],
                ["pos", "value", "width"],
            )

    parts = df.select(*columns).mapInArrow(partial, "pos long, value double, width int")
    return parts.groupBy("pos").agg(F.sum("value").alias("value"), F.max("width").alias("width"))


def _centered(pdf: pd.DataFrame) -> tuple[float, np.ndarray]:
    """Row count and centred second moments from a moment table."""
    side = int(round(len(pdf) ** 0.5))
    full = np.zeros(side * side)
    full[pdf["pos"].to_numpy()] = pdf["value"].to_numpy()
    full = full.reshape(side, side)
    n, sums = full[0, 0], full[0, 1:]
    return n, full[1:, 1:] - np.outer(sums, sums) / n


def spectrum(df: DataFrame, feature: str = "feature") -> DataFrame:
    """One row: effective rank, largest and mean of the five largest singular values
    of the centred feature matrix; null with fewer than two rows."""

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        n, gram = _centered(pdf)
        if n < 2:
            return pd.DataFrame({"n": [int(n)], "effective_rank": [None], "top1": [None], "top5_mean": [None]})
        values = np.sqrt(np.clip(np.linalg.eigvalsh(gram)[::-1], 0, None))[: int(min(n, len(gram)))]
        probs = values / max(values.sum(), EPS)
        entropy = -(probs * np.log(probs + EPS)).sum()
        return pd.DataFrame(
            {"n": [int(n)], "effective_rank": [np.exp(entropy)], "top1": [values[0]], "top5_mean": [values[:5].mean()]}
        )

    # One group of (D + 1)^2 numbers, whatever the row count.
    return (
        _moments(df, [feature])
        .groupBy(F.lit("all"))
        .applyInPandas(finish, "n bigint, effective_rank double, top1 double, top5_mean double")
    )


def redundancy(views: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row for two views of the same rows: mean |cosine|, Frobenius norm of the
    cross-covariance (n - 1) and linear CKA."""
    cosines = views.select(F.when(F.size(x) == F.size(y), F.abs(cosine(F.col(x), F.col(y)))).alias("__c")).agg(
        F.avg("__c").alias("cosine_abs_mean")
    )

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        n, c = _centered(pdf)
        d = int(pdf["width"].iloc[0])
        if n < 2:
            return pd.DataFrame({"n": [int(n)], "cross_cov_fro": [None], "linear_cka": [None]})
        cross = c[:d, d:]
        scale = np.sqrt((c[:d, :d] ** 2).sum()) * np.sqrt((c[d:, d:] ** 2).sum())
        return pd.DataFrame(
            {
                "n": [int(n)],
                "cross_cov_fro": [np.linalg.norm(cross) / max(n - 1, 1)],
                "linear_cka": [(cross**2).sum() / max(scale, EPS)],
            }
        )

    moments = _moments(views, [x, y])
    solved = moments.groupBy(F.lit("all")).applyInPandas(finish, "n bigint, cross_cov_fro double, linear_cka double")
    return one_row(solved, cosines)


def value_stats(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Non-finite count, and min, max, mean, population std of the finite values."""
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    x = F.when(finite, v)
    return df.groupBy(*(keys or [])).agg(
        F.sum(F.when(v.isNotNull() & ~finite, 1).otherwise(0)).alias("nonfinite_count"),
        F.count(x).alias("finite_count"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
    )


def logit_means(pairs: DataFrame, image: str = "image", text: str = "text", scale: float = 1.0) -> DataFrame:
    """One row: mean scaled cosine of matching and of non-matching pairs.

    The sum over all pairs is the product of the two vector sums, so the
    non-matching mean costs one pass and no pair is formed.
    """
    unit = pairs.select(l2_normalize(F.col(image)).alias("i"), l2_normalize(F.col(text)).alias("t"))
    diagonal = unit.agg(F.count(F.lit(1)).alias("n"), F.sum(dot(F.col("i"), F.col("t"))).alias("own"))
    sums = (
        unit.select(F.posexplode(F.arrays_zip("i", "t")).alias("d", "z"))
        .groupBy("d")
        .agg(F.sum("z.i").alias("si"), F.sum("z.t").alias("st"))
        .agg(F.sum(F.col("si") * F.col("st")).alias("every"))
    )
    n = F.col("n")
    return one_row(diagonal, sums).select(
        "n",
        (F.lit(scale) * F.col("own") / n).alias("logits_pos_mean"),
        F.when(n > 1, F.lit(scale) * (F.col("every") - F.col("own")) / (n * n - n)).alias("logits_neg_mean"),
    )
