"""Vector expressions on array<float> or array<double> columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import let

# Fixed value: floor of the norm before division.
NORM_FLOOR = 1e-12


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two array<double> columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector; norms under the floor are divided by the floor."""
    return let(
        as_double(v),
        lambda d: let(F.greatest(norm(d), F.lit(NORM_FLOOR)), lambda n: F.transform(d, lambda x: x / n)),
    )


def mean_pool(m: Column) -> Column:
    """Mean over the K rows of a [K, D] array column."""
    return F.transform(
        F.sequence(F.lit(0), F.size(F.element_at(m, 1)) - 1),
        lambda i: F.aggregate(m, F.lit(0.0), lambda acc, row: acc + F.get(row, i).cast("double")) / F.size(m),
    )


def cosine(a: Column, b: Column) -> Column:
    return dot(l2_normalize(a), l2_normalize(b))


def score_block(images: Column, texts: Column) -> Column:
    """Scores of each vector of `images` against each of `texts`, as array<array<double>>.

    Both columns are short arrays of vectors held in one row (a 2x2 sample).
    """
    return F.transform(images, lambda a: F.transform(texts, lambda b: dot(a, b)))
