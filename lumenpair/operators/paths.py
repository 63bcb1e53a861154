"""Image references resolved against a file listing by joins, never by per-row file system calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import basename, candidate_names


def resolve_paths(
    df: DataFrame, value: str, base_dirs: Sequence[str], listing: DataFrame, name: str = "image_path"
) -> DataFrame:
    """Add the first existing path of each reference, or null.

    Order: the reference itself when absolute, then `base/reference` for each
    base in turn, then `base/last part` for each base in turn. `listing` has a
    `path` column. Each distinct reference is resolved once.
    """
    ref = F.col("__lookup_ref")
    full = [F.concat(F.lit(b.rstrip("/") + "/"), ref) for b in base_dirs]
    last = [F.concat(F.lit(b.rstrip("/") + "/"), basename(ref)) for b in base_dirs]
    absolute = ref.startswith("/")
    # An absolute reference replaces the base when the two are joined.
    ordered = F.when(absolute, F.concat(F.array(ref), F.array(*last) if last else F.array().cast("array<string>")))
    ordered = ordered.otherwise(F.array(*full, *last)) if full else ordered.otherwise(F.array().cast("array<string>"))
    refs = df.select(F.col(value).alias("__lookup_ref")).where(F.col(value).isNotNull()).distinct()
    tried = refs.select("__lookup_ref", F.posexplode(ordered).alias("__priority", "path"))
    found = (
        tried.join(listing.select("path").distinct(), "path")
        .groupBy("__lookup_ref")
        .agg(F.min_by("path", "__priority").alias(name))
    )
    kept = df.drop(name) if name in df.columns else df
    return kept.join(found, kept[value] == found["__lookup_ref"], "left").drop("__lookup_ref")


def has_image(df: DataFrame, value: str, roots: Sequence[str], listing: DataFrame, prefix: str | None = None) -> DataFrame:
    """Add `image_ok`: whether any candidate name of the reference exists under any root."""
    refs = df.select(F.col(value).alias("__lookup_ref")).where(F.col(value).isNotNull()).distinct()
    tried = refs.select("__lookup_ref", F.explode(candidate_names(F.col("__lookup_ref"), prefix)).alias("__name"))
    paths = tried.select(
        "__lookup_ref",
        F.explode(F.array(*[F.concat(F.lit(r.rstrip("/") + "/"), F.col("__name")) for r in roots])).alias("path"),
    )
    found = (
        paths.join(listing.select("path").distinct(), "path", "left_semi")
        .select("__lookup_ref")
        .distinct()
        .withColumn("__hit", F.lit(True))
    )
    return (
        df.join(found, df[value] == found["__lookup_ref"], "left")
        .withColumn("image_ok", F.coalesce("__hit", F.lit(False)))
        .drop("__lookup_ref", "__hit")
    )


def missing_members(df: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of `df` whose key is absent from a listing or feature table."""
    return df.join(table.select(*on), list(on), "left_anti")
