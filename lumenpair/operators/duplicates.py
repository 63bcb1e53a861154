"""Byte-identical file reports. Files are compared, never changed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_partitions
from ..sources.files import open_input

# Suffixes counted as raw archives.
ARCHIVE_SUFFIXES = (".zip", ".tar", ".gz", ".tgz")
CHUNK = 1024 * 1024


def match_pairs(pairs: DataFrame, listing: DataFrame) -> DataFrame:
    """Outcome of each (source, target) pair.

    `listing` has path, length, sha256 and may have `link_target` (null unless
    the entry is a link) and `is_file`. The first applicable reason wins.
    """
    extra = {"link_target": F.lit(None).cast("string"), "is_file": F.lit(True)}
    for column, default in extra.items():
        if column not in listing.columns:
            listing = listing.withColumn(column, default)
    src = listing.select(
        F.col("path").alias("source"),
        F.col("length").alias("__sl"),
        F.col("sha256").alias("__sh"),
        F.col("is_file").alias("__sf"),
    )
    dst = listing.select(
        F.col("path").alias("target"),
        F.col("length").alias("__tl"),
        F.col("sha256").alias("__th"),
        F.col("is_file").alias("__tf"),
        F.col("link_target").alias("__link"),
    )
    regular = F.col("__sf") & F.col("__tf")
    reason = (
        F.when(F.col("__sl").isNull(), "source_missing")
        .when(F.col("__tl").isNull(), "target_missing")
        .when(F.col("__link").isNotNull(), F.col("__link"))
        .when(~regular, "not_regular_file")
        .when(F.col("__sl") != F.col("__tl"), "size_differs")
        .when(F.col("__sh") != F.col("__th"), "sha256_differs")
        .otherwise("identical")
    )
    linked = F.col("__sl").isNotNull() & F.col("__link").isNotNull()
    return (
        pairs.join(src, "source", "left")
        .join(dst, "target", "left")
        .withColumn("reason", reason)
        .select(
            "source",
            "target",
            F.when(linked, "already_symlink")
            .when(F.col("reason") == "identical", "would_symlink")
            .otherwise("skip")
            .alias("action"),
            "reason",
            F.when(~linked & F.col("__sl").isNotNull() & F.col("__tl").isNotNull() & regular, F.col("__tl")).alias(
                "size_bytes"
            ),
        )
    )


def duplicate_groups(listing: DataFrame) -> DataFrame:
    """Groups of byte-identical entries: size, digest, copies, first path, bytes beyond one copy.

    Only counts and minima are kept per group, so its size does not matter.
    """
    return (
        listing.groupBy("length", "sha256")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path"))
        .where(F.col("copies") > 1)
        .withColumn("reclaimable_bytes", F.col("length") * (F.col("copies") - 1))
    )


def reclaimable(matches: DataFrame, applied: str = "would_symlink") -> DataFrame:
    """Per action and reason: pairs and bytes; bytes count only for `applied` actions."""
    return matches.groupBy("action", "reason").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum(F.when(F.col("action") == applied, F.col("size_bytes")).otherwise(F.lit(0))).alias("reclaimable_bytes"),
    )


def file_digests(listing: DataFrame) -> DataFrame:
    """Add sha256 of file contents, read in chunks so that any file size fits.

    Only files whose size occurs more than once are opened; the others cannot
    have a copy and keep a null digest.
    """
    shared = listing.groupBy("length").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).select("length")
    wanted = listing.join(shared, "length", "left_semi").select("path")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for pdf in batches:
            out = []
            for path in pdf["path"]:
                h = hashlib.sha256()
                with open_input(path) as handle:
                    while chunk := handle.read(CHUNK):
                        h.update(chunk)
                out.append(h.hexdigest())
            yield pd.DataFrame({"path": pdf["path"], "sha256": out})

    # Few rows, much work per row: spread by path before opening anything.
    tasks = work_partitions(listing.sparkSession)
    hashed = wanted.repartition(tasks, "path").mapInPandas(digest, "path string, sha256 string")
    return listing.join(hashed, "path", "left")


def largest_archives(listing: DataFrame, n: int | None = None) -> DataFrame:
    """Archive files by size, largest first."""
    from ..functions.records import file_suffix

    found = (
        listing.where(file_suffix(F.col("path")).isin(*ARCHIVE_SUFFIXES))
        .select("path", F.col("length").alias("size_bytes"))
        .orderBy(F.desc("size_bytes"), "path")
    )
    return found.limit(n) if n else found
