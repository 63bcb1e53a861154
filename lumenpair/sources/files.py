"""File access by URI from driver and tasks, and recursive listings."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import file_suffix


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a plain path or a URI (file, hdfs, s3, gs)."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + unquote(path.removeprefix("file:").lstrip("/"))
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def open_input(path: str):
    """Seekable binary reader of one file."""
    fs, name = resolve(path)
    return fs.open_input_file(name)


def glob_paths(pattern: str) -> list[str]:
    """Files that match a pattern with wildcards; empty for a pattern without any."""
    if not any(ch in pattern for ch in "*?["):
        return []
    fs, name = resolve(pattern)
    # The part of a URI before the path is put back, so that tasks find the same file system.
    prefix = pattern.removesuffix(name) if "://" in pattern and pattern.endswith(name) else ""
    fixed = re.split(r"[*?\[]", name, maxsplit=1)[0].rpartition("/")[0] or "."
    recursive = "/" in name[len(fixed) + 1 :]
    found = fs.get_file_info(pafs.FileSelector(fixed, allow_not_found=True, recursive=recursive))
    depth = name.count("/")
    return sorted(
        prefix + i.path
        for i in found
        if i.is_file and i.path.count("/") == depth and fnmatch.fnmatchcase(i.path, name)
    )


def list_files(
    spark: SparkSession, root: str | Sequence[str], suffixes: Sequence[str] | None = None, recursive: bool = True
) -> DataFrame:
    """(path, length, modification_time, suffix) of the files under `root`.

    The content column is never selected, so no file is opened. Paths are
    plain for local files.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    roots = [root] if isinstance(root, str) else list(root)
    files = reader.load(roots).select(
        F.regexp_replace("path", r"^file:/+", "/").alias("path"),
        "length",
        F.col("modificationTime").alias("modification_time"),
    )
    files = files.withColumn("suffix", file_suffix(F.col("path")))
    if suffixes is not None:
        files = files.where(F.col("suffix").isin([s.lower() for s in suffixes]))
    return files


def count_files(files: DataFrame) -> DataFrame:
    """Files and bytes per suffix."""
    return files.groupBy("suffix").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def count_by_name_part(files: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Files per suffix with one column per name part: how many paths contain it."""
    hits = [
        F.sum(F.when(F.contains(F.lower("path"), F.lit(p.lower())), 1).otherwise(0)).alias(f"files_{p}") for p in parts
    ]
    return files.groupBy("suffix").agg(F.count(F.lit(1)).alias("files"), *hits)
