"""Tar shards of keyed samples.

A first pass walks the headers of each shard, a few shards to a task, and yields
where every member of a sample lies. A second pass fetches only the members
asked for, with the byte ranges of large shards spread over many tasks: a job
over captions never reads image bytes, and one giant shard is no bottleneck.
Members that lie next to each other are read at once.

Conditions on `shard` reach the index scan (with `spark.sql.python.filterPushdown.enabled`),
so shards that they rule out are never opened.
"""

from __future__ import annotations

import io
import math
import re
import tarfile
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from ..session import materialize, work_partitions
from .files import open_input
from .shards import expand_shards

INDEX_SCHEMA = (
    "shard string, sample_index bigint, key string, members map<string,struct<offset:bigint,size:bigint>>, error string"
)
KEY_AND_EXTENSION = re.compile(r"^((?:.*/)?[^/.][^/.]*)\.([^/]*)$")
# Index tasks a core. Starting a task takes longer than walking a shard of some hundred members.
INDEX_TASKS = 4
# Read-ahead while walking headers: larger buffers would read the payload as well.
HEADER_BYTES = 4096
FETCH_BYTES = 64 * 1024 * 1024
# Bytes between two wanted members up to which one read takes both: less than a further request costs.
GAP_BYTES = 64 * 1024
RUN_BYTES = 16 * 1024 * 1024


class ShardPartition(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    @property
    def path(self) -> str:
        """The paths joined as in the option."""
        return "::".join(self.paths)


def index_shard(path: str, fail: bool) -> Iterator[tuple]:
    """Rows of INDEX_SCHEMA for one shard. Consecutive members of one stem form a sample.

    A damaged shard ends with a row that has only an error, unless `fail`.
    """
    count, key, members = 0, None, {}
    try:
        with open_input(path) as raw, tarfile.open(fileobj=io.BufferedReader(raw, HEADER_BYTES), mode="r:") as archive:
            for member in archive:
                found = KEY_AND_EXTENSION.match(member.name) if member.isfile() else None
                if found is None:
                    continue
                stem, extension = found.group(1), found.group(2).lower()
                if stem != key:
                    if members:
                        yield path, count, key, members, None
                        count += 1
                    key, members = stem, {}
                if extension in members:
                    if fail:
                        raise ValueError(f"duplicate member {member.name} in {path}")
                    yield path, None, key, None, f"duplicate member {member.name}"
                    continue
                members[extension] = (member.offset_data, member.size)
    except Exception as exc:
        if fail:
            raise
        if members:
            yield path, count, key, members, None
        yield path, None, None, None, f"{type(exc).__name__}: {exc}"
        return
    if members:
        yield path, count, key, members, None


def f_on_shard(f: Filter) -> bool:
    return isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("shard",)


def shard_passes(f: Filter, path: str) -> bool:
    if isinstance(f, In):
        return path in f.value
    return path.startswith(f.value) if isinstance(f, StringStartsWith) else path == f.value


class TarShardReader(DataSourceReader):
    def __init__(self, paths: list[str], fail: bool, tasks: int | None = None) -> None:
        self.paths, self.fail, self.tasks = paths, fail, tasks

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Shards that a condition on `shard` rules out get no partition; all other conditions stay with Spark."""
        for f in filters:
            if f_on_shard(f):
                self.paths = [p for p in self.paths if shard_passes(f, p)]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        tasks = min(self.tasks or len(self.paths), len(self.paths))
        return [ShardPartition(self.paths[i::tasks]) for i in range(tasks)]

    def read(self, partition: ShardPartition) -> Iterator[tuple]:
        for path in partition.paths:
            yield from index_shard(path, self.fail)


class TarShardSource(DataSource):
    """`spark.read.format("tar_shards")`: one row per sample with member offsets.

    Options: `errors` = skip (default) or fail; `tasks`, to which the shards are dealt
    in turn (default: one for each shard). The path is a pattern with
    braces and wildcards, several joined by '::'.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def schema(self) -> str:
        return INDEX_SCHEMA

    def reader(self, schema) -> TarShardReader:
        paths = expand_shards(self.options["path"].split("::"))
        return TarShardReader(paths, self.options.get("errors", "skip") == "fail", int(self.options.get("tasks", 0)))


def read_index(spark: SparkSession, pattern: str | Sequence[str], errors: str = "skip") -> DataFrame:
    """Sample index of tar shards, errors included as rows without a sample."""
    spark.dataSource.register(TarShardSource)
    path = pattern if isinstance(pattern, str) else "::".join(pattern)
    tasks = INDEX_TASKS * spark.sparkContext.defaultParallelism
    return spark.read.format("tar_shards").option("errors", errors).option("tasks", tasks).load(path)


def read_tar_shards(
    spark: SparkSession,
    pattern: str | Sequence[str],
    members: Sequence[str] | None = None,
    errors: str = "skip",
    where=None,
    keep_names: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(samples, problems) of tar shards.

    samples is (shard, sample_index, key, members map<string,binary>) with only
    the extensions in `members` fetched (all by default); with `keep_names` the others
    stay in the map without bytes, for filters on what a sample has. `where` is a condition
    on the index, such as a presence filter on the member names: samples it
    drops are never fetched. problems is (shard, key, error). The index is
    written once and serves both.
    """
    index = materialize(read_index(spark, pattern, errors), "tar-index")
    problems = index.where(F.col("error").isNotNull()).select("shard", "key", "error")
    wanted = index.where(F.col("error").isNull())
    if where is not None:
        wanted = wanted.where(where)
    if members is not None:
        names = F.array(*[F.lit(m.lower()) for m in members])
        if keep_names:
            unread = lambda k, v: F.when(F.array_contains(names, k), v)
            wanted = wanted.withColumn("members", F.transform_values("members", unread))
        else:
            wanted = wanted.withColumn("members", F.map_filter("members", lambda k, _: F.array_contains(names, k)))
    return fetch_members(wanted), problems


def read_runs(read_at, spans: list[tuple[int, int]]) -> list[bytes]:
    """The bytes of (offset, size) spans in their order, neighbours read at once."""
    data: list[bytes] = [b""] * len(spans)
    run: list[int] = []
    start = end = 0

    def flush() -> None:
        if run:
            block = read_at(end - start, start)
            for i in run:
                offset, size = spans[i]
                data[i] = bytes(block[offset - start : offset - start + size])

    for i in sorted(range(len(spans)), key=lambda i: spans[i]):
        offset, size = spans[i]
        if run and offset - end <= GAP_BYTES and max(end, offset + size) - start <= RUN_BYTES:
            end = max(end, offset + size)
        else:
            flush()
            run, start, end = [], offset, offset + size
        run.append(i)
    flush()
    return data


def fetch_members(index: DataFrame) -> DataFrame:
    """Replace member offsets by bytes; byte ranges of one shard go to different tasks.

    The number of tasks follows the bytes to fetch, which the small index rows
    do not show, and is at least the usual one: what comes next is often costly.
    """
    sizes = F.transform(F.map_values("members"), lambda m: F.coalesce(m["size"], F.lit(0).cast("bigint")))
    total = index.agg(F.sum(F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    tasks = max(work_partitions(index.sparkSession), math.ceil(total / FETCH_BYTES))
    start = F.array_min(F.transform(F.map_values("members"), lambda m: m["offset"]))
    spread = index.select(
        "shard",
        "sample_index",
        "key",
        F.transform(F.map_entries("members"), lambda e: F.struct(e["key"].alias("name"), e["value"]["offset"].alias("offset"), e["value"]["size"].alias("size"))).alias("parts"),
        F.floor(F.coalesce(start, F.lit(0)) / FETCH_BYTES).alias("__range"),
    ).repartition(tasks, "shard", "__range").sortWithinPartitions("shard", "sample_index").drop("__range")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        handle, current = None, None
        try:
            for pdf in batches:
                for shard, rows in pdf.groupby("shard", sort=False):
                    if shard != current:
                        if handle is not None:
                            handle.close()
                        handle, current = open_input(shard), shard
                    names = [[p["name"] for p in parts] for parts in rows["parts"]]
                    # A member that is not wanted has no place; pandas shows that as None or NaN.
                    wanted = [[not pd.isna(p["size"]) for p in parts] for parts in rows["parts"]]
                    spans = [(int(p["offset"]), int(p["size"])) for parts in rows["parts"] for p in parts if not pd.isna(p["size"])]
                    found = iter(read_runs(handle.read_at, spans))
                    data = [[next(found) if w else None for w in flags] for flags in wanted]
                    yield pd.DataFrame(
                        {
                            "shard": rows["shard"].to_numpy(),
                            "sample_index": rows["sample_index"].to_numpy(),
                            "key": rows["key"].to_numpy(),
                            "names": names,
                            "data": data,
                        }
                    )
        finally:
            if handle is not None:
                handle.close()

    fetched = spread.mapInPandas(
        fetch, "shard string, sample_index bigint, key string, names array<string>, data array<binary>"
    )
    return fetched.select("shard", "sample_index", "key", F.map_from_arrays("names", "data").alias("members"))
