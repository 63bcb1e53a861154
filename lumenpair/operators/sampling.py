"""Sub-caption draws, row samples, shuffles, sharding and batching.

Every random choice is a hash of (seed, key, purpose), so results repeat and do
not depend on partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import DRAW_RANGE, hkey, let
from ..session import work_partitions
from .ordering import dense_index, key_index, top_per_group

# Fixed value: joins the sentences of one sub-caption.
SENTENCE_JOINER = ".\n"


def _without_replacement(m: Column, count: Column, draw) -> Column:
    """`count` distinct indices below `m`: the j-th draw picks among the m - j left over."""

    def add(chosen: Column, j: Column) -> Column:
        start = F.pmod(draw(j), m - j)
        index = F.aggregate(F.sort_array(chosen), start, lambda x, c: x + F.when(x >= c, 1).otherwise(0))
        return F.concat(chosen, F.array(index))

    return F.aggregate(F.sequence(F.lit(0), count - 1), F.array().cast("array<bigint>"), add)


def draw_subcaption(sentences: Column, prefix: Column, max_merged: int = 3) -> Column:
    """One sub-caption: 1..max_merged sentences joined by '.' and a line break.

    A single sentence is drawn uniformly. Longer draws are, half of the time, a
    contiguous span and otherwise a random subset; with too few sentences both
    draw with replacement. No sentences give ''.
    """

    def h(*tag: Column | str) -> Column:
        return hkey(prefix, *tag)

    def pick(s: Column) -> Column:
        m = F.size(s).cast("bigint")
        span = (F.pmod(h("size"), F.lit(max(max_merged, 1))) + 1).cast("int")

        def chosen(n: Column) -> Column:
            def draw(j: Column) -> Column:
                return h("pick", j)

            repeated = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.pmod(draw(j), m))
            start = F.pmod(h("start"), m - n + 1)
            contiguous = F.transform(F.sequence(F.lit(0), n - 1), lambda j: start + j)
            return (
                F.when(m < n, repeated)
                .when(F.pmod(h("mode"), F.lit(2)) == 0, contiguous)
                .otherwise(_without_replacement(m, n, draw))
            )

        return F.array_join(
            F.transform(let(span, chosen), lambda i: F.get(s, i.cast("int"))), SENTENCE_JOINER
        )

    return let(sentences, lambda s: F.when(F.size(s) > 0, pick(s)).otherwise(F.lit("")))


def sample_subcaptions(
    df: DataFrame, key: str, sentences: str, k: int = 4, max_merged: int = 3, seed: int = 42, epoch: int = 0
) -> DataFrame:
    """k draws per row as (key, draw, subcaption)."""
    draws = df.select(
        key, sentences, F.explode(F.sequence(F.lit(0), F.lit(max(k, 1) - 1))).alias("draw")
    )
    prefix = F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string"), F.col("draw").cast("string"))
    return draws.select(key, "draw", draw_subcaption(F.col(sentences), prefix, max_merged).alias("subcaption"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows with the smallest hash of (seed, key); all rows if there are fewer."""
    return df.orderBy(hkey(seed, F.col(key)), key).limit(n)


def seeded_sample_per_group(df: DataFrame, group: Sequence[str], key: str, n: int, seed: int = 7) -> DataFrame:
    """`seeded_sample` within each group."""
    drawn = df.withColumn("__h", hkey(seed, F.col(key)))
    return top_per_group(drawn, group, [F.col("__h"), F.col(key)], n, [key], name="__rn").drop("__h", "__rn")


def balanced_quotas(counts: dict[object, int], limit: int) -> dict[object, int]:
    """Rows to take per category when categories take turns until `limit` rows are out.

    Categories take turns in the order of their names. The turn counter runs
    over the categories that still have rows, so one running dry shifts the
    turns of the others; whole rounds in which none can run dry are counted at
    once.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    order = sorted(left, key=str)
    quota = dict.fromkeys(counts, 0)
    turn, remaining = 0, limit
    while remaining > 0 and order:
        rounds = min(min(left[k] for k in order) - 1, remaining // len(order))
        if rounds > 0:
            for k in order:
                quota[k] += rounds
                left[k] -= rounds
            remaining -= rounds * len(order)
            turn += rounds * len(order)
            continue
        k = order[turn % len(order)]
        quota[k] += 1
        left[k] -= 1
        remaining -= 1
        turn += 1
        if not left[k]:
            order.remove(k)
    return quota


def balanced_limit(df: DataFrame, category: str, order: str, limit: int | None) -> DataFrame:
    """At most `limit` rows, spread over categories in turn; rows keep their order in a category.

    Counts of the first 2 * limit + 1 categories by name reach the driver, no
    more: `limit` turns move that far at most, one step per row taken and one
    per category run dry. All rows if there are not more than `limit`, or if the
    limit is null or not positive.
    """
    if limit is None or limit <= 0:
        return df
    if df.select(category).limit(limit + 1).count() <= limit:
        return df
    name = F.coalesce(F.col(category).cast("string"), F.lit("None"))
    first = df.groupBy(category).count().orderBy(name).limit(2 * limit + 1)
    counts = {r[0]: r[1] for r in first.collect()}
    quotas = [(k, q) for k, q in balanced_quotas(counts, limit).items() if q > 0]
    schema = df.select(F.col(category).alias("__category")).schema.add("__quota", T.IntegerType())
    table = df.sparkSession.createDataFrame(quotas, schema)
    # One row per category with a quota; the planner knows its size and chooses the join by it.
    tagged = df.join(table, F.col(category).eqNullSafe(F.col("__category")))
    return top_per_group(tagged, ["__category"], [F.col(order)], "__quota", [order], name="__rn").select(*df.columns)


def head_limit(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """First n rows in `order`; all rows if n is null or not positive."""
    return df if n is None or n <= 0 else df.orderBy(order).limit(n)


def epoch_shuffle(df: DataFrame, key: str, seed: int = 0, epoch: int = 0, position: str | None = None) -> DataFrame:
    """Full shuffle that depends on (seed, epoch) only; optionally with each row's position.

    Draws are uniform, so their range is cut into equal parts, one per
    partition, in order. Unlike a sort by sampled bounds this runs the input
    once. Rows of one key stay together.
    """
    drawn = df.withColumn("__draw", hkey(seed, epoch, F.col(key)))
    if position:
        return dense_index(drawn, "__draw", key, name=position).drop("__draw")
    parts = work_partitions(df.sparkSession)
    part = F.floor(F.col("__draw") / F.lit(DRAW_RANGE) * parts).cast("int")
    rest = [c for c in df.columns if c != key and not df.schema[c].dataType.typeName() == "map"]
    return drawn.repartitionById(parts, part).sortWithinPartitions("__draw", key, *rest).drop("__draw")


def shuffle_shards_then_samples(
    df: DataFrame, shard: str, key: str, seed: int = 0, epoch: int = 0, position: str = "position", group: int = 16
) -> DataFrame:
    """Shards in a seeded order, then samples mixed among `group` neighbouring shards.

    Mixing blocks of neighbouring shards stands in for a sample buffer that is
    filled while shards stream by.
    """
    shards = dense_index(
        df.select(shard).distinct().withColumn("__sd", hkey(seed, epoch, F.col(shard))), "__sd", shard, name="__so"
    ).select(shard, F.floor(F.col("__so") / group).alias("__block"))
    drawn = df.join(shards, shard).withColumn("__draw", hkey(seed, epoch, F.col(key)))
    return dense_index(drawn, "__block", "__draw", key, name=position).drop("__block", "__draw")


def weighted_shards(
    spark, sources: str | Sequence[str], weights: str | Sequence[float] | None, draws: int, seed: int = 0, epoch: int = 0
) -> DataFrame:
    """(draw, path): shards drawn with replacement, each with the weight of its source.

    `sources` are patterns, or one string of patterns joined by '::', expanded
    to shard paths; `weights` are given likewise, one per source.
    """
    from ..sources.shards import expand_shards

    names = sources.split("::") if isinstance(sources, str) else list(sources)
    if weights is None:
        values = [1.0] * len(names)
    else:
        values = [float(w) for w in (weights.split("::") if isinstance(weights, str) else weights)]
    if len(values) != len(names):
        raise ValueError(f"Expected {len(names)} weights, one per source, got {len(values)}")
    expanded = [expand_shards(n) for n in names]
    paths = [(s, i, p) for s, found in enumerate(expanded) for i, p in enumerate(found)]
    table = spark.createDataFrame(paths, "source int, position bigint, path string")
    drawn = weighted_draws(spark.range(draws).withColumnRenamed("id", "draw"), "draw",
                           [len(e) * w for e, w in zip(expanded, values)], seed, epoch)
    sizes = F.array(*[F.lit(len(e)).cast("bigint") for e in expanded])
    placed = drawn.withColumn("position", F.pmod(hkey(seed, epoch, F.col("draw"), "shard"), F.get(sizes, F.col("source"))))
    return placed.join(table, ["source", "position"]).select("draw", "path")


def weighted_draws(
    df: DataFrame, key: str, weights: Sequence[float], seed: int = 0, epoch: int = 0, name: str = "source"
) -> DataFrame:
    """Add the index of a source drawn in proportion to `weights` (few, given by the caller).

    The draw is compared with the cumulative weights held as literals: no join.
    """
    total = math.fsum(weights)
    cumulative = [math.fsum(weights[: i + 1]) / total for i in range(len(weights) - 1)]
    u = hkey(seed, epoch, F.col(key)) / F.lit(DRAW_RANGE)
    index = F.lit(0)
    for bound in cumulative:
        index = index + F.when(u >= bound, 1).otherwise(0)
    return df.withColumn(name, index.cast("int"))


def resample_rows(df: DataFrame, key: str, weight: Column, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Repeat each row floor(weight) times, once more with probability frac(weight)."""
    fraction = weight - F.floor(weight)
    extra = F.when(hkey(seed, epoch, F.col(key)) / F.lit(DRAW_RANGE) < fraction, 1).otherwise(0)
    return (
        df.withColumn("__n", (F.floor(weight) + extra).cast("int"))
        .where(F.col("__n") > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
        .drop("__n")
    )


def rank_shard(df: DataFrame, world: int, *order: str) -> DataFrame:
    """Add `rank`: rows dealt out in turn to `world` ranks in the order given (columns that are unique together)."""
    return key_index(df, order, "__idx").withColumn("rank", (F.col("__idx") % world).cast("int")).drop("__idx")


def fixed_batches(df: DataFrame, size: int, *order: str, partial: bool = True) -> DataFrame:
    """Add `batch_id` and `batch_pos` by `order` (unique together); the short last batch is dropped unless `partial`."""
    indexed = key_index(df, order, "__idx")
    if not partial:
        n = df.count()
        indexed = indexed.where(F.col("__idx") < n - n % size)
    return indexed.select(
        *df.columns,
        F.floor(F.col("__idx") / size).alias("batch_id"),
        (F.col("__idx") % size).cast("int").alias("batch_pos"),
    )


def epoch_plan(
    samples: DataFrame, batch_size: int, world: int, workers: int, floor: bool = False, shards: str | None = None
) -> DataFrame:
    """One row: batches per epoch and worker, and the samples they amount to.

    With a shard column the number of shards is checked against the workers;
    too few fail the job.
    """
    round_ = F.floor if floor else F.ceil
    workers = max(1, workers)
    counted = samples.agg(
        F.count(F.lit(1)).alias("num_samples"),
        (F.countDistinct(shards) if shards else F.lit(workers * world)).alias("num_shards"),
    )
    enough = F.when(
        F.col("num_shards") < workers * world,
        F.raise_error(F.lit("number of shards must be >= total workers")).cast("bigint"),
    ).otherwise(round_(F.col("num_samples") / (batch_size * world)))
    return (
        counted.withColumn("__batches", enough)
        .withColumn("worker_batches", round_(F.col("__batches") / workers))
        .select(
            "num_samples",
            "num_shards",
            "worker_batches",
            (F.col("worker_batches") * workers).alias("num_batches"),
            (F.col("worker_batches") * workers * batch_size * world).alias("epoch_samples"),
        )
    )


def eval_batches(samples: DataFrame, batch_size: int) -> DataFrame:
    """One row: evaluation batches, the partial last one included."""
    return samples.agg(F.ceil(F.count(F.lit(1)) / batch_size).alias("num_batches"))


def route_splits(df: DataFrame, split: str = "split") -> DataFrame:
    """Add `route`: train (train, restval), val or test; other rows leave."""
    route = F.when(F.col(split).isin("train", "restval"), "train").when(F.col(split).isin("val", "test"), F.col(split))
    return df.withColumn("route", route).where(F.col("route").isNotNull())


def dataset_size(samples: DataFrame, shard: str, configured: int | None = None) -> DataFrame:
    """One row (num_samples, num_shards): the configured count, else the counted one.

    Zero samples fail the job: an epoch cannot be sized without them.
    """
    per_shard = samples.groupBy(shard).agg(F.count(F.lit(1)).alias("__n"))
    total = F.lit(configured).cast("bigint") if configured is not None else F.coalesce(F.sum("__n"), F.lit(0))
    counted = per_shard.agg(total.alias("num_samples"), F.count(F.lit(1)).alias("num_shards"))
    checked = F.when(
        F.col("num_samples") <= 0, F.raise_error(F.lit("the number of samples must be specified")).cast("bigint")
    ).otherwise(F.col("num_samples"))
    return counted.select(checked.alias("num_samples"), "num_shards")
