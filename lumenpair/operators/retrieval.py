"""Image-text retrieval: all-pairs work in tiles, ranks, recall, top-k and re-ranking.

Images are (image_id, feature), captions are (text_id, image_id, feature) with
many captions to an image. The similarity matrix is never stored: each tile of
it lives in one task, which emits counts only; top k comes out of walks (`walks`).

Rows take part if their vector is there, has no missing or non-finite number, and
has the width that most rows have. A caption whose image takes no part takes none
either, nor does an image without any caption left: `set_aside` lists both with reasons.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2_normalize
from ..session import materialize
from .ordering import exact_median, top_per_group
from .walks import walked

# Rows of each side per tile, at most and at least, and the bytes that one side may take;
# a task holds two blocks of vectors and one strip of scores.
MAX_TILE_ROWS, MIN_TILE_ROWS = 32768, 1024
SIDE_BYTES = 32 << 20
# Small tiles asked for are joined to larger ones beyond so many a core: what is shuffled, and the number of tasks,
# then grow with the rows and not with the pairs.
TILES_PER_CORE = 8
# Rows and columns of a tile that are scored at once.
STRIP_ROWS, STRIP_COLUMNS = 512, 2048
# Bytes of inputs that a pair scorer is given at once, and the most rows of its tiles: a pair costs it more.
STRIP_BYTES = 64 << 20
SCORER_TILE_ROWS = 16384
MAX_TILE_TASKS = 100_000
# Scores closer than this count as equal: block and row kernels sum in different orders.
TIE = 1e-9
TOP_DIGITS = 12


def normalized(df: DataFrame, feature: str = "feature") -> DataFrame:
    return df.withColumn(feature, l2_normalize(F.col(feature)))


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    values = pa.concat_arrays(table.column(column).chunks) if table.num_rows else None
    if values is None:
        return np.empty((0, 0))
    lengths = values.value_lengths()
    if values.null_count or pa.compute.min_max(lengths)["min"] != pa.compute.min_max(lengths)["max"]:
        raise ValueError(f"{column} needs vectors of one width in all rows")
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1)


def _whole(feature: Column, width: int) -> Column:
    finite = F.forall(feature.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return feature.isNotNull() & (F.size(feature) == width) & finite


class Shape(NamedTuple):
    """Rows of each side that have the common width, and that width."""

    images: int
    captions: int
    width: int

    @property
    def sizes(self) -> tuple[int, int]:
        return self.images, self.captions


def shape_of(images: DataFrame, captions: DataFrame) -> Shape:
    """The width that most vectors of both sides have (the smaller one of equals), and the rows with it, in one job."""
    widths = [
        side.where(F.col("feature").isNotNull()).select(F.size("feature").alias("w"), F.lit(k).alias("side"))
        for k, side in enumerate((images, captions))
    ]
    rows = widths[0].unionByName(widths[1])
    counted = rows.groupBy("w").agg(F.count_if(F.col("side") == 0).alias("i"), F.count_if(F.col("side") == 1).alias("t"))
    found = counted.orderBy(F.desc(F.col("i") + F.col("t")), "w").limit(1).collect()
    return Shape(found[0].i, found[0].t, found[0].w) if found else Shape(0, 0, 0)


def usable(df: DataFrame, width: int, feature: str = "feature") -> DataFrame:
    return df.where(_whole(F.col(feature), width))


def set_aside(images: DataFrame, captions: DataFrame) -> DataFrame:
    """(image_id, text_id, reason): the rows that take no part in all-pairs work, with the first reason that holds."""
    width = shape_of(images, captions).width
    none = F.lit(None).cast("bigint")
    broken = lambda name: F.when(F.col("feature").isNull(), F.lit(f"{name} has no vector")).when(
        F.size("feature") != width, F.lit(f"{name} has a vector of another width")
    ).when(~_whole(F.col("feature"), width), F.lit(f"{name} has a vector with missing or non-finite numbers"))
    own = images.select("image_id", broken("image").alias("__image"), F.lit(True).alias("__there"))
    texts = captions.select("text_id", "image_id", broken("caption").alias("__caption")).join(own, "image_id", "left")
    orphan = F.when(F.col("__there").isNull(), F.lit("caption has no image")).when(
        F.col("__image").isNotNull(), F.lit("image of the caption takes no part")
    )
    of_texts = texts.select("image_id", "text_id", F.coalesce("__caption", orphan).alias("reason"))
    kept = texts.where(F.col("__caption").isNull()).select("image_id").distinct()
    served = own.join(kept.withColumn("__served", F.lit(True)), "image_id", "left")
    lonely = F.when(F.col("__served").isNull(), F.lit("image has no caption that takes part"))
    of_images = served.select("image_id", none.alias("text_id"), F.coalesce("__image", lonely).alias("reason"))
    return of_images.unionByName(of_texts).where(F.col("reason").isNotNull())


def _column(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy()


def choose_tile(n_left: int, n_right: int, cores: int, row_bytes: int = 1) -> int:
    """Rows per tile side: large, to repeat few rows, yet small enough to occupy all cores and to fit `SIDE_BYTES`."""
    most = max(1, min(MAX_TILE_ROWS, SIDE_BYTES // max(1, row_bytes)))
    return int(min(most, max(MIN_TILE_ROWS, math.sqrt(n_left * n_right / (2 * cores)))))


def tile_side(asked: int | None, sizes: tuple[int, int], cores: int, row_bytes: int = 1, most: int = MAX_TILE_ROWS) -> int:
    """Rows per tile side: `choose_tile`, or those asked for, more where these would make over `TILES_PER_CORE` tiles a core."""
    largest = choose_tile(1 << 40, 1 << 40, 1, row_bytes)
    if asked is None:
        return min(most, choose_tile(*sizes, cores, row_bytes))
    enough = int(math.sqrt(sizes[0] * sizes[1] / (TILES_PER_CORE * cores)))
    return max(asked, min(most, largest, enough))


def tiles(
    left: DataFrame,
    right: DataFrame,
    sizes: tuple[int, int],
    kernel: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    tile_rows: int | None = None,
    row_bytes: int = 1,
    most: int = MAX_TILE_ROWS,
) -> DataFrame:
    """Run `kernel` on every (left block, right block) tile of image_id and text_id rows.

    Rows go to blocks by a hash of their unique id, so blocks are even whatever
    the data look like; each side is shuffled once per block of the other.
    `sizes` are the row counts (upper bounds will do), `row_bytes` what a row of
    the wider side takes; `tile_rows` is the least side of a tile (`tile_side`).
    """
    spark = left.sparkSession
    tile_rows = tile_side(tile_rows, sizes, spark.sparkContext.defaultParallelism, row_bytes, most)
    left_blocks, right_blocks = (max(1, math.ceil(n / tile_rows)) for n in sizes)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    a = left.withColumn("__lb", block("image_id", left_blocks)).withColumn("__rb", every(right_blocks))
    b = right.withColumn("__rb", block("text_id", right_blocks)).withColumn("__lb", every(left_blocks))
    # A named number, as work grows faster than the bytes that adaptive coalescing
    # looks at. Hashing may put a few tiles into one task.
    tasks = min(left_blocks * right_blocks, MAX_TILE_TASKS)
    a, b = (side.repartition(tasks, "__lb", "__rb") for side in (a, b))

    def run(_key, l: pa.Table, r: pa.Table) -> pa.Table:
        return kernel(l, r)

    return a.groupBy("__lb", "__rb").cogroup(b.groupBy("__lb", "__rb")).applyInArrow(run, schema)


Strips = Callable[[pa.Table, pa.Table], Iterator[tuple[slice, slice, np.ndarray]]]


def _strips(l: pa.Table, r: pa.Table) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Row and column ranges of a tile with their scores."""
    if not l.num_rows or not r.num_rows:
        return
    a, b = _matrix(l, "feature"), _matrix(r, "feature").T
    for start in range(0, len(a), STRIP_ROWS):
        rows = slice(start, start + STRIP_ROWS)
        for first in range(0, b.shape[1], STRIP_COLUMNS):
            columns = slice(first, first + STRIP_COLUMNS)
            yield rows, columns, a[rows] @ b[:, columns]


def similarity_summary(images: DataFrame, captions: DataFrame, tile_rows: int | None = None) -> DataFrame:
    """Per image over all captions: number scored, best and worst score, mean score."""

    def kernel(l: pa.Table, r: pa.Table) -> pa.Table:
        rows_in = l.num_rows if r.num_rows else 0
        hi, lo, total = np.full(rows_in, -np.inf), np.full(rows_in, np.inf), np.zeros(rows_in)
        for rows, _, sims in _strips(l, r):
            hi[rows] = np.maximum(hi[rows], sims.max(axis=1))
            lo[rows] = np.minimum(lo[rows], sims.min(axis=1))
            total[rows] += sims.sum(axis=1)
        ids = pa.array(_column(l, "image_id")[:rows_in], pa.int64())
        scored = pa.array(np.full(rows_in, r.num_rows), pa.int64())
        return pa.table({"image_id": ids, "n": scored, "hi": hi, "lo": lo, "total": total})

    shape = shape_of(images, captions)
    parts = tiles(
        normalized(usable(images, shape.width).select("image_id", "feature")),
        normalized(usable(captions, shape.width).select("text_id", "feature")),
        shape.sizes,
        kernel,
        "image_id bigint, n bigint, hi double, lo double, total double",
        tile_rows,
        8 * shape.width,
    )
    return parts.groupBy("image_id").agg(
        F.sum("n").alias("n_texts"),
        F.max("hi").alias("max_sim"),
        F.min("lo").alias("min_sim"),
        (F.sum("total") / F.sum("n")).alias("mean_sim"),
    )


def _rank_counts(
    left: DataFrame,
    right: DataFrame,
    sizes: tuple[int, int],
    tile_rows: int | None,
    row_bytes: int,
    strips: Strips = _strips,
    most: int = MAX_TILE_ROWS,
) -> DataFrame:
    """(side, id, above): how many scores of the row (side 'i') or column (side 't') exceed its threshold.

    `left` is (image_id, threshold, ...), `right` is (text_id, threshold, ...), with what
    `strips` scores. Where both have a `tie_id`, equal scores of a smaller opposite
    id count as well.
    """
    ties = "tie_id" in left.columns

    def kernel(l: pa.Table, r: pa.Table) -> pa.Table:
        iid, tid = _column(l, "image_id"), _column(r, "text_id")
        ithr, tthr = _column(l, "threshold"), _column(r, "threshold")
        itie, ttie = (_column(l, "tie_id"), _column(r, "tie_id")) if ties else (None, None)
        above_i = np.zeros(len(iid), dtype=np.int64)
        above_t = np.zeros(len(tid), dtype=np.int64)
        for rows, columns, sims in strips(l, r):
            gap = sims - ithr[rows, None]
            above_i[rows] += np.count_nonzero(gap > TIE, axis=1)
            if ties:
                at, other = np.nonzero(np.abs(gap) <= TIE)
                np.add.at(above_i[rows], at, tid[columns][other] < itie[rows][at])
            gap = np.subtract(sims, tthr[None, columns], out=gap)
            above_t[columns] += np.count_nonzero(gap > TIE, axis=0)
            if ties:
                other, at = np.nonzero(np.abs(gap) <= TIE)
                np.add.at(above_t[columns], at, iid[rows][other] < ttie[columns][at])
        return pa.table(
            {
                "side": pa.array(np.repeat(["i", "t"], [len(iid), len(tid)]), pa.string()),
                "id": pa.array(np.concatenate([iid, tid]), pa.int64()),
                "above": pa.array(np.concatenate([above_i, above_t]), pa.int64()),
            }
        )

    parts = tiles(left, right, sizes, kernel, "side string, id bigint, above bigint", tile_rows, row_bytes, most)
    return parts.groupBy("side", "id").agg(F.sum("above").alias("above"))


def positive_scores(images: DataFrame, captions: DataFrame) -> DataFrame:
    """(text_id, image_id, score) of each caption with its own image; unit features in."""
    own = images.select("image_id", F.col("feature").alias("__image"))
    return captions.join(own, "image_id").select(
        "text_id", "image_id", dot(F.col("__image"), F.col("feature")).alias("score")
    )


def retrieval_ranks(images: DataFrame, captions: DataFrame, tile_rows: int | None = None) -> DataFrame:
    """(side, id, rank) in both directions, 1 + number of strictly greater scores.

    Side 'i' ranks the best caption of an image, side 't' the image of a
    caption. `set_aside` lists the rows that take no part.
    """
    shape = shape_of(images, captions)
    unit_images, unit_captions = (normalized(usable(side, shape.width)) for side in (images, captions))
    own = positive_scores(unit_images, unit_captions)
    best = own.groupBy("image_id").agg(F.max("score").alias("threshold"))
    left = unit_images.select("image_id", "feature").join(best, "image_id")
    right = unit_captions.select("text_id", "feature").join(own.select("text_id", F.col("score").alias("threshold")), "text_id")
    counts = _rank_counts(left, right, shape.sizes, tile_rows, 8 * shape.width)
    return counts.select("side", "id", (F.col("above") + 1).alias("rank"))


def images_without_caption(images: DataFrame, captions: DataFrame) -> DataFrame:
    return images.join(captions.select("image_id"), "image_id", "left_anti")


def paired_ranks(pairs: DataFrame, tile_rows: int | None = None) -> DataFrame:
    """(side, id, rank) for pairs (pair_id, image, text): the partner's place in the
    ordering by score descending, then id ascending. Pairs with an unusable vector
    on either side take no part."""
    shape = shape_of(pairs.select(F.col("image").alias("feature")), pairs.select(F.col("text").alias("feature")))
    pairs = usable(usable(pairs, shape.width, "image"), shape.width, "text")
    unit = pairs.select("pair_id", l2_normalize(F.col("image")).alias("image"), l2_normalize(F.col("text")).alias("text"))
    scored = unit.withColumn("threshold", dot(F.col("image"), F.col("text")))
    left = scored.select(
        F.col("pair_id").alias("image_id"), "threshold", F.col("pair_id").alias("tie_id"), F.col("image").alias("feature")
    )
    right = scored.select(
        F.col("pair_id").alias("text_id"), "threshold", F.col("pair_id").alias("tie_id"), F.col("text").alias("feature")
    )
    counts = _rank_counts(left, right, shape.sizes, tile_rows, 8 * shape.width)
    return counts.select("side", "id", (F.col("above") + 1).alias("rank"))


def recall_metrics(ranks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Recall at 1, 5 and 10 in percent, mean rank and lower-median rank per direction.

    Ranks are stored first: they are narrow, cost an all-pairs job and are read
    more than once.
    """
    keys = ["side"] if keys is None else keys
    ranks = materialize(ranks.select(*keys, "rank"), "ranks")
    at = lambda k: (F.avg((F.col("rank") <= k).cast("int")) * 100).alias(f"r_at_{k}")
    means = ranks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), at(1), at(5), at(10), F.avg("rank").alias("mean_rank")
    )
    median = exact_median(ranks, keys, "rank", "median_rank", lower=True)
    return means.join(median, keys)


def flat_metrics(metrics: DataFrame) -> DataFrame:
    """One row with i2t_ and t2i_ columns."""
    names = ["r_at_1", "r_at_5", "r_at_10", "mean_rank", "median_rank"]
    return metrics.agg(
        *[
            F.max(F.when(F.col("side") == side, F.col(n))).alias(f"{prefix}_{n.replace('_at_', '@')}")
            for side, prefix in (("i", "i2t"), ("t", "t2i"))
            for n in names
        ]
    )


def top_pairs(
    images: DataFrame,
    captions: DataFrame,
    k: int,
    tile_rows: int | None = None,
    sides: tuple[str, ...] = ("i", "t"),
    shape: Shape | None = None,
) -> DataFrame:
    """(side, image_id, text_id, sim, rn): k best captions per image (side 'i') and
    k best images per caption (side 't'), or one of them; equal scores (12 digits) go by id."""
    shape = shape or shape_of(images, captions)
    cores = images.sparkSession.sparkContext.defaultParallelism
    cell_rows = choose_tile(*shape.sizes, cores, 8 * shape.width)
    a = normalized(usable(images, shape.width).select(F.col("image_id").alias("id"), "feature"))
    b = normalized(usable(captions, shape.width).select(F.col("text_id").alias("id"), "feature"))
    walks = {"i": (a, b, shape.sizes), "t": (b, a, shape.sizes[::-1])}
    ids = {"i": ("__own", "__other"), "t": ("__other", "__own")}
    parts = []
    for side in sides:
        found = walked(*walks[side], k, tile_rows or 1, cell_rows)
        best = top_per_group(found, ["__own"], [F.desc("sim"), F.col("__other")], k, ["__other"], salts=8)
        image, text = ids[side]
        parts.append(best.select(F.lit(side).alias("side"), F.col(image).alias("image_id"), F.col(text).alias("text_id"), "sim", "rn"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def candidate_pairs(images: DataFrame, captions: DataFrame, k: int, tile_rows: int | None = None) -> DataFrame:
    """Distinct (image_id, text_id, sim): top k of both directions, k held within both sizes."""
    shape = shape_of(images, captions)
    k = max(1, min(int(k), *shape.sizes))
    found = top_pairs(images, captions, k, tile_rows, shape=shape)
    return found.groupBy("image_id", "text_id").agg(F.max("sim").alias("sim"))


def overwrite_scores(coarse: DataFrame, exact: DataFrame) -> DataFrame:
    """Exact scores in place of coarse ones on the pairs that have them."""
    renamed = exact.select("image_id", "text_id", F.col("sim").alias("__exact"))
    return coarse.join(renamed, ["image_id", "text_id"], "left").withColumn(
        "sim", F.coalesce("__exact", "sim")
    ).drop("__exact")


def rerank_ranks(
    images: DataFrame,
    captions: DataFrame,
    k: int,
    exact: Callable[[DataFrame], DataFrame],
    tile_rows: int | None = None,
) -> DataFrame:
    """(side, id, rank) after the top-k candidates got exact scores.

    `exact` maps distinct (image_id, text_id, sim) to the same columns with new
    scores. All other pairs keep their coarse score: the tile job counts coarse
    scores over each threshold, and the candidates' contribution is then taken
    out and put back with exact scores. Cost beyond the tiles is linear in
    candidates.
    """
    width = shape_of(images, captions).width
    # Candidates among the rows that take part only, else others would push ranks.
    captions = usable(captions, width).join(usable(images, width).select("image_id"), "image_id", "left_semi")
    images = usable(images, width).join(captions.select("image_id"), "image_id", "left_semi")
    candidates = materialize(candidate_pairs(images, captions, k, tile_rows), "candidates")
    rescored = materialize(
        candidates.select("image_id", "text_id", F.col("sim").alias("coarse")).join(
            exact(candidates).select("image_id", "text_id", F.col("sim").alias("exact")), ["image_id", "text_id"]
        ),
        "rescored",
    )
    shape = shape_of(images, captions)
    unit_images, unit_captions = normalized(images), normalized(captions)
    own = (
        positive_scores(unit_images, unit_captions)
        .join(rescored.select("image_id", "text_id", "exact"), ["image_id", "text_id"], "left")
        .select("text_id", "image_id", F.coalesce("exact", "score").alias("score"))
    )
    best = own.groupBy("image_id").agg(F.max("score").alias("threshold"))
    left = unit_images.select("image_id", "feature").join(best, "image_id")
    right = unit_captions.select("text_id", "feature").join(own.select("text_id", F.col("score").alias("threshold")), "text_id")
    coarse = _rank_counts(left, right, shape.sizes, tile_rows, 8 * shape.width)

    def shift(ids: str, thresholds: DataFrame, side: str) -> DataFrame:
        over = lambda c: (F.col(c) > F.col("threshold") + TIE).cast("int")
        return (
            rescored.join(thresholds.select(ids, "threshold"), ids)
            .groupBy(F.lit(side).alias("side"), F.col(ids).alias("id"))
            .agg(F.sum(over("exact") - over("coarse")).alias("shift"))
        )

    moved = shift("image_id", left, "i").unionByName(shift("text_id", right, "t"))
    return coarse.join(moved, ["side", "id"], "left").select(
        "side", "id", (F.col("above") + F.coalesce("shift", F.lit(0)) + 1).alias("rank")
    )


def exact_by_features(images: DataFrame, captions: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Exact scorer for `rerank_ranks`: cosine of finer features held in two tables."""

    def score(candidates: DataFrame) -> DataFrame:
        a = normalized(images).select("image_id", F.col("feature").alias("__a"))
        b = normalized(captions).select("text_id", F.col("feature").alias("__b"))
        return candidates.join(a, "image_id").join(b, "text_id").select(
            "image_id", "text_id", dot(F.col("__a"), F.col("__b")).alias("sim")
        )

    return score


class PairScorer(Protocol):
    """Scores that depend on the pair: `__call__` takes aligned inputs, one entry for each pair.

    A scorer that has a method `block` as well scores all pairs of n images and m texts by it, as [n, m].
    """

    image_inputs: tuple[str, ...]
    text_inputs: tuple[str, ...]

    def __call__(self, images: dict[str, np.ndarray], texts: dict[str, np.ndarray]) -> np.ndarray: ...


class AttentionScorer:
    """Pools an image's tokens by their attention to a caption's cues, and compares with the caption's feature.

    tokens [n, K, D], cues [n, C, D], text_feature [n, D]: weights are the mean over cues of
    softmax(tokens . cue), the score is the cosine of the weighted sum and the feature.
    """

    image_inputs = ("tokens",)
    text_inputs = ("cues", "text_feature")

    def __call__(self, images: dict[str, np.ndarray], texts: dict[str, np.ndarray]) -> np.ndarray:
        tokens, cues, feature = images["tokens"], texts["cues"], texts["text_feature"]
        raw = np.einsum("nkd,ncd->nck", tokens, cues)
        weights = np.exp(raw - raw.max(axis=2, keepdims=True))
        weights = (weights / weights.sum(axis=2, keepdims=True)).mean(axis=1)
        pooled = np.einsum("nk,nkd->nd", weights, tokens)
        scale = np.maximum(np.linalg.norm(pooled, axis=1), 1e-12) * np.maximum(np.linalg.norm(feature, axis=1), 1e-12)
        return np.einsum("nd,nd->n", pooled, feature) / scale

    def block(self, images: dict[str, np.ndarray], texts: dict[str, np.ndarray]) -> np.ndarray:
        """The same scores of every image with every text, by matrix products; no pooled vector is formed.

        Its length comes from the products of an image's tokens. Pairs whose tokens nearly cancel go through `__call__`.
        """
        tokens, cues, feature = images["tokens"], texts["cues"], texts["text_feature"]
        (n, k, d), m = tokens.shape, len(feature)
        flat = tokens.reshape(n * k, d)
        weights = np.zeros((n, k, m))
        for c in range(cues.shape[1]):
            raw = (flat @ cues[:, c].T).reshape(n, k, m)
            raw -= raw.max(axis=1, keepdims=True)
            np.exp(raw, out=raw)
            raw /= raw.sum(axis=1, keepdims=True)
            weights += raw
        weights /= cues.shape[1]
        gram = tokens @ tokens.transpose(0, 2, 1)
        square = (weights * (gram @ weights)).sum(axis=1)
        weights *= (flat @ feature.T).reshape(n, k, m)
        scale = np.maximum(np.sqrt(np.maximum(square, 0)), 1e-12) * np.maximum(np.linalg.norm(feature, axis=1), 1e-12)
        scores = weights.sum(axis=1) / scale
        i, t = np.nonzero(square <= 1e-6 * np.einsum("nkk->nk", gram).max(axis=1)[:, None])
        if len(i):
            scores[i, t] = self({"tokens": tokens[i]}, {"cues": cues[t], "text_feature": feature[t]})
        return scores


def _tensor(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally shaped nested lists as one array."""
    values = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    dims = [len(values)]
    while pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        dims.append(len(values[0]) if len(values) else 0)
        values = values.flatten()
    return values.to_numpy(zero_copy_only=False).astype(float).reshape(dims)


def input_shape(df: DataFrame, inputs: tuple[str, ...]) -> Column:
    """Shapes of a row's inputs as one string: null where one is missing, holds a missing number, or is ragged."""
    kinds = dict(df.dtypes)
    parts, whole = [], F.lit(True)
    for name in inputs:
        x = F.col(name)
        dims = [F.size(x)]
        for _ in range(kinds[name].count("array<") - 1):
            sizes = F.transform(x, lambda v: F.size(v))
            dims.append(F.when(F.array_min(sizes) == F.array_max(sizes), F.array_max(sizes)))
            x = F.flatten(x)  # null if one of the lists is
        whole = whole & F.col(name).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")))
        for d in dims:
            whole = whole & d.isNotNull()
        parts.append(F.concat_ws("x", *dims))
    return F.when(whole, F.concat_ws(",", *parts))


def common_shape(df: DataFrame, inputs: tuple[str, ...]) -> tuple[str | None, int]:
    """The most frequent shape of the inputs (the smaller one of equals) and its number of rows."""
    shapes = df.select(input_shape(df, inputs).alias("shape")).where(F.col("shape").isNotNull())
    found = shapes.groupBy("shape").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "shape").limit(1).collect()
    return (found[0].shape, found[0].n) if found else (None, 0)


def _shape_bytes(shape: str | None) -> int:
    return 8 * sum(math.prod(map(int, part.split("x"))) for part in (shape or "1").split(","))


def conditioned_ranks(
    images: DataFrame, captions: DataFrame, factory: Callable[[], PairScorer], tile_rows: int | None = None
) -> DataFrame:
    """(side, id, rank) in both directions, every image-caption pair scored by a pair scorer.

    `images` holds image_id and the scorer's image inputs, `captions` text_id, image_id
    and its text inputs. Rows whose inputs are missing, or shaped otherwise than most, take no
    part, nor do their partners. Tiles are cut by the bytes of the inputs; within a tile
    the scorer is given as many pairs at once as fit `STRIP_BYTES`. The scorer is built
    once a task.
    """
    scorer = factory()
    sides = []
    for df, key, inputs in ((images, ["image_id"], scorer.image_inputs), (captions, ["text_id", "image_id"], scorer.text_inputs)):
        shape, n = common_shape(df, inputs)
        kept = df.where(input_shape(df, inputs) == F.lit(shape)) if shape else df.limit(0)
        sides.append((kept.select(*key, *inputs), n, _shape_bytes(shape)))
    (a, n_images, image_bytes), (b, n_captions, text_bytes) = sides
    pair_rows = max(1, STRIP_BYTES // (image_bytes + text_bytes))
    both = b.join(a, "image_id").select("text_id", "image_id", *scorer.image_inputs, *scorer.text_inputs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = factory()
        for batch in batches:
            for start in range(0, batch.num_rows, pair_rows):
                part = batch.slice(start, pair_rows)
                given = [{c: _tensor(part.column(c)) for c in names} for names in (own.image_inputs, own.text_inputs)]
                scores = pa.array(np.asarray(own(*given), float))
                yield pa.RecordBatch.from_arrays([part.column("text_id"), part.column("image_id"), scores], names=["text_id", "image_id", "score"])

    # Stored once, as the model's work is read by both directions.
    own = materialize(both.mapInArrow(score, "text_id long, image_id long, score double"), "own")
    best = own.groupBy("image_id").agg(F.max("score").alias("threshold"))
    left = a.join(best, "image_id")
    right = b.drop("image_id").join(own.select("text_id", F.col("score").alias("threshold")), "text_id")

    def strips(l: pa.Table, r: pa.Table) -> Iterator[tuple[slice, slice, np.ndarray]]:
        if not l.num_rows or not r.num_rows:
            return
        model = factory()
        given = {c: _tensor(l.column(c)) for c in model.image_inputs}
        texts = {c: _tensor(r.column(c)) for c in model.text_inputs}
        wide = min(r.num_rows, pair_rows, STRIP_COLUMNS)
        step = max(1, pair_rows // wide)
        for start in range(0, l.num_rows, step):
            rows = slice(start, min(start + step, l.num_rows))
            n = rows.stop - rows.start
            for first in range(0, r.num_rows, wide):
                part = slice(first, min(first + wide, r.num_rows))
                m = part.stop - part.start
                if hasattr(model, "block"):
                    scores = model.block({c: v[rows] for c, v in given.items()}, {c: v[part] for c, v in texts.items()})
                else:
                    x = {c: np.repeat(v[rows], m, axis=0) for c, v in given.items()}
                    y = {c: np.tile(v[part], (n, *[1] * (v.ndim - 1))) for c, v in texts.items()}
                    scores = model(x, y)
                yield rows, part, np.asarray(scores, float).reshape(n, m)

    counts = _rank_counts(left, right, (n_images, n_captions), tile_rows, max(image_bytes, text_bytes), strips, SCORER_TILE_ROWS)
    return counts.select("side", "id", (F.col("above") + 1).alias("rank"))


PROTOCOLS = {"global": "dual_encoder_global", "rerank_topk": "global_topk_exact_rerank", "full": "full_exact_conditioned"}


def protocol(mode: Column) -> Column:
    """Name of the retrieval protocol of a mode."""
    return F.coalesce(*[F.when(mode == k, F.lit(v)) for k, v in PROTOCOLS.items()])


class RetrievalModel(NamedTuple):
    """A model's features of one retrieval set, and its pair scorer if it has one.

    images: image_id, feature and the scorer's image inputs; captions: text_id, image_id,
    feature and its text inputs.
    """

    name: str
    images: DataFrame
    captions: DataFrame
    scorer: Callable[[], PairScorer] | None = None


UNSUPPORTED = "the model has no pair scorer, so it cannot score every pair with conditioning"


def exact_by_scorer(images: DataFrame, captions: DataFrame, factory: Callable[[], PairScorer]) -> Callable[[DataFrame], DataFrame]:
    """Exact scores for `rerank_ranks` from a pair scorer."""

    def score(candidates: DataFrame) -> DataFrame:
        scorer = factory()
        texts = captions.select("text_id", *scorer.text_inputs)
        both = candidates.select("image_id", "text_id").join(images.select("image_id", *scorer.image_inputs), "image_id").join(texts, "text_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = factory()
            for batch in batches:
                if batch.num_rows:
                    given = [{c: _tensor(batch.column(c)) for c in names} for names in (own.image_inputs, own.text_inputs)]
                    sims = pa.array(np.asarray(own(*given), float))
                    yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("text_id"), sims], names=["image_id", "text_id", "sim"])

        return both.mapInArrow(run, "image_id long, text_id long, sim double")

    return score


def retrieval_report(models: list[RetrievalModel], mode: str, k: int = 100, tile_rows: int | None = None) -> DataFrame:
    """One row for each model: status and reason, protocol, sizes, and i2t_ and t2i_ metrics.

    Modes: 'global' compares features; 'rerank_topk' scores the best `k` candidates of both
    directions anew where the model has a pair scorer; 'full' scores every pair by it,
    and a model without one gets the status 'unsupported'.
    """
    rows = []
    for m in models:
        spark = m.images.sparkSession
        if mode == "full" and m.scorer is None:
            rows.append(spark.range(1).select(F.lit(m.name).alias("model"), F.lit("unsupported").alias("status"), F.lit(UNSUPPORTED).alias("reason")))
            continue
        if mode == "full":
            ranks = conditioned_ranks(m.images, m.captions, m.scorer, tile_rows)
        elif mode == "rerank_topk" and m.scorer is not None:
            ranks = rerank_ranks(m.images, m.captions, k, exact_by_scorer(m.images, m.captions, m.scorer), tile_rows)
        else:
            ranks = retrieval_ranks(m.images, m.captions, tile_rows)
        done = mode if mode != "rerank_topk" or m.scorer is not None else "global"
        metrics = recall_metrics(ranks)
        sizes = metrics.agg(
            F.max(F.when(F.col("side") == "i", F.col("n"))).alias("num_images"), F.max(F.when(F.col("side") == "t", F.col("n"))).alias("num_captions")
        )
        named = sizes.select(
            F.lit(m.name).alias("model"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason"),
            F.lit(PROTOCOLS[done]).alias("retrieval_protocol"), "num_images", "num_captions",
        )
        rows.append(named.join(F.broadcast(flat_metrics(metrics))))  # one row each
    report = rows[0]
    for r in rows[1:]:
        report = report.unionByName(r, allowMissingColumns=True)
    return report
