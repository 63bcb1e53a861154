"""Hard-negative mining over an STR-packed R-tree.

Vectors of one label and width are packed by sort-tile-recursive: quantile slices of
the first coordinate, of the second inside each slice, then inside a task leaves of
`LEAF` rows by the next two coordinates. A tile of leaves is a subtree of at most
`TILE_BYTES`; a tile that holds more (equal values cannot be cut) is dealt by a hash
of the id. Every node has its minimum bounding box, which gives the interval of inner
products with a query coordinate by coordinate.

Queries are packed into blocks. Each block is held against pages of tile boxes first,
and only tiles that some query of it wants go on, the best bounds first. One task
walks a run of tiles for a block: leaves come off a queue by their best bound, and a
query skips boxes that lie outside its score window or strictly below its kth score.
So a task emits k rows for each query, not for each tile.

Scores are inner products of the components floor(256 x). Up to 2^53 they are exact;
beyond that they are rounded to doubles and nothing is skipped by bounds.

Defined results: rows with a null id, label or vector, and rows with a null component
or one whose 256-fold is not finite, take no part. Rows equal in id, label and vector
count once. Vectors of another width are never compared. A row's other rows are those
of another id. Equal scores go by the smaller id. Vectors without components have score
0. An empty table, or one without anchors, gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import per_group_side
from ..session import materialize, work_partitions

EVERY = 50
POSITIVES = 5
NEGATIVES = 3
WINDOW = (50, 95)  # per cent of the positive's score
SCALE = 256.0
LEAF = 128
TILE_BYTES = 2 << 20
MAX_TILE_ROWS = 4096
# Slices of a coordinate that quantiles tell apart; finer tiles are dealt by hash.
SLICES = 100
BLOCK_QUERIES = 1024
PAGE_TILES = 256
# Tiles that one task walks for a block.
RUN_TILES = 64
EXACT = float(1 << 53)


def prepared(vectors: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(`__row`, `__id`, `__label`, `__width`, `__x`): the rows that take part, each once."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    rows = vectors.select(F.col(key).cast("bigint").alias("__id"), F.col(label).cast("bigint").alias("__label"), x.alias("__x"))
    finite = F.forall("__x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * SCALE) < float("inf")))
    rows = rows.where(F.col("__id").isNotNull() & F.col("__label").isNotNull() & F.col("__x").isNotNull() & finite)
    rows = rows.withColumn("__row", F.xxhash64("__id", "__label", "__x")).dropDuplicates(["__row", "__id", "__label"])
    return rows.select("__row", "__id", "__label", F.size("__x").alias("__width"), "__x")


def _tile_rows() -> Column:
    return F.greatest(F.lit(LEAF), F.least(F.lit(MAX_TILE_ROWS), F.floor(F.lit(TILE_BYTES) / (8 * (F.col("__width") + 1)))))


def _sliced(rows: DataFrame, keys: list[str], coordinate: int, name: str, root: bool) -> DataFrame:
    """Cut each group at quantiles of a coordinate: as many slices as it has tiles, or the root of that."""
    value = F.coalesce(F.get("__x", F.lit(coordinate)), F.lit(0.0))
    grid = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx(value, grid, F.lit(10 * SLICES)).alias("__grid"))
    tiles = F.ceil(F.col("__n") / _tile_rows())
    wanted = F.least(F.lit(SLICES), F.ceil(F.sqrt(tiles.cast("double"))) if root else tiles).cast("int")
    picks = F.when(wanted > 1, F.sequence(F.lit(1), wanted - 1)).otherwise(F.array().cast("array<int>"))
    bounds = F.transform(picks, lambda i: F.get("__grid", F.floor(i * SLICES / wanted).cast("int") - 1))
    side = per_group_side(found.select(*keys, bounds.alias("__bounds")))
    joined = rows.join(side, keys)
    at = F.size(F.filter("__bounds", lambda b: b < value))
    return joined.withColumn(name, at).drop("__bounds")


def tiled(rows: DataFrame) -> DataFrame:
    """The rows with `__tile`, the name of their subtree."""
    first = _sliced(rows, ["__width", "__label"], 0, "__s0", root=True)
    both = _sliced(first, ["__width", "__label", "__s0"], 1, "__s1", root=False)
    keys = ["__width", "__label", "__s0", "__s1"]
    chunks = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).select(*keys, F.ceil(F.col("__n") / _tile_rows()).alias("__chunks"))
    chunk = F.pmod(F.xxhash64("__id", "__row"), F.col("__chunks"))
    named = both.join(per_group_side(chunks), keys)
    return named.select(*rows.columns, F.concat_ws(":", *keys, chunk).alias("__tile"))


def _vectors(table: pa.Table, width: int) -> np.ndarray:
    values = pa.concat_arrays(table.column("__x").chunks).flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * values.astype(np.float64)).reshape(table.num_rows, width)


def leaf_order(x: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Order of the rows and ends of the leaves: slices of one coordinate, cut into leaves by the next."""
    n, width = x.shape
    if not width:
        return np.arange(n), [*range(LEAF, n, LEAF), n]
    a, b = x[:, 2 % width], x[:, 3 % width]
    slices = max(1, round(np.sqrt(-(-n // LEAF))))
    order, ends = [], []
    for part in np.array_split(np.argsort(a, kind="stable"), slices):
        part = part[np.argsort(b[part], kind="stable")]
        start = sum(map(len, order))
        order.append(part)
        ends += [start + e for e in [*range(LEAF, len(part), LEAF), len(part)] if e]
    return np.concatenate(order), ends


def packed_tree(rows: DataFrame) -> DataFrame:
    """One row for each tile: its ids and vectors in the order of the leaves, their ends, and its box."""

    def build(table: pa.Table) -> pa.Table:
        width = table.column("__width")[0].as_py()
        x = _vectors(table, width)
        order, ends = leaf_order(x)
        x, ids = x[order], table.column("__id").to_numpy()[order]
        return pa.table(
            {
                "__tile": pa.array([table.column("__tile")[0].as_py()]),
                "__width": pa.array([width], pa.int32()),
                "__label": pa.array([table.column("__label")[0].as_py()], pa.int64()),
                "__ids": pa.array([ids.tobytes()], pa.binary()),
                "__ends": pa.array([np.array(ends, np.int32).tobytes()], pa.binary()),
                "__x": pa.array([x.tobytes()], pa.binary()),
                "__low": pa.array([x.min(axis=0).tobytes()], pa.binary()),
                "__high": pa.array([x.max(axis=0).tobytes()], pa.binary()),
            }
        )

    schema = "__tile string, __width int, __label long, __ids binary, __ends binary, __x binary, __low binary, __high binary"
    columns = ["__tile", "__width", "__label", "__id", "__x"]
    return materialize(rows.select(*columns).groupBy("__tile").applyInArrow(build, schema), "tree")


def packed_queries(queries: DataFrame, by_label: bool) -> DataFrame:
    """Blocks of `BLOCK_QUERIES` queries (`__query`, `__id`, `__label`, `__width`, `__least`, `__most`, `__x`), one row each."""
    keys = ["__width", "__label"] if by_label else ["__width"]
    sizes = queries.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("__blocks"))
    dealt = queries.join(per_group_side(sizes), keys)
    block = F.concat_ws(":", *keys, F.pmod(F.xxhash64("__query"), F.col("__blocks")))

    def build(table: pa.Table) -> pa.Table:
        width = table.column("__width")[0].as_py()
        numbers = {c: table.column(c).to_numpy() for c in ("__query", "__id", "__label", "__least", "__most")}
        columns = {"__block": pa.array([table.column("__block")[0].as_py()]), "__width": pa.array([width], pa.int32())}
        columns["__group"] = pa.array([int(numbers["__label"][0]) if by_label else None], pa.int64())
        columns |= {c: pa.array([v.tobytes()], pa.binary()) for c, v in numbers.items()}
        return pa.table(columns | {"__x": pa.array([_vectors(table, width).tobytes()], pa.binary())})

    schema = "__block string, __width int, __group long, __query binary, __id binary, __label binary, __least binary, __most binary, __x binary"
    rows = dealt.select(block.alias("__block"), "__width", "__query", "__id", "__label", "__least", "__most", "__x")
    return materialize(rows.groupBy("__block").applyInArrow(build, schema), "queries")


class Queries:
    """A block of queries with their windows and the best rows so far."""

    def __init__(self, row: dict, k: int, same: bool) -> None:
        whole = lambda c, t: np.frombuffer(row[c], t)
        self.query, self.id, self.label = (whole(c, np.int64) for c in ("__query", "__id", "__label"))
        self.least, self.most = (whole(c, np.float64) for c in ("__least", "__most"))
        self.x = whole("__x", np.float64).reshape(len(self.id), row["__width"])
        self.up, self.down = np.maximum(self.x, 0), np.minimum(self.x, 0)
        self.top = float(np.abs(self.x).max(initial=0))
        self.k, self.same = k, same
        self.scores = np.full((len(self.id), k), -np.inf)
        self.ids = np.full((len(self.id), k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        """What a score has to reach: the window's start and the kth score so far."""
        return np.maximum(self.least, self.scores[:, -1])

    def wants(self, label: int) -> np.ndarray:
        return self.label == label if self.same else self.label != label

    def bounds(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Best score that each query can find in each box; -inf where the box lies outside its window.

        Beyond exact sums every box may hold any score.
        """
        reach = float(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)))
        if self.top * reach * max(1, self.x.shape[1]) >= EXACT:
            return np.repeat(self.most[:, None], len(low), axis=1)
        best = self.up @ high.T + self.down @ low.T
        worst = self.up @ low.T + self.down @ high.T
        outside = (best < self.least[:, None]) | (worst > self.most[:, None])
        return np.where(outside, -np.inf, np.minimum(best, self.most[:, None]))

    def take(self, at: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Score the rows of a leaf for the queries `at`."""
        scores = self.x[at] @ x.T
        open_ = (scores >= self.floor()[at, None]) & (scores <= self.most[at, None]) & (ids[None, :] != self.id[at, None])
        some = np.flatnonzero(open_.any(axis=1))
        if not len(some):
            return
        rows = at[some]
        scores = np.concatenate([self.scores[rows], np.where(open_[some], scores[some], -np.inf)], axis=1)
        found = np.concatenate([self.ids[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        order = np.lexsort((found, -scores), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(scores, order, axis=1)
        self.ids[rows] = np.take_along_axis(found, order, axis=1)

    def walk(self, row: dict) -> None:
        """Best-first through the leaves of one tile."""
        width = self.x.shape[1]
        ids, ends = np.frombuffer(row["__ids"], np.int64), np.frombuffer(row["__ends"], np.int32)
        x = np.frombuffer(row["__x"], np.float64).reshape(len(ids), width)
        starts = np.append(0, ends[:-1])
        low = np.minimum.reduceat(x, starts, axis=0) if width else np.empty((len(ends), 0))
        high = np.maximum.reduceat(x, starts, axis=0) if width else np.empty((len(ends), 0))
        bounds = np.where(self.wants(row["__label"])[:, None], self.bounds(low, high), -np.inf)
        queue = [(-float(b), i) for i, b in enumerate(bounds.max(axis=0, initial=-np.inf)) if b > -np.inf]
        heapq.heapify(queue)
        while queue:
            before, i = heapq.heappop(queue)
            live = np.flatnonzero((bounds[:, i] >= self.floor()) & (bounds[:, i] > -np.inf))
            if not len(live):
                continue
            best = -float(bounds[live, i].max())
            if queue and best > queue[0][0] and best > before:
                heapq.heappush(queue, (best, i))  # its best query is served by now
                continue
            self.take(live, ids[starts[i] : ends[i]], x[starts[i] : ends[i]])

    def rows(self) -> Iterator[pa.RecordBatch]:
        at, k = np.nonzero(self.scores > -np.inf)
        if len(at):
            found = [self.query[at], self.scores[at, k], self.ids[at, k]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["__query", "__score", "__found"])


def pages(tree: DataFrame) -> DataFrame:
    """(`__width`, `__group`, `__page`, ...): the boxes of `PAGE_TILES` tiles in one row."""
    boxes = tree.select("__tile", "__width", "__label", "__low", "__high")
    sizes = boxes.groupBy("__width").agg(F.ceil(F.count(F.lit(1)) / PAGE_TILES).cast("int").alias("__pages"))
    dealt = boxes.join(per_group_side(sizes), "__width")
    page = F.pmod(F.xxhash64("__tile"), F.col("__pages")).cast("int")
    listed = F.collect_list(F.struct("__tile", "__label", "__low", "__high"))
    return dealt.groupBy("__width", page.alias("__page"), "__pages").agg(listed.alias("__boxes"))


def wanted_tiles(blocks: DataFrame, tree: DataFrame, k: int, same: bool) -> DataFrame:
    """(`__block`, `__tile`, `__bound`): tiles where some query of the block may find something, with the best bound."""
    listed = materialize(pages(tree), "pages")
    counts = listed.select("__width", "__pages").distinct()
    asked = blocks.join(per_group_side(counts), "__width").withColumn("__page", F.explode(F.sequence(F.lit(0), F.col("__pages") - 1)))
    pairs = asked.drop("__pages").join(listed.select("__width", "__page", "__boxes"), ["__width", "__page"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own = Queries(row, k, same)
                boxes = [b for b in row["__boxes"] if not same or b["__label"] == row["__group"]]
                if not boxes:
                    continue
                side = lambda c: np.array([np.frombuffer(b[c], np.float64) for b in boxes]).reshape(len(boxes), -1)  # noqa: B023, E731
                bounds = own.bounds(side("__low"), side("__high"))
                wants = np.array([own.wants(b["__label"]) for b in boxes]).T
                best = np.where(wants, bounds, -np.inf).max(axis=0)
                kept = np.flatnonzero(best > -np.inf).tolist()
                columns = [[row["__block"]] * len(kept), [boxes[j]["__tile"] for j in kept], best[kept]]
                types = [pa.string(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["__block", "__tile", "__bound"])

    return pairs.mapInArrow(run, "__block string, __tile string, __bound double")


def best_rows(blocks: DataFrame, tree: DataFrame, k: int, same: bool, partitions: int) -> DataFrame:
    """(`__query`, `__rank`, `__score`, `__found`): the first `k` rows of each query inside its window."""
    pairs = materialize(wanted_tiles(blocks, tree, k, same), "pairs")
    runs = per_group_side(pairs.groupBy("__block").agg(F.ceil(F.count(F.lit(1)) / RUN_TILES).cast("int").alias("__runs")))
    payload = [c for c in tree.columns if c not in ("__tile", "__width", "__low", "__high")]
    asks = [c for c in blocks.columns if c not in ("__block", "__x", "__group", "__label")]
    visit = pairs.join(runs, "__block").withColumn("__run", F.pmod(F.xxhash64("__tile"), F.col("__runs")).cast("int"))
    visit = visit.drop("__runs").join(tree.select("__tile", *payload), "__tile")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    tiles = visit.select(
        "__block", "__run", F.lit(1).alias("__kind"), "__bound", *[none(c, t) for c, t in blocks.select(*asks).dtypes],
        none("__labels", "binary"), "__label", "__ids", "__ends", "__x",
    )
    open_ = blocks.join(runs, "__block").withColumn("__run", F.explode(F.sequence(F.lit(0), F.col("__runs") - 1)))
    heads = open_.select(
        "__block", "__run", F.lit(0).alias("__kind"), none("__bound", "double"), *asks, F.col("__label").alias("__labels"),
        none("__label", "long"), none("__ids", "binary"), none("__ends", "binary"), "__x",
    )
    both = heads.unionByName(tiles).repartition(partitions, "__block", "__run")
    dealt = both.sortWithinPartitions("__block", "__run", "__kind", F.desc("__bound"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Queries | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["__kind"] == 0:
                    if own:
                        yield from own.rows()
                    own = Queries(row | {"__label": row["__labels"]}, k, same)
                else:
                    own.walk(row)
        if own:
            yield from own.rows()

    found = dealt.mapInArrow(run, "__query long, __score double, __found long")
    order = Window.partitionBy("__query").orderBy(F.desc("__score"), "__found")
    return found.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by `every`; their positives the best
    `positives` rows of their label; negatives of a positive the best `negatives` rows
    of other labels with scores between the two per cents of the positive's.
    """
    partitions = work_partitions(vectors.sparkSession)
    rows = materialize(prepared(vectors, key, label, vector), "vectors")
    tree = packed_tree(tiled(rows))
    anchors = rows.where(F.col("__id") % every == 0).withColumnRenamed("__row", "__query")
    unbounded = {"__least": F.lit(float("-inf")), "__most": F.lit(float("inf"))}
    first = best_rows(packed_queries(anchors.withColumns(unbounded), by_label=True), tree, positives, True, partitions)
    first = materialize(first.withColumnRenamed("__query", "__anchor"), "positives")
    # Whole numbers between the two shares; a negative score has none.
    low, high = F.ceil(F.col("__score") * window[0] / 100), F.floor(F.col("__score") * window[1] / 100)
    asked = first.join(anchors.withColumnRenamed("__query", "__anchor"), "__anchor").select(
        F.xxhash64("__anchor", "__rank").alias("__query"),
        "__id",
        "__label",
        "__width",
        "__x",
        low.cast("double").alias("__least"),
        high.cast("double").alias("__most"),
        F.col("__found").alias("positive_id"),
        F.col("__score").cast("bigint").alias("positive_score"),
    )
    asked = materialize(asked.where(F.col("__least") <= F.col("__most")), "asked")
    found = best_rows(packed_queries(asked.drop("positive_id", "positive_score"), by_label=False), tree, negatives, False, partitions)
    return found.join(asked.select("__query", "__id", "positive_id", "positive_score"), "__query").select(
        F.col("__id").alias("anchor_id"),
        "positive_id",
        F.col("__rank").cast("int").alias("rank"),
        F.col("__found").alias("negative_id"),
        "positive_score",
        F.col("__score").cast("bigint").alias("negative_score"),
    )
