"""Top k of every row of one side over all rows of the other, by walks with a moving bound.

Rows of both sides are dealt to blocks around pivots. One task holds a part of the left
blocks and a run of right blocks; each of its left blocks walks the run, nearest centre
first. It keeps k partners a row and leaves out a right block for every row that cannot
gain from it: by Cauchy-Schwarz no member scores more than q.c + |q| r, with c the block's
centre and r its radius. So a task emits k rows for each of its rows, however many blocks
it has walked, and a right block is moved once for each part, not for each left block.

Pivots are a bounded sample (`MAX_PIVOTS` rows, the first in the order of a hash of the
id). They only decide how much can be left out, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, work_partitions
from .ordering import per_group_side

MAX_PIVOTS = 256
# Blocks of full size in a part and in a run, at most.
RUN_BLOCKS = 32
STRIP_ROWS = 512
# Equal scores agree to so many digits; bounds get that much slack.
DIGITS, SLACK = 12, 1e-9


def first_k(owners: np.ndarray, others: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Entries cut to the k best of each owner; equal scores go by the partner's id."""
    order = np.lexsort((others, -sims, owners))
    owners, others, sims = owners[order], others[order], sims[order]
    keep = np.arange(len(owners)) - np.searchsorted(owners, owners, side="left") < k
    return owners[keep], others[keep], sims[keep]


class Walk:
    """One left block on its walk."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, vectors, k
        self.norms = np.linalg.norm(vectors, axis=1)
        self.kth = np.full(len(ids), -np.inf)
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def visit(self, ids: np.ndarray, vectors: np.ndarray, center: np.ndarray, radius: float) -> int:
        """Take over the best of a right block; returns the number of rows that had to look into it."""
        bound = self.x @ center + self.norms * radius
        live = np.flatnonzero(bound >= self.kth - SLACK)
        for start in range(0, len(live), STRIP_ROWS):
            rows = live[start : start + STRIP_ROWS]
            sims = self.x[rows] @ vectors.T
            least, new = self.kth[rows], np.isneginf(self.kth[rows])
            if new.any():
                place = sims.shape[1] - min(self.k, sims.shape[1])
                least[new] = np.partition(sims[new], place, axis=1)[:, place]
            # Somewhat more than the rounded scores need; `first_k` takes the rest out.
            row, col = np.nonzero(sims >= least[:, None] - SLACK)
            if not len(row):
                continue
            owners, others, found = self.best
            changed = np.isin(owners, rows)
            fresh = (rows[row], ids[col], np.round(sims[row, col], DIGITS))
            merged = first_k(*(np.concatenate([a[changed], b]) for a, b in zip(self.best, fresh)), self.k)
            self.best = tuple(np.concatenate([a[~changed], b]) for a, b in zip((owners, others, found), merged))
            counts = np.bincount(merged[0], minlength=len(self.ids))
            full = counts == self.k
            worst = np.full(len(self.ids), np.inf)
            np.minimum.at(worst, merged[0], merged[2])
            self.kth[full] = worst[full]
        return len(live)

    def rows(self) -> Iterator[pa.RecordBatch]:
        owners, others, sims = self.best
        if len(owners):
            columns = [pa.array(self.ids[owners]), pa.array(others.astype(np.int64)), pa.array(sims.astype(float))]
            yield pa.RecordBatch.from_arrays(columns, names=["__own", "__other", "sim"])


def _matrix(values: pa.Array, rows: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def pivots_of(side: DataFrame, count: int) -> np.ndarray:
    """A bounded sample of vectors: the first `count` in the order of a hash of the id."""
    found = side.orderBy(F.xxhash64(F.lit("pivot"), "id"), "id").limit(min(count, MAX_PIVOTS)).select("feature").collect()
    return np.array([r.feature for r in found], float)


def packed_blocks(side: DataFrame, rows: int, block_rows: int, pivots: np.ndarray | None) -> DataFrame:
    """One row for each block: `__block`, ids, vectors, centre and radius.

    `side` is (id, feature) with `rows` rows at most. Rows go to the nearest pivot, and a
    pivot's rows to blocks of about `block_rows` by a hash of the id.
    """
    if pivots is None or not len(pivots):
        at = F.lit(0)
        near = side.select("id", "feature", at.alias("__pivot"))
    else:

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("feature"), batch.num_rows)
                at = np.argmin((pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T), axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=["id", "feature", "__pivot"])

        near = materialize(side.mapInArrow(nearest, "id long, feature array<double>, __pivot int"), "near")
    if pivots is None or not len(pivots):
        chunks = F.lit(max(1, math.ceil(rows / block_rows)))
        named = near
    else:
        sizes = near.groupBy("__pivot").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("__chunks"))
        named, chunks = near.join(per_group_side(sizes), "__pivot"), F.col("__chunks")
    block = F.concat_ws(":", "__pivot", F.pmod(F.xxhash64("id"), chunks))

    def pack(table: pa.Table) -> pa.Table:
        x = _matrix(pa.concat_arrays(table.column("feature").chunks), table.num_rows)
        center = x.mean(axis=0)
        return pa.table(
            {
                "__block": table.column("__block")[:1],
                "__ids": pa.array([table.column("id").to_numpy().tobytes()], pa.binary()),
                "__x": pa.array([x.tobytes()], pa.binary()),
                "__center": pa.array([center.tolist()], pa.list_(pa.float64())),
                "__radius": pa.array([float(np.linalg.norm(x - center, axis=1).max())], pa.float64()),
            }
        )

    schema = "__block string, __ids binary, __x binary, __center array<double>, __radius double"
    packed = named.select(block.alias("__block"), "id", "feature").groupBy("__block").applyInArrow(pack, schema)
    return materialize(packed, "blocks")


def walked(
    left: DataFrame, right: DataFrame, sizes: tuple[int, int], k: int, block_rows: int, cell_rows: int | None = None
) -> DataFrame:
    """(`__own`, `__other`, `sim`): the k best of each left row, once for each run of right blocks.

    Parts and runs have about `cell_rows` rows, blocks `block_rows` of them, but no less than a
    `RUN_BLOCKS`-th of a cell: the rows moved go by the cells, what is left out by the blocks.
    """
    cell_rows = max(cell_rows or RUN_BLOCKS * block_rows, block_rows)
    block_rows = max(block_rows, math.ceil(cell_rows / RUN_BLOCKS))
    n_blocks = [max(1, math.ceil(n / block_rows)) for n in sizes]
    pivots = pivots_of(right, n_blocks[1]) if n_blocks[1] > 1 else None
    lefts = packed_blocks(left, sizes[0], block_rows, pivots if n_blocks[0] > 1 else None)
    rights = packed_blocks(right, sizes[1], block_rows, pivots)
    parts, runs = (max(1, math.ceil(n / cell_rows)) for n in sizes)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = lambda n: F.pmod(F.xxhash64("__block"), F.lit(n)).cast("int")
    columns = ["__part", "__run", "__kind", "__ids", "__x", "__center", "__radius"]
    heads = lefts.withColumns({"__part": cell(parts), "__run": every(runs), "__kind": F.lit(0)}).select(columns)
    tails = rights.withColumns({"__run": cell(runs), "__part": every(parts), "__kind": F.lit(1)}).select(columns)
    # More partitions than cells, so that few cells meet in a task; right blocks come first and stay while the left ones pass.
    dealt = heads.unionByName(tails).repartition(max(work_partitions(left.sparkSession), 2 * parts * runs), "__part", "__run")
    dealt = dealt.sortWithinPartitions("__part", "__run", F.desc("__kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks, centers = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if at != (row["__part"], row["__run"]):
                    at, blocks, centers = (row["__part"], row["__run"]), [], None
                ids = np.frombuffer(row["__ids"], np.int64)
                x = np.frombuffer(row["__x"], float).reshape(len(ids), -1)
                if row["__kind"] == 1:
                    blocks.append((ids, x, np.array(row["__center"]), row["__radius"]))
                    continue
                if not blocks:
                    continue
                if centers is None:
                    centers = np.array([b[2] for b in blocks])
                walk = Walk(ids, x, k)
                for b in np.argsort(-(centers @ np.array(row["__center"])), kind="stable"):
                    walk.visit(*blocks[b])
                yield from walk.rows()

    return dealt.mapInArrow(run, "__own long, __other long, sim double")
