"""Shingle sets, groups of candidates and components, for joins of similar documents.

Nodes are distinct shingle sets. Candidates come in groups named by one of their nodes
(`__head`); a group of more than `BLOCK` nodes is dealt in pairs of blocks, so no task
holds more than two blocks of a group, whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import per_group_side
from ..session import materialize
from .frames import whole_text

WORDS = 5
# Groups of more nodes are dealt to several tasks in pairs of blocks of this size.
BLOCK = 512
# Bytes of shingle sets that a task keeps while it confirms pairs.
KEPT_BYTES = 256 << 20
# Ids of documents to fetch are broadcast up to this many bytes, and joined with a shuffle beyond.
BROADCAST_BYTES = 32 << 20
GROUP = ["__head", "__i", "__j"]


def _random_table(size: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, size, np.uint64, endpoint=False)


BYTE_VALUES = _random_table(256)
IS_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LONG_WORD = 64
with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.append(np.uint64(1), np.full(LONG_WORD - 1, 0xD1342543DE82EF95, np.uint64)))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words between ASCII blanks: a polynomial over the bytes, or xxHash for long words."""
    points = np.frombuffer(data, np.uint8)
    blank = IS_BLANK[points]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    terms = BYTE_VALUES[points[~blank]] * POWERS[place & (LONG_WORD - 1)]
    hashes = np.add.reduceat(terms, first) ^ (lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for i in np.flatnonzero(lengths > LONG_WORD):
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return hashes


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text; a text of fewer words is one shingle."""
    # bytes.lower knows A-Z only, as asked for.
    hashes = word_hashes(text.encode("utf-8", "surrogatepass").lower())
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    count = len(hashes) - width + 1
    mixed = np.full(count, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ hashes[i : i + count]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return mixed[np.append(True, mixed[1:] != mixed[:-1])]


def node_of(shingles: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def similar(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= similarity * (len(a) + len(b) - common)


def links_of(nodes: np.ndarray, pairs: Iterable[tuple[int, int]], linked: Callable[[int, int], bool]) -> Iterator[pa.RecordBatch]:
    """(`__a`, `__b`): a link from each node to the first of those that `pairs` of places connect; connected ones are not asked for again."""
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in pairs:
        if (first := root(i)) != (second := root(j)) and linked(i, j):
            parent[max(first, second)] = min(first, second)
    found = [(int(nodes[root(i)]), int(nodes[i])) for i in range(len(parent)) if root(i) != i]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["__a", "__b"])


class Sets:
    """The shingle sets of a group, made from compressed texts when they are needed, the latest kept."""

    def __init__(self, blobs: pa.ChunkedArray, words: int) -> None:
        self.blobs, self.words = blobs, words
        self.unpack = zstandard.ZstdDecompressor()
        self.kept: dict[int, np.ndarray] = {}
        self.bytes = 0

    def __getitem__(self, i: int) -> np.ndarray:
        if i not in self.kept:
            if self.bytes > KEPT_BYTES:
                self.kept, self.bytes = {}, 0
            text = self.unpack.decompress(self.blobs[i].as_py()).decode("utf-8", "surrogatepass")
            self.kept[i] = shingle_set(text, self.words)
            self.bytes += self.kept[i].nbytes
        return self.kept[i]


def list_heads(rows: DataFrame, partitions: int) -> DataFrame:
    """`rows` of posting lists (`__token`, `__node`, more numbers) with the first node of the list, `__head`, in place of the token.

    Lists of one node are left out. The rows stream through in the order of the token; a list
    is never held as a whole.
    """
    names = ["__head", *rows.columns[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        rank, head = 0, 0
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if held:
                columns = [np.append(h, c) for h, c in zip(held, columns)]
            token, node = columns[:2]
            opens = np.append(True, token[1:] != token[:-1])
            start = np.maximum.accumulate(np.where(opens, np.arange(len(token)), 0))
            first = start == 0
            place = np.arange(len(token)) - start + np.where(first, rank, 0)
            heads = np.where(first & (rank > 0), head, node[start])
            several = (place > 0) | np.append(~opens[1:], False)
            # The last row waits for the next batch, which tells whether its list goes on.
            kept = np.flatnonzero(several[:-1])
            if len(kept):
                yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (heads, *columns[1:])], names=names)
            held, rank, head = [c[-1:] for c in columns], int(place[-1]), int(heads[-1])
        if held and rank:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.array([head]), *held[1:])], names=names)

    dealt = rows.repartition(partitions, "__token").sortWithinPartitions("__token", "__node")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def in_blocks(rows: DataFrame) -> DataFrame:
    """The rows of each group (`__head`), those of a large one once for each pair of its blocks: `__i` <= `__j`, own block `__in`."""
    large = rows.groupBy("__head").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > BLOCK)
    large = per_group_side(large.select("__head", F.ceil(F.col("__n") / BLOCK).cast("int").alias("__blocks")))
    blocks = F.coalesce("__blocks", F.lit(1))
    placed = rows.join(large, "__head", "left").withColumn("__in", F.pmod(F.xxhash64(F.lit("block"), "__node"), blocks).cast("int"))
    spread = placed.withColumn("__other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    i, j = F.least("__in", "__other").alias("__i"), F.greatest("__in", "__other").alias("__j")
    return spread.select(i, j, "__in", *rows.columns)


def grouped(rows: DataFrame, partitions: int, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Give `work` the rows of each (`__head`, `__i`, `__j`), two blocks of nodes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in GROUP]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if held and any(k[s] != held[0].column(c)[0].as_py() for k, c in zip(keys, GROUP)):
                    yield from work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(s, e - s))
        if held:
            yield from work(pa.Table.from_batches(held))

    return rows.repartition(partitions, *GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, schema)


def node_texts(docs: DataFrame, wanted: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(`__node`, `__blob`): one compressed text of each wanted (`__node`, `__id`)."""
    rows = docs.select(F.col(key).alias("__id"), whole_text(text).alias("__text"))
    needed = F.broadcast(wanted) if wanted.count() * 24 <= BROADCAST_BYTES else wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            nodes, blobs = [], []
            for node, t in zip(batch.column("__node").to_pylist(), batch.column("__text").to_pylist()):
                # Other texts under the same id have another set.
                if len(s := shingle_set(t, words)) and node_of(s) == node:
                    nodes.append(node)
                    blobs.append(packer.compress(t.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], names=["__node", "__blob"])

    return rows.join(needed, "__id").select("__node", "__text").mapInArrow(run, "__node long, __blob binary").dropDuplicates(["__node"])


def components(links: DataFrame, values: DataFrame) -> DataFrame:
    """(`__node`, `__value`): the least value in each node's component, for the nodes with links.

    `links`: `__a`, `__b`; `values`: `__node`, `__value`. Least values spread along the links, and each round also
    takes over the value of the node that holds a node's least one, so long chains shorten quickly.
    """
    both = links.unionByName(links.select(F.col("__b").alias("__a"), F.col("__a").alias("__b")))
    both = materialize(both.distinct(), "links")
    state = both.select(F.col("__a").alias("__node")).distinct().join(values, "__node")
    state = materialize(state.select("__node", "__value", F.col("__node").alias("__holder")), "state")
    best = F.min(F.struct("__value", "__holder"))
    while True:
        near = both.join(state.withColumnRenamed("__node", "__b"), "__b").select(F.col("__a").alias("__node"), "__value", "__holder")
        jump = state.select("__node", "__holder").join(
            state.select(F.col("__node").alias("__holder"), "__value", F.col("__holder").alias("__next")), "__holder"
        ).select("__node", "__value", F.col("__next").alias("__holder"))
        offered = near.unionByName(jump).withColumn("__own", F.lit(False)).unionByName(state.withColumn("__own", F.lit(True)))
        before = F.max(F.when(F.col("__own"), F.struct("__value"))).alias("__before")
        joined = offered.groupBy("__node").agg(best.alias("__best"), before)
        moved = ~F.col("__best.__value").eqNullSafe(F.col("__before.__value"))
        after = materialize(joined.select("__node", "__best.__value", "__best.__holder", moved.alias("__moved")), "state")
        if after.where("__moved").isEmpty():
            return after.select("__node", "__value")
        state = after.drop("__moved")
