"""N-gram Jaccard join with adaptive multi-match prefixes, exact.

A document is its set of word shingles. The shingles have one global order: rarer
first, by counts in a table of hash buckets over all documents (any order gives
right results; this one keeps shared passages out of the prefixes). A document of
n shingles must share o = ceil(n * similarity) with a partner, so two partners
have at least l common shingles among the first n - o + l of each. Every document
chooses its own l from 1 to `MAX_LEVEL` by the estimated cost of its candidates; a
pair is verified only if it shares as many prefix shingles as the smaller of its
two levels asks for, counted up to that level.

Lists are merged by their first node: a node comes once to each such group (a large one
is dealt in pairs of blocks). A first pass holds the nodes of a group against each other by
sizes and by a bitmap bound on the symmetric difference, as wide as the sets ask for; neither
drops a pair that reaches the similarity. Nodes with a pair left come again with their texts,
and the shared prefix shingles are counted and pairs verified on whole shingle sets in the
same task, the most similar first. Nodes that a task has linked already are not verified
again, and it emits one link for each node, so a group of copies gives no square of pairs.

Documents with equal sets count as one in the join (a node, named by a 64-bit
digest of the set) and share its component.

Defined results: null, empty and blank texts have no shingles, are linked with
nothing, and their component is their own id. Rows with one id and different
texts each have their own set, and the id stands for all of them in the smallest
id. A row without id has the component of rows with the same set, else null, and
takes no part in near links. Repeated rows stay. An empty table gives an empty
result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, work_partitions
from .frames import whole_text
from .groups import WORDS, Sets, components, grouped, in_blocks, links_of, list_heads, node_of, node_texts, shingle_set, similar

SIMILARITY = 75  # per cent
MAX_LEVEL = 4
VERIFY_COST = 20.0
BUCKET_BITS = 18
# Bits of a bitmap for each shingle of its set, and the words it has at least; widths are powers of two.
BITS_PER_SHINGLE = 2
LEAST_WORDS = 4


def least_overlap(n: int, similarity: int) -> int:
    """ceil(n * similarity / 100): what any partner shares."""
    return -(-n * similarity // 100)


def bucket_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def bitmap_of(shingles: np.ndarray) -> np.ndarray:
    """Parities of the set's members in a power of two of words, by the size of the set.

    Two bitmaps of one width differ in no more bits than the sets' symmetric difference has
    members; the two halves of one xor-ed give the bitmap of half the width.
    """
    words = LEAST_WORDS
    while 64 * words < BITS_PER_SHINGLE * len(shingles):
        words *= 2
    at = ((shingles >> np.uint64(7)) % np.uint64(64 * words)).astype(np.int64)
    odd = (np.bincount(at, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def prefix_of(shingles: np.ndarray, counts: np.ndarray, similarity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(shingles, level of each, chosen level) of the prefix in the global order.

    `counts` holds the bucket counts beyond the usual load. The cost of a level is
    the length of the posting lists read plus the verifications, of which there
    are at most (matches / level).
    """
    n = len(shingles)
    first = n - least_overlap(n, similarity) + 1
    longest = min(n, first + MAX_LEVEL - 1)
    weight = counts[bucket_of(shingles)]
    order = np.lexsort((shingles, weight))[:longest]
    matches = np.cumsum(weight[order])
    levels = np.arange(1, longest - first + 2)
    reached = matches[first - 1 :]
    level = int(levels[np.argmin(reached * (1.0 + VERIFY_COST / levels))])
    size = first + level - 1
    own = np.maximum(1, np.arange(1, size + 1) - first + 1)
    return shingles[order[:size]], own, level


def document_sets(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """Rows (`__id`, `__n`, `__node`, `__bitmap`) of documents, and (`__bucket`, `__count`) of each task's bucket counts."""
    rows = docs.select(F.col(key).alias("__id"), whole_text(text).alias("__text"))
    kind = dict(rows.dtypes)["__id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("__id").type
            sets = [shingle_set(t, words) for t in batch.column("__text").to_pylist()]
            for s in sets:
                np.add.at(total, bucket_of(s), 1)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([bitmap_of(s).tobytes() for s in sets], pa.binary()),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.int64()),
                ],
                names=["__id", "__n", "__node", "__bitmap", "__bucket", "__count"],
            )
        used = np.flatnonzero(total)
        for part in np.array_split(used, max(1, len(used) // 20_000)):
            if len(part):
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
                        pa.array(part, pa.int32()), pa.array(total[part], pa.int64()),
                    ],
                    names=["__id", "__n", "__node", "__bitmap", "__bucket", "__count"],
                )

    schema = f"__id {kind}, __n long, __node long, __bitmap binary, __bucket int, __count long"
    return rows.mapInArrow(run, schema)


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """Counts of all buckets beyond the usual load; a table of fixed size, 2 ** BUCKET_BITS entries."""
    found = sets.where(F.col("__bucket").isNotNull()).groupBy("__bucket").agg(F.sum("__count").alias("n")).toPandas()
    counts = np.zeros(1 << BUCKET_BITS, np.float32)
    counts[found["__bucket"].to_numpy(int)] = found["n"].to_numpy(float)
    return np.maximum(0, counts - np.median(counts))


def prefixes(docs: DataFrame, counts: np.ndarray, text: str, words: int, similarity: int) -> DataFrame:
    """(`__token`, `__node`): the prefixes of all documents, the node of equal sets once a batch."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, np.ndarray] = {}
            for t in batch.column("__text").to_pylist():
                s = shingle_set(t, words)
                if len(s) and (node := node_of(s)) not in found:
                    found[node] = prefix_of(s, shared.value, similarity)[0]
            if found:
                tokens = np.concatenate(list(found.values())).view(np.int64)
                nodes = np.repeat(np.array(list(found), np.int64), [len(p) for p in found.values()])
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(nodes)], names=["__token", "__node"])

    return docs.select(whole_text(text).alias("__text")).mapInArrow(run, "__token long, __node long")


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def close_pairs(table: pa.Table, similarity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, differing bits) of the pairs of a group whose sizes and bitmaps allow the similarity."""
    size, block = table.column("__size").to_numpy(), table.column("__in").to_numpy()
    blobs = table.column("__bitmap").to_pylist()
    width = np.array([len(b) // 8 for b in blobs])
    crossing = table.column("__i")[0].as_py() != table.column("__j")[0].as_py()
    found: list[tuple[np.ndarray, ...]] = []
    for words in np.unique(width).tolist():
        # Sets that reach the similarity have widths at most one step apart.
        own = np.flatnonzero(width == words)
        next_ = np.flatnonzero(width == 2 * words)
        rows = np.append(own, next_)
        bits = [np.frombuffer(b"".join([blobs[i] for i in at]), np.uint64).reshape(len(at), -1) for at in (own, next_) if len(at)]
        bits = np.concatenate([_fold(b, words) for b in bits])
        for k in range(len(own)):
            x, others = rows[k], rows[k + 1 :]
            both = size[x] + size[others]
            least = -(-similarity * both // (100 + similarity))
            fits = least <= np.minimum(size[x], size[others])
            if crossing:
                fits &= block[x] != block[others]
            at = np.flatnonzero(fits)
            if len(at):
                apart = np.bitwise_count(bits[k] ^ bits[k + 1 + at]).sum(axis=1)
                ok = apart <= (both - 2 * least)[at]
                if ok.any():
                    y = others[at[ok]]
                    found.append((np.full(len(y), x), y, apart[ok].astype(np.int64)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


def close_nodes(blocks: DataFrame, partitions: int, similarity: int) -> DataFrame:
    """(`__head`, `__node`): the nodes of each group that a pair is left of."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        x, y, _ = close_pairs(table, similarity)
        at = np.unique(np.concatenate([x, y]))
        if len(at):
            yield pa.RecordBatch.from_arrays([table.column(c).combine_chunks().take(pa.array(at)) for c in names], names=names)

    names = ["__head", "__node"]
    return grouped(blocks, partitions, work, "__head long, __node long").distinct()


class Prefixes:
    """The prefixes of a group's sets: sorted shingles with their levels, and the chosen levels."""

    def __init__(self, sets: Sets, counts: np.ndarray, similarity: int) -> None:
        self.sets, self.counts, self.similarity = sets, counts, similarity
        self.kept: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, int]:
        if i not in self.kept:
            tokens, own, level = prefix_of(self.sets[i], self.counts, self.similarity)
            order = np.argsort(tokens)
            self.kept[i] = tokens[order], own[order], level
        return self.kept[i]

    def enough(self, i: int, j: int) -> bool:
        """Whether two sets share as many prefix shingles as the smaller of their levels asks for, counted up to that level."""
        (x, own_x, level_x), (y, own_y, level_y) = self[i], self[j]
        need = min(level_x, level_y)
        common = np.intersect1d(x[own_x <= need], y[own_y <= need], assume_unique=True)
        return len(common) >= need


def confirmed(blocks: DataFrame, counts: np.ndarray, partitions: int, words: int, similarity: int) -> DataFrame:
    """Links (`__a`, `__b`) by whole sets, one from each node to the first of those it is connected with in its group."""
    shared = blocks.sparkSession.sparkContext.broadcast(counts)

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        x, y, apart = close_pairs(table, similarity)
        sets = Sets(table.column("__blob"), words)
        prefixes = Prefixes(sets, shared.value, similarity)
        order = np.argsort(apart, kind="stable")
        linked = lambda i, j: prefixes.enough(i, j) and similar(sets[i], sets[j], similarity)
        yield from links_of(table.column("__node").to_numpy(), zip(x[order].tolist(), y[order].tolist()), linked)

    return grouped(blocks, partitions, work, "__a long, __b long")


def similar_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: int = SIMILARITY
) -> DataFrame:
    """One row for each row of `docs`: key, n_shingles, component_id, class_id.

    The component is the least key reachable by links, the class the least key with the same set.
    """
    spark = docs.sparkSession
    partitions = work_partitions(spark)
    stored = materialize(document_sets(docs, key, text, words), "sets")
    sets = stored.where(F.col("__bucket").isNull())
    counts = bucket_counts(stored)
    named = sets.where(F.col("__node").isNotNull()).groupBy("__node")
    classes = materialize(
        named.agg(F.min("__id").alias("__value"), F.first("__n").alias("__size"), F.first("__bitmap").alias("__bitmap")), "classes"
    )
    values = classes.select("__node", "__value")
    # A set without any id cannot be linked.
    nodes = classes.where(F.col("__value").isNotNull()).select("__node", "__size", "__bitmap")
    heads = list_heads(prefixes(docs, counts, text, words, similarity), partitions)
    # A set without any id, whose rows are among the prefixes, finds no node here.
    groups = materialize(heads.distinct(), "groups")
    close = materialize(close_nodes(in_blocks(groups.join(nodes, "__node")), partitions, similarity), "close")
    ids = materialize(close.select("__node").distinct().join(values.withColumnRenamed("__value", "__id"), "__node"), "ids")
    texts = materialize(node_texts(docs, ids, key, text, words), "texts")
    chosen = close.join(nodes.join(texts, "__node"), "__node")
    links = materialize(confirmed(in_blocks(chosen), counts, partitions, words, similarity), "links")
    found = components(links, values).withColumnRenamed("__value", "__component")
    labels = classes.select("__node", F.col("__value").alias("__class")).join(found, "__node", "left")
    return sets.select("__id", "__n", "__node").join(labels, "__node", "left").select(
        F.col("__id").alias(key),
        F.col("__n").alias("n_shingles"),
        F.coalesce("__component", "__class", "__id").alias("component_id"),
        F.coalesce("__class", "__id").alias("class_id"),
    )
