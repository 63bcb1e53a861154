"""MinHash near-dedup by a signature-coordinate inverted join.

A document is its set of word shingles, reduced to `COORDINATES` minima under different
hash orders. Two sets agree in a coordinate with a chance equal to their Jaccard
similarity, so similar ones collide in many. A document is posted under coordinate-value
pairs, collisions are counted, and pairs with at least `threshold` of them are confirmed
on whole shingle sets. The threshold follows from the similarity: a pair right at it is
missed with a chance below `MISS`.

Counting merges two kinds of lists. A document is posted only under its rarest
`COORDINATES - threshold + 1` pairs in one global order (rarer first, by counts in a table
of hash buckets): documents with enough collisions meet in one of these prefix lists. The
longer lists are skipped; a pair that meets is looked up in the two signatures instead,
a quarter of the coordinates at a time, and left as soon as the rest cannot reach the
threshold. It is counted under the first list that both prefixes share, and nowhere else.

Lists are merged by their first node: a node comes once to each such group (a large one is dealt in
pairs of blocks), with its signature. A first pass tells which nodes have a match at all; these come
again with their texts, and matches are confirmed in the same task, those with most collisions first.
Nodes that a task has linked already are not confirmed again, and it emits one link for each node, so
a group of copies gives no square of pairs. Documents with equal sets are one node.

Defined results: null, empty and blank texts have no shingles, are linked with nothing,
and their component is their own id. Rows with one id and different texts each have
their own set, and the id stands for all of them in the smallest id. A row without id has
the component of rows with the same set, else null, and takes no part in near links.
`kept` tells whether id and component are equal, two nulls included. Repeated rows stay
and share their id. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, work_partitions
from .frames import whole_text
from .groups import WORDS, Sets, components, grouped, in_blocks, links_of, list_heads, node_of, node_texts, shingle_set, similar

SIMILARITY = 85  # per cent
COORDINATES = 64  # at most, as prefixes are bits of a long
MISS = 1e-8
BUCKET_BITS = 18
_MIX = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, (2, 256), np.uint64) | np.uint64(1)


def match_threshold(similarity: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """Most collisions that can be asked for while a pair at the similarity is missed with a chance below `miss`."""
    p = similarity / 100
    below = 0.0
    for t in range(coordinates + 1):
        below += comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below >= miss:
            return max(1, t)
    return coordinates


def signature_of(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """32-bit minima of the set under `coordinates` hash orders."""
    with np.errstate(over="ignore"):
        mixed = (shingles[None, :] ^ _MIX[0, :coordinates, None]) * _MIX[1, :coordinates, None]
    return (mixed >> np.uint64(32)).min(axis=1).astype(np.uint32)


def tokens_of(signatures: np.ndarray) -> np.ndarray:
    """64-bit names of the coordinate-value pairs of signatures, one row each."""
    places = np.arange(signatures.shape[1], dtype=np.uint64) << np.uint64(32)
    with np.errstate(over="ignore"):
        mixed = (signatures.astype(np.uint64) | places) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        return mixed * np.uint64(0xBF58476D1CE4E5B9)


def bucket_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def signed_sets(docs: DataFrame, key: str, text: str, words: int, coordinates: int) -> DataFrame:
    """Rows (`__id`, `__n`, `__node`, `__sig`) of documents, and (`__bucket`, `__count`) of each task's bucket counts."""
    rows = docs.select(F.col(key).alias("__id"), whole_text(text).alias("__text"))
    names = ["__id", "__n", "__node", "__sig", "__bucket", "__count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("__id").type
            sizes, nodes, signatures = [], [], []
            for t in batch.column("__text").to_pylist():
                s = shingle_set(t, words)
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                signatures.append(signature_of(s, coordinates) if len(s) else None)
            known = [s for s in signatures if s is not None]
            if known:
                total += np.bincount(bucket_of(tokens_of(np.array(known))).ravel(), minlength=len(total))
            blobs = pa.array([None if s is None else s.tobytes() for s in signatures], pa.binary())
            none = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.int64())
            columns = [batch.column("__id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), blobs, *none]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        used = np.flatnonzero(total)
        for part in np.array_split(used, max(1, len(used) // 20_000)) if len(used) else []:
            n = len(part)
            none = pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays([*none, pa.array(part, pa.int32()), pa.array(total[part], pa.int64())], names=names)

    kind = dict(rows.dtypes)["__id"]
    return rows.mapInArrow(run, f"__id {kind}, __n long, __node long, __sig binary, __bucket int, __count long")


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """Counts of all buckets beyond the usual load; a table of fixed size, 2 ** BUCKET_BITS entries."""
    found = sets.where(F.col("__bucket").isNotNull()).groupBy("__bucket").agg(F.sum("__count").alias("n")).toPandas()
    counts = np.zeros(1 << BUCKET_BITS, np.float32)
    counts[found["__bucket"].to_numpy(int)] = found["n"].to_numpy(float)
    return np.maximum(0, counts - np.median(counts))


def prefix_mask(tokens: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Whether each coordinate-value pair is among the rarest `size` of its row, in the global order (bucket count, token)."""
    order = np.lexsort((tokens, counts[bucket_of(tokens)]), axis=1)[:, :size]
    mask = np.zeros(tokens.shape, bool)
    np.put_along_axis(mask, order, True, axis=1)
    return mask


def postings(nodes: DataFrame, counts: np.ndarray, coordinates: int, threshold: int) -> DataFrame:
    """(`__token`, `__node`, `__at`): each node under the coordinate-value pairs of its prefix."""
    shared = nodes.sparkSession.sparkContext.broadcast(counts)
    size = coordinates - threshold + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signatures = np.frombuffer(b"".join(batch.column("__sig").to_pylist()), np.uint32).reshape(-1, coordinates)
            tokens = tokens_of(signatures)
            mask = prefix_mask(tokens, shared.value, size)
            node = np.repeat(batch.column("__node").to_numpy(), mask.sum(axis=1))
            columns = [tokens[mask].view(np.int64), node, np.nonzero(mask)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["__token", "__node", "__at"])

    return nodes.select("__node", "__sig").mapInArrow(run, "__token long, __node long, __at long")


def members(rows: DataFrame, partitions: int) -> DataFrame:
    """(`__head`, `__node`, `__own`): the nodes of each group, with the bits of the coordinates whose lists they share there."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("__at").cast("int"))
    return list_heads(rows, partitions).groupBy("__head", "__node").agg(F.bit_or(bit).alias("__own"))


def matches(table: pa.Table, coordinates: int, threshold: int, similarity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, collisions) of the pairs of a group with at least `threshold` collisions that count here."""
    column = {c: table.column(c).to_numpy() for c in ("__in", "__size", "__own", "__mask")}
    signature = np.frombuffer(b"".join(table.column("__sig").to_pylist()), np.uint32).reshape(-1, coordinates)
    bits = np.arange(coordinates, dtype=np.int64)
    own, mask = ((column[c][:, None] >> bits) & 1 == 1 for c in ("__own", "__mask"))
    size, block = column["__size"], column["__in"]
    crossing = table.column("__i")[0].as_py() != table.column("__j")[0].as_py()
    step = max(1, coordinates // 4)
    n = len(size)
    found: list[tuple[np.ndarray, ...]] = []
    for d in range(1, n):
        x = np.arange(n - d)
        y = x + d
        fits = 100 * np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y])
        if crossing:
            fits &= block[x] != block[y]
        x, y = x[fits], y[fits]
        count, first = np.zeros(len(x), np.int64), np.full(len(x), coordinates)
        for start in range(0, coordinates, step):
            if not len(x):
                break
            part = slice(start, min(coordinates, start + step))
            equal = signature[x, part] == signature[y, part]
            count += equal.sum(axis=1)
            both = equal & mask[x, part] & mask[y, part]
            first = np.where((first == coordinates) & both.any(axis=1), start + both.argmax(axis=1), first)
            live = count + coordinates - part.stop >= threshold
            x, y, count, first = x[live], y[live], count[live], first[live]
        if len(x):
            here = (first < coordinates) & own[x, np.minimum(first, coordinates - 1)]
            found.append((x[here], y[here], count[here]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


def matched_nodes(blocks: DataFrame, partitions: int, coordinates: int, threshold: int, similarity: int) -> DataFrame:
    """(`__head`, `__node`): the nodes of each group that have a match there."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        x, y, _ = matches(table, coordinates, threshold, similarity)
        at = np.unique(np.concatenate([x, y]))
        if len(at):
            yield pa.RecordBatch.from_arrays([table.column(c).combine_chunks().take(pa.array(at)) for c in names], names=names)

    names = ["__head", "__node"]
    return grouped(blocks, partitions, work, "__head long, __node long").distinct()


def confirmed(blocks: DataFrame, partitions: int, coordinates: int, threshold: int, similarity: int, words: int) -> DataFrame:
    """Links (`__a`, `__b`) by whole sets, one from each node to the first of those it is connected with in its group."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        x, y, count = matches(table, coordinates, threshold, similarity)
        sets = Sets(table.column("__blob"), words)
        order = np.argsort(-count, kind="stable")
        pairs = zip(x[order].tolist(), y[order].tolist())
        yield from links_of(table.column("__node").to_numpy(), pairs, lambda i, j: similar(sets[i], sets[j], similarity))

    return grouped(blocks, partitions, work, "__a long, __b long")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    similarity: int = SIMILARITY,
    coordinates: int = COORDINATES,
) -> DataFrame:
    """One row for each row of `docs`: key, n_shingles, component_id, kept, class_id.

    The component is the least key reachable by links, the class the least key with the same set.
    """
    spark = docs.sparkSession
    partitions = work_partitions(spark)
    threshold = match_threshold(similarity, coordinates)
    stored = materialize(signed_sets(docs, key, text, words, coordinates), "signed")
    sets = stored.where(F.col("__bucket").isNull())
    counts = bucket_counts(stored)
    named = sets.where(F.col("__node").isNotNull()).groupBy("__node")
    classes = named.agg(F.min("__id").alias("__value"), F.first("__n").alias("__size"), F.first("__sig").alias("__sig"))
    classes = materialize(classes, "classes")
    values = classes.select("__node", "__value")
    # A set without any id cannot be linked.
    own = classes.where(F.col("__value").isNotNull())
    groups = materialize(members(postings(own, counts, coordinates, threshold), partitions), "members")
    masks = groups.groupBy("__node").agg(F.bit_or("__own").alias("__mask"))
    nodes = materialize(own.join(masks, "__node"), "nodes")
    signed = in_blocks(groups.join(nodes.drop("__value"), "__node"))
    wanted = materialize(matched_nodes(signed, partitions, coordinates, threshold, similarity), "wanted")
    ids = materialize(nodes.select("__node", F.col("__value").alias("__id")).join(wanted.select("__node").distinct(), "__node"), "ids")
    texts = materialize(node_texts(docs, ids, key, text, words), "texts")
    chosen = groups.join(wanted, ["__head", "__node"]).join(nodes.drop("__value").join(texts, "__node"), "__node")
    links = materialize(confirmed(in_blocks(chosen), partitions, coordinates, threshold, similarity, words), "links")
    found = components(links, values).withColumnRenamed("__value", "__component")
    labels = classes.select("__node", F.col("__value").alias("__class")).join(found, "__node", "left")
    component = F.coalesce("__component", "__class", "__id")
    return sets.select("__id", "__n", "__node").join(labels, "__node", "left").select(
        F.col("__id").alias(key),
        F.col("__n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("__id").eqNullSafe(component).alias("kept"),
        F.coalesce("__class", "__id").alias("class_id"),
    )

