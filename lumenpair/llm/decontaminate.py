"""Benchmark decontamination by the q-gram lemma.

An item of n characters found with at most k edits shares at least
n - q + 1 - k * q of its q-grams with the text, all within k diagonals of one
another (diagonal: place in the text minus place in the item). So the shared
q-grams are counted in bands of 2(k + 1) diagonals, each overlapping the next by
half; bands that reach the bound are verified by a banded alignment.

Text and items are compared with A-Z and Latin-1 capitals lower-cased and runs of
white space as one space; the results give places in the original text. The edit
budget of an item is min(rate * n, (n - q) / q), whole, so that the bound is at
least one q-gram. An item shorter than q is sought as it is.

The items are taken in blocks of bounded size, so no more than one block goes to
the tasks; every block meets all rows, and no document is shuffled.

Defined results: null and empty texts, and null and blank items, match nothing.
Repeated rows each give their matches. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import whole_text

Q = 10
EDIT_RATE = 0.06
# Characters of items in a block; what the driver reads and a task holds at once.
BLOCK_CHARS = 4 << 20
# Characters of documents that a task hashes at once.
CHUNK_CHARS = 1 << 20
# Stands between two texts of a chunk; matches are verified within one text.
BETWEEN = "\U0010ffff"
BASE = np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = 22

MATCH_SCHEMA = "item_id {item}, start_char long, end_char long, edits int"


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points and the place of each in the original text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (points == 32) | ((points >= 9) & (points <= 13)) | (points == 0x85) | (points == 0xA0)
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    places = np.flatnonzero(keep)
    out = np.where(blank, np.uint32(32), points)[places]
    capital = ((out >= 65) & (out <= 90)) | ((out >= 0xC0) & (out <= 0xDE) & (out != 0xD7))
    out = np.where(capital, out + np.uint32(32), out)
    return out, places


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each window of q code points, from windows of half the length."""
    if len(points) < q:
        return np.empty(0, np.uint64)
    result, width = None, 0
    window, size = (points.astype(np.uint64) + np.uint64(1)) * BASE, 1
    count = len(points) - q + 1
    with np.errstate(over="ignore"):
        while True:
            if q & size:
                part = window[width : width + count]
                result = part.copy() if result is None else result * _power(size) + part
                width += size
            if width == q:
                return result ^ (result >> np.uint64(29))
            window = window[:-size] * _power(size) + window[size:]
            size *= 2


def _power(size: int) -> np.uint64:
    return np.uint64(pow(0xD6E8FEB86659FD93, size, 1 << 64))


@dataclass
class Items:
    """The searched items and their q-grams, sorted by hash."""

    ids: list
    texts: list[np.ndarray]
    budgets: np.ndarray
    bounds: np.ndarray
    grams: np.ndarray
    starts: np.ndarray
    item_of: np.ndarray
    place_of: np.ndarray
    table: np.ndarray
    q: int


def index_items(items: list[tuple], q: int = Q, rate: float = EDIT_RATE) -> Items:
    found = [(i, normalise(t.strip())[0]) for i, t in items if t is not None and t.strip()]
    texts = [p for _, p in found]
    n = np.array([len(p) for p in texts], np.int64)
    budgets = np.maximum(0, np.minimum(np.floor(rate * n + 1e-9).astype(np.int64), (n - q) // q))
    hashes = [gram_hashes(p, q) for p in texts]
    flat = np.concatenate([np.empty(0, np.uint64), *hashes])
    item_of = np.repeat(np.arange(len(texts)), [len(h) for h in hashes]) if texts else np.empty(0, np.int64)
    place_of = np.concatenate([np.empty(0, np.int64), *[np.arange(len(h)) for h in hashes]])
    order = np.argsort(flat, kind="stable")
    grams, starts = np.unique(flat[order], return_index=True)
    table = np.zeros(1 << TABLE_BITS, bool)
    table[(grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
    return Items(
        [i for i, _ in found], texts, budgets, n - q + 1 - budgets * q, grams,
        np.append(starts, len(flat)), item_of[order], place_of[order], table, q,
    )


def align(item: np.ndarray, text: np.ndarray, lowest: int, highest: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of `item` on the diagonals `lowest` to `highest` of `text`.

    The item is matched whole, the text from any place to any place. None beyond the budget.
    """
    n, big = len(item), 1 << 20
    width = highest - lowest + 1
    offsets = np.arange(width)
    # Cell c of row i stands for the text place i + lowest + c. Starts on the top row cost nothing.
    places = lowest + offsets
    inside = (places >= 0) & (places <= len(text))
    cost = np.where(inside, 0, big)
    start = places.copy()
    padded = np.full(width + n, -1, np.int64)
    lo, hi = max(0, lowest), min(len(text), lowest + width + n)
    if hi > lo:
        padded[lo - lowest : hi - lowest] = text[lo:hi]
    for i in range(1, n + 1):
        places = i + lowest + offsets
        inside = (places >= 0) & (places <= len(text))
        # Diagonal step: the text character before this place; its index in `padded` is i - 1 + c.
        step = cost + (padded[i - 1 : i - 1 + width] != item[i - 1])
        step = np.where(places >= 1, step, big)
        skip = np.append(cost[1:], big) + 1
        best, origin = step, start
        better = skip < best
        best = np.where(better, skip, best)
        origin = np.where(better, np.append(start[1:], 0), origin)
        best = np.where(inside, best, big)
        # A text character without partner moves along the row.
        run = np.minimum.accumulate(best - offsets)
        moved = run + offsets
        source = np.maximum.accumulate(np.where(best - offsets == run, offsets, -1))
        source = np.where(moved < best, source, offsets)
        cost, start = np.minimum(moved, best), origin[source]
        cost = np.where(inside, cost, big)
        if cost.min() > budget:
            return None
    at = int(np.argmin(cost))
    return int(cost[at]), int(start[at]), int(n + lowest + at)


def _occurrences(text: np.ndarray, item: np.ndarray) -> list[int]:
    """Places where the item stands unchanged."""
    hay, needle = text.astype(np.uint32).tobytes(), item.astype(np.uint32).tobytes()
    found, at = [], hay.find(needle)
    while at >= 0:
        if at % 4 == 0:
            found.append(at // 4)
        at = hay.find(needle, at + 1)
    return found


def candidate_bands(grams: np.ndarray, doc_starts: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """(document, item, lowest diagonal of the band) where the shared q-grams reach the item's bound."""
    at = np.flatnonzero(items.table[(grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
    if not len(at) or not len(items.grams):
        return
    slot = np.minimum(np.searchsorted(items.grams, grams[at]), len(items.grams) - 1)
    real = items.grams[slot] == grams[at]
    at, slot = at[real], slot[real]
    counts = items.starts[slot + 1] - items.starts[slot]
    posting = np.repeat(items.starts[slot] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    which = items.item_of[posting]
    place = np.repeat(at, counts)
    doc = np.searchsorted(doc_starts, place, "right") - 1
    half = items.budgets[which] + 1
    # The band that starts at this multiple of k + 1, and the one before it, hold the diagonal.
    band = np.floor_divide(place - items.place_of[posting], half)
    low, span = band.min() - 1, band.max() - band.min() + 2
    code = (doc * len(items.texts) + which) * span + band - low
    codes, shared = _counted(np.concatenate([code, code - 1]))
    which = codes // span % len(items.texts)
    enough = shared >= items.bounds[which]
    for code, i in zip(codes[enough].tolist(), which[enough].tolist()):
        yield code // span // len(items.texts), i, (code % span + low) * (int(items.budgets[i]) + 1)


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values.sort()
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[first], np.diff(np.append(first, len(values)))


def verify(text: np.ndarray, item: np.ndarray, lowest: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the item on the band's diagonals and the `budget` next to it."""
    low, high = lowest - budget, lowest + 2 * (budget + 1) + budget
    base = max(0, low)
    for place in _occurrences(text[base : max(0, high + len(item))], item):
        return 0, base + place, base + place + len(item)
    return align(item, text, low, high, budget)


def search_texts(texts: list[str], items: Items) -> list[list[tuple[int, int, int, int]]]:
    """(item index, start, end, edits) for each text, in places of the original text.

    No two matches of an item overlap; those with fewer edits, then earlier ones, stay.
    """
    lengths = np.array([len(t) for t in texts])
    begins = np.cumsum(lengths + 1) - lengths - 1
    points, places = normalise(BETWEEN.join(texts))
    starts = np.searchsorted(places, begins)
    ends = np.searchsorted(places, begins + lengths)
    hits: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    for d, i, lowest in candidate_bands(gram_hashes(points, items.q), starts, items):
        found = verify(points[starts[d] : ends[d]], items.texts[i], lowest - int(starts[d]), int(items.budgets[i]))
        if found:
            hits[d].append((i, found[1], found[2], found[0]))
    for i in np.flatnonzero(np.array([len(t) for t in items.texts]) < items.q).tolist():
        item = items.texts[i]
        for d in range(len(texts)):
            hits[d] += [(i, p, p + len(item), 0) for p in _occurrences(points[starts[d] : ends[d]], item)]
    for d, found in enumerate(hits):
        if found:
            own = places[starts[d] : ends[d]] - begins[d]
            hits[d] = [(i, int(own[a]), int(own[b - 1]) + 1, e) for i, a, b, e in _apart(found) if b > a]
    return hits


def _apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    kept: list[tuple[int, int, int, int]] = []
    for hit in sorted(set(found), key=lambda h: (h[0], h[3], h[1], h[2])):
        if not any(o[0] == hit[0] and o[1] < hit[2] and hit[1] < o[2] for o in kept):
            kept.append(hit)
    return kept


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """Runs of whole texts of about `CHUNK_CHARS`."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The items in blocks of at most `BLOCK_CHARS` characters or one item, read one at a time."""
    rows = items.select(F.col(item_id), F.col(text).cast("string")).orderBy(item_id, text)
    block, size = [], 0
    for row in rows.toLocalIterator():
        length = len(row[1] or "")
        if block and size + length > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += length
    if block:
        yield block


def find_items(
    docs: DataFrame,
    items: DataFrame,
    keep: list[str],
    q: int = Q,
    rate: float = EDIT_RATE,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """All rows' columns `keep` and `matches`: an array of (item_id, start_char, end_char, edits)."""
    kind = dict(items.dtypes)[item_id]
    rows = docs.select(*keep, whole_text(text).alias("__text"), F.array().cast(_array(kind)).alias("__m"))
    for block in item_blocks(items, item_id, item_text):
        rows = _with_block(rows, block, q, rate, kind)
    return rows.select(*keep, F.col("__m").alias("matches"))


def _array(kind: str) -> str:
    fields = ", ".join(f"{f.split()[0]}: {f.split()[1]}" for f in MATCH_SCHEMA.format(item=kind).split(", "))
    return f"array<struct<{fields}>>"


def _with_block(rows: DataFrame, block: list[tuple], q: int, rate: float, kind: str) -> DataFrame:
    names = rows.columns
    schema = ", ".join(f"`{c}` {_array(kind) if c == '__m' else t}" for c, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = index_items(block, q, rate)
        for batch in batches:
            found = [m for part in chunks(batch.column("__text").to_pylist()) for m in search_texts(part, items)]
            column = batch.column("__m")
            if any(found):
                added = [
                    (old or []) + [
                        {"item_id": items.ids[i], "start_char": a, "end_char": b, "edits": e} for i, a, b, e in new
                    ]
                    for old, new in zip(column.to_pylist(), found)
                ]
                column = pa.array(added, column.type)
            yield pa.RecordBatch.from_arrays([column if c == "__m" else batch.column(c) for c in names], names=names)

    return rows.mapInArrow(run, schema)


def contaminations(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row for each match: key, item_id, start_char, end_char (exclusive), edits."""
    found = find_items(docs, items, [key], **options).where(F.size("matches") > 0)
    return found.select(key, F.explode("matches").alias("m")).select(key, "m.*")


def is_contaminated() -> Column:
    return F.size("matches") > 0
