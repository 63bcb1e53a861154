"""Spelling variant grouping by blocked Gram matrices.

Words are counted over all documents; frequent ones become vectors of letter counts.
One inserted or deleted letter puts two vectors at a squared distance of 1, one
replaced letter at 2. Squared distances of two blocks come from one NumPy product,
|x|^2 + |y|^2 - 2 x.y; pairs at most two apart are verified letter by letter.

A block holds the words with equal lengths in each of `CLASSES` classes of letters
(its total length is the sum). One edit changes one class length by one, or two of
them by one in opposite directions, so a word visits its own block, the `CLASSES`
blocks one letter longer, and half of those with one letter moved; the other half
comes the other way round. Classes are balanced by the letters' frequencies, which
changes the size of blocks, never the result. A block of more than `CHUNK` words is
dealt to several tasks, and every visitor goes to all of its chunks. Tasks emit the
number of near words and the best one for each word, never pairs.

Defined results: a null text has no words. A row without id has its words counted as
they are written, as they have no digest to be edited by. Repeated rows count each
time. Words of equal count tie in code-point order. A word of any length is handled
whole; chunks go by bytes. An empty table, or one without frequent words, gives an
empty result. Only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, work_partitions
from .frames import whole_text

EDIT_EVERY = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
DOMINANCE = 5
CLASSES = 6
CHUNK = 1024
# Letters that a chunk holds at most, so that very long words come in smaller chunks.
CHUNK_LETTERS = 1 << 22
# Distinct words that a task keeps while it counts.
KEPT_WORDS = 400_000
BROADCAST_ROWS = 100_000
RUN = re.compile("[a-zA-ZÀ-ÿ]+")
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
# Code point (Latin-1) to place in the alphabet; the pad byte lies beyond it.
PLACE = np.full(256, len(ALPHABET), np.uint8)
PLACE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
EXACT_IN_SINGLE = 4096


def edited_words(doc_id: int | None, text: str) -> Counter[str]:
    """Counts of a text's lower-cased runs; every `EDIT_EVERY`-th, by its digest, loses one letter."""
    # bytes.lower knows A-Z only, as asked for.
    found = Counter(RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    if doc_id is None:
        return found
    head = zlib.crc32(f"{doc_id}:".encode())
    digests = [(run, zlib.crc32(run.encode(), head)) for run in found]
    # Taken out first: the word that one run becomes may itself be a run that changes.
    changed = [(run, h % len(run), found.pop(run)) for run, h in digests if h % EDIT_EVERY == 0]
    for run, at, n in changed:
        found[run[:at] + run[at + 1 :]] += n
    return found


def word_counts(docs: DataFrame, key: str, text: str, least_length: int, least_count: int) -> DataFrame:
    """(`word`, `n`): words of at least `least_length` letters and `least_count` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            for i, t in zip(batch.column("__id").to_pylist(), batch.column("__text").to_pylist()):
                for word, n in edited_words(i, t).items():
                    if len(word) >= least_length:
                        total[word] = total.get(word, 0) + n
                if len(total) > KEPT_WORDS:
                    yield from _count_rows(total)
                    total = {}
        yield from _count_rows(total)

    rows = docs.select(F.col(key).cast("bigint").alias("__id"), whole_text(text).alias("__text"))
    parts = rows.mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _count_rows(total: dict[str, int]) -> Iterator[pa.RecordBatch]:
    words = list(total)
    for i in range(0, len(words), 50_000):
        part = words[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([total[w] for w in part], pa.int64())], names=["word", "n"])


def letter_classes(words: DataFrame, classes: int = CLASSES) -> list[str]:
    """The alphabet in `classes` parts of about equal frequency; at most one row a letter reaches the driver."""
    letters = F.explode(F.split("word", ""))
    found = words.select(letters.alias("c")).where("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {r.c: r.n for r in found}
    parts, weights = [""] * classes, [0] * classes
    for c in sorted(ALPHABET, key=lambda c: (-counts.get(c, 0), c)):
        k = min(range(classes), key=lambda i: (weights[i], i))
        parts[k] += c
        weights[k] += counts.get(c, 0)
    return parts


def _class_lengths(word: Column, classes: list[str]) -> list[Column]:
    others = ["".join(p for j, p in enumerate(classes) if j != i) for i in range(len(classes))]
    # Letters outside the class are deleted; what is left is its length.
    return [F.length(F.translate(word, o, "")) for o in others]


def visits(words: DataFrame, classes: list[str], chunk: int = CHUNK) -> DataFrame:
    """(`__block`, `__chunk`, `__home`, `word`, `n`): each word at home, and wherever a word one edit away may be at home."""
    lengths = _class_lengths(F.col("word"), classes)
    keyed = words.select("word", "n", *[c.cast("int").alias(f"__k{i}") for i, c in enumerate(lengths)])
    keys = [F.col(f"__k{i}") for i in range(len(classes))]

    def moved(*steps: tuple[int, int]) -> Column:
        change = dict(steps)
        return F.concat_ws(",", *[(k + change[i] if i in change else k).cast("string") for i, k in enumerate(keys)])

    longer = [moved((i, 1)) for i in range(len(keys))]
    replaced = [F.when(keys[j] > 0, moved((i, 1), (j, -1))) for i in range(len(keys)) for j in range(i + 1, len(keys))]
    keyed = keyed.select("word", "n", moved().alias("__own"), F.array(*longer, *replaced).alias("__other"))
    size = F.greatest(F.lit(1), F.least(F.lit(chunk), F.floor(F.lit(CHUNK_LETTERS) / F.max(F.length("word")))))
    blocks = keyed.groupBy(F.col("__own").alias("__block")).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("__chunks"))
    stored = materialize(blocks, "blocks")
    blocks = F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored
    at = F.pmod(F.xxhash64("word"), F.col("__chunks")).cast("int")
    home = keyed.select(F.col("__own").alias("__block"), "word", "n").join(blocks, "__block").withColumn("__at", at)
    # The chunks after its own in the same block are visited too.
    own = F.sequence(F.col("__at"), F.col("__chunks") - 1)
    home = home.select("__block", F.explode(own).alias("__chunk"), "__at", "word", "n")
    home = home.select("__block", "__chunk", (F.col("__chunk") == F.col("__at")).alias("__home"), "word", "n")
    away = keyed.select(F.explode(F.filter("__other", lambda k: k.isNotNull())).alias("__block"), "word", "n").join(blocks, "__block")
    away = away.select(
        "__block", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)).alias("__chunk"), F.lit(False).alias("__home"), "word", "n"
    )
    return home.unionByName(away)


class Block:
    """Words of a block as letters and letter counts."""

    def __init__(self, words: list[str], counts: np.ndarray) -> None:
        self.words, self.n = words, counts
        self.lengths = np.array([len(w) for w in words])
        width = int(self.lengths.max())
        kind = np.float32 if width < EXACT_IN_SINGLE else np.float64
        raw = "".join(w.ljust(width, "\0") for w in words).encode("latin-1")
        self.letters = PLACE[np.frombuffer(raw, np.uint8).reshape(len(words), width)]
        size = len(ALPHABET) + 1
        flat = self.letters.astype(np.int64) + np.arange(len(words))[:, None] * size
        counted = np.bincount(flat.ravel(), minlength=len(words) * size).reshape(len(words), size)
        self.vectors = counted[:, :-1].astype(kind)
        self.norms = (self.vectors * self.vectors).sum(axis=1)


def near_pairs(a: Block, b: Block, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of the words one edit apart; `within` one block each pair comes once."""
    gram = a.vectors @ b.vectors.T
    # Squared distances; those of words one edit apart are 1 or 2.
    gram *= -2
    gram += a.norms[:, None]
    gram += b.norms[None, :]
    i, j = np.nonzero(gram <= 2)
    if within:
        i, j = i[i < j], j[i < j]
    by = a.lengths[i] - b.lengths[j]
    out = []
    for step, x, y, p, q in ((0, a, b, i, j), (1, b, a, j, i), (-1, a, b, i, j)):
        at = np.flatnonzero(by == step)
        if len(at):
            ok = at[_replaced(x, y, p[at], q[at]) if step == 0 else _inserted(x, y, p[at], q[at])]
            out.append(ok)
    kept = np.concatenate(out) if out else np.empty(0, np.int64)
    return i[kept], j[kept]


def _replaced(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    width = min(a.letters.shape[1], b.letters.shape[1])
    return (a.letters[i, :width] != b.letters[j, :width]).sum(axis=1) == 1


def _inserted(short: Block, long: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the longer word without one letter is the shorter one: the common start and end cover it."""
    width = int(short.lengths[i].max())
    x, y = short.letters[i, :width], long.letters[j, : width + 1]
    inside = np.arange(width) < short.lengths[i][:, None]
    start = (np.cumprod((x == y[:, :-1]) & inside, axis=1)).sum(axis=1)
    end = (np.cumprod(((x == y[:, 1:]) | ~inside)[:, ::-1], axis=1)).sum(axis=1) - (width - short.lengths[i])
    return start + end >= short.lengths[i]


class Tally:
    """Number of near words and the best one, for the words of one block."""

    def __init__(self, block: Block) -> None:
        self.block = block
        self.n_near = np.zeros(len(block.words), np.int64)
        self.best: dict[int, tuple[int, str]] = {}

    def add(self, i: np.ndarray, other: Block, j: np.ndarray) -> None:
        np.add.at(self.n_near, i, 1)
        # Only the largest counts of each word can be the best; ties go by the word itself.
        order = np.lexsort((-other.n[j], i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else i
        top = np.repeat(other.n[j[first]], np.diff(np.append(first, len(i)))) if len(i) else i
        for x, y in zip(i[other.n[j] == top].tolist(), j[other.n[j] == top].tolist()):
            found = (-int(other.n[y]), other.words[y])
            self.best[x] = min(self.best.get(x, found), found)

    def rows(self) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(self.n_near)
        if not len(at):
            return
        best = [self.best[i] for i in at.tolist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([self.block.words[i] for i in at.tolist()]),
                pa.array(self.n_near[at], pa.int64()),
                pa.array([-n for n, _ in best], pa.int64()),
                pa.array([w for _, w in best]),
            ],
            names=["word", "n_near", "best_n", "best"],
        )


class _Group:
    """One chunk of a block: its home words, then guests as they stream through."""

    def __init__(self, at: tuple[str, int]) -> None:
        self.at = at
        self.words: list[str] = []
        self.counts: list[np.ndarray] = []
        self.home: Block | None = None

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at_home = batch.column("__home").to_numpy(zero_copy_only=False)
        words, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        m = int(at_home.sum())  # home words come first
        self.words += words[:m]
        self.counts.append(counts[:m])
        if m == len(words) or not self.words:
            return
        home = self.close_home()
        step = max(1, min(2 * CHUNK, CHUNK_LETTERS // int(home.lengths.max())))
        for s in range(m, len(words), step):
            guests = Block(words[s : s + step], counts[s : s + step])
            i, j = near_pairs(home, guests, within=False)
            self.tally.add(i, guests, j)
            theirs = Tally(guests)
            theirs.add(j, home, i)
            yield from theirs.rows()

    def close_home(self) -> Block:
        if self.home is None:
            self.home = Block(self.words, np.concatenate(self.counts))
            self.tally = Tally(self.home)
            i, j = near_pairs(self.home, self.home, within=True)
            self.tally.add(np.concatenate([i, j]), self.home, np.concatenate([j, i]))
        return self.home

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.words:
            self.close_home()
            yield from self.tally.rows()


def near_words(visiting: DataFrame, partitions: int) -> DataFrame:
    """(`word`, `n_near`, `best_n`, `best`): near words of each word that has any, its most frequent one among them."""
    names = ["__block", "__chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: _Group | None = None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in names]))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                if group is None or keys[s] != group.at:
                    if group:
                        yield from group.close()
                    group = _Group(keys[s])
                yield from group.add(batch.slice(s, e - s))
        if group:
            yield from group.close()

    dealt = visiting.repartition(partitions, *names).sortWithinPartitions(*names, F.desc("__home"))
    parts = dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    found = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(`word`, `root`) of the words with a form (`word`, `form`): forms followed to the last.

    A form is `DOMINANCE` times as frequent as its word, so chains are short and never close.
    Each round doubles the distance followed.
    """
    state = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        after = state.join(onward, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved"))
        after = materialize(after, "roots")
        if after.where("__moved").isEmpty():
            return after.select("word", "root")
        state = after.select("word", "root")


def spelling_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    dominance: int = DOMINANCE,
) -> DataFrame:
    """One row for each frequent word: word, n, n_near, form, form_n, root.

    `form` is the most frequent near word where it has `dominance` times the word's
    count, `root` the last of the forms that follow one another.
    """
    partitions = work_partitions(docs.sparkSession)
    words = materialize(word_counts(docs, key, text, least_length, least_count), "words")
    near = near_words(visits(words, letter_classes(words)), partitions)
    joined = words.join(near, "word", "left")
    strong = F.col("best_n") >= F.col("n") * dominance
    named = materialize(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(strong, F.col("best")).alias("form"),
            F.when(strong, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    last = roots(named.where(F.col("form").isNotNull()))
    return named.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
