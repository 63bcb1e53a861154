"""Substring dedup by hashing sentences and lines.

A unit is a line or a sentence of it (a sentence ends at `.`, `!` or `?` before
a blank), so that a passage set into running text is found as well as one with
lines of its own. Units are compared lower-cased with white space as one space, by
a 128-bit digest. Of each digest the occurrence with the lowest (rank, place)
stays. The others go where they stand together: in runs of neighbouring repeated
units of at least `min_words` words, so that a short sentence which two texts
share by chance is left alone. With `whole_lines` that rule holds for sentences
inside running text only: a later occurrence of a whole line (of one sentence or
several) goes whatever its length, and so does a paragraph, line by line.

Digests are counted with a combine on the map side and joined back by equality,
a join that adaptive execution splits; no occurrence list of a digest meets in
one task.

Defined results: null, empty and blank texts have no units. Repeated rows with
one id and text count as one document; an id with different texts, null
included, is a document for each, ranked by a hash of the text after the id (a
null id first). An empty table gives an empty result.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .frames import whole_text

MIN_WORDS = 24


def units_of(text: str) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each unit with words, in code points."""
    # A blank after a closing mark becomes a line end; places do not change.
    text = text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n")
    start = 0
    for unit in text.split("\n"):
        words = unit.split()
        if words:
            yield start, start + len(unit), len(words), _digest(words)
        start += len(unit) + 1


def _digest(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words).lower().encode("utf-8", "surrogatepass"))


def units_and_lines(text: str) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(number, units, start, end, words, digest) of each unit and, before its units, of each line of several.

    `units` is the number of units of a whole line, 0 for a sentence beside others.
    """
    found, i, start = list(units_of(text)), 0, 0
    for line in text.split("\n"):
        start += len(line) + 1
        begin = i
        while i < len(found) and found[i][0] < start:
            i += 1
        if i - begin > 1:
            words = line.split()
            yield begin, i - begin, found[begin][0], found[i - 1][1], len(words), _digest(words)
        for k in range(begin, i):
            yield k, int(i - begin == 1), *found[k]


def text_units(docs: DataFrame, key: str = "doc_id", text: str = "text", whole_lines: bool = False) -> DataFrame:
    """One row for each unit: `__id`, `__hash` (of the text), `__i` (number in the text), `__units`, `__at` (start), `__end`, `__words`, `__digest`.

    With `whole_lines` as in `units_and_lines`; else `__units` is 0.
    """
    rows = docs.select(F.col(key).alias("__id"), F.xxhash64(whole_text(text)).alias("__hash"), whole_text(text).alias("__text"))
    kind = dict(rows.dtypes)["__id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            # In steps of some megabytes, as a unit row is larger than a short unit.
            for part in _steps(texts):
                if whole_lines:
                    found = [list(units_and_lines(t)) for t in texts[part]]
                else:
                    found = [[(i, 0, *u) for i, u in enumerate(units_of(t))] for t in texts[part]]
                rows_of = np.repeat(np.arange(part.start, part.stop), [len(f) for f in found])
                flat = [u for f in found for u in f]
                if flat:
                    *places, digest = zip(*flat)
                    at = pa.array(rows_of)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("__id").take(at),
                            batch.column("__hash").take(at),
                            *[pa.array(p, pa.int32()) for p in places],
                            pa.array(digest, pa.binary()),
                        ],
                        names=["__id", "__hash", "__i", "__units", "__at", "__end", "__words", "__digest"],
                    )

    places = "__i int, __units int, __at int, __end int, __words int"
    return rows.mapInArrow(run, f"__id {kind}, __hash bigint, {places}, __digest binary")


def _steps(texts: list[str], size: int = 4 << 20) -> Iterator[slice]:
    begin, total = 0, 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= size:
            yield slice(begin, i + 1)
            begin, total = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def repeated_units(
    docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text", whole_lines: bool = False
) -> DataFrame:
    """The units to remove: key, text_hash, start_char, end_char, words, first_<key>, first_char.

    The last two name the occurrence that stays. A line of several units that
    goes as a whole is one row.
    """
    units = text_units(docs, key, text, whole_lines)
    first = (
        units.groupBy("__digest")
        .agg(F.min(F.struct("__id", "__hash", "__at")).alias("__first"), F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > 1)
        .select("__digest", *[F.col(f"__first.__{x}").alias(f"__f{x}") for x in ("id", "hash", "at")])
    )
    # Stored, so that both sides of the join are plain exchanges, which adaptive execution splits at hot digests.
    first = materialize(first, "repeats")
    itself = F.col("__id").eqNullSafe(F.col("__fid")) & (F.col("__hash") == F.col("__fhash")) & (F.col("__at") == F.col("__fat"))
    later = units.join(first, "__digest").where(~itself).drop("__digest", "__fhash")
    # Neighbouring units of a document meet after the join; a document's units are as many as its text has.
    # A line comes before its units. Repeated rows lie side by side.
    ordered = Window.partitionBy("__id", "__hash").orderBy("__at", F.desc("__units"))
    again = (F.col("__at") == F.lag("__at").over(ordered)) & (F.col("__units") == F.lag("__units").over(ordered))
    rows = later.withColumn("__again", F.coalesce(again, F.lit(False))).where(~F.col("__again"))
    several = F.col("__units") > 1
    opens = (F.col("__i") > F.lag("__i").over(ordered) + 1).cast("int")
    until = F.max(F.when(several, F.col("__i") + F.col("__units"))).over(ordered)
    runs = rows.withColumns({"__opens": F.coalesce(opens, F.lit(0)), "__until": F.coalesce(until, F.lit(0))})
    runs = runs.withColumn("__run", F.sum("__opens").over(ordered))
    total = F.sum(F.when(several, 0).otherwise(F.col("__words"))).over(Window.partitionBy("__id", "__hash", "__run"))
    return (
        runs.withColumn("__total", total)
        .where(several | (F.col("__i") >= F.col("__until")) & ((F.col("__units") == 1) | (F.col("__total") >= min_words)))
        .select(
            F.col("__id").alias(key),
            F.col("__hash").alias("text_hash"),
            F.col("__at").cast("bigint").alias("start_char"),
            F.col("__end").cast("bigint").alias("end_char"),
            F.col("__words").alias("words"),
            F.col("__fid").alias(f"first_{key}"),
            F.col("__fat").cast("bigint").alias("first_char"),
        )
    )


WITHOUT = "struct<text: string, kept: array<struct<start_char: bigint, end_char: bigint>>>"


def _without(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out: list[tuple[str, list[dict]]] = []
    for text, gone in zip(texts, spans):
        kept, at = [], 0
        for span in sorted(gone if gone is not None else [], key=lambda s: s["start_char"]):
            # The blank or line end after a removed unit goes with it.
            if span["start_char"] > at:
                kept.append({"start_char": at, "end_char": span["start_char"]})
            at = min(len(text), span["end_char"] + 1)
        if at < len(text):
            kept.append({"start_char": at, "end_char": len(text)})
        out.append(("".join(text[k["start_char"] : k["end_char"]] for k in kept), kept))
    return pd.DataFrame(out, columns=["text", "kept"])


def _cut(docs: DataFrame, removed: DataFrame, key: str, text: str) -> DataFrame:
    """Each document whole in `__row`, its removed units in `__gone`, and `__out`: what is left."""
    rows = docs.select(
        F.col(key).alias("__id"), F.xxhash64(whole_text(text)).alias("__hash"), whole_text(text).alias("__text"), F.struct(*[docs[c] for c in docs.columns]).alias("__row")
    )
    place = F.struct("start_char", "end_char", f"first_{key}", "first_char")
    # A row repeated with one id and text has its units once.
    spans = removed.groupBy(F.col(key).alias("__of"), F.col("text_hash").alias("__of_hash")).agg(
        F.array_sort(F.collect_list(place)).alias("__gone")
    )
    joined = rows.join(spans, F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__hash") == F.col("__of_hash")), "left")
    without = F.pandas_udf(_without, WITHOUT)
    return joined.select("__id", "__row", "__gone", without(F.col("__text"), F.col("__gone")).alias("__out"))


def remove_repeats(docs: DataFrame, removed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without the removed units; `kept_spans` are the original places of what stays, in order."""
    columns = [F.col("__out.text").alias(c) if c == text else F.col("__row")[c].alias(c) for c in docs.columns]
    return _cut(docs, removed, key, text).select(*columns, F.col("__out.kept").alias("kept_spans"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, text (what is left), n_chars, kept_spans, removed_spans.

    Later whole lines go whatever their length. Each removed span names the
    occurrence that stays.
    """
    docs = docs.select(key, text)
    removed = repeated_units(docs, min_words, key, text, whole_lines=True)
    return _cut(docs, removed, key, text).select(
        F.col("__id").alias(key),
        F.col("__out.text").alias(text),
        F.length("__out.text").cast("bigint").alias("n_chars"),
        F.col("__out.kept").alias("kept_spans"),
        F.coalesce("__gone", F.array()).alias("removed_spans"),
    )
