"""Hard, word-order and random negative captions."""

from __future__ import annotations

from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import hkey
from ..functions.text import clean_text
from .ordering import attach, dense_index

# Names of the perturbations, in the order they are tried.
REVERSE, SWAP, TRIGRAMS, SHUFFLE = (
    "reverse_words",
    "swap_adjacent_tokens",
    "shuffle_trigrams_seeded",
    "shuffle_all_words_seeded",
)


PERTURBED = "array<struct<type:string,text:binary>>"
RESULT_TYPE = "array<struct<type:string,text:string>>"


def _shuffled(items: list, seed: bytes, tag: bytes) -> list:
    """Items in the order of an md5 over (seed, tag, position)."""
    prefix, places = seed + tag + b":", range(len(items))
    drawn = [md5(prefix + b"%d" % i).digest() for i in places]
    return [items[i] for i in sorted(places, key=drawn.__getitem__)]


def _perturbed(text: bytes | None, seed: bytes | None) -> list[dict]:
    """The perturbations of a text of words with single spaces, first of each result."""
    w = [x for x in text.split(b" ") if x] if text else []
    if len(w) < 2:
        return []
    prefix = b"" if seed is None else seed + b":"
    swapped = w.copy()
    even = len(w) // 2 * 2
    swapped[0:even:2], swapped[1:even:2] = w[1:even:2], w[0:even:2]
    blocks = [w[i : i + 3] for i in range(0, len(w), 3)]
    made = {
        REVERSE: w[::-1],
        SWAP: swapped,
        TRIGRAMS: [x for block in _shuffled(blocks, prefix, b"trigram") for x in block],
        SHUFFLE: _shuffled(w, prefix, b"word"),
    }
    first: dict[bytes, str] = {}
    for name, found in made.items():
        first.setdefault(b" ".join(found), name)
    return [{"type": name, "text": found} for found, name in first.items()]


def _perturb(texts: pa.Array, seeds: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("type", pa.string()), ("text", pa.binary())]))
    return pa.array([_perturbed(t, s) for t, s in zip(texts.to_pylist(), seeds.to_pylist())], kind)


def word_order_negatives(caption: Column, seed: Column, max_words: int | None = 30) -> Column:
    """array<struct<type,text>> of perturbed captions that differ from the caption and each other.

    The two shuffles are ordered by a hash of `seed`, so a caption always gets
    the same negatives. Fewer than two words give an empty array. Words are hashed and
    sorted in Arrow batches: lambdas over arrays are interpreted, several steps a word.
    """
    perturb = F.arrow_udf(_perturb, PERTURBED)
    made = perturb(clean_text(caption, max_words).cast("binary"), seed.cast("string").cast("binary"))
    return F.filter(made.cast(RESULT_TYPE), lambda e: e["text"] != caption)


def negative_links(samples: DataFrame, order: list[str], seed: int = 42) -> DataFrame:
    """`order` and `other`, a struct of the same columns: the key of a uniformly drawn other sample.

    Positions come from the order of `order` (unique). A draw at or past the
    row's own position moves up by one, so no row draws itself. No rows when there
    are fewer than two samples. Only the key columns are read, sorted and joined.
    """
    placed = dense_index(samples.select(*order), *order, name="__idx")
    n = placed.count()
    draw = F.pmod(hkey(seed, F.col("__idx")), F.lit(max(1, n - 1)))
    left = placed.where(F.lit(n > 1)).withColumn("__other", F.when(draw >= F.col("__idx"), draw + 1).otherwise(draw))
    right = placed.select(F.col("__idx").alias("__other"), F.struct(*order).alias("other"))
    return left.join(right, "__other").select(*order, "other")


def random_negatives(
    samples: DataFrame, order: list[str], caption: str = "positive_caption", seed: int = 42
) -> DataFrame:
    """Add `random_negative_caption`: the caption of a uniformly drawn other sample (`negative_links`).

    Null when there are fewer than two samples. Keys and captions alone are moved to
    find it; the whole rows take part in the last join only.
    """
    links = negative_links(samples, order, seed)
    wanted = links.select(F.struct(*order).alias("__for"), "other.*")
    captions = samples.select(*order, F.col(caption).alias("random_negative_caption"))
    drawn = attach(wanted, captions, order, "inner").select("__for.*", "random_negative_caption")
    return attach(samples, drawn, order)


def explode_negatives(samples: DataFrame) -> DataFrame:
    """One row per (sample, negative) with its index and type (default `hard_negative`)."""
    rest = [c for c in samples.columns if c not in ("negative_captions", "negative_types")]
    return samples.select(
        *rest, "negative_types", F.posexplode("negative_captions").alias("negative_index", "negative_caption")
    ).select(
        *rest,
        "negative_caption",
        "negative_index",
        F.coalesce(F.get("negative_types", F.col("negative_index")), F.lit("hard_negative")).alias("negative_type"),
    )
