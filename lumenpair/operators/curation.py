"""Filters and caption choice for shard samples, and the offline curation job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import let
from ..functions.records import has_caption_and_image
from ..functions.text import (
    TOP_LEVEL_CAPTIONS,
    caption_pool,
    has_json_sentence,
    json_list,
    json_sentences,
    split_sentences,
    strip,
)
from .sampling import epoch_shuffle, sample_subcaptions

# Fields of the metadata member.
METADATA = (
    "captions map<string,string>, default_caption_key string, caption string, "
    + ", ".join(f"{name} string" for name in TOP_LEVEL_CAPTIONS)
)
SUCCESS_KEY = "longSV"


def relabel_succeeded(metadata: Column, text: Column, key: str = SUCCESS_KEY, strict: bool = True) -> Column:
    """Whether a sample carries a usable caption under `key`.

    The caption must split to at least one sentence, the default key must be
    unset or equal to `key`, and, if `strict`, a string caption must equal the
    text member, both trimmed. A list is not compared.
    """
    expected = F.element_at(metadata["captions"], F.lit(key))
    usable = has_json_sentence(expected)
    default = metadata["default_caption_key"]
    passes = usable & (default.isNull() | (default == key))
    if strict:
        same = F.coalesce(strip(text) == strip(expected), F.lit(False))
        passes = passes & (json_list(expected).isNotNull() | same)
    return passes


def caption_sentences(
    metadata: Column | None, text: Column | None = None, raw_text: Column | None = None, key: str = SUCCESS_KEY
) -> Column:
    """Sentences to draw sub-captions from.

    With metadata: its caption pool, else its `caption`, else the raw text.
    Without: the text itself, else the raw text. The pool as a whole is
    filtered once more: a group without any valid sentence gives way to others.
    """
    raw = split_sentences(strip(raw_text) if raw_text is not None else F.lit(""))
    if metadata is None:
        return raw if text is None else F.when(text.isNotNull(), split_sentences(text)).otherwise(raw)
    pool = caption_pool(metadata["captions"], {n: metadata[n] for n in TOP_LEVEL_CAPTIONS}, key, valid_first=True)
    fallback = F.when(metadata["caption"].isNotNull(), json_sentences(metadata["caption"])).otherwise(raw)
    return let(pool, lambda p: F.when(F.size(p) > 0, p).otherwise(fallback))


def relabelled_samples(samples: DataFrame, key: str = SUCCESS_KEY, strict: bool = True) -> DataFrame:
    """(shard, key, sentences) of shard samples that pass the presence and relabel filters.

    `samples` has members map<string,binary>.
    """
    member = lambda n: F.element_at("members", F.lit(n)).cast("string")
    present = samples.where(has_caption_and_image(F.col("members"), "json"))
    text = member("txt")
    # Filter and projection share one parse: a sample that fails explodes to nothing.
    chosen = let(
        F.from_json(member("json"), METADATA),
        lambda m: F.when(
            relabel_succeeded(m, text, key, strict), F.array(caption_sentences(m, raw_text=text, key=key))
        ),
    )
    return present.select("shard", "key", F.explode(chosen).alias("sentences"))


def plain_samples(samples: DataFrame) -> DataFrame:
    """(shard, key, sentences) of shard samples with a text and an image member."""
    text = F.element_at("members", F.lit("txt")).cast("string")
    present = samples.where(has_caption_and_image(F.col("members")))
    return present.select("shard", "key", caption_sentences(None, text=text).alias("sentences"))


def curate(
    samples: DataFrame, k: int = 4, max_merged: int = 3, seed: int = 42, epoch: int = 0, relabelled: bool = True
) -> DataFrame:
    """(key, draw, subcaption) of an epoch in shuffled order, ready to be written."""
    chosen = relabelled_samples(samples) if relabelled else plain_samples(samples)
    drawn = sample_subcaptions(chosen, "key", "sentences", k, max_merged, seed, epoch)
    return epoch_shuffle(drawn, "key", seed, epoch)

