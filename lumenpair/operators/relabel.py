"""Caption relabelling: a key to caption table and lookups against it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_non_blank, first_non_blank, strip

# Order in which caption columns are tried.
CAPTION_COLUMNS = (
    "longSV_captions",
    "longIB_captions",
    "longLLA_captions",
    "shortSV_captions",
    "shortIB_captions",
    "shortLLA_captions",
    "raw_caption",
)
POLICIES = ("fallback", "skip", "error")


class MissingCaption(ValueError):
    """Raised by the `error` policy when a sample has no relabelled caption."""


def caption_columns(preferred: str | Sequence[str] | None, fallback: Sequence[str] = CAPTION_COLUMNS) -> list[str]:
    """Preferred columns (a list, or names separated by commas), then the fallback ones not yet named."""
    if isinstance(preferred, str):
        preferred = preferred.split(",")
    names = [n.strip() for n in preferred or [] if n.strip()]
    return names + [n for n in fallback if n not in names]


def build_caption_table(
    rows: DataFrame, key: str = "Image Path", columns: Sequence[str] = CAPTION_COLUMNS, order: str = "seq"
) -> DataFrame:
    """(lookup_key, caption), unique on the key; of equal keys the last row in `order` wins.

    `max_by` combines on the map side, so a key repeated in a third of the
    rows costs one partial result per task.
    """
    if key not in rows.columns:
        raise ValueError(f"Caption relabel key column not found: {key}")
    # The filter has a cheap form of its own, so the caption is trimmed once.
    usable = rows.where(any_non_blank(rows, columns)).select(
        strip(F.col(f"`{key}`").cast("string")).alias("lookup_key"),
        first_non_blank(rows, columns).alias("caption"),
        F.col(order).alias("__order"),
    ).where(F.col("lookup_key") != "")
    return usable.groupBy("lookup_key").agg(F.max_by("caption", "__order").alias("caption"))


def relabel(
    samples: DataFrame,
    captions: DataFrame,
    sample_key: str = "url",
    caption: str = "caption",
    policy: str = "fallback",
) -> DataFrame:
    """Replace `caption` by the looked-up one.

    Samples without a match keep their caption (`fallback`), leave the flow
    (`skip`), or fail the job when it runs (`error`). Samples with a null or
    empty key are spread over the join instead of meeting in one partition.
    """
    if policy not in POLICIES:
        raise ValueError(f"Unsupported caption relabel missing policy: {policy}")
    key = F.col(sample_key)
    blank = key.isNull() | (key == "")
    spread = F.concat(F.lit("\x00"), (F.monotonically_increasing_id() % 4096).cast("string"))
    left = samples.withColumn("__key", F.when(blank, spread).otherwise(key))
    right = captions.select(F.col("lookup_key").alias("__key"), F.col("caption").alias("__new"))
    joined = left.join(right, "__key", "inner" if policy == "skip" else "left")
    if policy == "error":
        message = F.concat(F.lit("no relabelled caption for key "), F.coalesce(key, F.lit("<null>")))
        new = F.when(F.col("__new").isNull(), F.raise_error(message).cast("string")).otherwise(F.col("__new"))
    else:
        new = F.coalesce("__new", caption)
    return joined.select(*[new.alias(caption) if c == caption else F.col(c) for c in samples.columns])
