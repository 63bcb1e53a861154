"""Row-level helpers of the annotation loaders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import truthy

IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp")
CATEGORY_NAME = r"^([^_]+)_(.+)"


def has_caption_and_image(members: Column, caption_member: str = "txt") -> Column:
    """Presence filter on a map keyed by member extension."""
    image = F.lit(False)
    for ext in IMAGE_EXTENSIONS:
        image = image | F.map_contains_key(members, F.lit(ext))
    return F.map_contains_key(members, F.lit(caption_member)) & image


def crop_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """struct<l,t,r,b> of a bounding box at least one pixel wide and high; null if a part is missing."""
    box = F.struct(
        x.cast("int").alias("l"),
        y.cast("int").alias("t"),
        (x.cast("int") + F.greatest(F.lit(1), w.cast("int"))).alias("r"),
        (y.cast("int") + F.greatest(F.lit(1), h.cast("int"))).alias("b"),
    )
    return F.when(x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull(), box)


def clamp_box(box: Column, width: Column, height: Column) -> Column:
    """Crop box moved inside the image, still at least one pixel in each direction."""
    left = F.greatest(F.lit(0), F.least(box["l"], width - 1))
    top = F.greatest(F.lit(0), F.least(box["t"], height - 1))
    return F.struct(
        left.alias("l"),
        top.alias("t"),
        F.greatest(left + 1, F.least(box["r"], width)).alias("r"),
        F.greatest(top + 1, F.least(box["b"], height)).alias("b"),
    )


def joined_attributes(attributes: Column) -> Column:
    """Attribute list as one subcategory name; null when empty."""
    return truthy(F.array_join(attributes, "_"))


def category_tail(category: Column) -> Column:
    """The part after the first underscore of a category name; null where there is none."""
    return truthy(F.regexp_extract(category, CATEGORY_NAME, 2))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def file_suffix(path: Column) -> Column:
    """Lower-case suffix with its dot; '' where there is none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def candidate_names(value: Column, prefix: str | None = None) -> Column:
    """Names an image reference may be stored under, most literal first:
    the value, its last part, its digits padded to 12 with `.jpg`, the same with a prefix."""
    last = basename(value)
    digits = F.regexp_replace(last, r"\D", "")
    bare = F.regexp_replace(digits, r"^0+(?=\d)", "")
    number = F.lpad(bare, 12, "0")
    # A number longer than 12 digits is kept whole.
    number = F.when(F.length(bare) > 12, bare).otherwise(number)
    numbered = [F.concat(number, F.lit(".jpg"))]
    if prefix:
        numbered.append(F.concat(F.lit(f"{prefix}_"), number, F.lit(".jpg")))
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(
        F.concat(
            F.array(value, last),
            F.when(digits != "", F.array(*numbered)).otherwise(F.array().cast("array<string>")),
        )
    )


def remaining_fields(df: DataFrame, used: Sequence[str]) -> Column:
    """JSON object of the columns not in `used`; nulls are left out."""
    rest = [c for c in df.columns if c not in set(used)]
    return F.to_json(F.struct(*rest)) if rest else F.lit("{}")


def quarantine(
    df: DataFrame, checks: Sequence[tuple[Column, str | Column]], reason: str = "reason"
) -> tuple[DataFrame, DataFrame]:
    """Split rows by an ordered list of (failing condition, reason).

    Returns rows that fail nothing, and failing rows with their first reason.
    """
    ladder = F.lit(None).cast("string")
    for failing, text in reversed(list(checks)):
        ladder = F.when(failing, text if isinstance(text, Column) else F.lit(text)).otherwise(ladder)
    tagged = df.withColumn(reason, ladder)
    return tagged.where(F.col(reason).isNull()).drop(reason), tagged.where(F.col(reason).isNotNull())


def skip_rows(df: DataFrame, benchmark: str, sample_id: str = "sample_id", source: str = "source_file") -> DataFrame:
    """The four quarantine columns of failing rows."""
    return df.select(
        F.lit(benchmark).alias("benchmark"),
        F.coalesce(F.col(source), F.lit("")).alias("source_file"),
        F.col(sample_id).cast("string").alias("sample_id"),
        F.col("reason"),
    )
