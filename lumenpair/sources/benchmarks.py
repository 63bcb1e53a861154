"""Loaders of the compositional benchmarks into pairwise and 2x2 sample tables.

Each loader returns (samples, skipped): usable rows, and rows set aside with
(benchmark, source_file, sample_id, reason).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import first_alias, truthy
from ..functions.records import (
    category_tail,
    crop_box,
    file_stem,
    joined_attributes,
    quarantine,
    remaining_fields,
    skip_rows,
)
from ..functions.text import clean_text, string_or_list
from ..operators.negatives import word_order_negatives
from ..operators.ordering import dense_index
from ..operators.paths import resolve_paths

# Field names tried in order, file names and reasons.
IMAGE_FIELDS = ("image_path", "image", "filename")
FILE_FIRST = ("filename", "image", "image_path")
ORDER_IMAGE_FIELDS = ("image", "image_path", "filename")
ATTRIBUTION_POSITIVE = ("true_caption", "positive_caption", "caption")
ATTRIBUTION_NEGATIVE = ("false_caption", "negative_caption")
CREPE_POSITIVE = ("caption", "positive_caption", "true_caption")
CREPE_SECOND = ("caption2", "positive_caption_2")
CREPE_NEGATIVE = ("negative_caption", "false_caption")
CREPE_FILES = (
    "add_att.json",
    "add_obj.json",
    "replace_att.json",
    "replace_obj.json",
    "replace_rel.json",
    "swap_att.json",
    "swap_obj.json",
)
CREPE_PP_FILES = CREPE_FILES[2:]
WINOGROUND_FILES = ("annotations.jsonl", "examples.jsonl")
MISSING_FIELDS = "missing image or caption fields"
NO_ORDER_NEGATIVE = "could not generate order negative"

PAIRWISE_FIELDS = (
    "benchmark",
    "sample_id",
    "image_path",
    "positive_caption",
    "negative_captions",
    "category",
    "subcategory",
    "source_file",
    "image_id",
    "crop_box",
    "negative_types",
    "metadata",
)
TWO_BY_TWO_FIELDS = (
    "benchmark",
    "sample_id",
    "image_0_path",
    "image_1_path",
    "caption_0",
    "caption_1",
    "category",
    "source_file",
    "metadata",
)
BOX_TYPE = "struct<l:int,t:int,r:int,b:int>"


def prefer_split(names: Sequence[str], stem_prefix: str, splits: Sequence[str]) -> str | None:
    """The path named `<prefix>_<split>.json` for the first split that has one, else
    the first JSON path whose name starts with the prefix."""
    tail = lambda p: p.rsplit("/", 1)[-1]
    for split in splits:
        exact = sorted(p for p in names if tail(p) == f"{stem_prefix}_{split}.json")
        if exact:
            return exact[0]
    loose = sorted(p for p in names if tail(p).startswith(stem_prefix) and p.endswith(".json"))
    return loose[0] if loose else None


def choose_files(names: Sequence[str], known: Sequence[str], suffix: str = ".json") -> list[str]:
    """The known files among `names`, or all with the suffix if none is known."""
    found = sorted(p for p in names if p.rsplit("/", 1)[-1] in known)
    return found or sorted(p for p in names if p.endswith(suffix))


def _resolve(rows: DataFrame, ref: str, dirs: Sequence[str], listing: DataFrame | None, name: str) -> DataFrame:
    """Add the resolved path; without a listing references are taken as they are."""
    if listing is None:
        return rows.withColumn(name, F.col(ref))
    return resolve_paths(rows, ref, dirs, listing, name)


def _pairwise(
    rows: DataFrame,
    benchmark: str,
    metadata: Column,
    dirs: Sequence[str],
    listing: DataFrame | None,
    once: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Finish rows that have __id, __ref, __pos, __neg, category, subcategory, sample_id and so on.

    `once` picks the row that reports a record several rows stem from.
    """
    resolved = _resolve(rows.withColumn("metadata", metadata), "__ref", dirs, listing, "image_path")
    absent = F.col("__ref").isNull() | F.col("__pos").isNull() | F.col("__neg").isNull()
    good, bad = quarantine(
        resolved,
        [
            (absent, MISSING_FIELDS),
            (F.col("image_path").isNull(), F.concat(F.lit("image not found: "), F.col("__ref"))),
        ],
    )
    samples = good.select(
        F.lit(benchmark).alias("benchmark"),
        "sample_id",
        "image_path",
        clean_text(F.col("__pos")).alias("positive_caption"),
        F.array(clean_text(F.col("__neg"))).alias("negative_captions"),
        "category",
        "subcategory",
        "source_file",
        "image_id",
        "crop_box",
        F.array(F.lit("hard_negative")).alias("negative_types"),
        "metadata",
    )
    return samples, skip_rows(bad if once is None else bad.where(once), benchmark, "__id")


def load_attribution(
    records: DataFrame, category: str, dirs: Sequence[str] = (), listing: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Attribute ('attr') and relation ('rel') pairs with one crop box per record."""
    index = F.col("record_index").cast("string")
    raw_id = F.coalesce(first_alias(records, ("sample_id", "image_id")), F.concat(F.lit(f"{category}_"), index))
    names = set(records.columns)
    box = F.lit(None).cast(BOX_TYPE)
    if {"bbox_x", "bbox_y", "bbox_w", "bbox_h"} <= names:
        box = crop_box(*[F.col(c) for c in ("bbox_x", "bbox_y", "bbox_w", "bbox_h")])
    sub = F.lit(None).cast("string")
    if category == "attr" and "attributes" in names:
        sub = joined_attributes(F.col("attributes"))
    elif category == "rel" and "relation_name" in names:
        sub = truthy(F.col("relation_name"))
    image_id = F.coalesce(F.col("image_id").cast("string"), F.lit("")) if "image_id" in names else F.lit("")
    metadata = remaining_fields(records, ["true_caption", "false_caption", "source_file", "record_index", "value"])
    rows = records.withColumns(
        {
            "__id": raw_id,
            "__ref": first_alias(records, IMAGE_FIELDS),
            "__pos": first_alias(records, ATTRIBUTION_POSITIVE),
            "__neg": first_alias(records, ATTRIBUTION_NEGATIVE),
            "__meta": metadata,
            "__image_id": image_id,
        }
    ).select(
        "__id",
        "__ref",
        "__pos",
        "__neg",
        F.concat_ws("_", F.lit(category), "__id", index).alias("sample_id"),
        F.lit(category).alias("category"),
        sub.alias("subcategory"),
        "source_file",
        F.col("__image_id").alias("image_id"),
        box.alias("crop_box"),
        "__meta",
    )
    return _pairwise(rows, "aro", F.col("__meta"), dirs, listing)


def load_order(
    records: DataFrame,
    subcategory: str,
    seed: int = 42,
    max_words: int = 30,
    dirs: Sequence[str] = (),
    listing: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Word-order pairs: every caption of an image with its perturbed forms as negatives.

    Captions are cut to `max_words` first; that limit belongs to the benchmark.
    """
    captions = string_or_list(first_alias(records, ("caption", "captions")))
    names = set(records.columns)
    ref = first_alias(records, ORDER_IMAGE_FIELDS)
    image_id = F.coalesce(truthy(F.col("image_id").cast("string")), ref) if "image_id" in names else ref
    rows = records.select(
        F.concat(F.lit(f"{subcategory}_"), F.col("record_index").cast("string")).alias("__id"),
        "record_index",
        ref.alias("__ref"),
        F.when(F.size(captions) > 0, captions).alias("__captions"),
        image_id.alias("image_id"),
        "source_file",
    )
    found = _resolve(rows, "__ref", dirs, listing, "image_path")
    good, bad = quarantine(
        found,
        [
            (F.col("__ref").isNull() | F.col("__captions").isNull(), MISSING_FIELDS),
            (F.col("image_path").isNull(), F.concat(F.lit("image not found: "), F.col("__ref"))),
        ],
    )
    each = good.select(
        "*", F.posexplode("__captions").alias("__cap", "__caption")
    ).withColumn("positive_caption", clean_text(F.col("__caption"), max_words))
    negatives = word_order_negatives(
        F.col("positive_caption"), seed + F.col("record_index") * 100 + F.col("__cap"), max_words
    )
    # A generator of one row: a filter on its result is not pushed below it, so the
    # negatives are made once.
    made = each.select("*", F.explode(F.array(negatives)).alias("__made")).withColumn(
        "sample_id", F.concat_ws("_", "__id", F.col("__cap").cast("string"))
    )
    usable, dull = quarantine(made, [(F.size("__made") == 0, NO_ORDER_NEGATIVE)])
    samples = usable.select(
        F.lit("aro").alias("benchmark"),
        "sample_id",
        "image_path",
        "positive_caption",
        F.transform("__made", lambda m: m["text"]).alias("negative_captions"),
        F.lit("order").alias("category"),
        F.lit(subcategory).alias("subcategory"),
        "source_file",
        "image_id",
        F.lit(None).cast(BOX_TYPE).alias("crop_box"),
        F.transform("__made", lambda m: m["type"]).alias("negative_types"),
        F.to_json(F.struct(F.lit("deterministic_token_perturbations").alias("order_negative_generation"))).alias("metadata"),
    )
    return samples, skip_rows(bad, "aro", "__id").unionByName(skip_rows(dull, "aro"))


def _crepe_rows(records: DataFrame) -> tuple[DataFrame, Column]:
    index = F.col("record_index").cast("string")
    tagged = records.withColumns(
        {
            "__id": F.coalesce(first_alias(records, ("sample_id", "id")), index),
            "__ref": first_alias(records, FILE_FIRST),
            "__neg": first_alias(records, CREPE_NEGATIVE),
            "category": file_stem(F.col("source_file")),
        }
    ).withColumns(
        {
            "subcategory": category_tail(F.col("category")),
            "image_id": F.col("__ref"),
            "crop_box": F.lit(None).cast(BOX_TYPE),
        }
    )
    return tagged, F.concat_ws("_", "category", "__id")


def load_sugarcrepe(
    records: DataFrame, dirs: Sequence[str] = (), listing: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """One pair per record; the category is the file's stem."""
    metadata = remaining_fields(records, ["caption", "negative_caption", "source_file", "record_index", "value"])
    tagged, sample_id = _crepe_rows(records.withColumn("__meta", metadata))
    rows = tagged.withColumns({"__pos": first_alias(tagged, CREPE_POSITIVE), "sample_id": sample_id})
    return _pairwise(rows, "sugarcrepe", F.col("__meta"), dirs, listing)


def load_sugarcrepe_pp(
    records: DataFrame, dirs: Sequence[str] = (), listing: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """One pair per positive caption of a record, at most two."""
    used = ["caption", "caption2", "negative_caption", "source_file", "record_index", "value"]
    metadata = remaining_fields(records, used)
    tagged, sample_id = _crepe_rows(records.withColumn("__meta", metadata))
    first, second = first_alias(tagged, CREPE_POSITIVE), first_alias(tagged, CREPE_SECOND)
    variants = F.array(
        F.struct(F.lit("caption").alias("variant"), first.alias("text")),
        F.struct(F.lit("caption2").alias("variant"), second.alias("text")),
    )
    kept = F.filter(variants, lambda v: (v["variant"] == "caption") | v["text"].isNotNull())
    # A record without its first caption is set aside once, whatever the second one is.
    kept = F.when(first.isNull(), F.slice(kept, 1, 1)).otherwise(kept)
    rows = (
        tagged.withColumn("__v", F.explode(kept))
        .withColumn("__pos", F.col("__v.text"))
        .withColumn("sample_id", F.concat_ws("_", sample_id, "__v.variant"))
        .withColumn(
            "__meta",
            F.to_json(
                F.map_concat(
                    F.coalesce(F.from_json("__meta", "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>")),
                    F.create_map(F.lit("positive_variant"), F.col("__v.variant")),
                )
            ),
        )
    )
    first_variant = F.col("__v.variant") == "caption"
    return _pairwise(rows, "sugarcrepe_pp", F.col("__meta"), dirs, listing, first_variant)


def image_bytes(df: DataFrame, column: str) -> Column:
    """Bytes of an image cell: binary, or a struct with `bytes` or `data`."""
    kind = df.schema[column].dataType
    if kind.typeName() == "binary":
        return F.col(column)
    parts = [F.col(f"{column}.{n}") for n in ("bytes", "data") if n in kind.fieldNames()]
    return F.coalesce(*[F.when(F.octet_length(p) > 0, p) for p in parts]) if parts else F.lit(None).cast("binary")


def load_bivlc(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """2x2 samples out of rows with embedded images.

    The image bytes stay binary columns (image_0, image_1); paths name where an
    export would put them. `rows` has source_file and record_index.
    """
    stem = file_stem(F.col("source_file"))
    number = F.lpad(F.col("record_index").cast("string"), 6, "0")
    names = set(rows.columns)
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in names else F.lit("")
    tagged = rows.withColumns(
        {
            "sample_id": F.concat_ws("_", stem, F.col("record_index").cast("string")),
            "__b0": image_bytes(rows, "image"),
            "__b1": image_bytes(rows, "negative_image"),
            "__c0": truthy(F.col("caption")),
            "__c1": truthy(F.col("negative_caption")),
        }
    )
    good, bad = quarantine(
        tagged,
        [
            (F.col("__c0").isNull() | F.col("__c1").isNull(), "missing caption fields"),
            (F.col("__b0").isNull() | F.col("__b1").isNull(), "missing image bytes"),
        ],
    )
    samples = good.select(
        F.lit("bivlc").alias("benchmark"),
        "sample_id",
        F.concat_ws("/", stem, F.concat(number, F.lit("_pos.jpg"))).alias("image_0_path"),
        F.concat_ws("/", stem, F.concat(number, F.lit("_neg.jpg"))).alias("image_1_path"),
        clean_text(F.col("__c0")).alias("caption_0"),
        clean_text(F.col("__c1")).alias("caption_1"),
        field("type").alias("category"),
        "source_file",
        F.to_json(F.struct(field("type").alias("type"), field("subtype").alias("subtype"))).alias("metadata"),
        F.col("__b0").alias("image_0"),
        F.col("__b1").alias("image_1"),
    )
    return samples, skip_rows(bad, "bivlc")


def load_winoground(
    records: DataFrame, dirs: Sequence[str] = (), listing: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """2x2 samples; wide records hold both sides, flat ones come in pairs of rows."""
    if {"caption_0", "caption_1", "image_0_path", "image_1_path"} <= set(records.columns):
        return _winoground_wide(records, dirs, listing)
    return _winoground_flat(records, dirs, listing)


def _winoground_wide(records: DataFrame, dirs, listing) -> tuple[DataFrame, DataFrame]:
    metadata = remaining_fields(
        records, ["caption_0", "caption_1", "image_0_path", "image_1_path", "source_file", "record_index", "value"]
    )
    index = F.col("record_index").cast("string")
    rows = records.select(
        F.coalesce(first_alias(records, ("id", "sample_id")), index).alias("sample_id"),
        F.col("image_0_path").alias("__r0"),
        F.col("image_1_path").alias("__r1"),
        "caption_0",
        "caption_1",
        F.coalesce(first_alias(records, ("collapsed_tag", "tag")), F.lit("")).alias("category"),
        "source_file",
        metadata.alias("metadata"),
    )
    return _winoground(rows, dirs, listing, "image_0 or image_1 not found")


def _winoground_flat(records: DataFrame, dirs, listing) -> tuple[DataFrame, DataFrame]:
    """Rows 2k and 2k+1 in file order: captions of the first, images of both; an odd last row is left out."""
    pair = F.floor(F.col("record_index") / 2)
    first = F.col("record_index") % 2 == 0
    text = lambda c: F.coalesce(F.col(c), F.lit("None"))
    rows = (
        records.groupBy("source_file", pair.alias("__pair"))
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.max(F.when(first, F.col("image"))).alias("__r0"),
            F.max(F.when(~first, F.col("image"))).alias("__r1"),
            F.max(F.when(first, text("true_caption"))).alias("caption_0"),
            F.max(F.when(first, text("false_caption"))).alias("caption_1"),
        )
        .where(F.col("__n") == 2)
        .select(
            F.col("__pair").cast("string").alias("sample_id"),
            "__r0",
            "__r1",
            "caption_0",
            "caption_1",
            F.lit(None).cast("string").alias("category"),
            "source_file",
            F.to_json(F.struct(F.lit(True).alias("flattened_source"))).alias("metadata"),
        )
    )
    return _winoground(rows, dirs, listing, "flattened image pair not found")


def _winoground(rows: DataFrame, dirs, listing, reason: str) -> tuple[DataFrame, DataFrame]:
    found = _resolve(_resolve(rows, "__r0", dirs, listing, "image_0_path"), "__r1", dirs, listing, "image_1_path")
    good, bad = quarantine(found, [(F.col("image_0_path").isNull() | F.col("image_1_path").isNull(), reason)])
    samples = good.select(
        F.lit("winoground").alias("benchmark"),
        "sample_id",
        "image_0_path",
        "image_1_path",
        clean_text(F.col("caption_0")).alias("caption_0"),
        clean_text(F.col("caption_1")).alias("caption_1"),
        "category",
        "source_file",
        "metadata",
    )
    return samples, skip_rows(bad, "winoground")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def number_rows(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Add `record_index` to rows that come from a table."""
    return dense_index(rows, *order, name="record_index")

