"""Retrieval data sets: images and captions out of nested annotation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import caption_text, strip
from ..operators.ordering import dense_index
from .documents import json_entries
from .records import read_records

# Fixed value: folder of an image whose record names none.
DEFAULT_FOLDER = "val2014"
KARPATHY = (
    "filepath string, filename string, split string, "
    "sentences array<struct<raw:string,tokens:array<string>>>"
)


def _sets(images: DataFrame, sentences: str) -> tuple[DataFrame, DataFrame]:
    """images (image_idx, image_path, cue) and captions (text_idx, image_idx, caption)."""
    texts = F.transform(F.coalesce(sentences, F.array()), lambda s: caption_text(s["raw"], s["tokens"]))
    held = images.withColumn("__texts", texts)
    out = held.select("image_idx", "image_path", F.coalesce(F.get("__texts", F.lit(0)), F.lit("")).alias("cue"))
    captions = held.select("image_idx", F.posexplode("__texts").alias("__pos", "caption")).where(F.col("caption") != "")
    return out, dense_index(captions, "image_idx", "__pos", name="text_idx").select("text_idx", "image_idx", "caption")


def read_karpathy(
    spark: SparkSession,
    path: str,
    image_root: str,
    split: str | None = None,
    limit_images: int | None = None,
    folders: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Images and captions of a file of image records with nested sentences.

    `split` keeps one split; the limit counts images of that split in file
    order. With `folders` the record's folder is part of the path. The cue is
    the first sentence; blank sentences give no caption.
    """
    rows = read_records(spark, path, KARPATHY, "json", unwrap="images")
    if split is not None:
        rows = rows.where(F.col("split") == split)
    indexed = dense_index(rows, "source_file", "record_index", name="image_idx")
    if limit_images and limit_images > 0:
        indexed = indexed.where(F.col("image_idx") < limit_images)
    parts = [F.lit(image_root.rstrip("/"))]
    if folders:
        parts.append(F.coalesce(F.nullif("filepath", F.lit("")), F.lit(DEFAULT_FOLDER)))
    placed = indexed.withColumn("image_path", F.concat_ws("/", *parts, "filename"))
    return _sets(placed, "sentences")


def read_coco_captions(
    spark: SparkSession, path: str, image_root: str, limit_images: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Images and captions of a file with separate `images` and `annotations` lists.

    Images go by (file_name, id); the limit applies before images without a
    caption are dropped. Captions keep the order of the annotations; the first
    one is the cue.
    """
    image = F.from_json("record", "id bigint, file_name string")
    note = F.from_json("record", "image_id bigint, caption string")
    images = json_entries(spark, path, "images").where(F.col("key").isNull()).select(image.alias("i")).select("i.id", "i.file_name")
    listed = json_entries(spark, path, "annotations").where(F.col("key").isNull())
    notes = listed.select(F.col("record_index").alias("pos"), note.alias("a")).select(
        "pos", F.col("a.image_id").alias("id"), strip(F.coalesce("a.caption", F.lit(""))).alias("caption")
    )
    return join_annotations(images, notes, image_root, limit_images)


def join_annotations(
    images: DataFrame, notes: DataFrame, image_root: str, limit_images: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Images (id, file_name) joined with annotations (pos, id, caption), order kept."""
    selected = images.where(F.col("id").isNotNull())
    if limit_images and limit_images > 0:
        selected = selected.orderBy("file_name", "id").limit(limit_images)
    joined = selected.join(notes.where(F.col("caption") != ""), "id")
    cues = joined.groupBy("id", "file_name").agg(F.min_by("caption", "pos").alias("cue"))
    placed = dense_index(cues, "file_name", "id", name="image_idx")
    captions = dense_index(
        joined.select("id", "pos", "caption").join(placed.select("id", "image_idx"), "id"),
        "image_idx",
        "pos",
        name="text_idx",
    )
    paths = F.concat(F.lit(image_root.rstrip("/") + "/"), F.col("file_name"))
    return placed.select("image_idx", paths.alias("image_path"), "cue"), captions.select("text_idx", "image_idx", "caption")
