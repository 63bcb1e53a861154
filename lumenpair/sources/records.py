"""Keyed-record and manifest scans of JSON, JSONL, CSV, TSV and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import FILE_ORDER, dense_index, file_order
from .documents import json_entries

Schema = T.StructType | str


def _struct(spark: SparkSession, schema: Schema) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _suffix(path: str, fmt: str | None) -> str:
    return (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower().lstrip(".")


def read_records(
    spark: SparkSession,
    path: str | list[str],
    schema: Schema,
    fmt: str | None = None,
    id_field: str = "sample_id",
    unwrap: str | None = None,
    numbered: bool = True,
) -> DataFrame:
    """Records of an annotation file as rows.

    A JSON object gives one row per key, the key filling `id_field` where the
    record has none; members that are no objects go to `value`. A JSON list
    gives its elements, JSONL its non-blank lines, CSV and TSV their rows.
    Fields that hold a string or a list are declared as string and read with
    `string_or_list`. Adds `source_file` and, if `numbered`, `record_index`,
    the row's place in its file.

    JSON documents of any size are read in byte ranges by many tasks (`json_entries`);
    JSONL, CSV and Parquet are split as usual.
    """
    struct = _struct(spark, schema)
    if id_field not in struct.names:
        struct = T.StructType([*struct.fields, T.StructField(id_field, T.StringType())])
    if "value" not in struct.names:
        struct = T.StructType([*struct.fields, T.StructField("value", T.StringType())])
    names = struct.names
    kind = _suffix(path if isinstance(path, str) else path[0], fmt)
    if kind == "json":
        items = json_entries(spark, path, unwrap)
        record, key = F.col("record"), F.col("key")
        is_object = F.ltrim(record).startswith("{")
        parsed = items.select(
            F.from_json(F.when(is_object, record), struct).alias("__r"),
            key.alias("__key"),
            F.when(~is_object, record).alias("__scalar"),
            "source_file",
            F.col("record_index").cast("bigint").alias("record_index"),
        )
        id_type = struct[id_field].dataType
        columns = [F.col(f"__r.{n}").alias(n) for n in names if n not in (id_field, "value")]
        out = parsed.select(
            *columns,
            F.coalesce(F.col(f"__r.{id_field}"), F.col("__key").cast(id_type)).alias(id_field),
            F.coalesce(F.col("__r.value"), F.col("__scalar").cast(struct["value"].dataType)).alias("value"),
            "source_file",
            "record_index",
        ).select(*names, "source_file", "record_index")
        return out if numbered else out.drop("record_index")
    if kind == "jsonl":
        rows = file_order(spark.read.schema(struct).json(path))
    elif kind in ("csv", "tsv"):
        header = spark.read.option("header", True).option("multiLine", False).csv(path, sep="\t" if kind == "tsv" else ",")
        cast = [
            (F.col(f"`{n}`") if n in header.columns else F.lit(None)).cast(struct[n].dataType).alias(n) for n in names
        ]
        rows = file_order(header).select(*cast, *FILE_ORDER)
    elif kind == "parquet":
        rows = file_order(spark.read.schema(struct).parquet(path))
    else:
        raise ValueError(f"Unsupported data file extension: {path}")
    if not numbered:
        return rows.select(*names, "source_file")
    placed = dense_index(rows, *FILE_ORDER, name="__global")
    first = placed.groupBy("source_file").agg(F.min("__global").alias("__first"))
    return placed.join(first, "source_file").select(
        *names, "source_file", (F.col("__global") - F.col("__first")).alias("record_index")
    )


def read_manifest(spark: SparkSession, path: str, fmt: str | None = None, schema: Schema | None = None) -> DataFrame:
    """Manifest rows from CSV, TSV, JSONL, JSON (a list, or a list under `data`) or Parquet.

    The format comes from the argument or the suffix. Without a schema CSV and
    TSV columns are strings and JSON is inferred.
    """
    kind = _suffix(path, fmt)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind in ("csv", "tsv"):
        return reader.option("header", True).csv(path, sep="\t" if kind == "tsv" else ",")
    if kind == "jsonl":
        return reader.json(path)
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "json":
        if schema is not None:
            rows = read_records(spark, path, schema, "json", unwrap="data", numbered=False)
            return rows.select(*_struct(spark, schema).names)
        loaded = spark.read.option("multiLine", True).json(path)
        wrapped = "data" in loaded.columns and isinstance(loaded.schema["data"].dataType, T.ArrayType)
        if wrapped:
            return loaded.select(F.inline("data"))
        return loaded
    raise ValueError(f"Unsupported manifest format: {kind}")


def manifest_samples(
    rows: DataFrame, image: str, caption: str, image_root: str | None = None, id_column: str | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """(image_path, caption, image_id, sample_id) of manifest rows.

    Relative image paths are put under `image_root`. `sample_id` is the id
    column, or the row's position in `order`.
    """
    ref = F.col(image).cast("string")
    path = ref
    if image_root:
        path = F.when(ref.startswith("/"), ref).otherwise(F.concat(F.lit(image_root.rstrip("/") + "/"), ref))
    if id_column and id_column in rows.columns:
        sample_id = F.col(id_column).cast("string")
    else:
        if not order:
            raise ValueError("an order is needed to number rows without an id column")
        rows = dense_index(rows, *order, name="__idx")
        sample_id = F.col("__idx").cast("string")
    return rows.select(
        path.alias("image_path"), F.col(caption).cast("string").alias("caption"), ref.alias("image_id"),
        sample_id.alias("sample_id"),
    )


def synthetic_pairs(spark: SparkSession, n: int) -> DataFrame:
    """n numbered caption rows for dry runs."""
    sid = F.col("id").cast("string")
    return spark.range(n).select(
        F.concat(F.lit("synthetic sample "), sid).alias("caption"), sid.alias("image_id"), sid.alias("sample_id")
    )
