"""Pair scoring: feature joins, margins, 2x2 scores and the encoder / scorer surfaces."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.records import quarantine
from ..functions.vectors import dot, l2_normalize, score_block
from ..session import materialize, work_partitions

# Fixed value: keeps the sensitivity ratio finite.
SSR_EPSILON = 1e-6

# A scorer or encoder is built once per task and then called per batch.
Encoder = Callable[[list], np.ndarray]
PairScorer = Callable[[pd.DataFrame], np.ndarray]


def image_key(path: Column, crop: Column | None = None) -> Column:
    """Key of an encoded image: its path and, where it is cropped, the crop."""
    if crop is None:
        return path
    return F.concat(path, F.coalesce(F.concat(F.lit("#"), F.to_json(crop)), F.lit("")))


def score_specs(
    specs: DataFrame, images: DataFrame, texts: DataFrame, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Add score_pos, score_neg and score_random_neg to pairs; returns (scored, skipped).

    `specs` has image_key, positive_caption, negative_caption and
    random_negative_caption and is unique on `keys`; `images` is (image_key,
    feature), `texts` is (caption, feature), both unique. All three may have a
    model_name, so that several models are scored in one job. Pairs lacking the
    image, positive or negative feature are skipped with a reason; a missing
    random feature leaves its score null.

    Features are normalised before the joins, once each. A pair becomes one
    narrow row per caption, so each side is joined once and a row never
    carries more than two vectors; the scores are then put side by side.
    """
    by = ["model_name"] if "model_name" in specs.columns else []
    roles = {"pos": "positive_caption", "neg": "negative_caption", "rand": "random_negative_caption"}
    asked = F.array(*[F.struct(F.lit(r).alias("__role"), F.col(c).alias("caption")) for r, c in roles.items()])
    narrow = specs.select(*by, *keys, "image_key", F.inline(asked)).where(F.col("caption").isNotNull())
    unit = lambda df, key, name: df.select(*by, key, l2_normalize(F.col("feature")).alias(name))
    scored = (
        narrow.join(unit(images, "image_key", "__i"), [*by, "image_key"], "left")
        .join(unit(texts, "caption", "__t"), [*by, "caption"], "left")
        .select(*by, *keys, "__role", F.col("__i").isNotNull().alias("__image"), dot(F.col("__i"), F.col("__t")).alias("__s"))
    )
    at = lambda role: F.max(F.when(F.col("__role") == role, F.col("__s")))
    beside = scored.groupBy(*by, *keys).agg(
        F.max("__image").alias("__image"),
        at("pos").alias("score_pos"),
        at("neg").alias("score_neg"),
        at("rand").alias("score_random_neg"),
    )
    # Stored once, as both sides are read.
    good, bad = quarantine(
        materialize(specs.join(beside, [*by, *keys], "left"), "pairs"),
        [
            (~F.coalesce("__image", F.lit(False)), "image has no feature"),
            (F.col("score_pos").isNull(), "positive caption has no feature"),
            (F.col("score_neg").isNull(), "negative caption has no feature"),
        ],
    )
    return good.drop("__image"), bad.drop("__image", "score_pos", "score_neg", "score_random_neg")


def with_margins(scored: DataFrame) -> DataFrame:
    """Add hard_margin, random_margin, ssr and correct; a tie is not correct."""
    return scored.withColumns(
        {
            "hard_margin": F.col("score_pos") - F.col("score_neg"),
            "random_margin": F.col("score_pos") - F.col("score_random_neg"),
            "correct": (F.col("score_pos") > F.col("score_neg")).cast("int"),
        }
    ).withColumn("ssr", F.col("hard_margin") / (F.col("random_margin") + SSR_EPSILON))


def with_2x2_scores(df: DataFrame) -> DataFrame:
    """Add margins and text, image and group scores from S00, S01, S10, S11."""
    s00, s01, s10, s11 = (F.col(c) for c in ("S00", "S01", "S10", "S11"))
    margins = {
        "text_margin_0": s00 - s01,
        "text_margin_1": s11 - s10,
        "image_margin_0": s00 - s10,
        "image_margin_1": s11 - s01,
    }
    both = lambda a, b: ((F.col(a) > 0) & (F.col(b) > 0)).cast("int")
    return (
        df.withColumns(margins)
        .withColumns(
            {
                "text_score": both("text_margin_0", "text_margin_1"),
                "image_score": both("image_margin_0", "image_margin_1"),
                "group_min_margin": F.least(*margins),
            }
        )
        .withColumn("group_score", F.col("text_score") * F.col("image_score"))
    )


def score_2x2(df: DataFrame, image_0: str, image_1: str, text_0: str, text_1: str) -> DataFrame:
    """2x2 scores of four vector columns; the vectors are dropped."""
    vectors = [image_0, image_1, text_0, text_1]
    units = df.withColumns({v: l2_normalize(F.col(v)) for v in vectors})
    block = units.withColumn("__s", score_block(F.array(image_0, image_1), F.array(text_0, text_1)))
    cell = lambda i, j: F.get(F.get("__s", F.lit(i)), F.lit(j))
    named = block.withColumns({f"S{i}{j}": cell(i, j) for i in (0, 1) for j in (0, 1)})
    return with_2x2_scores(named.drop("__s", *vectors))


class HashingEncoder:
    """Bag of hashed words: token counts in `dim` buckets. A stand-in for a real model in tests."""

    def __init__(self, dim: int = 32) -> None:
        self.dim = dim
        self._bucket: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            for token in text.split():
                bucket = self._bucket.get(token)
                if bucket is None:
                    bucket = int(hashlib.md5(token.encode()).hexdigest()[:15], 16) % self.dim
                    if len(self._bucket) < 100_000:
                        self._bucket[token] = bucket
                out[row, bucket] += 1.0
        return out


def encode(
    df: DataFrame, value: str, factory: Callable[[], Encoder], batch_size: int = 256
) -> tuple[DataFrame, DataFrame]:
    """Encode each distinct non-null `value` once; returns (features, failures).

    features is (value column, feature array<double>), failures adds `reason`.
    A failing batch is tried row by row, so only the bad rows are set aside.
    Join the features back on `value` for the rows of `df`.
    """
    schema = T.StructType(
        [
            df.schema[value],
            T.StructField("feature", T.ArrayType(T.DoubleType())),
            T.StructField("reason", T.StringType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = factory()
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                values = pdf[value].iloc[start : start + batch_size].tolist()
                rows: list[tuple] = []
                try:
                    rows = [(v, f, None) for v, f in zip(values, encoder(values), strict=True)]
                except Exception:
                    for v in values:
                        try:
                            rows.append((v, encoder([v])[0], None))
                        except Exception as exc:
                            rows.append((v, None, f"encoding failed: {exc!r}"))
                yield pd.DataFrame(rows, columns=[value, "feature", "reason"])

    distinct = df.select(value).where(F.col(value).isNotNull()).distinct()
    # Distinct first, so a value held by many rows is shuffled once per task; then even out.
    encoded = distinct.repartition(work_partitions(df.sparkSession), value).mapInPandas(run, schema)
    # Stored once, so that the model does not run again when failures are read as well.
    encoded = materialize(encoded, "encoded")
    return (
        encoded.where(F.col("reason").isNull()).drop("reason"),
        encoded.where(F.col("reason").isNotNull()).select(value, "reason"),
    )


def encode_rows(df: DataFrame, key: str, value: str, factory: Callable[[], Encoder], batch_size: int = 256) -> DataFrame:
    """(key, feature) for every row, each distinct value encoded once and joined back."""
    features, _ = encode(df, value, factory, batch_size)
    return df.select(key, value).join(features, value).select(key, "feature")


def score_pairs(
    df: DataFrame, keys: Sequence[str], inputs: Sequence[str], factory: Callable[[], PairScorer], name: str = "score"
) -> DataFrame:
    """Score each row by a user-supplied function of its `inputs` columns.

    The scorer is built once per task and sees one pandas batch at a time; use
    it for scores that depend on the pair and are no plain dot product.
    """
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for pdf in batches:
            yield pdf[list(keys)].assign(**{name: np.asarray(scorer(pdf[list(inputs)]), dtype=float)})

    return df.select(*keys, *inputs).mapInPandas(run, schema)


class CosineScorer:
    """Pair scorer of two vector columns; the simplest user of `score_pairs`."""

    def __init__(self, left: str, right: str) -> None:
        self.left, self.right = left, right

    def __call__(self, pdf: pd.DataFrame) -> np.ndarray:
        a = np.stack(pdf[self.left].to_numpy()).astype(float)
        b = np.stack(pdf[self.right].to_numpy()).astype(float)
        scale = np.maximum(np.linalg.norm(a, axis=1), 1e-12) * np.maximum(np.linalg.norm(b, axis=1), 1e-12)
        return np.einsum("ij,ij->i", a, b) / scale
