"""Roles the given tables play in the registered queries.

Every row of a table takes part: image, caption or both.
"""

from __future__ import annotations

import io
import tarfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from ..operators.negatives import explode_negatives, random_negatives
from ..operators.ordering import attach, dense_index
from ..operators.scoring import score_2x2, score_specs, with_margins
from ..session import materialize, scratch_path, work_partitions
from ..sources.files import resolve
from .registry import Tables

MODELS = {"m64": 64, "m32": 32}
SAMPLES_PER_SHARD = 256
_stored: dict[tuple[str, str, str], tuple] = {}


def once(t: Tables, label: str, build) -> DataFrame:
    """A derived table written once per application and folder."""
    key = (t.spark.sparkContext.applicationId, t.folder, label)
    if key not in _stored:
        _stored[key] = (materialize(build(), label),)
    return _stored[key][0]


def images(t: Tables) -> DataFrame:
    """Every sixth vector is an image."""
    return t.embeddings.where(F.col("vec_id") % 6 == 0).select(
        F.col("vec_id").alias("image_id"), F.col("embedding").alias("feature"), "label"
    )


def captions(t: Tables) -> DataFrame:
    """The five vectors after an image are its captions."""
    return t.embeddings.where(F.col("vec_id") % 6 != 0).select(
        F.col("vec_id").alias("text_id"),
        (F.col("vec_id") - F.col("vec_id") % 6).alias("image_id"),
        F.col("embedding").alias("feature"),
        "label",
    )


def pairs(t: Tables) -> DataFrame:
    """Vectors 2k and 2k + 1 are an image and its text."""
    half = F.floor(F.col("vec_id") / 2)
    even = F.col("vec_id") % 2 == 0
    return (
        t.embeddings.groupBy(half.alias("pair_id"))
        .agg(F.max(F.when(even, F.col("embedding"))).alias("image"), F.max(F.when(~even, F.col("embedding"))).alias("text"))
        .where(F.col("image").isNotNull() & F.col("text").isNotNull())
    )


def per_model(features: DataFrame, key: str) -> DataFrame:
    """(model_name, key, feature): a model sees the leading dimensions of each vector."""
    views = [F.struct(F.lit(n).alias("model_name"), F.slice("feature", 1, d).alias("feature")) for n, d in MODELS.items()]
    return features.select(key, F.inline(F.array(*views)))


def image_features(t: Tables) -> DataFrame:
    return per_model(images(t).select(F.col("image_id").cast("string").alias("image_key"), "feature"), "image_key")


def text_features(t: Tables) -> DataFrame:
    return per_model(captions(t).select(F.col("text_id").cast("string").alias("caption"), "feature"), "caption")


def pairwise_samples(t: Tables) -> DataFrame:
    """One sample per caption: its image, itself as positive, the captions at the same
    place of the next two images as negatives."""
    c = captions(t)
    group = F.floor(F.col("image_id") / 6) % 3
    benchmark = F.when(group == 0, "aro").when(group == 1, "sugarcrepe").otherwise("sugarcrepe_pp")
    by_label = F.col("label") % 3
    attribution = F.when(by_label == 0, "attr").when(by_label == 1, "rel").otherwise("order")
    kind = F.when(by_label == 0, "swap_att").when(by_label == 1, "add_obj").otherwise("replace_rel")
    ref = lambda offset: (F.col("text_id") + offset).cast("string")
    return c.select(
        F.col("text_id").alias("sample_no"),
        ref(0).alias("sample_id"),
        benchmark.alias("benchmark"),
        F.when(group == 0, attribution).otherwise(kind).alias("category"),
        F.when(F.col("label") % 4 != 0, F.concat(F.lit("sub"), (F.col("label") % 4).cast("string"))).alias("subcategory"),
        F.col("image_id").cast("string").alias("image_key"),
        ref(0).alias("positive_caption"),
        F.array(ref(6), ref(12)).alias("negative_captions"),
        F.array(F.lit("next_image")).alias("negative_types"),
    )


def pair_specs(t: Tables) -> DataFrame:
    """One row per sample and negative, with a random negative."""
    return explode_negatives(random_negatives(pairwise_samples(t), ["sample_no"]))


def scored_pairs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(scored, skipped) pairs of all models."""
    models = F.explode(F.array(*[F.lit(n) for n in MODELS])).alias("model_name")
    specs = pair_specs(t).select("*", models)
    good, bad = score_specs(specs, image_features(t), text_features(t), ["sample_id", "negative_index"])
    return with_margins(good), bad


def pairwise_scores(t: Tables) -> DataFrame:
    return once(t, "pairwise-scores", lambda: scored_pairs(t)[0])


def two_by_two_scores(t: Tables) -> DataFrame:
    """Vectors 4k .. 4k + 3 are two images and their two captions."""

    def build() -> DataFrame:
        place = F.col("vec_id") % 4
        quads = (
            t.embeddings.groupBy(F.floor(F.col("vec_id") / 4).alias("quad"))
            .agg(
                *[F.max(F.when(place == i, F.col("embedding"))).alias(n) for i, n in enumerate(("i0", "i1", "c0", "c1"))],
                F.max(F.when(place == 0, F.col("label"))).alias("label"),
                F.count(F.lit(1)).alias("n"),
            )
            .where(F.col("n") == 4)
        )
        named = quads.select(
            "quad",
            F.when(F.col("quad") % 2 == 0, "winoground").otherwise("bivlc").alias("benchmark"),
            F.when(F.col("label") % 5 != 0, F.concat(F.lit("tag"), (F.col("label") % 5).cast("string"))).alias("category"),
            *[F.col(c) for c in ("i0", "i1", "c0", "c1")],
        )
        frames = []
        for name, dims in MODELS.items():
            cut = named.withColumns({c: F.slice(c, 1, dims) for c in ("i0", "i1", "c0", "c1")})
            frames.append(score_2x2(cut.withColumn("model_name", F.lit(name)), "i0", "i1", "c0", "c1"))
        return frames[0].unionByName(frames[1])

    return once(t, "two-by-two-scores", build)


def pairwise_sql() -> str:
    """WITH clause ending in `pw`, the pairwise score table of `pairwise_scores`."""
    from . import sqltext as q

    models = " UNION ALL ".join(
        f"""SELECT '{n}' AS model_name, s.*, {q.dot('i.u', 'p.u')} AS score_pos, {q.dot('i.u', 'g.u')} AS score_neg,
            {q.dot('i.u', 'r.u')} AS score_random_neg
        FROM specs s JOIN u{n} i ON i.vec_id = s.image_id JOIN u{n} p ON p.vec_id = s.text_id
        JOIN u{n} g ON g.vec_id = s.negative LEFT JOIN u{n} r ON r.vec_id = s.random_id"""
        for n in MODELS
    )
    units = ", ".join(
        f"u{n} AS (SELECT vec_id, {q.unit('embedding', d)} AS u FROM embeddings)" for n, d in MODELS.items()
    )
    return f"""WITH caps AS (
      SELECT vec_id AS text_id, vec_id - vec_id % 6 AS image_id, label,
             row_number() OVER (ORDER BY vec_id) - 1 AS idx, count(*) OVER () AS n
      FROM embeddings WHERE vec_id % 6 <> 0),
    drawn AS (SELECT *, {q.hkey("concat('42:', idx)")} % (n - 1) AS j FROM caps),
    samples AS (SELECT d.*, r.text_id AS random_id FROM drawn d JOIN caps r ON r.idx = d.j + (d.j >= d.idx)::int),
    specs AS (
      SELECT text_id, image_id, random_id, k AS negative_index, text_id + 6 + 6 * k AS negative,
        CASE k WHEN 0 THEN 'next_image' ELSE 'hard_negative' END AS negative_type,
        CASE (image_id // 6) % 3 WHEN 0 THEN 'aro' WHEN 1 THEN 'sugarcrepe' ELSE 'sugarcrepe_pp' END AS benchmark,
        CASE WHEN (image_id // 6) % 3 = 0 THEN CASE label % 3 WHEN 0 THEN 'attr' WHEN 1 THEN 'rel' ELSE 'order' END
             ELSE CASE label % 3 WHEN 0 THEN 'swap_att' WHEN 1 THEN 'add_obj' ELSE 'replace_rel' END END AS category,
        CASE WHEN label % 4 <> 0 THEN concat('sub', label % 4) END AS subcategory
      FROM samples, (SELECT unnest([0, 1]) AS k)),
    {units},
    scored AS ({models}),
    pw AS (SELECT *, score_pos - score_neg AS hard_margin, score_pos - score_random_neg AS random_margin,
             (score_pos - score_neg) / (score_pos - score_random_neg + 1e-6) AS ssr,
             (score_pos > score_neg)::int AS correct FROM scored)
    """


def two_by_two_sql() -> str:
    """WITH clause ending in `tt`, the 2x2 score table of `two_by_two_scores`."""
    from . import sqltext as q

    place = lambda i, e="embedding": f"max(CASE WHEN vec_id % 4 = {i} THEN {e} END)"
    models = " UNION ALL ".join(
        f"""SELECT '{n}' AS model_name, quad, benchmark, category,
            {q.dot(q.unit('i0', d), q.unit('c0', d))} AS s00, {q.dot(q.unit('i0', d), q.unit('c1', d))} AS s01,
            {q.dot(q.unit('i1', d), q.unit('c0', d))} AS s10, {q.dot(q.unit('i1', d), q.unit('c1', d))} AS s11
        FROM named"""
        for n, d in MODELS.items()
    )
    return f"""WITH quads AS (
      SELECT vec_id // 4 AS quad, {place(0)} AS i0, {place(1)} AS i1, {place(2)} AS c0, {place(3)} AS c1,
             {place(0, 'label')} AS label FROM embeddings GROUP BY ALL HAVING count(*) = 4),
    named AS (SELECT *, CASE quad % 2 WHEN 0 THEN 'winoground' ELSE 'bivlc' END AS benchmark,
             CASE WHEN label % 5 <> 0 THEN concat('tag', label % 5) END AS category FROM quads),
    cells AS ({models}),
    margins AS (SELECT *, s00 - s01 AS t0, s11 - s10 AS t1, s00 - s10 AS i0, s11 - s01 AS i1 FROM cells),
    tt AS (SELECT *, (t0 > 0 AND t1 > 0)::int AS text_score, (i0 > 0 AND i1 > 0)::int AS image_score,
             (t0 > 0 AND t1 > 0 AND i0 > 0 AND i1 > 0)::int AS group_score,
             least(t0, t1, i0, i1) AS group_min_margin FROM margins)
    """


def write_tar_shards(placed: DataFrame, key: Column, members: dict[str, Column], folder: str) -> int:
    """Write rows as tar shards of SAMPLES_PER_SHARD samples; `members` are binary columns
    named by their extension, null where a sample has none.

    `placed` has the position of each row as `__idx`. Rows move to their shard as they are,
    sorted by it; the members are made after that, so that no copy of a text is moved twice.
    Each shard is one bounded group. A shard appears under its name only when
    it is complete, so a repeated task does no harm.
    """

    names = list(members)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__idx")
        shard = int(pdf["__shard"].iloc[0])
        buffer = io.BytesIO()
        with tarfile.open(fileobj=buffer, mode="w") as archive:
            for row in pdf[["__key", *names]].itertuples(index=False):
                for ext, data in zip(names, row[1:]):
                    if data is not None:
                        info = tarfile.TarInfo(f"{row[0]}.{ext}")
                        info.size = len(data)
                        archive.addfile(info, io.BytesIO(data))
        fs, base = resolve(folder)
        fs.create_dir(base, recursive=True)
        final = f"{base}/shard-{shard:06d}.tar"
        draft = f"{final}.{uuid.uuid4().hex}.part"
        with fs.open_output_stream(draft) as out:
            out.write(buffer.getbuffer())
        fs.move(draft, final)
        return pd.DataFrame({"shard": [shard], "n": [len(pdf)]})

    dealt = placed.withColumn("__shard", F.floor(F.col("__idx") / SAMPLES_PER_SHARD))
    dealt = dealt.repartition(work_partitions(placed.sparkSession), "__shard").sortWithinPartitions("__shard")
    made = dealt.select("__idx", "__shard", key.alias("__key"), *[c.alias(n) for n, c in members.items()])
    return made.groupBy("__shard").applyInPandas(write, "shard bigint, n bigint").count()


def document_shards(t: Tables) -> str:
    """Folder of tar shards of all documents: text and metadata, an image stand-in for labelled ones."""
    key = (t.spark.sparkContext.applicationId, t.folder, "tar-folder")
    if key not in _stored:
        folder = scratch_path(t.spark, "shards")
        name = F.lpad(F.col("doc_id").cast("string"), 9, "0")
        meta = F.to_json(
            F.struct(
                name.alias("key"),
                F.create_map(F.lit("raw"), F.col("source"), F.lit("longSV"), F.col("text")).alias("captions"),
                F.when(F.col("doc_id") % 5 != 0, "longSV").otherwise("raw").alias("default_caption_key"),
            )
        )
        # Ids and labels alone are joined and sorted for the positions.
        ids = t.documents.select("doc_id").join(t.labels.select("doc_id", F.col("quality").isNotNull().alias("__image")), "doc_id", "left")
        rows = attach(t.documents, dense_index(ids, "doc_id", name="__idx"), ["doc_id"], "inner")
        members = {
            "jpg": F.when(F.col("__image"), F.encode(F.concat("lang", "source"), "UTF-8")),
            "json": F.encode(meta, "UTF-8"),
            "txt": F.encode("text", "UTF-8"),
        }
        write_tar_shards(rows, name, members, folder)
        _stored[key] = (folder,)
    return _stored[key][0]
