"""Summaries, retrieval and diagnostics against plain numpy on small fixtures."""

import math

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from lumenpair.operators import diagnostics as D
from lumenpair.operators import retrieval as V
from lumenpair.operators import summaries as S
from lumenpair.operators import walks as W


def scores(spark, data):
    schema = "model_name string, benchmark string, category string, subcategory string, score_pos double, score_neg double, random double"
    df = spark.createDataFrame(data, schema)
    return df.select(
        "*",
        (F.col("score_pos") - F.col("score_neg")).alias("hard_margin"),
        (F.col("score_pos") - F.col("random")).alias("random_margin"),
        (F.col("score_pos") > F.col("score_neg")).cast("int").alias("correct"),
    ).withColumn("ssr", F.col("hard_margin") / (F.col("random_margin") + 1e-6))


DATA = [
    ("m", "sugarcrepe", "swap", None, 0.5, 0.5, 0.1),
    ("m", "sugarcrepe", "swap", "att", 0.6, 0.5, None),
    ("m", "sugarcrepe", "swap", "att", 0.9, 0.5, 0.95),
    ("m", "aro", "attr", None, 0.2, 0.3, None),
]


def test_summary_edges(spark):
    df = scores(spark, DATA)
    got = {(r.level, r.category, r.subcategory): r for r in S.summarize_by_subcategory(df).collect()}
    assert set(got) == {(0, "swap", None), (0, "swap", "att"), (1, "overall", None)}
    tie = got[(0, "swap", None)]
    assert tie.accuracy == 0.0 and tie.negative_win_rate == 1.0 and tie.margin_std is None and tie.sample_count == 1
    assert got[(1, "overall", None)].median_margin == pytest.approx(0.1)
    assert S.summarize_by_category(df.limit(0)).count() == 0
    ssr = {r.category: r for r in S.summarize_ssr(df).collect()}
    assert ssr["attr"].SSR_mean is None and ssr["attr"].invalid_random_margin_ratio == 0.0
    assert ssr["swap"].invalid_random_margin_ratio == pytest.approx(1 / 3)
    margins = {r.category: r for r in S.summarize_margins(df).collect()}
    assert margins["attr"].hard_vs_random_gap is None
    assert margins["swap"].random_margin_median == pytest.approx((0.4 - 0.05) / 2)


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([("m", 1.0)] * 4 + [("n", 0.0), ("n", 1.0), ("n", None)], "model_name string, hard_margin double")
    got = {(r.model_name, r.bin): r for r in S.margin_histogram(df, bins=4).collect()}
    assert len(got) == 8
    assert got[("m", 2)]["count"] == 4 and got[("m", 2)].bin_start == 1.0
    assert got[("n", 0)]["count"] == 1 and got[("n", 3)]["count"] == 1 and got[("n", 3)].density == 2.0


def unit(a):
    return a / np.linalg.norm(a, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def retrieval_set(spark):
    rng = np.random.default_rng(5)
    images, texts = rng.normal(size=(23, 8)), rng.normal(size=(60, 8))
    owner = rng.integers(0, 20, size=60)
    texts[7] = texts[3]  # equal scores everywhere
    i = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(images)], "image_id bigint, feature array<double>")
    c = spark.createDataFrame([(k, int(o), v.tolist()) for k, (o, v) in enumerate(zip(owner, texts))], "text_id bigint, image_id bigint, feature array<double>")
    return images, texts, owner, i, c


@pytest.mark.parametrize("tile", [4, 16, 8192])
def test_ranks_equal_dense_matrix(spark, retrieval_set, tile):
    images, texts, owner, i, c = retrieval_set
    kept = sorted(set(owner))
    sims = unit(images)[kept] @ unit(texts).T
    place = {k: n for n, k in enumerate(kept)}
    want = []
    for k in kept:
        row = sims[place[k]]
        want.append(("i", int(k), int((row > row[owner == k].max() + V.TIE).sum()) + 1))
    for t, o in enumerate(owner):
        want.append(("t", t, int((sims[:, t] > sims[place[o], t] + V.TIE).sum()) + 1))
    assert rows(V.retrieval_ranks(i, c, tile)) == sorted(want, key=repr)
    assert V.images_without_caption(i, c).count() == 23 - len(kept)


@pytest.mark.parametrize("tile", [5, 8192])
def test_top_pairs_equal_sorting(spark, retrieval_set, tile):
    images, texts, _, i, c = retrieval_set
    sims = np.round(unit(images) @ unit(texts).T, V.TOP_DIGITS)
    want = set()
    for a in range(len(images)):
        for b in sorted(range(len(texts)), key=lambda t: (-sims[a, t], t))[:4]:
            want.add((a, b))
    for b in range(len(texts)):
        for a in sorted(range(len(images)), key=lambda x: (-sims[x, b], x))[:4]:
            want.add((a, b))
    got = {(r.image_id, r.text_id) for r in V.candidate_pairs(i, c, 4, tile).collect()}
    assert got == want
    every = V.candidate_pairs(i, c, 10_000, tile).count()
    assert every == 23 * 60


def test_paired_ranks_break_ties_by_id(spark):
    same = [1.0, 0.0]
    df = spark.createDataFrame([(k, same, same) for k in range(3)], "pair_id bigint, image array<double>, text array<double>")
    assert rows(V.paired_ranks(df)) == [("i", 0, 1), ("i", 1, 2), ("i", 2, 3), ("t", 0, 1), ("t", 1, 2), ("t", 2, 3)]


def test_rerank_with_all_candidates_is_exact(spark, retrieval_set):
    _, _, _, i, c = retrieval_set
    cut = lambda df: df.withColumn("feature", F.slice("feature", 1, 3))
    i = i.join(c.select("image_id").distinct(), "image_id")
    full = V.rerank_ranks(cut(i), cut(c), 1000, V.exact_by_features(i, c), tile_rows=16)
    assert rows(full) == rows(V.retrieval_ranks(i, c))
    metrics = V.flat_metrics(V.recall_metrics(full)).first()
    assert set(metrics.asDict()) == {f"{p}_{n}" for p in ("i2t", "t2i") for n in ("r@1", "r@5", "r@10", "mean_rank", "median_rank")}


def test_lower_median_rank(spark):
    df = spark.createDataFrame([("i", r) for r in (1, 2, 3, 4)], "side string, rank int")
    got = V.recall_metrics(df).first()
    assert got.median_rank == 2 and got.r_at_1 == 25.0 and got.mean_rank == 2.5


@pytest.mark.parametrize("parts", [1, 4])
def test_spectrum_and_redundancy_equal_numpy(spark, parts):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(50, 6)) + 2, rng.normal(size=(50, 4))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>").repartition(parts)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    p = s / s.sum()
    got = D.spectrum(df.select(F.col("x").alias("feature"))).first()
    assert got.effective_rank == pytest.approx(math.exp(-(p * np.log(p + 1e-12)).sum()))
    assert (got.top1, got.top5_mean) == (pytest.approx(s[0]), pytest.approx(s[:5].mean()))
    xc, yc = x - x.mean(0), y - y.mean(0)
    cross = xc.T @ yc
    red = D.redundancy(df).first()
    assert red.cross_cov_fro == pytest.approx(np.linalg.norm(cross) / 49)
    cka = (cross**2).sum() / (np.linalg.norm(xc.T @ xc) * np.linalg.norm(yc.T @ yc))
    assert red.linear_cka == pytest.approx(cka) and red.cosine_abs_mean is None


def test_spectrum_of_one_row(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "feature array<double>")
    assert tuple(D.spectrum(df).first()) == (1, None, None, None)


def test_value_stats(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (float("-inf"),), (None,)], "v double")
    assert tuple(D.value_stats(df, "v").first()) == (2, 2, 1.0, 3.0, 2.0, 1.0)
    assert tuple(D.value_stats(df.where(F.isnan("v")), "v").first())[:3] == (1, 0, None)


def test_rows_without_vectors_are_not_ranked(spark):
    images = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [1.0, None])], "image_id bigint, feature array<double>")
    texts = [(11, 2, [1.0, 0.0]), (12, 1, [1.0, 0.1]), (13, 3, None), (14, 9, [1.0, 1.0]), (15, 1, [1.0, 0.0, 0.0]), (16, 1, [float("nan"), 0.0])]
    captions = spark.createDataFrame(texts, "text_id bigint, image_id bigint, feature array<double>")
    assert rows(V.retrieval_ranks(images, captions)) == [("i", 1, 1), ("t", 12, 1)]
    none = lambda c: c.withColumn("sim", F.lit(0.0))
    assert rows(V.rerank_ranks(images, captions, 2, none)) == [("i", 1, 1), ("t", 12, 1)]
    reasons = {(r.image_id, r.text_id): r.reason for r in V.set_aside(images, captions).collect()}
    assert reasons == {
        (2, None): "image has no vector",
        (3, None): "image has no caption that takes part",
        (4, None): "image has a vector with missing or non-finite numbers",
        (2, 11): "image of the caption takes no part",
        (3, 13): "caption has no vector",
        (9, 14): "caption has no image",
        (1, 15): "caption has a vector of another width",
        (1, 16): "caption has a vector with missing or non-finite numbers",
    }
    pairs = spark.createDataFrame(
        [(1, [1.0, 0.0], [1.0, 0.0]), (2, None, [1.0, 0.0]), (3, [0.0, 1.0], None)], "pair_id bigint, image array<double>, text array<double>"
    )
    assert rows(V.paired_ranks(pairs)) == [("i", 1, 1), ("t", 1, 1)]
    assert V.retrieval_ranks(images.limit(0), captions.limit(0)).collect() == []


@pytest.mark.parametrize("block_rows", [3, 7, 1000])
def test_walks_equal_dense_matrix_and_emit_k_rows_a_run(spark, retrieval_set, block_rows):
    images, texts, _, i, c = retrieval_set
    sims = np.round(unit(images) @ unit(texts).T, 12)
    want = {(n, int(j)) for n, row in enumerate(sims) for j in sorted(range(len(row)), key=lambda j: (-row[j], j))[:4]}
    left = V.normalized(i.select(F.col("image_id").alias("id"), "feature"))
    right = V.normalized(c.select(F.col("text_id").alias("id"), "feature"))
    out = W.walked(left, right, (23, 60), 4, block_rows).collect()
    runs = max(1, -(-W.packed_blocks(right, 60, block_rows, W.pivots_of(right, 60 // block_rows) if block_rows < 60 else None).count() // W.RUN_BLOCKS))
    assert len(out) <= 4 * 23 * runs and (runs > 1 or {(r["__own"], r["__other"]) for r in out} == want)
    top = V.top_pairs(i, c, 4, tile_rows=block_rows, sides=("i",))
    assert {(r.image_id, r.text_id) for r in top.collect()} == want


def test_walk_leaves_out_blocks_by_their_bound():
    """Tight, distant clusters: after the nearest one no row looks into another block."""
    rng = np.random.default_rng(3)
    centers = np.eye(16)
    right = [unit(c + 0.01 * rng.normal(size=(50, 16))) for c in centers]
    left = unit(centers[0] + 0.01 * rng.normal(size=(40, 16)))
    walk = W.Walk(np.arange(40), left, 5)
    looked = []
    for k, x in enumerate(right):
        center = x.mean(axis=0)
        looked.append(walk.visit(np.arange(50) + 50 * k, x, center, float(np.linalg.norm(x - center, axis=1).max())))
    assert looked[0] == 40 and sum(looked[1:]) == 0
    dense = np.round(left @ np.concatenate(right).T, 12)
    want = {(n, int(j)) for n, row in enumerate(dense) for j in sorted(range(len(row)), key=lambda j: (-row[j], j))[:5]}
    assert {(int(a), int(b)) for a, b in zip(walk.best[0], walk.best[1])} == want


def test_conditioned_ranks_equal_dense_scores(spark):
    rng = np.random.default_rng(8)
    tokens, cues, feature = rng.normal(size=(9, 3, 4)), rng.normal(size=(20, 2, 4)), rng.normal(size=(20, 4))
    owner = [n % 8 for n in range(20)]  # image 8 has no caption
    i = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(tokens)] + [(50, None), (51, [[1.0], [2.0, 3.0]])], "image_id bigint, tokens array<array<double>>")
    c = spark.createDataFrame(
        [(k, owner[k], cues[k].tolist(), feature[k].tolist()) for k in range(20)] + [(90, 50, cues[0].tolist(), feature[0].tolist()), (91, 0, None, feature[0].tolist())],
        "text_id bigint, image_id bigint, cues array<array<double>>, text_feature array<double>",
    )
    scorer = V.AttentionScorer()
    dense = np.array([scorer({"tokens": np.repeat(t[None], 20, axis=0)}, {"cues": cues, "text_feature": feature}) for t in tokens[:8]])
    want = [("i", n, 1 + int((dense[n] > max(dense[n][k] for k in range(20) if owner[k] == n) + 1e-9).sum())) for n in range(8)]
    want += [("t", k, 1 + int((dense[:, k] > dense[owner[k], k] + 1e-9).sum())) for k in range(20)]
    for tile in (None, 3):
        assert rows(V.conditioned_ranks(i, c, V.AttentionScorer, tile)) == sorted(want, key=repr)
    assert V.conditioned_ranks(i.limit(0), c, V.AttentionScorer).collect() == []


def test_tiles_are_cut_by_bytes():
    assert V.choose_tile(10**9, 10**9, 1000, 8 * 768) == V.SIDE_BYTES // (8 * 768)
    assert V.choose_tile(10**9, 10**9, 1000, 8) == V.MAX_TILE_ROWS
