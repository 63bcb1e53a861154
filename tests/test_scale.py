"""Steps whose moved rows, tasks and memory go by the rows, not by the pairs."""

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from lumenpair.operators import retrieval as V
from lumenpair.operators import walks as W


def unit(a):
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def sides(spark, n_left, n_right, width=8, seed=5):
    rng = np.random.default_rng(seed)
    left, right = rng.normal(size=(n_left, width)), rng.normal(size=(n_right, width))
    a, b = (spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(unit(x))], "id bigint, feature array<double>") for x in (left, right))
    return unit(left), unit(right), a, b


@pytest.mark.parametrize("cell_rows", [7, 30])
def test_walks_of_several_parts_and_runs(spark, cell_rows):
    left, right, a, b = sides(spark, 40, 90)
    sims = np.round(left @ right.T, 12)
    out = W.walked(a, b, (40, 90), 4, 1, cell_rows).collect()
    best = {}
    for r in out:
        best.setdefault(r["__own"], []).append((-r.sim, r["__other"]))
    want = {n: sorted((-s, j) for j, s in enumerate(row))[:4] for n, row in enumerate(sims)}
    assert {n: sorted(v)[:4] for n, v in best.items()} == want
    assert len(out) <= 4 * 40 * -(-90 // cell_rows)


def test_small_tiles_are_joined_where_they_would_be_many(spark):
    _, _, a, b = sides(spark, 600, 600, 2)
    one = lambda l, r: l.select(["image_id"]).slice(0, 1)
    left, right = a.withColumnRenamed("id", "image_id"), b.withColumnRenamed("id", "text_id")
    n = V.tiles(left, right, (600, 600), one, "image_id bigint", tile_rows=4).count()
    cores = spark.sparkContext.defaultParallelism
    assert n <= 2 * V.TILES_PER_CORE * cores
    # Forty times the rows: as many tiles, and no side beyond its bytes.
    assert V.tile_side(4, (24_000, 24_000), cores, 16) ** 2 * V.TILES_PER_CORE * cores == pytest.approx(24_000**2, rel=0.01)
    assert V.tile_side(4, (10**8, 10**8), cores, 8 * 768) == V.SIDE_BYTES // (8 * 768)


def test_strips_are_bounded_on_both_sides(spark):
    _, _, a, b = sides(spark, 600, 4500, 2)
    l, r = (x.select("feature").toArrow() for x in (a, b))
    parts = list(V._strips(l, r))
    assert max(s.size for *_, s in parts) <= V.STRIP_ROWS * V.STRIP_COLUMNS
    assert sum(s.size for *_, s in parts) == 600 * 4500


def test_paired_ties_across_strips(spark, monkeypatch):
    monkeypatch.setattr(V, "STRIP_ROWS", 2)
    same = [1.0, 0.0]
    one = spark.createDataFrame([(k, same, same) for k in range(5)], "pair_id bigint, image array<double>, text array<double>")
    assert rows(V.paired_ranks(one)) == [(s, k, k + 1) for s in "it" for k in range(5)]


def test_attention_block_equals_single_pairs():
    rng = np.random.default_rng(4)
    tokens, cues, feature = rng.normal(size=(6, 3, 4)), rng.normal(size=(9, 2, 4)), rng.normal(size=(9, 4))
    # Tokens that cancel, and an image of zeros.
    tokens[2] = [[1, 0, 0, 0], [-1, 0, 0, 0], [0, 0, 0, 0]]
    cues[3], tokens[4] = 0, 0
    scorer = V.AttentionScorer()
    got = scorer.block({"tokens": tokens}, {"cues": cues, "text_feature": feature})
    for n in range(6):
        single = scorer({"tokens": np.repeat(tokens[n : n + 1], 9, axis=0)}, {"cues": cues, "text_feature": feature})
        assert np.abs(got[n] - single).max() < 1e-10


def test_shards_sort_keys_only_and_hold_every_document_in_order(spark, monkeypatch):
    from lumenpair.plans import fixtures as fx
    from lumenpair.plans.registry import Tables
    from lumenpair.sources.tar import read_tar_shards

    sorted_columns = []
    index = fx.dense_index
    monkeypatch.setattr(fx, "_stored", {})
    monkeypatch.setattr(fx, "dense_index", lambda df, *keys, **kw: sorted_columns.append(df.columns) or index(df, *keys, **kw))
    t = Tables(spark, "/root/testdata/sf0.001")
    samples, _ = read_tar_shards(spark, f"{fx.document_shards(t)}/shard-*.tar")
    text = F.element_at("members", F.lit("txt")).cast("string")
    found = samples.orderBy("shard", "sample_index").select("key", text.alias("text"), F.map_contains_key("members", F.lit("jpg")).alias("image")).collect()
    labelled = {r.doc_id for r in t.labels.collect()}
    want = [(f"{r.doc_id:09d}", r.text, r.doc_id in labelled) for r in t.documents.orderBy("doc_id").collect()]
    assert [tuple(r) for r in found] == want
    assert sorted_columns == [["doc_id", "__image"]]
