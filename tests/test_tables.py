"""Relational operators, sampling and reports on small fixtures."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenpair.operators import duplicates as U
from lumenpair.operators import quality as Q
from lumenpair.operators import relabel as L
from lumenpair.operators import sampling as P
from lumenpair.operators import negatives, ordering
from lumenpair.operators.negatives import explode_negatives, negative_links, random_negatives
from lumenpair.operators.ordering import dense_index, exact_median, key_index, top_per_group
from lumenpair.operators.paths import has_image, resolve_paths
from lumenpair.operators.scoring import HashingEncoder, encode, image_key, score_specs, with_margins


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_dense_index_is_contiguous_for_any_partitioning(spark, parts):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(parts)
    got = dense_index(df, "k").orderBy("k").collect()
    assert [(r.k, r.idx) for r in got] == [(i, i) for i in range(1000)]


def test_dense_index_of_nothing(spark):
    assert dense_index(spark.range(0), "id").count() == 0


@pytest.mark.parametrize("lower", [False, True])
def test_exact_median_large_groups_ties_and_nulls(spark, lower):
    """One group holds most rows and many equal values; the sketch path is taken for it."""
    big = spark.range(60001).select(
        F.lit("big").alias("g"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.sin("id") * 1000).alias("v")
    )
    small = spark.createDataFrame([("s", 1.0), ("s", 2.0), ("s", 3.0), ("s", 4.0), (None, 7.0), (None, None), ("e", None)], "g string, v double")
    df = big.union(small)
    got = {r.g: r.m for r in exact_median(df, ["g"], "v", "m", lower).collect()}
    values = sorted(r.v for r in big.collect())
    n = len(values)
    want = values[(n - 1) // 2] if lower else (values[(n - 1) // 2] + values[n // 2]) / 2
    assert got == {"big": want, "s": 2.0 if lower else 2.5, None: 7.0}


def test_top_per_group_with_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(-1)).alias("g"), "id")
    got = top_per_group(df, ["g"], [F.desc("id")], 3, ["id"]).where(F.col("g") == -1)
    assert rows(got.select("id", "rn")) == [(4996, 3), (4997, 2), (4999, 1)]


RELABEL = [
    (0, "u1", "", "first", ""),
    (1, "u1", "second ", "x", ""),
    (2, " u2 ", None, " ", "raw two"),
    (3, "", "lost", "", ""),
    (4, "u3", " ", "", None),
]
RELABEL_SCHEMA = "seq int, `Image Path` string, longSV_captions string, longIB_captions string, raw_caption string"


def test_caption_table(spark):
    table = L.build_caption_table(spark.createDataFrame(RELABEL, RELABEL_SCHEMA))
    assert rows(table) == [("u1", "second"), ("u2", "raw two")]
    with pytest.raises(ValueError):
        L.build_caption_table(spark.createDataFrame([(1, "x")], "seq int, key string"))
    with pytest.raises(ValueError):
        L.build_caption_table(spark.createDataFrame([(1, "x")], "seq int, `Image Path` string"))


def test_relabel_policies(spark):
    table = L.build_caption_table(spark.createDataFrame(RELABEL, RELABEL_SCHEMA))
    samples = spark.createDataFrame([("u1", "old1"), ("u9", "old9"), (None, "none"), ("", "blank")], "url string, caption string")
    assert rows(L.relabel(samples, table)) == rows(
        spark.createDataFrame([("u1", "second"), ("u9", "old9"), (None, "none"), ("", "blank")], samples.schema)
    )
    assert rows(L.relabel(samples, table, policy="skip")) == [("u1", "second")]
    assert rows(L.relabel(samples.where("url = 'u1'"), table, policy="error")) == [("u1", "second")]
    with pytest.raises(Exception, match="no relabelled caption"):
        L.relabel(samples, table, policy="error").collect()
    with pytest.raises(ValueError):
        L.relabel(samples, table, policy="other")


def test_path_resolution_order(spark):
    listing = spark.createDataFrame([("/b1/d/x.jpg",), ("/b2/x.jpg",), ("/b1/y.jpg",), ("/abs/z.jpg",)], "path string")
    refs = spark.createDataFrame([("d/x.jpg",), ("x.jpg",), ("e/y.jpg",), ("/abs/z.jpg",), ("/gone/x.jpg",), ("q.jpg",), (None,)], "ref string")
    got = dict(rows(resolve_paths(refs, "ref", ["/b2", "/b1"], listing).select("ref", "image_path")))
    assert got == {
        "d/x.jpg": "/b1/d/x.jpg",
        "x.jpg": "/b2/x.jpg",
        "e/y.jpg": "/b1/y.jpg",
        "/abs/z.jpg": "/abs/z.jpg",
        "/gone/x.jpg": "/b2/x.jpg",
        "q.jpg": None,
        None: None,
    }
    checked = has_image(refs, "ref", ["/b1", "/b2"], listing)
    assert dict(rows(checked.select("ref", "image_ok")))["e/y.jpg"] is True
    assert dict(rows(checked.select("ref", "image_ok")))[None] is False


def test_match_pairs_reasons(spark):
    listing = spark.createDataFrame(
        [("a", 3, "h1", None, True), ("b", 3, "h1", None, True), ("c", 3, "h2", None, True), ("d", 4, "h3", None, True),
         ("l", 3, "h1", "a", True), ("dir", 0, None, None, False)],
        "path string, length bigint, sha256 string, link_target string, is_file boolean",
    )
    pairs = spark.createDataFrame(
        [("a", "b"), ("a", "c"), ("a", "d"), ("a", "l"), ("a", "dir"), ("gone", "a"), ("a", "gone")], "source string, target string"
    )
    got = {(r.source, r.target): (r.action, r.reason, r.size_bytes) for r in U.match_pairs(pairs, listing).collect()}
    assert got == {
        ("a", "b"): ("would_symlink", "identical", 3),
        ("a", "c"): ("skip", "sha256_differs", 3),
        ("a", "d"): ("skip", "size_differs", 4),
        ("a", "l"): ("already_symlink", "a", None),
        ("a", "dir"): ("skip", "not_regular_file", None),
        ("gone", "a"): ("skip", "source_missing", None),
        ("a", "gone"): ("skip", "target_missing", None),
    }


def turns(counts, limit):
    """Balanced limit as a walk over lists, one pick at a time."""
    left = dict(counts)
    keys = sorted((k for k in left if left[k]), key=str)
    taken, cursor = dict.fromkeys(counts, 0), 0
    while sum(taken.values()) < limit and keys:
        k = keys[cursor % len(keys)]
        taken[k] += 1
        left[k] -= 1
        keys = [x for x in keys if left[x]]
        cursor += 1
    return taken


def test_balanced_quotas_equal_the_walk():
    rng = random.Random(3)
    for _ in range(400):
        counts = {f"c{i}": rng.randint(0, 30) for i in range(rng.randint(1, 8))}
        limit = rng.randint(1, 120)
        assert P.balanced_quotas(counts, limit) == turns(counts, limit)


def test_balanced_limit_keeps_order_and_null_category(spark):
    data = [(i, "a" if i < 50 else None if i < 53 else "b") for i in range(60)]
    df = spark.createDataFrame(data, "i int, c string")
    got = sorted(r.i for r in P.balanced_limit(df, "c", "i", 12).collect())
    quotas = turns({"a": 50, None: 3, "b": 7}, 12)
    want = list(range(quotas["a"])) + [50, 51, 52][: quotas[None]] + list(range(53, 53 + quotas["b"]))
    assert got == sorted(want)
    assert P.balanced_limit(df, "c", "i", 100).count() == 60
    assert P.balanced_limit(df, "c", "i", 0).count() == 60


def test_random_negative_is_another_sample(spark):
    df = spark.range(300).select("id", F.concat(F.lit("cap"), "id").alias("positive_caption"))
    got = random_negatives(df, ["id"]).collect()
    assert len(got) == 300 and all(r.random_negative_caption != r.positive_caption for r in got)
    assert len({r.random_negative_caption for r in got}) > 150
    assert random_negatives(df.limit(1), ["id"]).first().random_negative_caption is None


def test_positions_sort_and_store_keys_only(spark, monkeypatch):
    stored = []
    inner = ordering.dense_index

    def watched(df, *keys, **more):
        stored.append(df.columns)
        return inner(df, *keys, **more)

    monkeypatch.setattr(ordering, "dense_index", watched)
    monkeypatch.setattr(negatives, "dense_index", watched)
    data = [(s, k, f"cap{s}{k}", "wide" * 50) for s in ("a", None, "b") for k in range(40)]
    df = spark.createDataFrame(data, "source string, k int, positive_caption string, payload string").repartition(5)
    placed = {(r.source, r.k): r.idx for r in key_index(df, ["source", "k"]).collect()}
    ranked = sorted(placed, key=lambda e: (e[0] is not None, e[0] or "", e[1]))
    assert [placed[e] for e in ranked] == list(range(120))
    got = random_negatives(df, ["source", "k"]).collect()
    captions = {(r[0], r[1]): r[2] for r in data}
    links = {(r.source, r.k): (r.other.source, r.other.k) for r in negative_links(df, ["source", "k"]).collect()}
    assert len(got) == len(links) == 120 and all(a != b for a, b in links.items())
    assert all(r.random_negative_caption == captions[links[r.source, r.k]] and r.payload == "wide" * 50 for r in got)
    assert P.rank_shard(df, 7, "source", "k").where("rank = 6").count() == 17
    full = P.fixed_batches(df, 50, "source", "k", partial=False)
    assert rows(full.groupBy("batch_id").count()) == [(0, 50), (1, 50)] and full.columns == [*df.columns, "batch_id", "batch_pos"]
    assert stored and all(set(c) <= {"source", "k"} for c in stored)


def test_random_negatives_are_uniform(spark):
    """4,000 samples draw from ten equal ranges of partners: each range gets its tenth."""
    drawn = negative_links(spark.range(4000), ["id"]).groupBy(F.floor(F.col("other.id") / 400)).count().collect()
    assert len(drawn) == 10 and all(abs(r["count"] - 400) < 100 for r in drawn)


def test_explode_negatives_default_type(spark):
    df = spark.createDataFrame([("s", ["x", "y"], ["t"])], "sample_id string, negative_captions array<string>, negative_types array<string>")
    assert rows(explode_negatives(df)) == [("s", "x", 0, "t"), ("s", "y", 1, "hard_negative")]


def test_feature_join_and_margins(spark):
    crop = T.StructType.fromDDL("l int, t int, r int, b int")
    specs = spark.createDataFrame(
        [("p", "n", "r", (1, 2, 3, 4)), ("p", "n", None, None), ("p", "gone", "r", None), ("p", "p", "gone", None)],
        T.StructType.fromDDL("positive_caption string, negative_caption string, random_negative_caption string").add("crop", crop),
    ).withColumn("image_key", image_key(F.lit("/i.jpg"), F.col("crop"))).withColumn("k", F.monotonically_increasing_id())
    images = specs.select("image_key").distinct().withColumn("feature", F.array(F.lit(1.0), F.lit(0.0)))
    texts = spark.createDataFrame([("p", [1.0, 0.0]), ("n", [0.0, 2.0]), ("r", [1.0, 1.0])], "caption string, feature array<double>")
    assert images.count() == 2
    good, bad = score_specs(specs, images, texts, ["k"])
    assert [r.reason for r in bad.collect()] == ["negative caption has no feature"]
    got = with_margins(good).orderBy("negative_caption", F.col("random_negative_caption").desc_nulls_last()).collect()
    assert got[0].hard_margin == 1.0 and got[0].correct == 1 and abs(got[0].ssr - 1 / (1 - 2**-0.5 + 1e-6)) < 1e-9
    assert got[1].random_margin is None and got[1].ssr is None
    assert got[2].hard_margin == 0.0 and got[2].correct == 0


def test_encoder_sets_bad_rows_aside(spark):
    class Fussy(HashingEncoder):
        def __call__(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("cannot encode")
            return super().__call__(texts)

    df = spark.createDataFrame([(1, "a b"), (2, "bad"), (3, "a b"), (4, None)], "k int, t string")
    features, failures = encode(df, "t", lambda: Fussy(4), batch_size=8)
    assert [r.t for r in features.collect()] == ["a b"]
    assert [(r.t, "cannot encode" in r.reason) for r in failures.collect()] == [("bad", True)]


def test_epoch_plan_needs_enough_shards(spark):
    df = spark.range(100).withColumn("shard", F.col("id") % 3)
    got = P.epoch_plan(df, 8, 1, 2, shards="shard").first()
    assert (got.num_batches, got.epoch_samples, got.worker_batches) == (14, 112, 7)
    assert P.epoch_plan(df, 8, 1, 2, floor=True).first().num_batches == 12
    with pytest.raises(Exception, match="number of shards"):
        P.epoch_plan(df, 8, 2, 2, shards="shard").collect()
    with pytest.raises(Exception, match="must be specified"):
        P.dataset_size(df.limit(0), "shard").collect()


def test_weighted_shards(spark):
    got = P.weighted_shards(spark, "/x/a-{0..3}.tar::/x/b-{0..1}.tar", "1::4", 3000).collect()
    assert len(got) == 3000
    share = sum("/b-" in r.path for r in got) / 3000
    assert 0.6 < share < 0.74
    with pytest.raises(ValueError):
        P.weighted_shards(spark, "a::b", "1", 5)


def test_verifier_isolates_failures(spark):
    listing = spark.createDataFrame([("/r/coco/images/1.jpg",), ("/r/coco/ann.json",)], "path string")
    good = lambda: spark.range(20).select(F.col("id").alias("row_id"), F.lit(True).alias("passed"))
    sets = [
        Q.DatasetCheck("coco", ["/r/coco/images", "/r/coco/ann.json"], good),
        Q.DatasetCheck("lost", ["/r/lost"], lambda: good().withColumn("passed", F.col("row_id") < 0)),
        Q.DatasetCheck("empty", [], lambda: good().limit(0)),
        Q.DatasetCheck("gated", ["/r/gated"], None, gated=True, note="terms"),
        Q.DatasetCheck("broken", [], lambda: spark.read.parquet("/nowhere/at/all")),
    ]
    got = {r.name: r for r in Q.report_state(Q.verify_datasets(spark, sets, listing)).collect()}
    assert {n: r.state for n, r in got.items()} == {
        "coco": "ok", "lost": "needs_attention", "empty": "needs_attention", "gated": "gated_or_auth_required", "broken": "needs_attention",
    }
    assert got["lost"].messages == ["missing: /r/lost", "sample checks passed 0/8"]
    assert got["gated"].checked_files_exist and not got["gated"].sample_read_success
    assert got["broken"].status_hint == "error" and got["broken"].messages[0].startswith("verification exception")


def test_skip_reasons(spark):
    df = spark.createDataFrame([("b", "image not found: x"), ("b", "image not found: y"), ("b", "other")], "benchmark string, reason string")
    assert rows(Q.skip_reasons(df)) == [("b", "image not found", 2), ("b", "other", 1)]


def test_epoch_shuffle_order(spark):
    """Partitions follow each other in the order of the draws, and epochs differ."""
    df = spark.range(2000).withColumn("x", F.lit(1))
    shuffled = P.epoch_shuffle(df, "id", 1, 0)
    first = [r.id for r in shuffled.collect()]
    placed = P.epoch_shuffle(df, "id", 1, 0, position="p")
    assert first == [r.id for r in placed.orderBy("p").collect()]
    assert first == [r.id for r in P.epoch_shuffle(df.repartition(3), "id", 1, 0).collect()]
    assert first != [r.id for r in P.epoch_shuffle(df, "id", 1, 1).collect()]
    sizes = [n for (n,) in shuffled.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) > 1 and max(sizes) < 2 * min(sizes)


def test_dense_index_runs_over_hot_leading_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id")).alias("a"), "id")
    got = dense_index(df, "a", "id").orderBy("a", "id").collect()
    assert [r.idx for r in got] == list(range(3000))


def test_balanced_limit_with_more_categories_than_turns(spark):
    """Categories run dry at once, and there are far more of them than the limit."""
    data = [(100 * c + i, f"c{c:03d}") for c in range(60) for i in range(1 + c % 2)]
    df = spark.createDataFrame(data, "i int, c string")
    counts = {}
    for _, c in data:
        counts[c] = counts.get(c, 0) + 1
    quotas = turns(counts, 7)
    want = sorted(i for i, c in data if i % 100 < quotas[c])
    assert sorted(r.i for r in P.balanced_limit(df, "c", "i", 7).collect()) == want
