"""Whole evaluation runs on a small benchmark."""

import os

from pyspark.sql import functions as F

from lumenpair.plans import evaluation as E
from lumenpair.sinks.results import write_metric_rows
from lumenpair.sources import benchmarks as B


def samples(spark):
    rows = [(i, f"{i}.jpg", f"a dog number {i} runs", f"a cat number {i} runs", i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "image_id int, image_path string, true_caption string, false_caption string, k int")
    records = B.number_rows(df.withColumn("source_file", F.lit("f.json")), "image_id")
    return B.load_attribution(records.drop("k"), "attr")


def features(spark, keys, name, offset):
    one = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda d: F.sin(F.xxhash64(F.col(name), d) % 1000 + offset))
    return keys.select(F.explode(F.array(F.lit("m1"), F.lit("m2"))).alias("model_name"), name, one.alias("feature"))


def test_pairwise_run(spark, tmp_path):
    good, bad = samples(spark)
    assert bad.count() == 0
    specs = E.build_specs(good)
    assert specs.count() == 12 and specs.where("random_negative_caption = positive_caption").count() == 0
    images = features(spark, specs.select("image_key").distinct(), "image_key", 0)
    captions = specs.select(F.explode(F.array("positive_caption", "negative_caption")).alias("caption")).distinct()
    texts = features(spark, captions.where("caption != 'a cat number 3 runs'"), "caption", 1)
    scores, skipped = E.score_pairwise(specs, images, texts, str(tmp_path))
    assert scores.count() == 22 and {r.reason for r in skipped.collect()} == {"negative caption has no feature"}
    models = spark.createDataFrame([("m2", "t"), ("m1", "t"), ("m0", "t")], "model_name string, model_type string")
    squares = spark.createDataFrame(
        [], "model_name string, benchmark string, category string, text_score int, image_score int, group_score int, group_min_margin double"
    )
    out = E.summary_set(models, scores, squares)
    board = out["summary_all_models"].collect()
    assert [r.model_name for r in board] == ["m0", "m1", "m2"]
    assert board[0].ARO_overall_acc is None and board[1].ARO_overall_acc == board[1].ARO_attr_acc
    assert len(board[0]) == 23
    paths = E.export_summaries(out, str(tmp_path))
    assert len(paths) == 8 and all(os.path.isdir(p) for p in paths)


def test_retrieval_run_reports_failures(spark, tmp_path):
    images = spark.range(6).select(F.col("id").alias("image_id"), F.array(F.cos("id"), F.sin("id")).alias("feature"))
    captions = spark.range(18).select(
        F.col("id").alias("text_id"), F.floor(F.col("id") / 3).alias("image_id"), F.array(F.cos(F.col("id") / 3), F.sin(F.col("id") / 3)).alias("feature")
    )
    broken = images.drop("feature")
    runs = [E.RetrievalRun("m", "coco", "test", images, captions), E.RetrievalRun("b", "coco", "test", broken, captions)]
    rows = E.evaluate_retrieval(runs, "rerank_topk", 5)
    write_metric_rows(rows, str(tmp_path))
    got = {r.model: r for r in spark.read.json(str(tmp_path / "retrieval_metrics.json")).collect()}
    assert got["m"].status == "ok" and got["m"].retrieval_protocol == "dual_encoder_global" and got["m"].num_captions == 18
    assert got["m"]["i2t_r@1"] == 100.0
    assert got["b"].status == "failed" and got["b"].reason
