"""End-to-end evaluation runs: pair scores to leaderboard, and retrieval to metric rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieval as V
from ..operators import summaries as S
from ..operators.negatives import explode_negatives, random_negatives
from ..operators.scoring import image_key, score_specs, with_margins
from ..session import materialize
from ..sinks.results import write_results, write_skipped, write_summaries


def build_specs(samples: DataFrame, order: Sequence[str] = ("benchmark", "sample_id"), seed: int = 42) -> DataFrame:
    """One row per sample and negative, with a random negative and the key of its image.

    Random negatives are drawn over all samples given; call it per benchmark to
    draw within each.
    """
    drawn = random_negatives(samples, list(order), seed=seed)
    specs = explode_negatives(drawn)
    return specs.withColumn("image_key", image_key(F.col("image_path"), F.col("crop_box")))


def score_pairwise(
    specs: DataFrame, images: DataFrame, texts: DataFrame, folder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(scores, skipped) of all models in the feature tables.

    Specs are repeated for each model of `images` (model_name, image_key,
    feature). Scores are stored, as result lines under `folder` if given, since
    every summary reads them.
    """
    # A handful of model names; each spec is repeated for each of them.
    names = [r[0] for r in images.select("model_name").distinct().collect()]
    repeated = specs.withColumn("model_name", F.explode(F.array(*[F.lit(n) for n in names])))
    good, bad = score_specs(repeated, images, texts, ["benchmark", "sample_id", "negative_index"])
    scores = materialize(with_margins(good), "scores")
    if folder:
        write_results(scores.drop("image_key"), f"{folder}/raw_results")
        write_skipped(
            bad.select("benchmark", "source_file", "sample_id", "reason").distinct(), specs.sparkSession, f"{folder}/skipped_samples"
        )
    return scores, bad


def summary_set(models: DataFrame, pairwise: DataFrame, two_by_two: DataFrame) -> dict[str, DataFrame]:
    """The eight named summaries of stored pairwise and 2x2 scores.

    `models` is (model_name, model_type) of every registered model.
    """
    out = {
        "summary_aro_by_category": S.summarize_by_category(pairwise),
        "summary_sugarcrepe_by_category": S.summarize_by_subcategory(pairwise),
        "summary_winoground": S.summarize_2x2(two_by_two),
        "summary_pairwise_by_benchmark": S.summarize_by_benchmark(pairwise),
        "summary_2x2_by_benchmark": S.summarize_2x2_by_benchmark(two_by_two),
        "summary_margins": S.summarize_margins(pairwise),
        "summary_ssr": S.summarize_ssr(pairwise),
    }
    # Summaries are a few rows each; stored, the leaderboard and exports need no second pass.
    stored = {name: materialize(df, name) for name, df in out.items()}
    stored["summary_all_models"] = S.leaderboard(
        models,
        stored["summary_aro_by_category"],
        stored["summary_sugarcrepe_by_category"],
        stored["summary_winoground"],
        stored["summary_margins"],
        stored["summary_ssr"],
        stored["summary_pairwise_by_benchmark"],
        stored["summary_2x2_by_benchmark"],
    )
    return stored


def export_summaries(summaries: dict[str, DataFrame], folder: str) -> list[str]:
    """CSV per summary; the internal `level` column is left out."""
    return write_summaries({n: df.drop("level") for n, df in summaries.items()}, f"{folder}/summaries")


@dataclass
class RetrievalRun:
    """One model on one data set: feature tables and, for re-ranking, an exact scorer."""

    model: str
    dataset: str
    split: str
    images: DataFrame
    captions: DataFrame
    exact: Callable[[DataFrame], DataFrame] | None = None


def evaluate_retrieval(runs: Sequence[RetrievalRun], mode: str = "global", topk: int = 100) -> list[DataFrame]:
    """One metric row per run, ready for `write_metric_rows`.

    Mode `global` ranks by the features alone; `rerank_topk` gives the top
    candidates exact scores where the run has a scorer and otherwise ranks by
    the features. A run that cannot be evaluated yields a row with its status
    and reason, and the others go on.
    """
    if mode not in V.PROTOCOLS:
        raise ValueError(f"Unsupported retrieval mode: {mode}")
    out = []
    for run in runs:
        spark = run.images.sparkSession
        named = {"model": run.model, "dataset": run.dataset, "split": run.split}
        try:
            rerank = mode == "rerank_topk" and run.exact is not None
            ranks = (
                V.rerank_ranks(run.images, run.captions, topk, run.exact)
                if rerank
                else V.retrieval_ranks(run.images, run.captions)
            )
            row = V.flat_metrics(V.recall_metrics(ranks))
            facts = {
                **named,
                "status": "ok",
                "retrieval_protocol": V.PROTOCOLS[mode if rerank else "global"],
                "retrieval_mode": mode,
                "rerank_topk": topk if mode == "rerank_topk" else None,
                "num_images": run.images.count(),
                "num_captions": run.captions.count(),
            }
            types = {"rerank_topk": "int", "num_images": "bigint", "num_captions": "bigint"}
            out.append(row.select("*", *[F.lit(v).cast(types.get(n, "string")).alias(n) for n, v in facts.items()]))
        except Exception as exc:
            reason = (str(exc).strip().splitlines() or [type(exc).__name__])[0]
            failed = {**named, "status": "failed", "reason": reason}
            out.append(spark.createDataFrame([tuple(failed.values())], ", ".join(f"{n} string" for n in failed)))
    return out
