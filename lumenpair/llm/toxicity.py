"""Toxicity by a classifier chain.

The categories are predicted one after another by linear models over the word
stems of a text (the first four and the first five letters of each word, so that
inflected forms count together). Each model also sees the probabilities of the categories before it;
for training these come out of folds, so that no row is judged by a model that
has seen it.

The chain is fitted on at most `max_rows` labelled rows (the first in the order
of a hash of the id), a documented bound; it scores every row on its whole text.

Defined results: a text with no stem that a model knows, such as a null or empty
one, gets probability 0, as do all texts where no stem tells the classes apart or
no row is labelled. A null label is no training row. Repeated rows stay. An empty
table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .frames import whole_text

WORD = re.compile(r"[^\W\d_]+")
BIAS = ""  # no word is empty
STEPS = 80
RATE = 0.15
PENALTY = 0.05
LEAST_Z = 5.0


def words_of(text: str) -> set[str]:
    """The distinct stems of the lower-cased words of letters; a dash ends a word that is no longer than its stem."""
    words = set(WORD.findall(text.lower()))
    long = [w for w in words if len(w) > 5]
    return {w[:5] for w in long} | {w[:4] for w in long} | {w + "-" for w in words if len(w) <= 5}


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Word weights (the bias under the empty word) and one weight for each earlier category."""

    weights: dict[str, float]
    earlier: list[float]

    def score(self, found: set[str], before: Sequence[float]) -> float:
        words = found & self.weights.keys()
        if not words:
            return 0.0  # nothing to judge by
        z = self.weights.get(BIAS, -40.0) + sum(map(self.weights.__getitem__, sorted(words)))
        return float(sigmoid(z + sum(w * p for w, p in zip(self.earlier, before))))


def fit_linear(word_sets: Sequence, before: np.ndarray, y: np.ndarray, least: int) -> Model:
    """Logistic regression with an L2 penalty, by Adam steps over all rows, with the classes weighted evenly.

    Left out are stems in fewer than `least` rows and those whose share of rows
    differs by less than `LEAST_Z` standard errors between the classes.
    """
    lengths = np.array([len(s) for s in word_sets])
    flat = np.concatenate([np.asarray(s, dtype=object) for s in word_sets]) if lengths.sum() else np.array([], object)
    codes, names = pd.factorize(flat, sort=True)
    rows = np.repeat(np.arange(len(y)), lengths)
    all_rows = np.bincount(codes, minlength=len(names))
    positive_rows = np.bincount(codes, y[rows], minlength=len(names))
    n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    share = all_rows / max(1, len(y))
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    gap = np.abs(positive_rows / n1 - (all_rows - positive_rows) / n0)
    kept = (all_rows >= least) & (gap >= LEAST_Z * error)
    place = np.cumsum(kept) - 1
    chosen = kept[codes] if len(codes) else np.array([], bool)
    rows, codes, names = rows[chosen], place[codes[chosen]], np.asarray(names, object)[kept]
    n, d, e = len(y), len(names), before.shape[1]
    w = np.zeros(d + e + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    positive = max(1.0, y.sum())
    share = np.where(y == 1, 0.5 / positive, 0.5 / max(1.0, n - y.sum()))
    dense = np.hstack([before, np.ones((n, 1))])
    for step in range(1, STEPS + 1):
        z = np.bincount(rows, w[:d][codes], minlength=n) + dense @ w[d:]
        gap = (sigmoid(z) - y) * share
        grad = np.concatenate([np.bincount(codes, gap[rows], minlength=d), dense.T @ gap])
        grad[:-1] += PENALTY * w[:-1] / positive
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = dict(zip(names.tolist(), w[:d].tolist()))
    weights[BIAS] = float(w[-1])
    return Model(weights, w[d : d + e].tolist())


def training_rows(
    docs: DataFrame, labels: DataFrame, categories: dict[str, str], folds: int, max_rows: int, key: str, text: str
) -> DataFrame:
    """The labelled sample: `__id`, `__words`, `__fold` and one 0/1 column for each category.

    One row for each id: of repeated labels the largest counts.
    """
    id_ = F.col(key)
    drawn = (
        labels.select(id_.alias("__id"), *[F.expr(c).cast("int").alias(f"__y{i}") for i, c in enumerate(categories.values())])
        .dropna()
        .groupBy("__id")
        .agg(*[F.max(f"__y{i}").alias(f"__y{i}") for i in range(len(categories))])
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_rows)
        .withColumn("__fold", F.pmod(F.xxhash64("__id", F.lit("fold")), F.lit(folds)).cast("int"))
    )
    drawn = materialize(drawn, "labels")
    # At most max_rows narrow rows, so the texts stay where they are.
    texts = docs.select(id_.alias("__id"), whole_text(text).alias("__text")).join(F.broadcast(drawn), "__id")
    names = [c for c in texts.columns if c != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(words_of(t)) for t in batch.column("__text").to_pylist()]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(words, pa.list_(pa.string()))], names=[*names, "__words"]
            )

    schema = ", ".join(f"{c} {t}" for c, t in texts.dtypes if c != "__text") + ", __words array<string>"
    return materialize(texts.mapInArrow(run, schema).dropDuplicates(["__id"]), "training")


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, str],
    folds: int = 3,
    max_rows: int = 8000,
    least: int = 5,
    key: str = "doc_id",
    text: str = "text",
) -> list[Model]:
    """One model for each category in the given order; the values are SQL conditions over `labels`."""
    sample = training_rows(docs, labels, categories, folds, max_rows, key, text)
    models: list[Model] = []
    for i in range(len(categories)):
        last = i == len(categories) - 1
        earlier = [f"__p{j}" for j in range(i)]

        def fit(part: pd.DataFrame) -> pd.DataFrame:
            # One group is one fit over the bounded sample: fold `fit` held out, or none.
            held = int(part["__fit"].iloc[0])
            part = part.sort_values("__id", ignore_index=True)
            out = (part["__fold"] == held).to_numpy()
            seen = part[~out]
            if not len(seen):
                model = Model({}, [0.0] * i)
            else:
                before = seen[earlier].to_numpy(float).reshape(len(seen), i)
                model = fit_linear(list(seen["__words"]), before, seen[f"__y{i}"].to_numpy(float), least)
            if held < 0:
                items = [(w, model.weights[w]) for w in sorted(model.weights)]
                items += [(str(j), x) for j, x in enumerate(model.earlier)]
                words, values = [w for w, _ in items], [x for _, x in items]
                return pd.DataFrame({"__id": [None], "p": [None], "words": [words], "weights": [values]})
            rest = part[out]
            before = rest[earlier].to_numpy(float).reshape(len(rest), i)
            p = [model.score(set(w), b) for w, b in zip(rest["__words"], before)]
            return pd.DataFrame({"__id": rest["__id"], "p": p, "words": [None] * len(rest), "weights": None})

        fits = [-1] if last else [-1, *range(folds)]
        fitted = materialize(
            sample.withColumn("__fit", F.explode(F.array(*map(F.lit, fits))))
            .groupBy("__fit")
            .applyInPandas(fit, f"__id {dict(sample.dtypes)['__id']}, p double, words array<string>, weights array<double>"),
            "fits",
        )
        whole = fitted.where(F.col("words").isNotNull()).select("words", "weights").first()
        if whole is None:
            models.append(Model({}, [0.0] * i))
        else:
            cut = len(whole["words"]) - i
            models.append(Model(dict(zip(whole["words"][:cut], whole["weights"][:cut])), list(whole["weights"][cut:])))
        if not last:
            judged = fitted.where(F.col("words").isNull()).select("__id", F.col("p").alias(f"__p{i}"))
            sample = sample.join(judged, "__id")
    return models


def score_chain(
    docs: DataFrame, models: list[Model], categories: Sequence[str], keep: Sequence[str] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """The columns of `keep` and `p_<category>` for every row, in one pass without a shuffle."""
    keep = list(keep)
    rows = docs.select(*keep, whole_text(text).alias("__text"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set().union(*[m.weights.keys() for m in models])
        for batch in batches:
            scores: list[list[float]] = [[] for _ in models]
            for t in batch.column("__text").to_pylist():
                found, before = words_of(t) & known, []
                for model, column in zip(models, scores):
                    before.append(model.score(found, before))
                    column.append(before[-1])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], *[pa.array(s, pa.float64()) for s in scores]],
                names=[*keep, *[f"p_{c}" for c in categories]],
            )

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], *[f"`p_{c}` double" for c in categories]])
    return rows.mapInArrow(run, schema)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, str],
    reject: str,
    threshold: float = 0.5,
    keep: Sequence[str] = ("doc_id",),
    **options,
) -> DataFrame:
    """`keep`, the chain's probabilities, and `rejected`: category `reject` at `threshold` or more."""
    models = fit_chain(docs, labels, categories, **options)
    scored = score_chain(docs, models, list(categories), keep)
    return scored.withColumn("rejected", F.col(f"p_{reject}") >= threshold)
