"""Corpus pipeline: five stages over documents, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenpair.llm.decontaminate import find_items, is_contaminated
from lumenpair.llm.groups import BROADCAST_BYTES
from lumenpair.llm.ngram_join import similar_groups
from lumenpair.llm.secrets import BASE_KINDS, METHOD, find_secrets, masked
from lumenpair.llm.sentencepiece_lattice import encode_documents
from lumenpair.llm.toxicity import fit_chain, score_chain
from lumenpair.session import materialize, tune

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
TOXIC = 0.3


def _packed(docs: DataFrame) -> DataFrame:
    """Each row whole in `row`, beside the columns that operators read, so that no other column can clash."""
    return docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not call toxic. Null and empty texts stay."""
    tune(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    models = fit_chain(docs, labels, CATEGORIES)
    scored = score_chain(_packed(docs), models, list(CATEGORIES), ["row"])
    return scored.where(F.col("p_toxic") < TOXIC).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the least id. Rows with the same id stay or go together."""
    tune(spark)
    groups = similar_groups(docs)
    gone = materialize(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "dropped")
    # Ids only, broadcast while they are few; beyond that the join shuffles.
    ids = F.broadcast(gone) if gone.count() * 16 <= BROADCAST_BYTES else gone
    return docs.join(ids, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    tune(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_items(_packed(docs), items, ["row"]).where(~is_contaminated()).select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced in the text; n_chars is that of the new text."""
    tune(spark)
    found = find_secrets(_packed(docs), ["row"])
    spans = F.concat(*[F.col(k) for k in (*BASE_KINDS, METHOD)])
    changed = F.size(spans) > 0
    text = masked(F.col("row.text"), spans)
    columns = {"text": text}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        columns["n_chars"] = F.when(changed, F.length(text).cast(kind)).otherwise(F.col("row.n_chars"))
    return found.select([columns.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with counts and the check of the round trip."""
    tune(spark)
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("sentencepiece", encode_pieces),
]

# Trained models, similarity components and piece lattices are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
