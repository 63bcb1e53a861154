"""Registered queries: all-pairs scoring in tiles, ranks, recall, top-k and re-ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import rounded
from ..operators import retrieval as V
from . import fixtures as fx
from . import sqltext as q
from .registry import Tables, query
from .score_queries import tidy

TIE = "1e-9"


def _sides(dims: int | None = None) -> str:
    u = q.unit("embedding", dims)
    return f"""i AS MATERIALIZED (SELECT vec_id AS image_id, {u} AS u FROM embeddings WHERE vec_id % 6 = 0),
    c AS MATERIALIZED (SELECT vec_id AS text_id, vec_id - vec_id % 6 AS image_id, {u} AS u FROM embeddings WHERE vec_id % 6 <> 0)"""


SIM = f"""{_sides()}, own AS (SELECT text_id, c.image_id, {q.dot("i.u", "c.u")} AS s FROM c JOIN i USING (image_id)),
    thr AS (SELECT image_id, max(s) AS thr FROM own GROUP BY image_id),
    sim AS MATERIALIZED (SELECT i.image_id, c.text_id, {q.dot("i.u", "c.u")} AS s FROM i JOIN thr USING (image_id), c)"""
RANKS = f"""{SIM},
    ri AS (SELECT sim.image_id AS id, count(*) FILTER (s > thr + {TIE}) + 1 AS rank FROM sim JOIN thr USING (image_id) GROUP BY 1),
    rt AS (SELECT sim.text_id AS id, count(*) FILTER (sim.s > own.s + {TIE}) + 1 AS rank FROM sim JOIN own USING (text_id) GROUP BY 1)"""
RECALL = f"""count(*) AS n, {q.rnd("avg((rank <= 1)::int) * 100")} AS r_at_1, {q.rnd("avg((rank <= 5)::int) * 100")} AS r_at_5,
    {q.rnd("avg((rank <= 10)::int) * 100")} AS r_at_10, {q.rnd("avg(rank)")} AS mean_rank, quantile_disc(rank, 0.5) AS median_rank"""


@query(
    "j5_all_pairs_similarity",
    f"""WITH {_sides()} SELECT i.image_id, count(*) AS n_texts, {q.rnd(f"max({q.dot('i.u', 'c.u')})")} AS max_sim,
        {q.rnd(f"min({q.dot('i.u', 'c.u')})")} AS min_sim, {q.rnd(f"avg({q.dot('i.u', 'c.u')})")} AS mean_sim FROM i, c GROUP BY i.image_id""",
)
def _(t: Tables) -> DataFrame:
    return tidy(V.similarity_summary(fx.images(t), fx.captions(t)))


@query(
    "v8_blocked_top5",
    f"""WITH {SIM} SELECT image_id, text_id, {q.rnd("s")} AS sim, rn::int AS rn FROM (
          SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(s, 12) DESC, text_id) AS rn FROM sim) WHERE rn <= 5""",
)
def _(t: Tables) -> DataFrame:
    # Small blocks, so that walks have many of them to leave out.
    found = V.top_pairs(fx.images(t), fx.captions(t), 5, tile_rows=128, sides=("i",))
    return found.select("image_id", "text_id", rounded(F.col("sim")).alias("sim"), "rn")


@query("r1_image_to_text_rank", f"WITH {RANKS} SELECT id AS image_id, rank FROM ri")
def _(t: Tables) -> DataFrame:
    ranks = V.retrieval_ranks(fx.images(t), fx.captions(t))
    return ranks.where(F.col("side") == "i").select(F.col("id").alias("image_id"), "rank")


@query("r2_text_to_image_rank", f"WITH {RANKS} SELECT id AS text_id, rank FROM rt")
def _(t: Tables) -> DataFrame:
    ranks = V.retrieval_ranks(fx.images(t), fx.captions(t), tile_rows=256)
    return ranks.where(F.col("side") == "t").select(F.col("id").alias("text_id"), "rank")


@query(
    "r3_recall_metrics",
    f"WITH {RANKS} SELECT 'i' AS side, {RECALL} FROM ri UNION ALL SELECT 't' AS side, {RECALL} FROM rt",
)
def r3(t: Tables) -> DataFrame:
    return tidy(V.recall_metrics(V.retrieval_ranks(fx.images(t), fx.captions(t))))


@query(
    "r4_paired_retrieval_metrics",
    f"""WITH u AS (SELECT vec_id, {q.unit("embedding")} AS u FROM embeddings),
    i AS (SELECT vec_id // 2 AS id, u FROM u WHERE vec_id % 2 = 0), c AS (SELECT vec_id // 2 AS id, u FROM u WHERE vec_id % 2 = 1),
    own AS (SELECT id, {q.dot("i.u", "c.u")} AS s FROM i JOIN c USING (id)),
    sim AS (SELECT i.id AS a, c.id AS b, {q.dot("i.u", "c.u")} AS s FROM i, c),
    ri AS (SELECT a AS id, count(*) FILTER (sim.s > own.s + {TIE} OR (abs(sim.s - own.s) <= {TIE} AND b < a)) + 1 AS rank FROM sim JOIN own ON own.id = a GROUP BY 1),
    rt AS (SELECT b AS id, count(*) FILTER (sim.s > own.s + {TIE} OR (abs(sim.s - own.s) <= {TIE} AND a < b)) + 1 AS rank FROM sim JOIN own ON own.id = b GROUP BY 1)
    SELECT 'i' AS side, {RECALL} FROM ri UNION ALL SELECT 't' AS side, {RECALL} FROM rt""",
)
def _(t: Tables) -> DataFrame:
    return tidy(V.recall_metrics(V.paired_ranks(fx.pairs(t))))


def _candidates(k: int) -> str:
    return f"""SELECT image_id, text_id, any_value(s) AS s FROM (
        SELECT image_id, text_id, s, row_number() OVER (PARTITION BY image_id ORDER BY round(s, 12) DESC, text_id) AS a,
          row_number() OVER (PARTITION BY text_id ORDER BY round(s, 12) DESC, image_id) AS b FROM sim)
        WHERE a <= {k} OR b <= {k} GROUP BY image_id, text_id"""


@query("r5_u3_bidirectional_top_k", f"WITH {SIM} SELECT image_id, text_id, {q.rnd('s')} AS sim FROM ({_candidates(10)})")
def _(t: Tables) -> DataFrame:
    return tidy(V.candidate_pairs(fx.images(t), fx.captions(t), 10))


def _coarse(df: DataFrame) -> DataFrame:
    return df.withColumn("feature", F.slice("feature", 1, 32))


RERANKED = f"""{SIM.replace(q.unit("embedding"), q.unit("embedding", 32))}, cand AS MATERIALIZED ({_candidates(10)}),
    fine AS MATERIALIZED (SELECT image_id, text_id, {q.dot("a.u", "b.u")} AS s FROM cand
      JOIN (SELECT vec_id AS image_id, {q.unit("embedding")} AS u FROM embeddings) a USING (image_id)
      JOIN (SELECT vec_id AS text_id, {q.unit("embedding")} AS u FROM embeddings) b USING (text_id)),
    mixed AS MATERIALIZED (SELECT sim.image_id, sim.text_id, coalesce(fine.s, sim.s) AS s FROM sim LEFT JOIN fine USING (image_id, text_id))"""


@query(
    "j10_rerank_overwrite",
    f"""WITH {RERANKED} SELECT text_id, image_id, {q.rnd("s")} AS sim FROM mixed WHERE image_id = text_id - text_id % 6""",
)
def _(t: Tables) -> DataFrame:
    """Scores of matching pairs, exact where the pair is a candidate."""
    images, captions = fx.images(t), fx.captions(t)
    coarse = V.positive_scores(V.normalized(_coarse(images)), V.normalized(_coarse(captions))).withColumnRenamed("score", "sim")
    candidates = V.candidate_pairs(_coarse(images), _coarse(captions), 10)
    exact = V.exact_by_features(images, captions)(candidates)
    return tidy(V.overwrite_scores(coarse, exact).select("text_id", "image_id", "sim"))


@query(
    "r6_prune_then_rescore",
    f"""WITH {RERANKED}, o2 AS (SELECT text_id, image_id, s FROM mixed WHERE image_id = text_id - text_id % 6),
    t2 AS (SELECT image_id, max(s) AS thr FROM o2 GROUP BY image_id),
    ri AS (SELECT mixed.image_id AS id, count(*) FILTER (s > thr + {TIE}) + 1 AS rank FROM mixed JOIN t2 USING (image_id) GROUP BY 1),
    rt AS (SELECT mixed.text_id AS id, count(*) FILTER (mixed.s > o2.s + {TIE}) + 1 AS rank FROM mixed JOIN o2 USING (text_id) GROUP BY 1)
    SELECT 'global_topk_exact_rerank' AS protocol, 'i' AS side, {RECALL} FROM ri
    UNION ALL SELECT 'global_topk_exact_rerank' AS protocol, 't' AS side, {RECALL} FROM rt""",
)
def _(t: Tables) -> DataFrame:
    """Candidates by the first 32 dimensions, exact scores by all 64."""
    images, captions = fx.images(t), fx.captions(t)
    ranks = V.rerank_ranks(_coarse(images), _coarse(captions), 10, V.exact_by_features(images, captions))
    return tidy(V.recall_metrics(ranks).withColumn("protocol", V.protocol(F.lit("rerank_topk"))))


def _gappy_sides() -> str:
    """Every third image and every seventh caption without a vector, one caption in eleven with a narrower one."""
    return f"""WITH raw AS (SELECT vec_id, CASE WHEN vec_id % 18 = 0 OR vec_id % 7 = 3 THEN NULL
          WHEN vec_id % 11 = 5 AND vec_id % 6 <> 0 THEN embedding[1:32] ELSE embedding END AS e FROM embeddings),
      good AS (SELECT vec_id, {q.unit("e")} AS u FROM raw WHERE e IS NOT NULL AND len(e) = 64),
      i AS (SELECT vec_id AS image_id, u FROM good WHERE vec_id % 6 = 0),
      c AS (SELECT vec_id AS text_id, vec_id - vec_id % 6 AS image_id, u FROM good WHERE vec_id % 6 <> 0),
      own AS (SELECT text_id, c.image_id, {q.dot("i.u", "c.u")} AS s FROM c JOIN i USING (image_id))"""


def _gappy(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = F.col("embedding")
    gone = (F.col("vec_id") % 18 == 0) | (F.col("vec_id") % 7 == 3)
    narrow = (F.col("vec_id") % 11 == 5) & (F.col("vec_id") % 6 != 0)
    broken = t.embeddings.withColumn("feature", F.when(gone, F.lit(None)).when(narrow, F.slice(e, 1, 32)).otherwise(e))
    images = broken.where("vec_id % 6 = 0").select(F.col("vec_id").alias("image_id"), "feature")
    texts = broken.where("vec_id % 6 <> 0")
    return images, texts.select(F.col("vec_id").alias("text_id"), (F.col("vec_id") - F.col("vec_id") % 6).alias("image_id"), "feature")


@query(
    "r1_r2_ranks_with_gaps",
    f"""{_gappy_sides()},
    thr AS (SELECT image_id, max(s) AS thr FROM own GROUP BY image_id),
    sim AS (SELECT i.image_id, c.text_id, {q.dot("i.u", "c.u")} AS s FROM i JOIN thr USING (image_id), c JOIN own USING (text_id))
    SELECT 'i' AS side, sim.image_id AS id, count(*) FILTER (s > thr + {TIE}) + 1 AS rank FROM sim JOIN thr USING (image_id) GROUP BY 2
    UNION ALL SELECT 't', sim.text_id, count(*) FILTER (sim.s > own.s + {TIE}) + 1 FROM sim JOIN own USING (text_id) GROUP BY 2""",
)
def _(t: Tables) -> DataFrame:
    """Captions whose image has no vector are not ranked, nor are images without any caption left."""
    return V.retrieval_ranks(*_gappy(t), tile_rows=64)


@query(
    "r1_r2_set_aside",
    f"""{_gappy_sides()}
    SELECT vec_id - vec_id % 6 AS image_id, vec_id AS text_id, CASE WHEN raw.e IS NULL THEN 'caption has no vector'
        WHEN len(raw.e) <> 64 THEN 'caption has a vector of another width' ELSE 'image of the caption takes no part' END AS reason
      FROM raw WHERE vec_id % 6 <> 0 AND vec_id NOT IN (SELECT text_id FROM own)
        AND (raw.e IS NULL OR len(raw.e) <> 64 OR (vec_id - vec_id % 6) IN (SELECT vec_id FROM raw))
    UNION ALL SELECT vec_id, NULL, CASE WHEN raw.e IS NULL THEN 'image has no vector' ELSE 'image has no caption that takes part' END
      FROM raw WHERE vec_id % 6 = 0 AND (raw.e IS NULL OR vec_id NOT IN (SELECT image_id FROM c))""",
)
def _(t: Tables) -> DataFrame:
    return V.set_aside(*_gappy(t))


def _conditioned(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Images as four tokens, captions as two cues and a feature, all sixteen wide."""
    part = lambda k: F.slice("feature", 16 * k + 1, 16).cast("array<double>")
    images = fx.images(t).withColumn("tokens", F.array(*[part(k) for k in range(4)]))
    captions = fx.captions(t).withColumns({"cues": F.array(part(0), part(1)), "text_feature": part(3)})
    return images, captions


_WIDE = lambda c, k: f"list_transform({c}[{16 * k + 1}:{16 * k + 16}], lambda x: x::DOUBLE)"
CONDITIONED = f"""WITH i AS (SELECT vec_id AS image_id, [{", ".join(_WIDE("embedding", k) for k in range(4))}] AS tokens FROM embeddings WHERE vec_id % 6 = 0),
    c AS (SELECT vec_id AS text_id, vec_id - vec_id % 6 AS image_id, {_WIDE("embedding", 0)} AS cue_a, {_WIDE("embedding", 1)} AS cue_b,
      {_WIDE("embedding", 3)} AS f FROM embeddings WHERE vec_id % 6 <> 0),
    e AS MATERIALIZED (SELECT i.image_id AS img, text_id, c.image_id AS own_img, tokens, f, list_transform(tokens, lambda x: exp(list_inner_product(x, cue_a))) AS a,
      list_transform(tokens, lambda x: exp(list_inner_product(x, cue_b))) AS b
      FROM i, c WHERE i.image_id IN (SELECT image_id FROM c) AND c.image_id IN (SELECT image_id FROM i)),
    w AS (SELECT img, text_id, own_img, tokens, f, list_transform([1, 2, 3, 4], lambda k: (a[k] / list_sum(a) + b[k] / list_sum(b)) / 2) AS w FROM e),
    p AS (SELECT img, text_id, own_img, f, list_transform(range(1, 17), lambda d: w[1] * tokens[1][d] + w[2] * tokens[2][d] + w[3] * tokens[3][d] + w[4] * tokens[4][d]) AS p FROM w),
    sim AS MATERIALIZED (SELECT img AS image_id, text_id, own_img, list_inner_product(p, f)
      / (greatest(sqrt(list_inner_product(p, p)), 1e-12) * greatest(sqrt(list_inner_product(f, f)), 1e-12)) AS s FROM p),
    own AS (SELECT text_id, image_id, s FROM sim WHERE image_id = own_img),
    thr AS (SELECT image_id, max(s) AS thr FROM own GROUP BY image_id),
    ri AS (SELECT sim.image_id AS id, count(*) FILTER (s > thr + {TIE}) + 1 AS rank FROM sim JOIN thr USING (image_id) GROUP BY 1),
    rt AS (SELECT sim.text_id AS id, count(*) FILTER (sim.s > own.s + {TIE}) + 1 AS rank FROM sim JOIN own USING (text_id) GROUP BY 1)"""


@query("j5_v8_conditioned_ranks", f"{CONDITIONED} SELECT 'i' AS side, id, rank FROM ri UNION ALL SELECT 't', id, rank FROM rt")
def _(t: Tables) -> DataFrame:
    """Every pair scored by a scorer of three tensors."""
    return V.conditioned_ranks(*_conditioned(t), V.AttentionScorer, tile_rows=128)


def _flat(side: str) -> str:
    names = {"1": "r@1", "5": "r@5", "10": "r@10"}
    at = ", ".join(f"{q.rnd(f'avg((rank <= {k})::int) * 100')} AS \"{side}_{n}\"" for k, n in names.items())
    return f'{at}, {q.rnd("avg(rank)")} AS "{side}_mean_rank", quantile_disc(rank, 0.5) AS "{side}_median_rank"'


@query(
    "r6_conditioned_full_report",
    f"""{CONDITIONED}, mi AS (SELECT count(*) AS num_images, {_flat("i2t")} FROM ri), mt AS (SELECT count(*) AS num_captions, {_flat("t2i")} FROM rt)
    SELECT 'attention' AS model, 'ok' AS status, NULL::VARCHAR AS reason, 'full_exact_conditioned' AS retrieval_protocol, * FROM mi, mt
    UNION ALL BY NAME SELECT 'dual' AS model, 'unsupported' AS status, '{V.UNSUPPORTED}' AS reason""",
)
def _(t: Tables) -> DataFrame:
    """Every pair by the model that can, a status row for the one that cannot."""
    images, captions = _conditioned(t)
    models = [V.RetrievalModel("attention", images, captions, V.AttentionScorer), V.RetrievalModel("dual", fx.images(t), fx.captions(t))]
    return tidy(V.retrieval_report(models, "full"))
