"""Registered queries: scoring, vector math, summaries, leaderboard, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import rounded
from ..functions.vectors import cosine, dot, l2_normalize, mean_pool, score_block
from ..operators import diagnostics as D
from ..operators import summaries as S
from ..operators.negatives import explode_negatives, random_negatives
from ..operators.ordering import one_row
from ..operators.paths import missing_members
from ..operators.scoring import CosineScorer, HashingEncoder, encode, encode_rows, score_pairs
from . import fixtures as fx
from . import sqltext as q
from .registry import Tables, query

PW, TT = fx.pairwise_sql(), fx.two_by_two_sql()


def tidy(df: DataFrame) -> DataFrame:
    """Round every double column."""
    return df.select(*[rounded(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


# --- vectors -----------------------------------------------------------------

@query(
    "v1_normalize_and_pool",
    f"""SELECT vec_id, {q.rnd("sqrt(list_dot_product(u, u))")} AS norm, {q.rnd("u[1]")} AS first,
        {q.rnd("(embedding[1]::double + embedding[33]::double) / 2")} AS pooled_first,
        {q.rnd("(embedding[32]::double + embedding[64]::double) / 2")} AS pooled_last
        FROM (SELECT *, {q.unit("embedding")} AS u FROM embeddings)""",
)
def _(t: Tables) -> DataFrame:
    v = F.col("embedding")
    rows = t.embeddings.select(
        "vec_id",
        l2_normalize(v).alias("u"),
        mean_pool(F.array(F.slice(v, 1, 32), F.slice(v, 33, 32))).alias("p"),
    )
    return rows.select(
        "vec_id",
        rounded(F.sqrt(dot(F.col("u"), F.col("u")))).alias("norm"),
        rounded(F.get("u", F.lit(0))).alias("first"),
        rounded(F.get("p", F.lit(0))).alias("pooled_first"),
        rounded(F.get("p", F.lit(31))).alias("pooled_last"),
    )


@query(
    "v2_cosine_of_pairs",
    f"""SELECT c.vec_id AS text_id, i.vec_id AS image_id, {q.rnd(q.dot(q.unit("c.embedding"), q.unit("i.embedding")))} AS score
        FROM embeddings c JOIN embeddings i ON i.vec_id = c.vec_id - c.vec_id % 6 WHERE c.vec_id % 6 <> 0""",
)
def _(t: Tables) -> DataFrame:
    own = fx.images(t).select("image_id", F.col("feature").alias("image"))
    return fx.captions(t).join(own, "image_id").select(
        "text_id", "image_id", rounded(cosine(F.col("feature"), F.col("image"))).alias("score")
    )


@query(
    "v3_pairwise_margins",
    f"""{PW} SELECT model_name, text_id::varchar AS sample_id, negative_index, negative_type, {q.rnd("score_pos")} AS score_pos,
        {q.rnd("score_neg")} AS score_neg, {q.rnd("score_random_neg")} AS score_random_neg,
        {q.rnd("hard_margin")} AS hard_margin, {q.rnd("random_margin")} AS random_margin, {q.rnd("ssr", 4)} AS ssr, correct FROM pw""",
)
def _(t: Tables) -> DataFrame:
    scores, _skipped = fx.scored_pairs(t)
    names = ["score_pos", "score_neg", "score_random_neg", "hard_margin", "random_margin"]
    return scores.select(
        "model_name", "sample_id", "negative_index", "negative_type",
        *[rounded(F.col(n)).alias(n) for n in names], rounded(F.col("ssr"), 4).alias("ssr"), "correct",
    )


@query(
    "v4_two_by_two_scores",
    f"""{TT} SELECT model_name, quad, benchmark, category, {", ".join(q.rnd(c) + " AS " + c for c in ("s00", "s01", "s10", "s11"))},
        text_score, image_score, group_score, {q.rnd("group_min_margin")} AS group_min_margin FROM tt""",
)
def _(t: Tables) -> DataFrame:
    cells = [rounded(F.col(c.upper())).alias(c) for c in ("s00", "s01", "s10", "s11")]
    return fx.two_by_two_scores(t).select(
        "model_name", "quad", "benchmark", "category", *cells, "text_score", "image_score", "group_score",
        rounded(F.col("group_min_margin")).alias("group_min_margin"),
    )


@query(
    "v5_dense_score_block",
    f"""WITH p AS (SELECT vec_id // 4 AS quad, vec_id % 4 AS pos, {q.unit("embedding")} AS u FROM embeddings)
        SELECT i.quad, i.pos::int AS image_no, (c.pos - 2)::int AS text_no, {q.rnd("list_dot_product(i.u, c.u)")} AS score
        FROM p i JOIN p c ON i.quad = c.quad AND i.pos < 2 AND c.pos >= 2""",
)
def _(t: Tables) -> DataFrame:
    place = F.col("vec_id") % 4
    at = lambda i: F.max(F.when(place == i, l2_normalize(F.col("embedding"))))
    quads = t.embeddings.groupBy(F.floor(F.col("vec_id") / 4).alias("quad")).agg(*[at(i).alias(f"v{i}") for i in range(4)])
    present = lambda *c: F.array_compact(F.array(*c))
    block = quads.select("quad", score_block(present("v0", "v1"), present("v2", "v3")).alias("m"))
    rows = block.select("quad", F.posexplode("m").alias("image_no", "row"))
    return rows.select("quad", "image_no", F.posexplode("row").alias("text_no", "s")).select(
        "quad", "image_no", "text_no", rounded(F.col("s")).alias("score")
    )


_BUCKETS = f"""buckets AS (SELECT text, {q.hkey("w")} % 32 AS b, count(*) AS c
    FROM (SELECT text, unnest(words) AS w FROM (SELECT DISTINCT text, list_filter(string_split_regex(text, '{q.SPACE}'), lambda x: x <> '') AS words FROM documents))
    GROUP BY ALL)"""


@query(
    "v6_encode_texts",
    f"""WITH {_BUCKETS} SELECT d.doc_id, coalesce(sum(b.c), 0)::double AS tokens, coalesce(max(b.c), 0)::double AS fullest,
        {q.rnd("coalesce(sqrt(sum(b.c * b.c)), 0)")} AS norm FROM documents d LEFT JOIN buckets b ON d.text = b.text GROUP BY d.doc_id""",
)
def _(t: Tables) -> DataFrame:
    rows = encode_rows(t.documents, "doc_id", "text", lambda: HashingEncoder(32))
    f = F.col("feature")
    return rows.select(
        "doc_id",
        F.aggregate(f, F.lit(0.0), lambda a, x: a + x).alias("tokens"),
        F.array_max(f).alias("fullest"),
        rounded(F.sqrt(dot(f, f))).alias("norm"),
    )


@query(
    "v7_pair_scorer",
    f"""SELECT c.vec_id AS text_id, {q.rnd(q.dot(q.unit("c.embedding"), q.unit("i.embedding")))} AS score
        FROM embeddings c JOIN embeddings i ON i.vec_id = c.vec_id - c.vec_id % 6 WHERE c.vec_id % 6 <> 0""",
)
def _(t: Tables) -> DataFrame:
    own = fx.images(t).select("image_id", F.col("feature").alias("image"))
    rows = fx.captions(t).join(own, "image_id").withColumnRenamed("feature", "text")
    scored = score_pairs(rows, ["text_id"], ["image", "text"], lambda: CosineScorer("image", "text"))
    return scored.select("text_id", rounded(F.col("score")).alias("score"))


# --- negatives and feature joins ---------------------------------------------

@query(
    "n2_random_negatives",
    f"""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n, md5(text) AS m FROM documents),
        j AS (SELECT *, {q.hkey("concat('42:', idx)")} % (n - 1) AS k FROM d)
        SELECT j.doc_id, r.m AS random_md5 FROM j JOIN d r ON r.idx = j.k + (j.k >= j.idx)::int""",
)
def _(t: Tables) -> DataFrame:
    rows = random_negatives(t.documents.select("doc_id", F.col("text").alias("positive_caption")), ["doc_id"])
    return rows.select("doc_id", F.md5("random_negative_caption").alias("random_md5"))


@query(
    "n3_explode_negatives",
    """SELECT vec_id::varchar AS sample_id, k::int AS negative_index, (vec_id + 6 + 6 * k)::varchar AS negative_caption,
       CASE k WHEN 0 THEN 'next_image' ELSE 'hard_negative' END AS negative_type
       FROM embeddings, (SELECT unnest([0, 1]) AS k) WHERE vec_id % 6 <> 0""",
)
def _(t: Tables) -> DataFrame:
    rows = explode_negatives(fx.pairwise_samples(t))
    return rows.select("sample_id", "negative_index", "negative_caption", "negative_type")


@query(
    "j4_feature_join_quarantine",
    """SELECT model_name, c.vec_id::varchar AS sample_id, k::int AS negative_index,
         CASE WHEN n.vec_id IS NULL THEN 'negative caption has no feature' ELSE 'ok' END AS outcome
       FROM (SELECT vec_id, k, vec_id + 6 + 6 * k AS neg FROM embeddings, (SELECT unnest([0, 1]) AS k) WHERE vec_id % 6 <> 0) c
       LEFT JOIN embeddings n ON n.vec_id = c.neg, (SELECT unnest(['m64', 'm32']) AS model_name)""",
)
def _(t: Tables) -> DataFrame:
    good, bad = fx.scored_pairs(t)
    cols = ["model_name", "sample_id", "negative_index"]
    return good.select(*cols, F.lit("ok").alias("outcome")).unionByName(bad.select(*cols, F.col("reason").alias("outcome")))


@query(
    "j9_encode_distinct_join_back",
    f"""SELECT count(*) AS n_rows, count(DISTINCT text) AS n_encoded, sum(len(list_filter(string_split_regex(text, '{q.SPACE}'), lambda x: x <> '')))::double AS tokens FROM documents""",
)
def _(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    features, _ = encode(docs, "text", lambda: HashingEncoder(32))
    size = F.aggregate("feature", F.lit(0.0), lambda a, x: a + x)
    lengths = features.select("text", size.alias("tokens"), F.lit(1).alias("one"))
    back = docs.join(lengths, "text").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("tokens").alias("tokens"))
    encoded = lengths.agg(F.count(F.lit(1)).alias("n_encoded"))
    return one_row(back, encoded).select("n_rows", "n_encoded", "tokens")


@query(
    "u4_members_without_label",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def _(t: Tables) -> DataFrame:
    return missing_members(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"])


# --- summaries ----------------------------------------------------------------

_AGG = f"""{q.rnd("avg(correct)")} AS accuracy, {q.rnd("avg(hard_margin)")} AS mean_margin, {q.rnd("median(hard_margin)")} AS median_margin,
    {q.rnd("stddev_samp(hard_margin)")} AS margin_std, {q.rnd("avg((score_neg >= score_pos)::int)")} AS negative_win_rate, count(*) AS sample_count"""
_AGG2 = f"""{q.rnd("avg(text_score)")} AS text_score, {q.rnd("avg(image_score)")} AS image_score, {q.rnd("avg(group_score)")} AS group_score,
    {q.rnd("avg(group_min_margin)")} AS group_min_margin_mean, {q.rnd("median(group_min_margin)")} AS group_min_margin_median, count(*) AS sample_count"""


def _leveled(where: str, keys: str, top: str, top_keys: str, agg: str = _AGG, source: str = "pw") -> str:
    return f"""SELECT 0 AS level, {keys}, {agg} FROM {source} {where} GROUP BY {keys}
        UNION ALL SELECT 1 AS level, {top}, {agg} FROM {source} {where} GROUP BY {top_keys}"""


@query("a1_summary_by_category", PW + _leveled("WHERE benchmark = 'aro'", "model_name, category", "model_name, 'overall' AS category", "model_name"))
def a1(t: Tables) -> DataFrame:
    return tidy(S.summarize_by_category(fx.pairwise_scores(t)))


@query(
    "a2_summary_by_subcategory",
    PW + _leveled("WHERE benchmark = 'sugarcrepe'", "model_name, category, subcategory", "model_name, 'overall' AS category, NULL AS subcategory", "model_name"),
)
def _(t: Tables) -> DataFrame:
    return tidy(S.summarize_by_subcategory(fx.pairwise_scores(t)))


@query(
    "a3_summary_by_benchmark",
    PW + _leveled("", "model_name, benchmark, category, subcategory", "model_name, benchmark, 'overall' AS category, NULL AS subcategory", "model_name, benchmark"),
)
def _(t: Tables) -> DataFrame:
    return tidy(S.summarize_by_benchmark(fx.pairwise_scores(t)))


@query("a4_two_by_two_summary", TT + f"SELECT model_name, {_AGG2} FROM tt WHERE benchmark = 'winoground' GROUP BY model_name")
def _(t: Tables) -> DataFrame:
    return tidy(S.summarize_2x2(fx.two_by_two_scores(t)))


@query(
    "a5_two_by_two_by_benchmark",
    TT + _leveled("", "model_name, benchmark, category", "model_name, benchmark, 'overall' AS category", "model_name, benchmark", _AGG2, "tt"),
)
def _(t: Tables) -> DataFrame:
    return tidy(S.summarize_2x2_by_benchmark(fx.two_by_two_scores(t)))


_MARGINS = """SELECT model_name, benchmark, category, avg(hard_margin) AS hard_margin_mean, median(hard_margin) AS hard_margin_median,
    avg(random_margin) AS random_margin_mean, median(random_margin) AS random_margin_median,
    avg(random_margin) - avg(hard_margin) AS hard_vs_random_gap, count(*) AS sample_count FROM pw GROUP BY model_name, benchmark, category"""
_MARGIN_COLUMNS = "model_name, benchmark, category, " + ", ".join(
    f"{q.rnd(c)} AS {c}" for c in ("hard_margin_mean", "hard_margin_median", "random_margin_mean", "random_margin_median", "hard_vs_random_gap")
) + ", sample_count"
_SSR = """SELECT model_name, benchmark, category, avg(ssr) AS SSR_mean, median(ssr) AS SSR_median,
    avg(coalesce((random_margin <= 0)::int, 0)) AS invalid_random_margin_ratio, count(*) AS sample_count FROM pw GROUP BY model_name, benchmark, category"""
_SSR_COLUMNS = f"""model_name, benchmark, category, {q.rnd("SSR_mean", 4)} AS SSR_mean, {q.rnd("SSR_median", 4)} AS SSR_median,
    {q.rnd("invalid_random_margin_ratio")} AS invalid_random_margin_ratio, sample_count"""


def _tidy_ssr(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "SSR_mean": rounded(F.col("SSR_mean"), 4),
            "SSR_median": rounded(F.col("SSR_median"), 4),
            "invalid_random_margin_ratio": rounded(F.col("invalid_random_margin_ratio")),
        }
    )


@query("a6_margin_summary", PW + f"SELECT {_MARGIN_COLUMNS} FROM ({_MARGINS})")
def _(t: Tables) -> DataFrame:
    return tidy(S.summarize_margins(fx.pairwise_scores(t)))


@query("a7_ssr_summary", PW + f"SELECT {_SSR_COLUMNS} FROM ({_SSR})")
def _(t: Tables) -> DataFrame:
    return _tidy_ssr(S.summarize_ssr(fx.pairwise_scores(t)))


def _models(t: Tables) -> DataFrame:
    """Models that have scores, and one registered without any."""
    scored = fx.pairwise_scores(t).select("model_name").distinct().withColumn("model_type", F.lit("dual_encoder"))
    spare = scored.limit(1).select(F.lit("absent").alias("model_name"), F.lit("dual_encoder").alias("model_type"))
    return scored.unionByName(spare)


def leaderboard_frame(t: Tables) -> DataFrame:
    pairwise, squares = fx.pairwise_scores(t), fx.two_by_two_scores(t)
    return S.leaderboard(
        _models(t),
        S.summarize_by_category(pairwise),
        S.summarize_by_subcategory(pairwise),
        S.summarize_2x2(squares),
        S.summarize_margins(pairwise),
        S.summarize_ssr(pairwise),
        S.summarize_by_benchmark(pairwise),
        S.summarize_2x2_by_benchmark(squares),
    )


def _pick(alias: str, agg: str, source: str, where: str) -> str:
    return f"(SELECT {q.rnd(agg)} FROM {source} x WHERE x.model_name = m.model_name AND {where}) AS {alias}"


_BOARD = ", ".join(
    [
        _pick("ARO_overall_acc", "avg(correct)", "pw", "benchmark = 'aro'"),
        *[_pick(f"ARO_{c}_acc", "avg(correct)", "pw", f"benchmark = 'aro' AND category = '{c}'") for c in ("attr", "rel", "order")],
        _pick("ARO_mean_margin", "avg(hard_margin)", "pw", "benchmark = 'aro'"),
        _pick("SugarCrepe_overall_acc", "avg(correct)", "pw", "benchmark = 'sugarcrepe'"),
        _pick("SugarCrepe_mean_margin", "avg(hard_margin)", "pw", "benchmark = 'sugarcrepe'"),
        _pick("SugarCrepePP_overall_acc", "avg(correct)", "pw", "benchmark = 'sugarcrepe_pp'"),
        _pick("SugarCrepePP_mean_margin", "avg(hard_margin)", "pw", "benchmark = 'sugarcrepe_pp'"),
        _pick("Winoground_text_score", "avg(text_score)", "tt", "benchmark = 'winoground'"),
        _pick("Winoground_image_score", "avg(image_score)", "tt", "benchmark = 'winoground'"),
        _pick("Winoground_group_score", "avg(group_score)", "tt", "benchmark = 'winoground'"),
        _pick("Winoground_group_min_margin", "avg(group_min_margin)", "tt", "benchmark = 'winoground'"),
        _pick("BiVLC_i2t_score", "avg(text_score)", "tt", "benchmark = 'bivlc'"),
        _pick("BiVLC_t2i_score", "avg(image_score)", "tt", "benchmark = 'bivlc'"),
        _pick("BiVLC_group_score", "avg(group_score)", "tt", "benchmark = 'bivlc'"),
        _pick("BiVLC_group_min_margin", "avg(group_min_margin)", "tt", "benchmark = 'bivlc'"),
        _pick("Hard_margin_mean", "avg(hard_margin_mean)", "ms", "true"),
        _pick("Random_margin_mean", "avg(random_margin_mean)", "ms", "true"),
        _pick("SSR_mean", "avg(SSR_mean)", "ss", "true").replace(", 6)", ", 4)"),
        _pick("SSR_median", "median(SSR_median)", "ss", "true").replace(", 6)", ", 4)"),
    ]
)


@query(
    "a8_j8_model_leaderboard",
    f"""{PW}, {TT[5:]}, ms AS ({_MARGINS}), ss AS ({_SSR}),
    m AS (SELECT DISTINCT model_name, 'dual_encoder' AS model_type FROM pw UNION ALL SELECT 'absent', 'dual_encoder')
    SELECT model_name, model_type, {_BOARD} FROM m""",
)
def _(t: Tables) -> DataFrame:
    board = leaderboard_frame(t)
    return tidy(board.withColumns({c: rounded(F.col(c), 4) for c in ("SSR_mean", "SSR_median")}))


@query(
    "a9_names_by_status",
    """SELECT status, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM (
         SELECT source AS name, CASE WHEN count(*) >= 60 THEN 'ready' WHEN count(*) >= 40 THEN 'partial' ELSE 'failed' END AS status
         FROM documents GROUP BY source) GROUP BY status""",
)
def _(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    status = F.when(n >= 60, "ready").when(n >= 40, "partial").otherwise("failed")
    items = t.documents.groupBy(F.col("source").alias("name")).agg(status.alias("status"))
    return S.names_by_status(items).withColumn("names", F.array_join("names", ","))


@query(
    "a10_accuracy_totals",
    PW + f"""SELECT model_name, benchmark, sum(correct)::bigint AS correct, count(*) AS total, {q.rnd("avg(correct)")} AS accuracy
        FROM pw GROUP BY model_name, benchmark""",
)
def a10(t: Tables) -> DataFrame:
    return tidy(S.accuracy_totals(fx.pairwise_scores(t)))


@query(
    "a10_two_by_two_totals",
    TT + """SELECT model_name, benchmark, sum(text_score)::bigint AS text, sum(image_score)::bigint AS image,
        sum(group_score)::bigint AS "group", count(*) AS total FROM tt GROUP BY model_name, benchmark""",
)
def _(t: Tables) -> DataFrame:
    return S.two_by_two_totals(fx.two_by_two_scores(t))


@query(
    "a11_margin_histogram",
    PW + f""", sp AS (SELECT model_name, min(hard_margin) AS lo, (max(hard_margin) - min(hard_margin)) / 30 AS w, count(*) AS n FROM pw GROUP BY model_name),
      cn AS (SELECT p.model_name, least(floor((hard_margin - lo) / w), 29)::int AS bin, count(*) AS c FROM pw p JOIN sp ON p.model_name = sp.model_name GROUP BY ALL),
      g AS (SELECT *, unnest(range(0, 30))::int AS bin FROM sp)
      SELECT g.model_name, g.bin, {q.rnd("lo + g.bin * w")} AS bin_start, coalesce(c, 0) AS count, {q.rnd("coalesce(c, 0) / (n * w)")} AS density
      FROM g LEFT JOIN cn ON g.model_name = cn.model_name AND g.bin = cn.bin""",
)
def _(t: Tables) -> DataFrame:
    return tidy(S.margin_histogram(fx.pairwise_scores(t)))


@query(
    "a12_mean_of_category_means",
    PW + f""", ms AS ({_MARGINS}) SELECT model_name, {q.rnd("avg(hard_margin_mean)")} AS hard_margin_mean,
        {q.rnd("avg(random_margin_mean)")} AS random_margin_mean FROM ms GROUP BY model_name""",
)
def _(t: Tables) -> DataFrame:
    return tidy(S.model_margin_means(S.summarize_margins(fx.pairwise_scores(t))))


def _events(t: Tables) -> DataFrame:
    """Events as perf log lines: user as rank, `k` of the JSON properties as pairs, value as time."""
    return t.events.select(
        F.lit("m64").alias("model"),
        F.col("event_type").alias("benchmark"),
        (F.col("user_id") % 8).cast("int").alias("rank"),
        F.col("event_id").alias("step"),
        F.get_json_object("props", "$.k").cast("bigint").alias("pairs"),
        (F.col("value") / 100).alias("h2d_time"),
        F.col("value").alias("gpu_time"),
    )


@query(
    "a13_perf_event_rollup",
    f"""SELECT 'm64' AS model, event_type AS benchmark, (user_id % 8)::int AS rank, count(*) AS events,
        sum((props->>'$.k')::bigint)::bigint AS pairs, {q.rnd("sum(value / 100)")} AS h2d_time, {q.rnd("sum(value)")} AS gpu_time,
        {q.rnd("sum((props->>'$.k')::bigint) / greatest(sum(value), 1e-9)")} AS pairs_per_s FROM events GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return tidy(S.perf_rollup(_events(t)))


@query(
    "a14_windowed_running_means",
    f"""WITH w AS (SELECT event_type AS benchmark, event_id // 500 AS log_window, sum(value * (props->>'$.k')::bigint) AS s,
          sum((props->>'$.k')::bigint) AS n FROM events GROUP BY ALL)
        SELECT benchmark, log_window, {q.rnd("s / greatest(n, 1)")} AS window_mean,
          {q.rnd("sum(s) OVER o / greatest(sum(n) OVER o, 1)")} AS running_mean, n::bigint AS weight
        FROM w WINDOW o AS (PARTITION BY benchmark ORDER BY log_window)""",
)
def _(t: Tables) -> DataFrame:
    return tidy(S.windowed_means(_events(t), "step", "gpu_time", "pairs", 500, ["benchmark"]))


@query(
    "t1_largest_random_hard_gap",
    PW + f", ms AS ({_MARGINS}) SELECT {_MARGIN_COLUMNS} FROM ms ORDER BY hard_vs_random_gap DESC NULLS LAST, model_name, benchmark, category LIMIT 12",
)
def _(t: Tables) -> DataFrame:
    return tidy(S.largest_gaps(S.summarize_margins(fx.pairwise_scores(t))))


@query(
    "t2_lowest_accuracy_slices",
    PW + f""", sl AS (SELECT 0 AS level, model_name, category, subcategory, {_AGG} FROM pw WHERE benchmark = 'sugarcrepe' GROUP BY ALL)
      SELECT * FROM sl ORDER BY accuracy NULLS LAST, model_name, category, subcategory NULLS FIRST LIMIT 10""",
)
def _(t: Tables) -> DataFrame:
    return S.weakest_slices(tidy(S.summarize_by_subcategory(fx.pairwise_scores(t))))


@query(
    "t3_lowest_ssr_slices",
    PW + f", ss AS ({_SSR}) SELECT {_SSR_COLUMNS} FROM ss ORDER BY ss.SSR_mean NULLS LAST, model_name, benchmark, category LIMIT 12",
)
def _(t: Tables) -> DataFrame:
    return _tidy_ssr(S.lowest_ssr(S.summarize_ssr(fx.pairwise_scores(t))))


_LINE = f"""count(*) AS sample_count, {q.rnd("avg(l_extendedprice * (1 - l_discount))", 4)} AS mean_margin,
    {q.rnd("median(l_extendedprice * (1 - l_discount))", 4)} AS median_margin, {q.rnd("stddev_samp(l_extendedprice * (1 - l_discount))", 4)} AS margin_std"""


@query(
    "a1_summary_lineitem_scale",
    f"""SELECT 0 AS level, l_returnflag, l_linestatus, {_LINE} FROM lineitem GROUP BY l_returnflag, l_linestatus
        UNION ALL SELECT 1 AS level, l_returnflag, 'overall' AS l_linestatus, {_LINE} FROM lineitem GROUP BY l_returnflag""",
)
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_returnflag", "l_linestatus", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("margin")
    )
    keys = ["l_returnflag", "l_linestatus"]
    out = S.summarize(
        rows,
        keys,
        [keys, keys[:1]],
        [F.count(F.lit(1)).alias("sample_count"), F.avg("margin").alias("mean_margin"), F.stddev_samp("margin").alias("margin_std")],
        {"median_margin": "margin"},
        "l_linestatus",
    )
    values = [rounded(F.col(c), 4).alias(c) for c in ("mean_margin", "median_margin", "margin_std")]
    return out.select("level", *keys, "sample_count", *values)


# --- feature diagnostics ------------------------------------------------------

@query(
    "d1_feature_statistics",
    f"""WITH n AS (SELECT count(*) AS n, {q.rnd("avg(x)")} AS norm_mean, {q.rnd("stddev_pop(x)")} AS norm_std
          FROM (SELECT sqrt(list_dot_product(embedding::double[], embedding::double[])) AS x FROM embeddings)),
        d AS (SELECT avg(x) AS m, var_pop(x) AS v FROM (
          SELECT unnest(embedding::double[]) AS x, unnest(range(0, len(embedding))) AS d FROM embeddings) GROUP BY d)
        SELECT n.*, {q.rnd("(SELECT avg(abs(m)) FROM d)")} AS feature_mean_abs, {q.rnd("(SELECT avg(v) FROM d)")} AS feature_variance_mean FROM n""",
)
def _(t: Tables) -> DataFrame:
    return tidy(D.feature_stats(t.embeddings, "embedding"))


@query("d2_effective_rank_spectrum")
def _(t: Tables) -> DataFrame:
    return tidy(D.spectrum(t.embeddings.select(F.col("embedding").alias("feature"))))


def _views(t: Tables) -> DataFrame:
    """Both halves of a vector as two views of one row."""
    v = F.col("embedding")
    return t.embeddings.select("vec_id", F.slice(v, 1, 32).alias("x"), F.slice(v, 33, 32).alias("y"))


_GRAM = """e AS (SELECT unnest(embedding::double[]) AS v, unnest(range(0, 64)) AS d, vec_id FROM embeddings),
    z AS (SELECT vec_id, d, v - avg(v) OVER (PARTITION BY d) AS v FROM e),
    g AS (SELECT a.d AS i, b.d AS j, sum(a.v * b.v) AS g FROM z a JOIN z b ON a.vec_id = b.vec_id GROUP BY ALL),
    s AS (SELECT sqrt(sum(g * g) FILTER (i < 32 AND j < 32)) AS xx, sqrt(sum(g * g) FILTER (i >= 32 AND j >= 32)) AS yy,
      sum(g * g) FILTER (i < 32 AND j >= 32) AS xy FROM g)"""


@query(
    "d3_d4_redundancy_and_cka",
    f"""WITH {_GRAM} SELECT (SELECT count(*) FROM embeddings) AS n, {q.rnd("sqrt(xy) / ((SELECT count(*) FROM embeddings) - 1)")} AS cross_cov_fro,
        {q.rnd("xy / greatest(xx * yy, 1e-12)")} AS linear_cka,
        (SELECT {q.rnd(f"avg(abs({q.dot(q.unit('embedding[1:32]'), q.unit('embedding[33:64]'))}))")} FROM embeddings) AS cosine_abs_mean FROM s""",
)
def _(t: Tables) -> DataFrame:
    return tidy(D.redundancy(_views(t)))


@query(
    "d5_finite_value_statistics",
    f"""SELECT event_type, count(*) FILTER (user_id % 7 = 0 OR user_id % 11 = 0) AS nonfinite_count,
        count(*) FILTER (NOT (user_id % 7 = 0 OR user_id % 11 = 0)) AS finite_count,
        {", ".join(q.rnd(f"{f}(CASE WHEN NOT (user_id % 7 = 0 OR user_id % 11 = 0) THEN value END)") + f" AS {n}" for f, n in (("min", "min"), ("max", "max"), ("avg", "mean"), ("stddev_pop", "std")))}
        FROM events GROUP BY event_type""",
)
def _(t: Tables) -> DataFrame:
    # Some users' values read as NaN and infinity.
    u = F.col("user_id")
    value = F.when(u % 7 == 0, float("nan")).when(u % 11 == 0, float("inf")).otherwise(F.col("value"))
    return tidy(D.value_stats(t.events.select("event_type", value.alias("v")), "v", ["event_type"]))


@query(
    "d6_positive_negative_logits",
    f"""WITH u AS (SELECT vec_id, {q.unit("embedding")} AS u FROM embeddings),
        s AS (SELECT i.vec_id = t.vec_id - 1 AS own, 100 * {q.dot("i.u", "t.u")} AS x FROM u i, u t WHERE i.vec_id % 2 = 0 AND t.vec_id % 2 = 1)
        SELECT count(*) FILTER (own) AS n, {q.rnd("avg(x) FILTER (own)")} AS logits_pos_mean, {q.rnd("avg(x) FILTER (NOT own)")} AS logits_neg_mean FROM s""",
)
def _(t: Tables) -> DataFrame:
    return tidy(D.logit_means(fx.pairs(t), scale=100.0))


