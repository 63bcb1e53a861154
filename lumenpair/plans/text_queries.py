"""Registered queries: caption text, record helpers, negatives, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import text as X
from ..functions.expressions import first_alias, let
from ..operators import curation as C
from ..operators import sampling as P
from ..operators.negatives import word_order_negatives
from ..operators.ordering import one_row
from ..session import spread
from . import sqltext as q
from .registry import Tables, query


def texts(t: Tables) -> DataFrame:
    """Documents, spread over the cores."""
    return spread(t.documents.select("doc_id", "text", "lang", "source"), "doc_id")


def joined(col):
    """A list as one string, so that results hold scalars only."""
    return F.array_join(col, "|")


DOC_SENTENCES = q.sentences("doc_id", "text", "documents")


@query(
    "f1_presence_filter",
    """SELECT d.doc_id, d.n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang <> 'de'""",
)
def _(t: Tables) -> DataFrame:
    """Texts outside German have a caption member, labelled documents an image member."""
    docs = t.documents.select("doc_id", "lang", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    members = F.map_filter(
        F.create_map(
            F.lit("txt"), F.when(F.col("lang") != "de", F.col("lang")),
            F.lit("webp"), F.col("quality").cast("string"),
        ),
        lambda _, v: v.isNotNull(),
    )
    return docs.where(R.has_caption_and_image(members)).select("doc_id", "n_chars")


def _metadata(t: Tables) -> DataFrame:
    """Documents with their shard metadata as JSON. By turns the success caption is the text itself, a list,
    other than the text, or missing; the default key varies as well."""
    k, text = F.col("doc_id") % 4, F.col("text")
    long_sv = (
        F.when(k == 0, text)
        .when(k == 1, F.to_json(F.array(text, F.col("source"))))
        .when(k == 2, F.concat(text, F.lit(" again")))
    )
    captions = F.map_filter(F.create_map(F.lit("raw"), F.upper("source"), F.lit("longSV"), long_sv), lambda _, v: v.isNotNull())
    default = F.when(F.col("doc_id") % 3 == 0, "longSV").when(F.col("doc_id") % 3 == 1, "raw")
    doc = F.to_json(
        F.struct(
            captions.alias("captions"),
            default.alias("default_caption_key"),
            F.when(F.col("doc_id") % 5 == 0, text).alias("shortIB_captions"),
        )
    )
    return texts(t).select("doc_id", text, doc.alias("json"))


@query(
    "f2_relabel_success_filter",
    f"""SELECT s.doc_id FROM {DOC_SENTENCES} s WHERE (s.doc_id % 4 = 1 OR (s.doc_id % 4 = 0 AND len(s.sentences) > 0)) AND s.doc_id % 3 <> 1""",
)
def _(t: Tables) -> DataFrame:
    passed = let(
        F.from_json("json", C.METADATA), lambda m: F.when(C.relabel_succeeded(m, F.col("text")), F.array(F.lit(True)))
    )
    return _metadata(t).select("doc_id", F.explode(passed)).select("doc_id")


@query(
    "f3_first_non_blank",
    f"""SELECT doc_id, md5(coalesce(nullif({q.strip("CASE WHEN lang = 'en' THEN text ELSE '  ' END")}, ''),
        nullif({q.strip("CASE WHEN lang <> 'fr' THEN concat(' ', source, ' ') END")}, ''), '')) AS picked FROM documents""",
)
def _(t: Tables) -> DataFrame:
    rows = t.documents.select(
        "doc_id",
        F.when(F.col("lang") == "en", F.col("text")).otherwise("  ").alias("longSV_captions"),
        F.when(F.col("lang") != "fr", F.concat(F.lit(" "), "source", F.lit(" "))).alias("raw_caption"),
    )
    return rows.select("doc_id", F.md5(X.first_non_blank(rows, ["longSV_captions", "longIB_captions", "raw_caption"])).alias("picked"))


@query("f4_clean_sentence", f"SELECT doc_id, {q.clean_sentence('text')} AS cleaned FROM documents")
def _(t: Tables) -> DataFrame:
    return texts(t).select("doc_id", X.clean_sentence(F.col("text")).alias("cleaned"))


@query(
    "f5_valid_sentence",
    f"""SELECT doc_id, count(*) AS parts, count(*) FILTER ({q.valid_sentence("p")}) AS valid FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) GROUP BY doc_id""",
)
def _(t: Tables) -> DataFrame:
    lines = texts(t).select("doc_id", F.explode(F.split("text", "\n")).alias("p"))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("parts"), F.count_if(X.is_valid_sentence(F.col("p"))).alias("valid")
    )


@query(
    "f6_split_sentences",
    f"SELECT doc_id, len(sentences)::int AS n, md5(array_to_string(sentences, '|')) AS joined FROM {DOC_SENTENCES}",
)
def split_documents(t: Tables) -> DataFrame:
    s = texts(t).select("doc_id", X.split_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.md5(joined("s")).alias("joined"))


_TURNS = "(SELECT conv_id, turn, text, upper(role) AS r FROM conversations)"


@query(
    "f7_caption_pool",
    f"""WITH a AS {q.sentences("conv_id, turn, r", "text", _TURNS)}, b AS {q.sentences("conv_id, turn", "r", _TURNS)}
        SELECT a.conv_id, a.turn, len(list_concat(list_concat(b.sentences, a.sentences), b.sentences))::int AS n,
          md5(array_to_string(list_concat(list_concat(b.sentences, a.sentences), b.sentences), '|')) AS joined
        FROM a JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn""",
)
def _(t: Tables) -> DataFrame:
    """Role as raw caption, text as success caption, role again as a top-level field."""
    role = F.upper("role")
    captions = F.create_map(F.lit("longSV"), F.col("text"), F.lit("raw"), role)
    pool = X.caption_pool(captions, {"raw_caption": role})
    rows = spread(t.conversations, "conv_id", "turn").select("conv_id", "turn", pool.alias("p"))
    return rows.select("conv_id", "turn", F.size("p").alias("n"), F.md5(joined("p")).alias("joined"))


@query(
    "f8_caption_source",
    f"""WITH s AS {DOC_SENTENCES}, u AS {q.sentences("doc_id", "concat(source, ' ', text)", "documents")}
        SELECT s.doc_id, CASE s.doc_id % 3 WHEN 0 THEN 'pool' WHEN 1 THEN 'caption' ELSE 'raw' END AS origin,
          md5(array_to_string(CASE WHEN s.doc_id % 3 = 1 THEN u.sentences ELSE s.sentences END, '|')) AS joined
        FROM s JOIN u ON s.doc_id = u.doc_id""",
)
def _(t: Tables) -> DataFrame:
    """By turns the caption comes from the pool, the caption field or the raw text."""
    k, text = F.col("doc_id") % 3, F.col("text")
    doc = F.to_json(
        F.struct(
            F.when(k == 0, F.create_map(F.lit("longSV"), text)).alias("captions"),
            F.when(k == 1, F.concat("source", F.lit(" "), text)).alias("caption"),
        )
    )
    rows = texts(t).select("doc_id", text, F.from_json(doc, C.METADATA).alias("m"))
    s = rows.select("doc_id", C.caption_sentences(F.col("m"), raw_text=F.col("text")).alias("s"))
    origin = F.when(k == 0, "pool").when(k == 1, "caption").otherwise("raw")
    return s.select("doc_id", origin.alias("origin"), F.md5(joined("s")).alias("joined"))


@query(
    "f9_clean_text_word_cap",
    f"""SELECT doc_id, md5({q.clean_text("text")}) AS cleaned, array_to_string({q.words("text", 12)}, ' ') AS capped FROM documents""",
)
def _(t: Tables) -> DataFrame:
    text = F.col("text")
    return texts(t).select("doc_id", F.md5(X.clean_text(text)).alias("cleaned"), X.clean_text(text, 12).alias("capped"))


@query(
    "f10_caption_text",
    f"""SELECT conv_id, turn, md5(CASE WHEN role = 'user' THEN {q.strip("text")}
        ELSE {q.strip("array_to_string(string_split(text, ' '), ' ')")} END) AS caption FROM conversations""",
)
def _(t: Tables) -> DataFrame:
    """Users' sentences have raw text, the others tokens only."""
    raw = F.when(F.col("role") == "user", F.col("text")).otherwise("")
    tokens = F.when(F.col("role") != "user", F.split("text", " "))
    return t.conversations.select("conv_id", "turn", F.md5(X.caption_text(raw, tokens)).alias("caption"))


@query(
    "f11_crop_box",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_suppkey::int - 20 AS x, (l_partkey % 400)::int AS y,
          l_quantity::int - 5 AS w, l_linenumber * 90 AS h, 320 AS iw, 240 AS ih FROM lineitem)
        SELECT l_orderkey, l_linenumber, x + greatest(1, w) AS right_edge, y + greatest(1, h) AS bottom_edge, l, t,
          greatest(l + 1, least(x + greatest(1, w), iw)) AS r, greatest(t + 1, least(y + greatest(1, h), ih)) AS b
        FROM (SELECT *, greatest(0, least(x, iw - 1)) AS l, greatest(0, least(y, ih - 1)) AS t FROM b)""",
)
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        R.crop_box(
            F.col("l_suppkey").cast("int") - 20,
            (F.col("l_partkey") % 400).cast("int"),
            F.col("l_quantity").cast("int") - 5,
            F.col("l_linenumber") * 90,
        ).alias("box"),
    )
    keys = ["l_orderkey", "l_linenumber"]
    clamped = rows.select(*keys, "box", R.clamp_box(F.col("box"), F.lit(320), F.lit(240)).alias("c"))
    return clamped.select(*keys, F.col("box.r").alias("right_edge"), F.col("box.b").alias("bottom_edge"), "c.*")


@query(
    "f12_subcategory",
    r"""SELECT p_partkey, concat(lower(p_type), '_', p_name) AS category,
        nullif(regexp_extract(concat(lower(p_type), '_', p_name), '^([^_]+)_(.+)', 2), '') AS tail,
        nullif(concat_ws('_', p_brand, nullif(p_type, 'SMALL')), '') AS attributes FROM part""",
)
def _(t: Tables) -> DataFrame:
    category = F.concat_ws("_", F.lower("p_type"), "p_name")
    attributes = F.array_compact(F.array("p_brand", F.nullif("p_type", F.lit("SMALL"))))
    return t.part.select(
        "p_partkey", category.alias("category"), R.category_tail(category).alias("tail"),
        R.joined_attributes(attributes).alias("attributes"),
    )


@query(
    "f13_alias_coalescing",
    """SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN nullif(source, '') END, CASE WHEN lang = 'fr' THEN 'fr-name' END,
        doc_id::varchar) AS image FROM documents""",
)
def _(t: Tables) -> DataFrame:
    rows = t.documents.select(
        "doc_id",
        F.when(F.col("lang") == "en", F.col("source")).otherwise("").alias("image_path"),
        F.when(F.col("lang") == "fr", "fr-name").alias("image"),
        F.col("doc_id").alias("filename"),
    )
    return rows.select("doc_id", first_alias(rows, ["image_path", "missing_column", "image", "filename"]).alias("image"))


@query(
    "f14_row_quarantine",
    """SELECT doc_id, CASE WHEN n_chars < 200 THEN 'too short' WHEN lang = 'de' THEN concat('language: ', lang)
        WHEN source IN ('src1', 'src2') THEN 'source' ELSE 'ok' END AS outcome FROM documents""",
)
def _(t: Tables) -> DataFrame:
    good, bad = R.quarantine(
        t.documents.select("doc_id", "lang", "source", "n_chars"),
        [
            (F.col("n_chars") < 200, "too short"),
            (F.col("lang") == "de", F.concat(F.lit("language: "), "lang")),
            (F.col("source").isin("src1", "src2"), "source"),
        ],
    )
    return good.select("doc_id", F.lit("ok").alias("outcome")).unionByName(bad.select("doc_id", F.col("reason").alias("outcome")))


_DIGITS = "regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '[^0-9]', '', 'g')"
_NUMBER = f"CASE WHEN len(ltrim({_DIGITS}, '0')) > 12 THEN ltrim({_DIGITS}, '0') ELSE lpad(ltrim({_DIGITS}, '0'), 12, '0') END"


@query(
    "f15_candidate_file_names",
    f"""SELECT page_id, c.n::int AS place, CASE c.n WHEN 0 THEN url WHEN 1 THEN regexp_extract(url, '([^/]*)/*$', 1)
          WHEN 2 THEN concat({_NUMBER}, '.jpg') ELSE concat('COCO_val2014_', {_NUMBER}, '.jpg') END AS name
        FROM pages, (SELECT unnest(range(0, 4)) AS n) c WHERE c.n < 2 OR {_DIGITS} <> ''""",
)
def _(t: Tables) -> DataFrame:
    names = R.candidate_names(F.col("url"), "COCO_val2014")
    return t.pages.select("page_id", F.posexplode(names).alias("place", "name"))


@query(
    "f16_metadata_pass_through",
    """SELECT p_partkey, p_brand, p_size::bigint AS p_size, p_type FROM part""",
)
def _(t: Tables) -> DataFrame:
    meta = R.remaining_fields(t.part, ["p_partkey", "p_name", "p_retailprice"])
    rows = t.part.select("p_partkey", F.from_json(meta, "p_brand string, p_type string, p_size bigint").alias("m"))
    return rows.select("p_partkey", "m.*")


# --- word-order negatives -----------------------------------------------------

def _shuffled(items: str, tag: str) -> str:
    return f"""list_transform(list_sort(list_transform(range(1, len({items}) + 1),
        lambda i: {{'h': md5(concat(seed, ':{tag}:', i - 1)), 'i': i, 'x': ({items})[i]}})), lambda e: e.x)"""


_PERTURBED = f"""made AS (SELECT *, [
      {{'t': 'reverse_words', 'x': array_to_string(list_reverse(w), ' ')}},
      {{'t': 'swap_adjacent_tokens', 'x': array_to_string(list_transform(range(1, len(w) + 1),
          lambda i: CASE WHEN i % 2 = 1 AND i < len(w) THEN w[i + 1] WHEN i % 2 = 0 THEN w[i - 1] ELSE w[i] END), ' ')}},
      {{'t': 'shuffle_trigrams_seeded', 'x': array_to_string(flatten({_shuffled("blocks", "trigram")}), ' ')}},
      {{'t': 'shuffle_all_words_seeded', 'x': array_to_string({_shuffled("w", "word")}, ' ')}}] AS m
    FROM (SELECT *, list_transform(range(1, len(w) + 1, 3), lambda i: w[i:i + 2]) AS blocks FROM base WHERE len(w) >= 2)),
    flat AS (SELECT *, m[n].t AS negative_type, m[n].x AS negative, n FROM made, (SELECT unnest(range(1, 5)) AS n)),
    firsts AS (SELECT * FROM flat f WHERE negative <> caption QUALIFY row_number() OVER (PARTITION BY id, caption, negative ORDER BY n) = 1)"""


def order_negatives_sql(select: str, base: str) -> str:
    """SELECT over word-order negatives; `base` yields id, caption, seed, w."""
    return f"WITH base AS ({base}), {_PERTURBED} {select}"


@query(
    "n1_word_order_negatives",
    order_negatives_sql(
        "SELECT id AS doc_id, negative_type, md5(negative) AS negative FROM firsts",
        f"SELECT doc_id AS id, {q.clean_text('text')} AS caption, doc_id * 100 + 42 AS seed, {q.words('text')} AS w FROM documents",
    ),
)
def _(t: Tables) -> DataFrame:
    caption = X.clean_text(F.col("text"))
    rows = texts(t).select("doc_id", caption.alias("c"))
    made = rows.select("doc_id", F.inline(word_order_negatives(F.col("c"), F.col("doc_id") * 100 + 42, None)))
    return made.select("doc_id", F.col("type").alias("negative_type"), F.md5("text").alias("negative"))


# --- sub-captions -------------------------------------------------------------

def _h(*tag: str) -> str:
    return q.hkey(f"concat(p, ':', {', '.join(tag)})")


def subcaption_sql(source: str, key: str) -> str:
    """Four draws per row of `source` (key, sentences), up to three sentences each."""
    pick = lambda j: _h("'pick:'", str(j))
    i0, i1, i2 = f"({pick(0)} % m)", "i1", "i2"
    return f"""WITH s AS (SELECT * FROM {source}),
    d AS (SELECT {key}, sentences, len(sentences) AS m, k AS draw, concat('42:0:', {key}, ':', k) AS p FROM s, (SELECT unnest([0, 1, 2, 3]) AS k)),
    n AS (SELECT *, ({_h("'size'")} % 3 + 1) AS n FROM d WHERE m > 0),
    a AS (SELECT *, {i0} AS i0, CASE WHEN m > 1 THEN {pick(1)} % (m - 1) END AS r1, CASE WHEN m > 2 THEN {pick(2)} % (m - 2) END AS r2 FROM n),
    b AS (SELECT *, r1 + (r1 >= i0)::int AS i1 FROM a),
    c AS (SELECT *, r2 + (r2 >= least(i0, i1))::int AS x2 FROM b),
    e AS (SELECT *, x2 + (x2 >= greatest(i0, i1))::int AS i2 FROM c),
    f AS (SELECT {key}, draw, CASE
        WHEN m < n THEN list_transform(range(0, n), lambda j: sentences[{_h("'pick:'", "j")} % m + 1])
        WHEN {_h("'mode'")} % 2 = 0 THEN sentences[{_h("'start'")} % (m - n + 1) + 1 : {_h("'start'")} % (m - n + 1) + n]
        ELSE list_transform(([i0, {i1}, {i2}])[1:n], lambda i: sentences[i + 1]) END AS chosen FROM e)
    SELECT {key}, draw::int AS draw, md5(array_to_string(chosen, '.' || chr(10))) AS subcaption FROM f
    UNION ALL SELECT {key}, draw::int, md5('') FROM d WHERE m = 0"""


@query("s1_subcaption_sampling", subcaption_sql(DOC_SENTENCES, "doc_id"))
def _(t: Tables) -> DataFrame:
    rows = texts(t).select("doc_id", X.split_sentences(F.col("text")).alias("s"))
    drawn = P.sample_subcaptions(rows, "doc_id", "s", k=4, max_merged=3)
    return drawn.select("doc_id", "draw", F.md5("subcaption").alias("subcaption"))


@query("s2_seeded_row_sample", f"SELECT doc_id, lang FROM documents ORDER BY {q.hkey("concat('7:', doc_id)")}, doc_id LIMIT 50")
def _(t: Tables) -> DataFrame:
    return P.seeded_sample(t.documents.select("doc_id", "lang"), "doc_id", 50)


@query(
    "s3_balanced_category_limit",
    """WITH RECURSIVE k AS (SELECT list(source ORDER BY source) AS names, list(n ORDER BY source) AS counts, sum(n)::bigint AS total
          FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)),
        w AS (
          SELECT range(1, len(names) + 1) AS keys, counts AS left_, list_transform(counts, lambda c: 0::bigint) AS quota, 0 AS turn FROM k
          UNION ALL
          SELECT list_filter(keys, lambda i: i <> p OR left_[p] > 1),
            list_transform(range(1, len(left_) + 1), lambda i: left_[i] - (i = p)::bigint),
            list_transform(range(1, len(quota) + 1), lambda i: quota[i] + (i = p)::bigint), turn + 1
          FROM (SELECT *, keys[turn % len(keys) + 1] AS p FROM w WHERE turn < 700 AND len(keys) > 0)),
        quotas AS (SELECT unnest(names) AS source, unnest(quota) AS quota FROM k, (SELECT quota FROM w ORDER BY turn DESC LIMIT 1))
        SELECT doc_id, source FROM (SELECT doc_id, d.source, quota, row_number() OVER (PARTITION BY d.source ORDER BY doc_id) AS rn
          FROM documents d JOIN quotas USING (source)) WHERE rn <= quota""",
)
def _(t: Tables) -> DataFrame:
    return P.balanced_limit(t.documents.select("doc_id", "source"), "source", "doc_id", 700)


@query("s4_head_limit", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def _(t: Tables) -> DataFrame:
    return P.head_limit(t.documents.select("doc_id", "n_chars"), "doc_id", 100)


@query(
    "s5_epoch_shuffle",
    f"""WITH sh AS (SELECT source, row_number() OVER (ORDER BY {q.hkey("concat('0:3:', source)")}, source) - 1 AS so
          FROM (SELECT DISTINCT source FROM documents))
        SELECT doc_id, row_number() OVER (ORDER BY {q.hkey("concat('0:3:', doc_id)")}, doc_id) - 1 AS position,
          row_number() OVER (ORDER BY so // 4, {q.hkey("concat('0:3:', doc_id)")}, doc_id) - 1 AS shard_position
        FROM documents d JOIN sh USING (source)""",
)
def _(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "source")
    free = P.epoch_shuffle(docs, "doc_id", 0, 3, position="position")
    staged = P.shuffle_shards_then_samples(docs, "source", "doc_id", 0, 3, "shard_position", group=4)
    return free.select("doc_id", "position").join(staged.select("doc_id", "shard_position"), "doc_id")


@query(
    "s6_weighted_resampling",
    f"""WITH d AS (SELECT doc_id, CASE lang WHEN 'en' THEN 2.5 WHEN 'fr' THEN 0.4 ELSE 1.0 END AS w, {q.hkey("concat('0:0:', doc_id)")} / {q.DRAW_RANGE}::double AS u FROM documents)
        SELECT doc_id, unnest(range(0, floor(w)::int + (u < w - floor(w))::int))::int AS copy FROM d""",
)
def _(t: Tables) -> DataFrame:
    weight = F.when(F.col("lang") == "en", 2.5).when(F.col("lang") == "fr", 0.4).otherwise(1.0)
    return P.resample_rows(t.documents.select("doc_id", "lang"), "doc_id", weight).select("doc_id", "copy")


@query(
    "s6_weighted_shard_draws",
    f"""WITH d AS (SELECT doc_id, {q.hkey("concat('0:0:', doc_id)")} / {q.DRAW_RANGE}::double AS u FROM documents)
        SELECT doc_id, CASE WHEN u < 8 / 20.0 THEN 'a' WHEN u < 14 / 20.0 THEN 'b' ELSE 'c' END AS source FROM d""",
)
def _(t: Tables) -> DataFrame:
    """One draw per document out of three sources."""
    drawn = P.weighted_draws(t.documents.select("doc_id"), "doc_id", [8, 6, 6], name="s")
    return drawn.select("doc_id", F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("s")).alias("source"))


@query("s7_rank_sharding", "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 8)::int AS rank FROM documents")
def _(t: Tables) -> DataFrame:
    return P.rank_shard(t.documents.select("doc_id"), 8, "doc_id")


@query(
    "s8_fixed_size_batches",
    """SELECT conv_id, turn, idx // 32 AS batch_id, (idx % 32)::int AS batch_pos FROM (
         SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx, count(*) OVER () AS n FROM conversations)
       WHERE idx < n - n % 32""",
)
def _(t: Tables) -> DataFrame:
    return P.fixed_batches(t.conversations.select("conv_id", "turn"), 32, "conv_id", "turn", partial=False)


@query(
    "s8_epoch_plan",
    """WITH c AS (SELECT count(*) AS n, count(DISTINCT source) AS s FROM documents),
        w AS (SELECT *, ceil(ceil(n / 32.0) / 5)::bigint AS wb FROM c)
        SELECT n AS num_samples, s AS num_shards, wb AS worker_batches, wb * 5 AS num_batches, wb * 5 * 32 AS epoch_samples,
          ceil(n / 16.0)::bigint AS eval_batches FROM w""",
)
def _(t: Tables) -> DataFrame:
    plan = P.epoch_plan(t.documents, batch_size=16, world=2, workers=5, shards="source")
    held = P.eval_batches(t.documents, 16).withColumnRenamed("num_batches", "eval_batches")
    return one_row(plan, held)


@query(
    "s9_split_routing",
    """SELECT route, count(*) AS n, sum(n_chars)::bigint AS chars FROM (
         SELECT n_chars, CASE source WHEN 'src0' THEN 'val' WHEN 'src1' THEN 'test' WHEN 'src2' THEN NULL ELSE 'train' END AS route FROM documents)
       WHERE route IS NOT NULL GROUP BY route""",
)
def _(t: Tables) -> DataFrame:
    s = F.col("source")
    split = F.when(s == "src0", "val").when(s == "src1", "test").when(s == "src2", "other").when(s == "src3", "restval").otherwise("train")
    routed = P.route_splits(t.documents.select("n_chars", split.alias("split")))
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("s10_dataset_size", "SELECT count(*) AS num_samples, count(DISTINCT source) AS num_shards FROM documents")
def _(t: Tables) -> DataFrame:
    return P.dataset_size(t.documents, "source")


