"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, tune
from .decontaminate import contaminations
from .fingerprints import compare_with_next
from .hard_negatives import hard_negatives
from .minhash_join import near_duplicates
from .ngram_join import similar_groups
from .quote_links import as_mail, link_conversations
from .secrets import scan_report
from .sentencepiece_lattice import encode_documents
from .spelling_groups import spelling_groups
from .substring_dedup import deduplicated, repeated_units
from .token_counts import count_tokens
from .toxicity import toxicity
from .url_filter import UrlRule, canonical_url, filter_urls, url_host

URL_RULES = [
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
]
#: Parts of host names whose pages make up the list of blocked URLs.
LISTED_HOSTS = "casino|pills|bets|adult|spam"
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
THRESHOLD = 0.3


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Rules and the list of canonical URLs over all pages."""
    pages = table(spark, folder, "pages")
    listed = pages.where(url_host(F.col("url")).rlike(LISTED_HOSTS)).select(canonical_url(F.col("url")).alias("listed"))
    return filter_urls(pages, listed, URL_RULES)


_HOST = "translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_QUERY = (
    "regexp_replace(regexp_replace(regexp_extract(url, '(?s)^[^?#]*\\?([^#]*)', 1),"
    " '(^|&)(utm_[^=&]*|ref|gclid|fbclid)=[^&]*', '', 'g'), '^&', '')"
)
OP1_SQL = f"""
WITH parts AS (
  SELECT page_id, url, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path, {_QUERY} AS q FROM pages
), canon AS (
  SELECT page_id, host, path, CASE WHEN contains(url, '://') THEN
    regexp_replace(host, '^(www|m)\\.|:(80|443)$', '', 'g')
    || regexp_replace(regexp_replace(path, '/index\\.html?$', ''), '/+$', '')
    || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS c
  FROM parts
), listed AS (SELECT DISTINCT c FROM canon WHERE regexp_matches(host, '{LISTED_HOSTS}') AND c IS NOT NULL),
ruled AS (
  SELECT canon.page_id, canon.host, canon.path, listed.c IS NOT NULL AS listed, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM canon LEFT JOIN listed ON canon.c = listed.c
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM ruled
"""


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every repeated unit that is removed, with its place and the occurrence that stays."""
    return repeated_units(table(spark, folder, "documents")).drop("text_hash")


def op2_whole_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without its repeats, later whole lines of any length among them, with the original places."""
    return deduplicated(table(spark, folder, "documents"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, with a cache that starts empty."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return count_tokens(table(spark, folder, "documents"), path, scratch_path(spark, "token-cache"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Chain probabilities of every document and whether it is rejected as toxic."""
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), CATEGORIES, "toxic", THRESHOLD)


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every document."""
    return scan_report(table(spark, folder, "documents"))


def op6_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Shingle sets and components of every document."""
    return similar_groups(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def _components_sql(similarity: int, columns: str) -> str:
    """Components of the documents whose shingle sets reach the similarity, by a self-join on shingles."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w
), sized AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS name FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM shared JOIN sized x ON a = x.doc_id JOIN sized y ON b = y.doc_id
  WHERE 100 * shared.n >= {similarity} * (x.n + y.n - shared.n)
), both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link), reach AS (
  SELECT doc_id AS node, doc_id AS first FROM documents UNION SELECT b, first FROM reach JOIN both_ways ON a = node
), component AS (SELECT node AS doc_id, min(first) AS component_id FROM reach GROUP BY node),
class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY name) AS class_id FROM sized)
SELECT doc_id, coalesce(sized.n, 0) AS n_shingles, component_id, {columns}
FROM documents JOIN component USING (doc_id) LEFT JOIN sized USING (doc_id) LEFT JOIN class USING (doc_id)
"""


OP6_SQL = _components_sql(75, "coalesce(class_id, doc_id) AS class_id")


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every place where a document holds a benchmark item within its edit budget."""
    return contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_quote_links(spark: SparkSession, folder: str) -> DataFrame:
    """The conversations, written as mails that quote one another, linked and freed of quotes."""
    return link_conversations(as_mail(table(spark, folder, "conversations")))


OP8_SQL = """
WITH m AS (
  SELECT conv_id, turn, role, trim(text, chr(10)) AS text,
    lag(turn) OVER w = turn - 1 AS one, lag(turn, 2) OVER w = turn - 2 AND lag(turn) OVER w = turn - 1 AS two
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), r AS (
  SELECT *, max(CASE WHEN coalesce(one, false) THEN NULL ELSE turn END)
    OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS root_turn FROM m
)
SELECT conv_id, turn, role, CASE WHEN one THEN turn - 1 END AS parent_turn, root_turn, turn - root_turn AS depth,
  coalesce(one, false)::BIGINT + coalesce(two, false)::BIGINT AS n_quotes,
  coalesce(one, false)::BIGINT + coalesce(two, false)::BIGINT AS n_linked, text
FROM r
"""


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document, against its edited text and the next document."""
    return compare_with_next(table(spark, folder, "documents"))


def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every document, and whether they decode to its text."""
    return encode_documents(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_minhash_join(spark: SparkSession, folder: str) -> DataFrame:
    """Shingle sets and components of every document, by MinHash collisions."""
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP11_SQL = _components_sql(85, "doc_id = component_id AS kept")


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every anchor; each seventh row carries the next label."""
    vectors = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", label.alias("label"), "embedding"))


OP12_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 3
"""


def op13_spelling_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Frequent words of all documents with their near words, forms and roots."""
    return spelling_groups(table(spark, folder, "documents"))


OP13_SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
), run AS (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS run FROM documents) GROUP BY ALL
), bytes AS (
  SELECT *, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: CASE WHEN unicode(c) < 128
    THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + unicode(c)::BIGINT % 64] END)) AS b FROM run
), hashed AS (
  SELECT doc_id, run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM bytes, crc
), word AS (
  SELECT CASE WHEN doc_id IS NOT NULL AND h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
    sum(n)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
), less AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS v FROM (SELECT word, n, unnest(range(length(word))) AS i FROM word)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT less.word, word.word, word.n FROM less JOIN word ON v = word.word
  UNION SELECT word.word, less.word, less.n FROM less JOIN word ON v = word.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS most, min_by(other, (-n, other)) AS other FROM near GROUP BY word
), formed AS (
  SELECT word.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * n THEN other END AS form, CASE WHEN most >= 5 * n THEN most END AS form_n
  FROM word LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS reached FROM word
  UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.reached WHERE formed.form IS NOT NULL
)
SELECT formed.word, formed.n, formed.n_near, formed.form, formed.form_n, chain.reached AS root
FROM formed JOIN chain ON chain.word = formed.word JOIN formed final ON final.word = chain.reached AND final.form IS NULL
"""


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(tune(spark), folder)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_substring_dedup": op2_substring_dedup,
    "op2_whole_line_dedup": op2_whole_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_secret_scan": op5_secret_scan,
    "op6_ngram_join": op6_ngram_join,
    "op7_decontamination": op7_decontamination,
    "op8_quote_links": op8_quote_links,
    "op9_fingerprints": op9_fingerprints,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_minhash_join": op11_minhash_join,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling_groups": op13_spelling_groups,
    "pipeline": pipeline,
}
ORACLES = {
    "op1_url_filter": OP1_SQL,
    "op6_ngram_join": OP6_SQL,
    "op8_quote_links": OP8_SQL,
    "op11_minhash_join": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_spelling_groups": OP13_SQL,
}
