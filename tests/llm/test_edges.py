"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import corpus_pipeline
import public_tokenizers
import pytest

from lumenpair.llm import (
    decontaminate,
    fingerprints,
    minhash_join,
    ngram_join,
    quote_links,
    secrets,
    sentencepiece_lattice,
    spelling_groups,
    substring_dedup,
    token_counts,
    toxicity,
    url_filter,
)

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __text string, __id int, row string, `matches` int"
LABELS = "doc_id long, quality int, toxic int"
CATEGORIES = corpus_pipeline.CATEGORIES

LONG = "some words and password=abcdef1234 " * 6000 + "x" * 50_000
ROWS = [
    (1, "a repeated row of text", "en", "s", 22, "q", 1, "r", 1),
    (1, "a repeated row of text", "en", "s", 22, "q", 1, "r", 1),
    (2, None, None, None, None, None, None, None, None),
    (3, "", "en", "s", 0, "", 0, "", 0),
    (4, " \n ", "en", "s", 3, "", 0, "", 0),
    (None, "no id here", "en", "s", 10, "", 0, "", 0),
    (5, LONG, "en", "s", len(LONG), "", 0, "", 0),
    (6, "a repeated row of text", "en", "s", 22, "", 0, "", 0),
]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def labels_of(spark, rows=((1, 1, 0), (5, 1, 1), (5, None, 1), (None, 0, 0), (6, 1, None), (3, 0, 1))):
    return spark.createDataFrame(list(rows), LABELS)


def items_of(spark, rows=((0, "a repeated row of text"), (1, None), (2, ""), (None, "other text that is nowhere"), (3, "row"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def operators(spark, docs, tmp_path):
    return {
        "substring": substring_dedup.repeated_units(docs, min_words=3),
        "without": substring_dedup.remove_repeats(docs.drop("__id", "__text"), substring_dedup.repeated_units(docs, min_words=3)),
        "tokens": token_counts.count_tokens(docs, WORD_BPE, str(tmp_path / "cache")),
        "toxicity": toxicity.toxicity(docs, labels_of(spark), CATEGORIES, "toxic"),
        "secrets": secrets.scan_report(docs),
        "join": ngram_join.similar_groups(docs),
        "minhash": minhash_join.near_duplicates(docs),
        "words": spelling_groups.spelling_groups(docs, least_count=1),
        "items": decontaminate.contaminations(docs, items_of(spark)),
        "fingerprints": fingerprints.compare_with_next(docs),
        "pieces": sentencepiece_lattice.encode_documents(docs, PIECE_BPE),
    }


def test_odd_rows(spark, tmp_path):
    got = {k: df.collect() for k, df in operators(spark, docs_of(spark, ROWS), tmp_path).items()}
    one = lambda name, i: [r for r in got[name] if r.doc_id == i]
    for name in ("without", "tokens", "toxicity", "secrets", "join", "minhash", "pieces"):
        assert len(got[name]) == len(ROWS), name
    assert {r.doc_id for r in got["substring"]} >= {6}
    assert one("tokens", 2)[0].n_tokens == 0 and one("tokens", 3)[0].n_bytes == 0
    assert one("secrets", 5)[0].n_assign == 6000 and one("secrets", 2)[0].spans == ""
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got["join"]} == {
        (1, 1, 1), (6, 1, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (None, 1, None), (5, one("join", 5)[0].n_shingles, 5),
    }
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got["minhash"]} == {
        (r.doc_id, r.n_shingles, r.component_id, r.doc_id == r.component_id) for r in got["join"]
    }
    assert {(r.word, r.n) for r in got["words"]} >= {("repeated", 3), ("password", 6000)}
    assert {(r.doc_id, r.item_id) for r in got["items"]} == {(1, 0), (6, 0), (1, 3), (6, 3)}
    assert len(got["fingerprints"]) == len(ROWS) - 1
    assert one("fingerprints", 1)[0].fingerprint == one("fingerprints", 6)[0].fingerprint
    assert all(r.round_trip for r in got["pieces"]) and one("pieces", 2)[0].n_pieces == 0


def test_empty_tables(spark, tmp_path):
    for name, df in operators(spark, docs_of(spark, []), tmp_path).items():
        assert df.collect() == [], name


def test_no_labels_and_no_items(spark):
    docs = docs_of(spark, ROWS)
    judged = toxicity.toxicity(docs, labels_of(spark, []), CATEGORIES, "toxic").collect()
    assert len(judged) == len(ROWS) and not any(r.rejected for r in judged)
    assert decontaminate.contaminations(docs, items_of(spark, [])).collect() == []


def test_urls(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "http://a.b/", "x"), (2, "", "x"), (3, "http://" + "a/" * 50_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, __key string")
    none = spark.createDataFrame([], "u string")
    assert {r.verdict for r in url_filter.filter_urls(pages, none).collect()} == {"allow"}
    assert url_filter.filter_urls(pages, none).count() == len(rows)
    assert url_filter.filter_urls(pages.limit(0), none).collect() == []


def test_messages(spark):
    schema = "conv_id long, turn long, role string, text string, __text string, level int"
    rows = [(1, 0, "u", "hi", "", 0), (1, 0, "u", "hi", "", 0), (1, 1, None, "> hi\nyes", "", 0), (1, None, "u", "> hi", "", 0),
            (None, 3, "u", None, "", 0), (2, 0, "u", None, "", 0), (2, 1, "u", ">", "", 0), (3, 0, "u", "> " * 30_000, "", 0)]
    got = quote_links.link_conversations(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    assert [r.parent_turn for r in got if (r.conv_id, r.turn) == (1, 1)] == [0]
    assert all(r.root_turn is None for r in got if r.turn is None or r.conv_id is None)
    assert quote_links.link_conversations(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("rows", [ROWS, []])
def test_stages(spark, tmp_path, rows):
    folder = str(tmp_path)
    labels_of(spark).write.parquet(f"{folder}/labels.parquet")
    items_of(spark, ((0, "text that no document holds, some forty characters"),)).write.parquet(f"{folder}/benchmark.parquet")
    docs = docs_of(spark, rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    # The copy goes; the chain, fitted on three labels, may reject any labelled text.
    left = {r.doc_id for r in docs.collect()}
    assert left <= {1, 2, 3, 4, None, 5} and left >= ({2, 4, None} if rows else set())


def test_pipeline_by_brute_force(spark):
    """On the smallest tables: near copies, benchmark passages and secrets as found by plain Python."""
    import re

    import test_operators as plain
    from oracle import connect
    from sentencepiece import SentencePieceProcessor

    folder = "/root/testdata/sf0.001"
    con = connect(folder)
    items = [" ".join(t.lower().split()) for (t,) in con.sql("SELECT text FROM benchmark").fetchall()]
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in stages["ngram_jaccard_join"](spark, docs, folder).collect()}
    assert kept == {i for i, (_, c) in plain.groups(texts).items() if i == c}
    clean = {r.doc_id for r in stages["benchmark_decontamination"](spark, docs, folder).collect()}
    assert clean == {i for i, t in texts.items() if not any(x in " ".join(t.lower().split()) for x in items)}
    masked = {r.doc_id: r for r in stages["secret_scan"](spark, docs, folder).collect()}
    pattern = re.compile(r"(?i)(?:password|token) ?= ?\"?[0-9a-f]{12,}|AKIA[A-Z0-9]{16,}")
    assert not any(pattern.search(r.text) for r in masked.values())
    assert all(masked[i].text == t for i, t in texts.items() if not re.search(r"[:=]|AKIA|[0-9a-f]{24}|\w{20}", t))
    # The whole run, each stage on what the one before it kept.
    rejected = {r.doc_id for r in plain.queries.op4_toxicity(spark, folder).collect() if r.rejected}
    clean = {i: t for i, t in texts.items() if i not in rejected}
    first = {i: clean[i] for i, (_, c) in plain.groups(clean).items() if i == c}
    left = {i for i, t in first.items() if not any(x in " ".join(t.lower().split()) for x in items)}
    masked = {r.doc_id: r.text for r in stages["secret_scan"](spark, docs.where(docs.doc_id.isin(list(left))), folder).collect()}
    model = SentencePieceProcessor(model_file=PIECE_BPE)
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(final) == left and 0 < len(left) < len(clean) < len(texts)
    assert all(r.round_trip and r.ids == model.encode(masked[i]) for i, r in final.items())


def test_words_are_cut_where_no_piece_goes_on():
    rows = [("▁", 0, -9.0), ("a", 1, -8.0), ("b", 2, -7.0), ("▁a", 3, -1.0), ("ab", 4, -2.0), ("▁ab", 5, -3.0)]
    pieces = sentencepiece_lattice.piece_table(rows, 10, [b""] * 10, "merge")
    words = sentencepiece_lattice.words_of("ab ba\nab ")
    assert words == ["ab", "ba\nab", ""]
    units, upto = sentencepiece_lattice.cut(words, pieces)
    assert units == ["▁ab", "▁", "b", "a", "\n", "ab", "▁"] and upto == [1, 6, 7]
    for text in ["  a▁ b", " a", "a  ", "▁", " ", "a b"]:
        assert "".join("▁" + w for w in sentencepiece_lattice.words_of(text)) == "▁" + text.replace(" ", "▁")
        assert all("▁" not in w.lstrip("▁") for w in sentencepiece_lattice.words_of(text))


def test_pieces_out_of_order_are_merged_step_by_step(spark):
    # "abcd" is better than the "abc" it is made of where "bc" comes first; "xx" and "xy" share a score.
    rows = [(c, i, -50.0 - i) for i, c in enumerate("abcdxy")]
    rows += [("bc", 6, -1.0), ("abc", 7, -5.0), ("abcd", 8, -2.0), ("cd", 9, -3.0), ("xx", 10, -4.0), ("xy", 11, -4.0)]
    pieces = sentencepiece_lattice.piece_table(rows, 20, [p.encode() for p, _, _ in rows], "merge")
    assert pieces.loose == {"abcd", "xx", "xy"}
    units = ["abcd", "abcdabcxx", "xxxy", "xyxx", "cdcd", "abc", "a", "éabé"]
    df = spark.createDataFrame([(u,) for u in units], "__unit string").repartition(2, "__unit")
    row = sentencepiece_lattice.RowFold(pieces)
    got = {r["__unit"]: r["__ids"] for r in sentencepiece_lattice.encode_units(df, pieces).collect()}
    assert got == {u: row.ids(u) for u in units}
    assert got["abcd"] == [8]


def test_units_are_shuffled_once(spark):
    docs = spark.createDataFrame([(1, "a b\nc"), (2, "a b")], "doc_id long, text string")
    got = sentencepiece_lattice.encode_documents(docs, PIECE_BPE)
    assert len(got.collect()) == 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
