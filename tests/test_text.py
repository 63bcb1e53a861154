"""Caption text: the small cases a whole-table comparison does not reach."""

import json

import pytest
from helpers import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenpair.functions import records as R
from lumenpair.functions import text as X
from lumenpair.operators import curation as C
from lumenpair.operators import sampling as P
from lumenpair.operators.negatives import word_order_negatives


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", expr(F.col("t")).alias("v")).collect())]


def test_split_keeps_valid_sentences(spark):
    text = (
        "Tiny. Two red kites circle over the hill! Does anyone hold the strings?\n"
        "www.kites.test !!! Wind bends the tall grass below."
    )
    assert values(spark, [text], X.split_sentences) == [
        ["Two red kites circle over the hill", "Does anyone hold the strings", "Wind bends the tall grass below"]
    ]


def test_split_falls_back_to_short_sentences(spark):
    assert values(spark, ["Hi. Yo", "  ", None, "'quoted'</s>x"], X.split_sentences) == [
        ["Hi", "Yo"], [], [], ["quoted", "x"]
    ]


def test_marks_alone_are_one_sentence(spark):
    texts = ["...", " !!! ", "</s>", "\"'", "。\n", "'.'"]
    assert values(spark, texts, X.split_sentences) == [["..."], ["!!!"], ["</s>"], [], ["。"], ["."]]
    assert values(spark, texts, X.has_json_sentence) == [True, True, True, False, True, True]


def test_clean_sentence_spaces_and_quotes(spark):
    assert values(spark, ["a\x00b\x1cc　d", " \"it's\" `", " x "], X.clean_sentence) == ["a b c d", "it's", "x"]


@pytest.mark.parametrize(
    "text, valid",
    [
        ("three small words", True),
        ("two words", False),
        ("a b c", False),
        ("小船停在安静的河边", True),
        ("四个汉字 abcdef", True),
        ("see HTTPS://x.y now please", False),
        ("look at WWW.site here", False),
        ("so g" + "o" * 12 + " long now", True),
        ("so g" + "o" * 13 + " far now", False),
        ("a b c ............................", False),
        ("x" * 4 + " word other " * 27, False),
        ("abc def " + "-" * 12, False),
    ],
)
def test_valid_sentence(spark, text, valid):
    assert values(spark, [text], X.is_valid_sentence) == [valid]


def plain_valid(s):
    """The rule written out for one string."""
    import re

    if not 8 <= len(s) <= 320 or re.search(r"https?://|www\.", s, re.I) or re.search(r"(.)\1{12,}", s):
        return False
    alnum = sum(c.isalnum() for c in s)
    cjk = len(re.findall("[一-鿿]", s))
    return alnum >= 4 and alnum / len(s) >= 0.35 and (len(re.findall("[A-Za-z0-9]+", s)) + cjk >= 3 or cjk >= 4)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB3 .-é湖\tw", max_size=30), min_size=200, max_size=200))
def test_valid_sentence_agrees_with_plain_rule(spark, texts):
    assert values(spark, texts, X.is_valid_sentence) == [plain_valid(t) for t in texts]


def test_first_non_blank(spark):
    df = spark.createDataFrame([(None, " b "), ("", ""), (" a", "b")], "x string, y string")
    assert [r[0] for r in df.select(X.first_non_blank(df, ["x", "missing", "y"])).collect()] == ["b", "", "a"]
    with pytest.raises(ValueError):
        X.first_non_blank(df, ["missing"])


def test_caption_pool_covers_all_groups(spark):
    captions = {
        "raw": "two mugs on a shelf",
        "shortIB": "blue mugs beside a window",
        "longIB": json.dumps(["Blue mugs stand beside a window. Kept whole here"]),
        "longSV": "Morning light falls on the shelf. A cat sleeps under the window.",
        "longLLA": "Both mugs have thin white handles. Dust covers the lower board.",
    }
    df = spark.createDataFrame([(captions,)], "c map<string,string>")
    pool = df.select(X.caption_pool(F.col("c"))).first()[0]
    assert pool == [
        "two mugs on a shelf",
        "blue mugs beside a window",
        "Blue mugs stand beside a window. Kept whole here",
        "Morning light falls on the shelf",
        "A cat sleeps under the window",
        "Both mugs have thin white handles",
        "Dust covers the lower board",
    ]


def test_bracketed_caption_is_no_list(spark):
    assert values(spark, ["[a] plain caption text", '["one two three four"]'], X.json_sentences) == [
        ["[a] plain caption text"], ["one two three four"]
    ]


@pytest.mark.parametrize("text", ["", " . ! ", "\"'`", "</s>", "a", "[]", '["", " "]', '["x"]', "<</s>/s>"])
def test_has_json_sentence_is_split_without_splitting(spark, text):
    found = values(spark, [text], lambda c: F.struct(X.has_json_sentence(c), F.size(X.json_sentences(c)) > 0))[0]
    assert found[0] == found[1]


def test_relabel_filter(spark):
    good = {"captions": {"raw": "ferry at the quay", "longSV": "grey ferry leaves the quay"}, "default_caption_key": "longSV"}
    cases = [
        (good, "grey ferry leaves the quay ", True),
        (good, "another text", False),
        ({"key": "000000002"}, "x", False),
        ({**good, "default_caption_key": "raw"}, "grey ferry leaves the quay", False),
        ({"captions": {"longSV": ["ferries in a row"]}}, "another text", True),
        ({"captions": {"longSV": "  "}}, "  ", False),
        ({"captions": "text"}, "text", False),
    ]
    df = spark.createDataFrame([(i, json.dumps(m), t) for i, (m, t, _) in enumerate(cases)], "i int, j string, t string")
    got = df.select("i", C.relabel_succeeded(F.from_json("j", C.METADATA), F.col("t"))).orderBy("i").collect()
    assert [bool(r[1]) for r in got] == [ok for _, _, ok in cases]


def test_caption_of_one_word_has_no_negative(spark):
    df = spark.createDataFrame([("single",), ("a a",), ("red dog",)], "c string")
    got = [r[0] for r in df.select(word_order_negatives(F.col("c"), F.lit(1))).collect()]
    assert got[0] == [] and got[1] == []
    assert [(n["type"], n["text"]) for n in got[2]] == [("reverse_words", "dog red")]


def test_negatives_are_permutations(spark):
    caption = "one two three four five six seven eight"
    df = spark.createDataFrame([(caption,)], "c string")
    made = df.select(word_order_negatives(F.col("c"), F.lit(7))).first()[0]
    texts = [m["text"] for m in made]
    assert len(set(texts)) == len(texts) and caption not in texts
    assert all(sorted(t.split()) == sorted(caption.split()) for t in texts)
    assert texts[1] == "two one four three six five eight seven"


def test_subcaptions_come_from_the_sentences(spark):
    sentences = [f"sentence number {i}" for i in range(6)]
    df = spark.createDataFrame([(i, sentences) for i in range(400)] + [(900, ["only one"]), (901, [])], "k int, s array<string>")
    drawn = P.sample_subcaptions(df, "k", "s", k=8, max_merged=4).collect()
    assert len(drawn) == 402 * 8
    sizes = {}
    for r in drawn:
        parts = r.subcaption.split(P.SENTENCE_JOINER)
        if r.k == 901:
            assert r.subcaption == ""
            continue
        assert set(parts) <= set(sentences) | {"only one"}
        if r.k < 900:
            sizes[len(parts)] = sizes.get(len(parts), 0) + 1
            assert len(set(parts)) == len(parts)
    assert set(sizes) == {1, 2, 3, 4} and min(sizes.values()) > 0.2 * sum(sizes.values())
    assert rows(P.sample_subcaptions(df.repartition(5), "k", "s", k=8, max_merged=4)) == sorted(map(tuple, drawn), key=repr)


def test_candidate_names_keep_long_numbers(spark):
    assert values(spark, ["d/img_0012.png", "plain", "1234567890123.jpg"], lambda c: R.candidate_names(c, "P")) == [
        ["d/img_0012.png", "img_0012.png", "000000000012.jpg", "P_000000000012.jpg"],
        ["plain", "plain"],
        ["1234567890123.jpg"] * 3 + ["P_1234567890123.jpg"],
    ]


def test_crop_box_edges(spark):
    df = spark.createDataFrame([(5, 6, 0, -3), (300, 2, 40, 10), (1, 1, None, 2)], "x int, y int, w int, h int")
    box = R.crop_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    got = df.select(box.alias("b"), R.clamp_box(box, F.lit(100), F.lit(50)).alias("c")).collect()
    assert tuple(got[0].b) == (5, 6, 6, 7)
    assert tuple(got[1].c) == (99, 2, 100, 12)
    assert got[2].b is None


def test_pool_is_judged_once_and_as_a_whole(spark):
    cases = [
        ({"raw": "Tiny. Bits", "longSV": "Morning light falls on the shelf. Hi"}, ["Morning light falls on the shelf"]),
        ({"raw": "Tiny. Bits", "longSV": "..."}, ["Tiny", "Bits", "..."]),
        ({"raw": json.dumps(["two red mugs.\nhere", "x"]), "longSV": "Ok"}, ["two red mugs. here"]),
        ({}, None),
    ]
    df = spark.createDataFrame([(json.dumps({"captions": c}),) for c, _ in cases], "j string")
    found = df.select(C.caption_sentences(F.from_json("j", C.METADATA), raw_text=F.lit("raw")).alias("s"))
    assert [r.s for r in found.collect()] == [want or ["raw"] for _, want in cases]
    plan = df.select(C.caption_sentences(F.from_json("j", C.METADATA)).alias("s"))._jdf.queryExecution().analyzed().toString()
    # Texts and lists, in the pool, the `caption` field and the raw text: no further pass over the pool.
    assert plan.count(X.REPEATED_CHARACTER) == 5


def test_character_sets_hold_what_they_held(spark):
    """Every character of the basic plane, and pairs of what counts with what does not."""
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    spaces = set("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0     　") | {chr(c) for c in range(0x2000, 0x200B)}
    got = values(spark, [f"a{c}b" for c in chars], X.clean_text)
    assert [c for c, v in zip(chars, got) if v == "a b"] == [c for c in chars if c in spaces]
    assert all(v == f"a{c}b" for c, v in zip(chars, got) if c not in spaces)
    cut = values(spark, [f"a{c}b" for c in chars], lambda t: F.size(F.split(t, X.SENTENCE_BOUNDARY)) > 1)
    assert {c for c, v in zip(chars, cut) if v} == set("\n.!?。！？")
    assert values(spark, ["a\r\n\nb\rc", "a</s>b<c", "a  \t b", "a \tb", "a\t b", "a  b　 c"], lambda t: F.array_join(F.split(X.clean_text(t), " "), "|")) == [
        "a|b|c", "a</s>b<c", "a|b", "a|b", "a|b", "a|b|c"
    ]
    assert values(spark, ["a\r\n\nb\rc", "a</s>b<c"], lambda t: F.split(t, X.SENTENCE_BOUNDARY)) == [["a", "b\rc"], ["a", "b<c"]]


def test_negatives_of_long_texts_are_not_made_by_lambdas(spark):
    """The rule written out, for long, null, repeated and uncleaned captions; words are hashed and sorted in batches."""
    import hashlib

    def plain(caption, seed, cap):
        w = (caption or "").split()[:cap]
        if len(w) < 2:
            return []
        drawn = lambda xs, tag: [x for _, _, x in sorted((hashlib.md5(f"{seed}:{tag}:{i}".encode()).hexdigest(), i, x) for i, x in enumerate(xs))]
        blocks = drawn([w[i : i + 3] for i in range(0, len(w), 3)], "trigram")
        swapped = [w[i + 1] if i % 2 == 0 and i + 1 < len(w) else w[i - 1] if i % 2 else w[i] for i in range(len(w))]
        made, seen = [], {caption}
        for kind, xs in (("reverse_words", w[::-1]), ("swap_adjacent_tokens", swapped), ("shuffle_trigrams_seeded", sum(blocks, [])), ("shuffle_all_words_seeded", drawn(w, "word"))):
            if (text := " ".join(xs)) not in seen:
                seen.add(text)
                made.append((kind, text))
        return made

    long = " ".join(f"wört{i % 97}" for i in range(5003))
    captions = [long, None, "", " one ", "a b", "b a", "a b a", "x x x x", "a  b\tc ", "湖 é a d e f g"]
    df = spark.createDataFrame(list(enumerate(captions)), "i int, c string")
    for cap in (None, 3, 30):
        made = df.select("i", word_order_negatives(F.col("c"), F.col("i") + 42, cap).alias("m"))
        got = {r.i: [tuple(x) for x in r.m] for r in made.collect()}
        assert got == {i: plain(c, i + 42, cap) for i, c in enumerate(captions)}
    assert "sort_array" not in made._jdf.queryExecution().optimizedPlan().toString()
    # Filters and generators on the result, and no seed at all.
    kept = df.select("i", word_order_negatives(F.col("c"), F.lit(None), None).alias("m")).where(F.size("m") > 0)
    assert {r.i for r in kept.select("i", F.inline("m")).collect()} == {i for i, c in enumerate(captions) if plain(c, 0, None)}
