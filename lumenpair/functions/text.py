"""Caption text expressions. Everything here is a JVM-side Column expression."""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import existing, let

# They must match the reference for equal results.
# The look-ahead tells with one look whether a character can begin a boundary.
SENTENCE_BOUNDARY = r"(?=[<\r\n.!?[\u3002-\uff1f&&[。！？]]])(?:</s>|\r?\n+|[.!?。！？]+)"
REPEATED_CHARACTER = r"(.)\1{12,}"
URL_MARKS = ("http://", "https://", "www.")  # in any letter case
MIN_CHARS, MIN_WORDS, MAX_CHARS = 8, 3, 320
MIN_ALNUM_SHARE = 0.35
MIN_CJK = 4
CAPTION_GROUPS = ("raw", "shortIB", "longIB", "shortSV", "longSV", "shortLLA", "longLLA")
TOP_LEVEL_CAPTIONS = (
    "raw_caption",
    "shortIB_captions",
    "longIB_captions",
    "shortSV_captions",
    "longSV_captions",
    "shortLLA_captions",
    "longLLA_captions",
)

# Unicode white space; the separators \x1c-\x1f count as space as well. Java looks up single
# Latin characters in one set and tries ranges one by one, so the first are spelled out and
# the others tried inside one range only.
OTHER_SPACES = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0[ -　&&[  -     　]]"
SPACE_CLASS = rf"\x20{OTHER_SPACES}"
# Runs of white space that are not a plain single space already.
SPACE_TO_COLLAPSE = rf"[{OTHER_SPACES}][{SPACE_CLASS}]*+|\x20[{SPACE_CLASS}]++"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
QUOTES_AND_SPACES = " \t\r\n\"'`"
ALNUM, CJK = string.ascii_letters + string.digits, "一-鿿"


def strip(col: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(col, F.lit(SPACES))


def clean_sentence(col: Column) -> Column:
    """NUL to space, white space collapsed, spaces and quotes stripped at both ends."""
    spaced = F.regexp_replace(F.replace(F.coalesce(col, F.lit("")), F.lit("\x00"), F.lit(" ")), SPACE_TO_COLLAPSE, " ")
    return F.btrim(spaced, F.lit(QUOTES_AND_SPACES))


def _at_least(pattern: str, other: str, n: int) -> str:
    """Pattern that stops at the n-th match; possessive, so nothing is tried twice."""
    return f"^(?:[^{other}]*+(?:{pattern})){{{n}}}"


def is_valid_sentence(
    col: Column, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, max_chars: int = MAX_CHARS
) -> Column:
    """Length, URL, repetition, alphanumeric and word-count checks; cheap ones first."""
    letters = F.length(F.regexp_replace(col, r"[^\p{L}\p{N}]+", ""))
    lowered = F.lower(col)
    return (
        F.length(col).between(max(min_chars, 1), max_chars)
        & (
            col.rlike(_at_least(f"[{ALNUM}]++|[{CJK}]", f"{ALNUM}{CJK}", min_words))
            | col.rlike(_at_least(f"[{CJK}]", CJK, MIN_CJK))
        )
        & let(letters, lambda n: (n >= max(3, min_chars // 2)) & (n / F.length(col) >= MIN_ALNUM_SHARE))
        & ~let(lowered, lambda s: F.contains(s, F.lit(URL_MARKS[0])) | F.contains(s, F.lit(URL_MARKS[1])) | F.contains(s, F.lit(URL_MARKS[2])))
        & ~col.rlike(REPEATED_CHARACTER)
    )


def _judged(cleaned: Column) -> Column:
    """struct<sentences,valid>: the valid sentences, or every non-empty one where none is valid."""

    def judge(kept: Column) -> Column:
        return let(
            F.filter(kept, lambda s: is_valid_sentence(s)),
            lambda valid: F.struct(
                F.when(F.size(valid) > 0, valid).otherwise(kept).alias("sentences"), (F.size(valid) > 0).alias("valid")
            ),
        )

    return let(F.filter(cleaned, lambda s: s != ""), judge)


def _judged_split(col: Column) -> Column:
    """`_judged` for a caption string. One of nothing but sentence marks is its own only sentence, and never valid."""
    parts = F.split(F.coalesce(col, F.lit("")), SENTENCE_BOUNDARY)
    whole = F.filter(F.array(clean_sentence(col)), lambda s: s != "")
    return let(
        _judged(F.transform(parts, lambda s: clean_sentence(s))),
        lambda j: F.when(F.size(j["sentences"]) > 0, j).otherwise(F.struct(whole.alias("sentences"), F.lit(False).alias("valid"))),
    )


def _judged_list(col: Column) -> Column:
    """`_judged` for captions that are already a list: cleaned, not split."""
    empty = F.array().cast("array<string>")
    return _judged(F.transform(F.coalesce(col, empty), lambda s: clean_sentence(s)))


def split_sentences(col: Column) -> Column:
    """Sentences of a caption string; an empty array for null or blank text.

    A text of nothing but sentence marks is its own only sentence.
    """
    return _judged_split(col)["sentences"]


def clean_sentence_list(col: Column) -> Column:
    """As `split_sentences` for captions that are already a list: cleaned, not split."""
    return _judged_list(col)["sentences"]


def clean_text(col: Column, max_words: int | None = None) -> Column:
    """White space collapsed; at most the first `max_words` words."""
    value = F.regexp_replace(strip(col), SPACE_TO_COLLAPSE, " ")
    if max_words is None or max_words <= 0:
        return value
    return F.array_join(F.slice(F.split(value, " "), 1, max_words), " ")


def words(col: Column, max_words: int | None = None) -> Column:
    """The words of a cleaned text; an empty array for a blank one."""
    value = clean_text(col, max_words)
    return F.filter(F.split(value, " "), lambda w: w != "")


def first_non_blank(df: DataFrame, columns: Sequence[str]) -> Column:
    """First candidate column with a non-blank value, trimmed; '' where all are blank.

    Candidates absent from `df` are passed over; none at all is an error.
    """
    found = existing(df, columns)
    if not found:
        raise ValueError(f"None of the caption columns were found: {list(columns)}")
    trimmed = [let(strip(F.col(c).cast("string")), lambda v: F.when(v != "", v)) for c in found]
    return F.coalesce(*trimmed, F.lit(""))


def any_non_blank(df: DataFrame, columns: Sequence[str]) -> Column:
    """Whether `first_non_blank` finds a value; looks no further than the first character that counts."""
    hits = [F.coalesce(F.col(c).cast("string").rlike(f"[^{SPACE_CLASS}]"), F.lit(False)) for c in existing(df, columns)]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def caption_text(raw: Column, tokens: Column) -> Column:
    """`raw` where it is not empty, else the tokens joined by spaces; trimmed."""
    joined = F.array_join(F.coalesce(tokens, F.array().cast("array<string>")), " ")
    return strip(F.coalesce(F.nullif(raw, F.lit("")), joined))


def json_list(col: Column) -> Column:
    """The elements of a JSON list of strings; null for any other text."""
    return F.when(col.rlike(r"^\s*\[[\s\S]*\]\s*$"), F.from_json(col, "array<string>"))


def string_or_list(col: Column) -> Column:
    """Array form of a JSON field that holds either one string or a list of strings."""
    return F.when(col.isNotNull(), F.coalesce(json_list(col), F.array(col)))


def _judged_json(col: Column) -> Column:
    """`_judged` for a JSON field that holds one caption string or a list of them."""
    return let(json_list(col), lambda xs: F.when(xs.isNotNull(), _judged_list(xs)).otherwise(_judged_split(col)))


def json_sentences(col: Column) -> Column:
    """Sentences of a JSON field that holds one caption string or a list of them."""
    return _judged_json(col)["sentences"]


def has_json_sentence(col: Column) -> Column:
    """Whether `json_sentences` gives anything, without splitting or filtering: some
    character must be neither space nor quote."""
    marks = "\\x00\"'`"
    plain = col.rlike(f"[^{SPACE_CLASS}{marks}]")
    listed = lambda xs: F.exists(xs, lambda x: clean_sentence(x) != "")
    return F.coalesce(let(json_list(col), lambda xs: F.when(xs.isNotNull(), listed(xs)).otherwise(plain)), F.lit(False))


def caption_pool(
    captions: Column,
    top_level: dict[str, Column] | None = None,
    success_key: str = "longSV",
    valid_first: bool = False,
) -> Column:
    """Sentences of the caption groups in fixed order, then of the top-level fields.

    `captions` is map<string,string>; duplicates are kept. Where both give
    nothing the success key alone is used. With `valid_first` the pool as a whole
    is filtered: a group without any valid sentence gives way to others.
    """
    fields = [F.element_at(captions, F.lit(k)) for k in CAPTION_GROUPS]
    fields += [top_level[k] for k in TOP_LEVEL_CAPTIONS if k in (top_level or {})]

    def sentences(judged: Column) -> Column:
        return F.flatten(F.transform(judged, lambda j: j["sentences"]))

    def pooled(values: list[Column]) -> Column:
        # One lambda over the fields keeps the expression small; an absent field gives no sentence.
        judged = F.transform(F.array(*values), lambda v: _judged_json(v))
        if not valid_first:
            return sentences(judged)
        # A field gives valid sentences only or none that is valid, so none is judged again.
        return let(judged, lambda js: sentences(F.when(F.exists(js, lambda j: j["valid"]), F.filter(js, lambda j: j["valid"])).otherwise(js)))

    if success_key in CAPTION_GROUPS:
        return pooled(fields)
    return let(
        pooled(fields),
        lambda pool: F.when(F.size(pool) > 0, pool).otherwise(pooled([F.element_at(captions, F.lit(success_key))])),
    )
