"""SQL fragments of the oracles, in DuckDB's dialect."""

from __future__ import annotations

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
CJK = r"[\x{4e00}-\x{9fff}]"


def hkey(expr: str) -> str:
    return f"(concat('0x', substr(md5({expr}), 1, 15))::bigint)"


DRAW_RANGE = "1152921504606846976.0"


def rnd(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}|{SPACE}$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{SPACE}', ' ', 'g')"


def clean_text(x: str) -> str:
    return collapse(strip(x))


def words(x: str, cap: int | None = None) -> str:
    out = f"list_filter(string_split({clean_text(x)}, ' '), lambda w: w <> '')"
    return out if cap is None else f"({out})[1:{cap}]"


def clean_sentence(x: str) -> str:
    return f"""regexp_replace({collapse(f"replace({x}, chr(0), ' ')")}, '^[ \\t\\r\\n"''`]+|[ \\t\\r\\n"''`]+$', '', 'g')"""


def valid_sentence(s: str) -> str:
    alnum = rf"length(regexp_replace({s}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
    return rf"""(length({s}) BETWEEN 8 AND 320
        AND (len(regexp_extract_all({s}, '[A-Za-z0-9]+|{CJK}')) >= 3 OR len(regexp_extract_all({s}, '{CJK}')) >= 4)
        AND {alnum} >= 4 AND {alnum} / length({s}) >= 0.35
        AND NOT regexp_matches({s}, '(?i)https?://|www\.')
        AND len(list_filter(range(1, length({s}) - 11),
                lambda i: substr({s}, i, 13) = repeat(substr({s}, i, 1), 13))) = 0)"""


def sentences(select_key: str, text: str, source: str) -> str:
    """SELECT key, sentences list FROM source; texts split, cleaned and filtered."""
    cleaned = clean_sentence("p")
    valid = valid_sentence("p")
    return f"""(SELECT {select_key}, CASE WHEN len(valid) > 0 THEN valid WHEN len(kept) = 0 AND whole <> '' THEN [whole]
          ELSE kept END AS sentences FROM (
        SELECT *, list_filter(kept, lambda p: {valid}) AS valid FROM (
          SELECT *, {clean_sentence(text)} AS whole, list_filter(list_transform(
              string_split_regex({text}, '</s>|\\r?\\n+|[.!?。！？]+'), lambda p: {cleaned}), lambda p: p <> '') AS kept
          FROM {source})))"""


def unit(v: str, dims: int | None = None) -> str:
    d = f"({v})::double[]" if dims is None else f"(({v})[1:{dims}])::double[]"
    return f"list_transform({d}, lambda x: x / greatest(sqrt(list_dot_product({d}, {d})), 1e-12))"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"
