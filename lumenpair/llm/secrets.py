"""Secret scans: fixed patterns, and random-looking strings by two Markov models.

The patterns give the base spans. Beyond them, runs of 20 or more characters of
the key alphabet are scored by two first-order character models, one of random
strings and one of ordinary identifiers: the mean log-likelihood ratio for each
character pair decides. Both models are counted on labelled samples: what the
patterns find in the training documents is random, the other words there are
ordinary. Training documents are the first `max_docs` in the order of a hash of
the id, a documented bound; the scan covers every row and its whole text.

Everything is DataFrame functions. A span's place comes from the lengths of the
pieces between the matches, so places count code points.

Defined results: null and empty texts have no spans (the digest is that of the
empty string). Repeated rows each give their row. An empty table gives an empty
result. Without samples both models are even and the method adds nothing. Only
the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import whole_text

# The patterns and least lengths of the base kinds, in the order in which ties of a start are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE_KINDS = ("assign", "access", "hex")
METHOD = "markov"

RUN = r"[A-Za-z0-9+/_-]{20,}"
IDENTIFIER = r"[A-Za-z0-9+/_-]{2,}"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
SIZE = len(LETTERS)
MAX_DOCS = 20_000
THRESHOLD = 0.5

SPAN = "struct<start: bigint, end: bigint>"
NONE = f"array<{SPAN}>"


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))


def pattern_spans(text: Column, pattern: str, keep: Column | None = None) -> Column:
    """Spans of the matches, left to right; of those only where the array `keep` is true.

    The text between matches and the matches themselves alternate, so a match
    starts where all before it ends.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("bigint"))
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x).cast("bigint"))
    both = F.arrays_zip(gaps.alias("gap"), matches.alias("length"))
    steps = F.filter(both, lambda x: x["length"].isNotNull())
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(NONE).alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + x["length"]
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(_span(begin, end))).alias("out"))

    spans = F.aggregate(steps, start, step, lambda state: state["out"])
    if keep is not None:
        spans = F.filter(spans, lambda x, i: F.get(keep, i))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(NONE))


def base_spans(text: Column) -> dict[str, Column]:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    return {
        "assign": pattern_spans(text, ASSIGN, F.transform(values, lambda v: F.length(v) >= ASSIGN_LEAST)),
        # A run of the class that is too short for its kind cannot hold a longer match, so the
        # least length stands in the pattern.
        "access": pattern_spans(text, ACCESS),
        "hex": pattern_spans(text, HEX),
    }


def _pairs(strings: Column) -> Column:
    """All neighbouring character pairs of the strings in an array."""
    return F.flatten(
        F.transform(strings, lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substr(s, i, F.lit(2))))
    )


def pair_counts(docs: DataFrame, key: str, text: str, max_docs: int) -> DataFrame:
    """(random, pair, n) over the labelled samples: at most 2 * 66 * 66 rows."""
    ids = docs.select(F.col(key).alias("__id")).orderBy(F.xxhash64("__id"), "__id").limit(max_docs)
    sample = docs.select(F.col(key).alias("__id"), whole_text(text).alias("__text")).join(F.broadcast(ids), "__id", "left_semi")
    t = F.col("__text")
    values = F.filter(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_LEAST)
    found = [values, *[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in (ACCESS, HEX)]]
    rest = t
    for p in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, p, " ")
    words = F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0))
    # Each distinct string of a document once, so that a repeated line does not shape a model.
    both = F.array(
        F.struct(F.lit(True).alias("random"), F.array_distinct(F.concat(*found)).alias("strings")),
        F.struct(F.lit(False).alias("random"), F.array_distinct(words).alias("strings")),
    )
    strings = sample.select(F.explode(both).alias("b")).select("b.random", "b.strings")
    return (
        strings.select("random", F.explode("strings").alias("s"))
        .where(F.length("s") >= 2)
        .distinct()
        .select("random", F.explode(_pairs(F.array("s"))).alias("pair"))
        .groupBy("random", "pair")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def ratio_table(counts: Sequence[tuple[bool, str, int]]) -> list[float]:
    """Log-likelihood ratios of all character pairs, random over ordinary, row by row in the order of LETTERS.

    A pair's probability is smoothed towards the share of its second character.
    """
    logs = []
    for kind in (True, False):
        n = [[0.0] * SIZE for _ in range(SIZE)]
        for random, pair, count in counts:
            a, b = LETTERS.find(pair[0]), LETTERS.find(pair[1])
            if random == kind and a >= 0 and b >= 0:
                n[a][b] += count
        total = sum(map(sum, n))
        share = [(sum(row[b] for row in n) + 1) / (total + SIZE) for b in range(SIZE)]
        logs.append([math.log((n[a][b] + SIZE * share[b]) / (sum(n[a]) + SIZE)) for a in range(SIZE) for b in range(SIZE)])
    return [x - y for x, y in zip(*logs)]


def mean_ratio(string: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio over the pairs of a string of LETTERS."""
    values = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")
    codes = F.transform(F.split(string, ""), lambda c: F.call_function("instr", F.lit(LETTERS), c) - 1)
    pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: a * SIZE + b)
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.get(values, p))
    return total / F.size(pairs)


def method_spans(text: Column, table: list[float], threshold: float = THRESHOLD) -> Column:
    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    return pattern_spans(text, RUN, F.transform(runs, lambda r: mean_ratio(r, table) >= threshold))


def find_secrets(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    key: str = "doc_id",
    text: str = "text",
    max_docs: int = MAX_DOCS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The columns of `keep`, one array of spans for each base kind, and `markov`: spans that overlap no base span."""
    table = ratio_table([tuple(r) for r in pair_counts(docs, key, text, max_docs).collect()])
    t = F.col("__text")
    found = docs.select(*keep, whole_text(text).alias("__text")).select(
        *keep, *[c.alias(k) for k, c in base_spans(t).items()], method_spans(t, table, threshold).alias("__run")
    )
    base = F.concat(*[F.col(k) for k in BASE_KINDS])
    free = F.filter(
        "__run", lambda r: ~F.exists(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
    )
    return found.withColumn(METHOD, free).drop("__run")


def _tagged(place: int, kind: str) -> Column:
    def entry(s: Column) -> Column:
        words = F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))
        return F.struct(s["start"].alias("start"), F.lit(place).alias("place"), words.alias("words"))

    return F.transform(kind, entry)


def _listed(kinds: Sequence[str]) -> Column:
    """`kind:start:end`, comma-joined, by start and then by the order of the kinds."""
    entries = F.array_sort(F.concat(*[_tagged(i, k) for i, k in enumerate(kinds)]))
    return F.array_join(F.transform(entries, lambda x: x["words"]), ",")


def scan_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    found = find_secrets(docs, **options)
    return found.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_listed(BASE_KINDS), 256).alias("base_sha256"),
        _listed([*BASE_KINDS, METHOD]).alias("spans"),
        F.size(METHOD).cast("bigint").alias(f"n_{METHOD}"),
    )


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span of a sorted or unsorted array replaced; overlapping spans count as one."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substr(text, (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        new = s["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(new, F.concat(state["out"], gap, F.lit(mask))).otherwise(state["out"]).alias("out"),
        )

    rest = lambda state: F.concat(state["out"], F.substr(text, (state["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(F.array_sort(spans), start, step, rest)).otherwise(text)
