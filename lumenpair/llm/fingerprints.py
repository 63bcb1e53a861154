"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words between white space, weighted by their counts.
For each of `SAMPLES` samples a term w with weight S draws r and c from
Gamma(2, 1) and b from [0, 1): t = floor(ln S / r + b), a = c exp(-r (t - b + 1)).
The term with the least a is the sample, as the pair (term, t). Two texts agree
in a sample with a chance equal to their generalised Jaccard similarity: the sum
of the smaller weights over the sum of the larger ones.

r is drawn as the sum of two exponential numbers, e = -ln u and f = -ln v, and b
as e / r, which is uniform and independent of r. So t = floor((ln S + e) / r) and
a = c exp(e - r (t + 1)); for the weight 1 that is t = 0 and a = c v, and only c
takes a logarithm. A text and its edited text share the draws of their terms.

The least `a` of a text of W words is exponential with rate W, so nearly all draws are
far above it. As e - r (t + 1) >= -ln S - r, every `a` is at least c u v / S (c v for the
weight 1), and -ln x >= 1 - x bounds c from below: draws whose bound is above `CUT` / W go
before any logarithm is taken or any row is aggregated. Where a sample has no `a` clearly
below the cut (a chance of exp(-CUT)), the text is sampled once more without a cut, so
the signatures are those of all draws.

Everything is DataFrame functions. A text's terms are counted in its own row, so
the samples come out of one aggregation over rows that lie together already.

Defined results: null texts count as empty. Texts without words have a
fingerprint of zeros, like one another and unlike all others. Rows with equal id
and text give one row; an id with different texts gives one for each, in the
order of a hash of the text. A null id comes last in the order. With one row
the next document is the row itself. An empty table gives an empty result. Only
the named columns are read.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import let
from ..operators.ordering import dense_index
from ..session import materialize
from .frames import whole_text

SAMPLES = 64
BLANKS = "[ \\t\\n\\r\\x0b\\f]+"
_MASK = (1 << 32) - 1
# Samples computed side by side. Alone, each draw is left out by itself; with four, the generated method is too long for the JVM to compile.
GROUP = 1
# Draws above CUT over the number of words are left out of the first pass.
CUT = 24.0


def weighted_terms(text: Column) -> Column:
    """Array of 64-bit digests of the words, one for each occurrence."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _on_side(digests: Column, side: int) -> Column:
    """Digests with the side (0 or 1) in place of their lowest bit."""
    return F.transform(digests, lambda d: d.bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(side)))


def _runs(digests: Column) -> Column:
    """(term, weight) of each run in a sorted array."""
    n = F.size(digests)
    starts = F.filter(
        F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(digests, i) != F.get(digests, i - 1))
    )

    def weigh(s: Column) -> Column:
        return F.zip_with(
            s,
            F.slice(s, 2, F.size(s)),
            lambda a, b: F.struct(F.get(digests, a).alias("term"), (F.coalesce(b, n) - a).alias("weight")),
        )

    return F.when(n > 0, let(starts, weigh))


def _entries(runs: DataFrame, kept: list[str]) -> DataFrame:
    """`kept`, `__first`, `__term`, `__weight`, `__on0`, `__on1` out of `__runs` of two texts' digests, the side in the lowest bit.

    A term of equal weights is one row for both sides, any other one for each side that has it;
    no runs give one row of weight zero. Runs are compared with their neighbours after they
    became rows, in generated code.
    """
    rows = runs.select(*kept, "__runs", F.posexplode_outer("__runs").alias("__pos", "__run"))
    pos = F.col("__pos")
    run = lambda i: F.get("__runs", i)
    even = lambda i: run(i)["term"].bitwiseAND(F.lit(-2))
    like = lambda i, j: F.coalesce((even(i) == even(j)) & (run(i)["weight"] == run(j)["weight"]), F.lit(False))
    left = F.col("__run.term").bitwiseAND(F.lit(1)) == 0
    made = {
        "first": F.coalesce(pos, F.lit(0)) == 0,
        "term": F.coalesce(F.col("__run.term").bitwiseAND(F.lit(-2)), F.lit(0)),
        "weight": F.coalesce(F.col("__run.weight").cast("bigint"), F.lit(0)),
        "on0": F.coalesce(left, F.lit(False)),
        "on1": F.coalesce(~left | like(pos, pos + 1), F.lit(False)),
    }
    return rows.where(~like(pos, pos - 1)).select(*kept, *[c.alias(f"__{n}") for n, c in made.items()])


def _unit(bits: Column, width: int) -> Column:
    """The lowest `width` bits as a number between 0 and 1, both excluded."""
    return (bits.bitwiseAND(F.lit((1 << width) - 1)).cast("double") + 0.5) * 2.0**-width


def _upper(a: Column) -> Column:
    """The root of `a` as a whole number of 31 bits."""
    return F.floor(F.least(F.sqrt(a), F.lit(7.99)) * float(1 << 28))


def candidates(terms: DataFrame, keys: list[str], carried: list[str], count: int = SAMPLES) -> DataFrame:
    """`keys`, `carried`, `__on0`, `__on1`, `__group` and a number `__s0`, ... for each sample of the group.

    A row for each term and group of samples, without those whose bounds are all above `__cut`;
    the first term of a key stays.

    Samples go in groups of `GROUP`, so that no plan step
    has more columns than generated code takes. A digest of the term and the sample holds
    c, v and the name; another one, for u, is needed for weights above 1 alone. A candidate
    is one number, the root of `a` in its upper bits and the name in the lower, so the
    least one is found by a plain minimum that combines early.
    """
    groups = -(-count // GROUP)
    size = min(GROUP, count)
    spread = terms.select(
        *keys, *carried, "__cut", "__term", "__weight", "__on0", "__on1", "__first",
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("__group"),
    )
    p, c, v, e, r, t = (lambda k, x=x: F.col(f"__{x}{k}") for x in "pcvert")

    def each(df: DataFrame, **made) -> DataFrame:
        return df.select(*df.columns, *[f(k).alias(f"__{x}{k}") for x, f in made.items() for k in range(size)])

    place = lambda k: F.col("__group") * GROUP + k
    heavy = F.col("__weight") > 1
    u = lambda k: _unit(F.xxhash64("__term", place(k), F.lit("u")), 32)
    x = lambda k: _unit(F.shiftrightunsigned(p(k), 21), 21)
    y = lambda k: _unit(F.shiftrightunsigned(p(k), 42), 21)
    rows = each(spread, p=lambda k: F.xxhash64("__term", place(k)))
    bound = lambda k: (2.0 - x(k) - y(k)) * _unit(p(k), 21) * F.when(heavy, u(k)).otherwise(1.0)
    near = [bound(k) <= F.col("__cut") * F.col("__weight") for k in range(size)]
    rows = rows.where(F.col("__first") | reduce(or_, near))
    rows = each(
        rows,
        v=lambda k: _unit(p(k), 21),
        c=lambda k: -F.log(x(k) * y(k)),
        e=lambda k: F.when(heavy, -F.log(u(k))).otherwise(0.0),
    )
    rows = each(rows, r=lambda k: F.when(heavy, e(k) - F.log(v(k))).otherwise(1.0))
    ln = F.when(heavy, F.log(F.col("__weight").cast("double"))).otherwise(0.0)
    rows = each(rows.withColumn("__ln", ln), t=lambda k: F.floor((F.col("__ln") + e(k)) / r(k)))

    def candidate(k: int) -> Column:
        a = c(k) * F.when(heavy, F.exp(e(k) - r(k) * (t(k) + 1))).otherwise(v(k))
        name = p(k).bitwiseXOR(F.shiftrightunsigned(p(k), 32)).bitwiseXOR(F.shiftleft(t(k), 7))
        return F.when(F.col("__weight") > 0, F.shiftleft(_upper(a), 32).bitwiseOR(name.bitwiseAND(F.lit(_MASK))))

    found = each(rows, s=candidate)
    return found.select(*keys, *carried, "__cut", "__on0", "__on1", "__group", *[f"__s{k}" for k in range(size)])


def samples(terms: DataFrame, keys: list[str], carried: list[str], count: int = SAMPLES) -> DataFrame:
    """Per `keys` the two signatures `__sig0` and `__sig1`: 32-bit digests of the chosen (term, t), zero where there is no term.

    `terms` has `__term`, `__weight` (zero for no term), for the sides it counts on `__on0`
    and `__on1`, `__first` on one term of a key, and `__cut`; no nulls. `__cut` and the numbers
    in `carried` are the same in all rows of a key. `__sure` tells whether no draw above the
    cut could change a signature.
    """
    groups = -(-count // GROUP)
    size = min(GROUP, count)
    found = candidates(terms, keys, carried, count)
    least = found.groupBy(*keys, "__group").agg(
        *[F.min(n).alias(n) for n in [*carried, "__cut"]],
        *[F.min(F.when(F.col(on), F.col(f"__s{k}"))).alias(f"{x}{k}") for x, on in (("__a", "__on0"), ("__b", "__on1")) for k in range(size)],
    )
    part = lambda x: F.array(
        *[F.coalesce(F.col(f"__{x}{k}").bitwiseAND(F.lit(_MASK)), F.lit(0)) for k in range(size)]
    )
    below = [F.shiftright(F.col(f"__{x}{k}"), 32) < _upper(F.col("__cut")) for x in "ab" for k in range(size)]
    sure = F.coalesce(reduce(and_, below), F.lit(False)) | (F.col("__cut") == math.inf)
    parts = least.select(
        *keys, *carried, sure.alias("__sure"),
        F.struct(F.col("__group").alias("g"), part("a").alias("a"), part("b").alias("b")).alias("__part"),
    )
    whole = parts.groupBy(*keys).agg(
        *[F.min(n).alias(n) for n in [*carried, "__sure"]], F.sort_array(F.collect_list("__part")).alias("__parts")
    )
    joined = lambda x: F.slice(F.flatten(F.transform("__parts", lambda e: e[x])), 1, count)
    return whole.select(*keys, *carried, "__sure", joined("a").alias("__sig0"), joined("b").alias("__sig1"))


def as_text(signature: Column) -> Column:
    """Eight hexadecimal digits for each sample."""
    return F.array_join(F.transform(signature, lambda s: F.lower(F.lpad(F.hex(s), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples: the estimate of the generalised Jaccard similarity."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return same.cast("double") / F.size(a)


def counted_terms(pairs: DataFrame, keys: list[str], texts: tuple[str, str], carried: list[str], cut: float = CUT) -> DataFrame:
    """The rows that `samples` takes: a row for each term of both texts of a row, at least one."""
    sides = [_on_side(weighted_terms(F.col(text)), side) for side, text in enumerate(texts)]
    split = pairs.select(*keys, *carried, *[d.alias(f"__d_{side}") for side, d in enumerate(sides)])
    n = F.least(F.size("__d_0"), F.size("__d_1"))
    limit = F.when(n > 0, F.lit(cut) / n).otherwise(F.lit(math.inf))
    digests = split.select(*keys, *carried, limit.alias("__cut"), F.sort_array(F.concat("__d_0", "__d_1")).alias("__digests"))
    kept = [*keys, *carried, "__cut"]
    return _entries(digests.select(*kept, _runs(F.col("__digests")).alias("__runs")), kept)


def fingerprints(
    pairs: DataFrame, keys: list[str], texts: tuple[str, str], carried: list[str], count: int = SAMPLES, cut: float = CUT
) -> DataFrame:
    """`keys`, `carried`, `__sure`, `__sig0` and `__sig1`, the signatures of both texts of every row; `keys` are unique together.

    Rows that are not sure are to be sampled once more without a cut.
    """
    return samples(counted_terms(pairs, keys, texts, carried, cut), keys, carried, count)


def next_documents(rows: DataFrame) -> DataFrame:
    """Each row's successor in descending id, the first after the last: `__key`, `__n`, `__next`."""
    order = dense_index(rows, F.col("__key.id").desc_nulls_last(), F.col("__key.hash"), name="__idx")
    total = max(1, order.count())
    after = order.select(F.pmod(F.col("__idx") - 1, F.lit(total)).alias("__idx"), F.col("__key").alias("__next"))
    return order.join(after, "__idx").drop("__idx")


def _parts(sha: Column) -> list[Column]:
    """A SHA-256 in hexadecimal as four 64-bit numbers."""
    return [F.conv(F.substr(sha, F.lit(16 * i + 1), F.lit(16)), 16, -10).cast("bigint") for i in range(4)]


def compare_with_next(
    docs: DataFrame, key: str = "doc_id", text: str = "text", count: int = SAMPLES, cut: float = CUT
) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text is the text with its last third replaced by the start of the
    next document. Columns: key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.
    """
    rows = docs.select(F.col(key).alias("__id"), whole_text(text).alias("__text"))
    rows = rows.select(F.struct(F.col("__id").alias("id"), F.xxhash64("__text").alias("hash")).alias("__key"), "__text")
    lengths = rows.select("__key", F.length("__text").alias("__n")).dropDuplicates(["__key"])
    links = materialize(next_documents(lengths), "links")
    # Keys of one type, down to nullability: a cast would shuffle the texts again.
    same = lambda c: F.struct(F.col(f"{c}.id").alias("id"), F.coalesce(F.col(f"{c}.hash"), F.lit(0)).alias("hash"))
    wanted = links.select(
        same("__next").alias("__key"), same("__key").alias("__for"), F.floor(F.col("__n") / 3).cast("int").alias("__need")
    )
    carried = [f"__d{i}" for i in range(4)]

    def signatures(rows: DataFrame, wanted: DataFrame, limit: float) -> DataFrame:
        # Texts are shuffled once, as both joins use this exchange; of the next texts only the starts move on.
        rows = rows.groupBy("__key").agg(F.first("__text").alias("__text"))
        heads = rows.join(wanted, "__key").select(
            F.col("__for").alias("__key"), "__need", F.substr("__text", F.lit(1), F.col("__need")).alias("__head")
        )
        whole = F.col("__text")
        kept = F.substr(whole, F.lit(1), F.length(whole) - F.col("__need"))
        pair = rows.join(heads, "__key").select("__key", "__text", F.concat(kept, F.col("__head")).alias("__edited"))
        hashed = pair.withColumn("__sha", F.sha2("__edited", 256))
        numbers = [x.alias(n) for x, n in zip(_parts(F.col("__sha")), carried)]
        sides = hashed.select("__key", "__text", "__edited", *numbers)
        return materialize(fingerprints(sides, ["__key"], ("__text", "__edited"), carried, count, limit), "fingerprints")

    signed = signatures(rows, wanted, cut)
    # Stored, so that a few keys are seen to be few; they, and the documents after them, are all that is read again.
    again = materialize(signed.where(~F.col("__sure")).select(same("__key").alias("__for")), "again")
    if not again.isEmpty():
        again = again.select(same("__for").alias("__for"))
        wanted = wanted.join(again, "__for", "left_semi").select("__key", "__for", "__need")
        needed = again.select(F.col("__for").alias("__key")).union(wanted.select("__key"))
        more = signatures(rows.join(needed, "__key", "left_semi"), wanted, math.inf)
        signed = signed.where("__sure").unionByName(more)

    near = signed.select("__key", F.col("__sig0").alias("__own"), F.col("__sig1").alias("__edit"), *carried)
    after = signed.select(F.col("__key").alias("__next"), F.col("__sig0").alias("__after"))
    joined = links.join(near, "__key").join(after, "__next")
    return joined.select(
        F.col("__key.id").alias(key),
        F.col("__n").cast("bigint").alias("n_chars"),
        F.concat(*[F.lower(F.lpad(F.hex(c), 16, "0")) for c in carried]).alias("edited_sha256"),
        as_text(F.col("__own")).alias("fingerprint"),
        as_text(F.col("__edit")).alias("edited_fingerprint"),
        likeness(F.col("__own"), F.col("__edit")).alias("near_edited"),
        likeness(F.col("__own"), F.col("__after")).alias("near_next"),
    )
