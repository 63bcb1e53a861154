"""URL filters: host and path rules first, then a list of canonical URLs.

Listed URLs are looked up in two steps. A blocked Bloom filter, one row of eight
32-bit words for each block, lets nearly all unlisted URLs go without a shuffle
of the URL table; what passes it is joined exactly, so no false positive stays.

Defined results: a null URL or one without `://` has an empty host and path,
fits no rule, is in no list and gets `allow`. Repeated rows stay. An empty list
lists nothing. Extra columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .frames import ascii_lower

WORDS = 8
BITS_PER_BLOCK = 32 * WORDS
BITS_PER_KEY = 16
# A filter up to this size is broadcast; a larger one meets the URLs in a join on the block.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class UrlRule:
    """`host` and all its subdomains, where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host, path and query in the form in which URLs are listed; null without `://`.

    The scheme, the fragment, a leading `www.` or `m.`, a default port, closing
    slashes, `index.html` and tracking parameters do not count.
    """
    host = F.regexp_replace(url_host(url), r"^(www|m)\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(url_path(url), r"/index\.html?$", ""), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(query, r"(^|&)(utm_[^=&]*|ref|gclid|fbclid)=[^&]*", "")
    query = F.regexp_replace(query, "^&", "")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.contains(url, F.lit("://")), whole)


def rule_of(rules: Sequence[UrlRule], host: Column, path: Column, field: str) -> Column:
    """`field` of the longest rule that fits, else null. Equally long rules go by the longer host."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    if not ordered:
        return F.lit(None).cast("string")
    pairs = [(r.fits(host, path), F.lit(getattr(r, field))) for r in ordered]
    return reduce(lambda chain, p: chain.when(*p), pairs[1:], F.when(*pairs[0]))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column, word: int) -> Column:
    """One of the 32 bits of `word`, taken from five bits of a second digest."""
    five = F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 5 * word).bitwiseAND(F.lit(31)).cast("int")
    return F.call_function("shiftleft", F.lit(1), five)


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter of all values of `key`: (`__block`, `__w0` to `__w7`), folded on the map side."""
    return keys.groupBy(_block(F.col(key), blocks).alias("__block")).agg(
        *[F.bit_or(_mask(F.col(key), i)).alias(f"__w{i}") for i in range(WORDS)]
    )


def passes(df: DataFrame, key: Column, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """Add `__key` and the flag `__maybe`: false means that the key is surely not in the filter."""
    keyed = df.withColumn("__key", key).withColumn("__at", _block(F.col("__key"), blocks))
    right = filter_blocks.withColumnRenamed("__block", "__at")
    if blocks * (BITS_PER_BLOCK // 8 + 8) <= BROADCAST_BYTES:
        right = F.broadcast(right)
    hit = reduce(
        lambda a, b: a & b,
        [F.col(f"__w{i}").bitwiseAND(_mask(F.col("__key"), i)) == _mask(F.col("__key"), i) for i in range(WORDS)],
    )
    return (
        keyed.join(right, "__at", "left")
        .withColumn("__maybe", F.coalesce(hit & F.col("__key").isNotNull(), F.lit(False)))
        .drop("__at", *[f"__w{i}" for i in range(WORDS)])
    )


def is_listed(df: DataFrame, url: Column, listed: DataFrame, name: str = "listed") -> DataFrame:
    """Add whether the canonical form of `url` is among the canonical URLs in the one column of `listed`."""
    column = listed.columns[0]
    keys = materialize(listed.select(F.col(column).alias("__key")).where(F.col("__key").isNotNull()).distinct(), "urls")
    count = keys.count()
    blocks = max(1, -(-count * BITS_PER_KEY // BITS_PER_BLOCK))
    flagged = passes(df, canonical_url(url), bloom_blocks(keys, "__key", blocks), blocks)
    exact = keys.withColumn(name, F.lit(True))
    hits = flagged.where("__maybe").join(exact, "__key", "left").withColumn(name, F.col(name).isNotNull())
    rest = flagged.where(~F.col("__maybe")).withColumn(name, F.lit(False))
    return hits.unionByName(rest).drop("__key", "__maybe")


def filter_urls(
    df: DataFrame, listed: DataFrame, rules: Sequence[UrlRule] = (), url: str = "url", key: str = "page_id"
) -> DataFrame:
    """One row for each row of `df`: key, host, path, rule, verdict (`allow` or `block`), listed.

    The longest fitting rule decides; without one a listed URL is blocked.
    """
    rows = df.select(F.col(key), F.col(url).cast("string").alias("__url"))
    judged = is_listed(rows, F.col("__url"), listed)
    parts = judged.select(key, "listed", url_host(F.col("__url")).alias("host"), url_path(F.col("__url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return parts.select(
        key,
        "host",
        "path",
        rule_of(rules, host, path, "text").alias("rule"),
        F.coalesce(rule_of(rules, host, path, "verdict"), method).alias("verdict"),
        "listed",
    )
