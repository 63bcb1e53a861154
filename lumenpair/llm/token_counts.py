"""Token counts by a digest cache.

A content is known by the digest of its normalised text, a tokenizer by the
digest of its file. Known pairs get their stored count in a join; of the others
each distinct content is encoded once and its count appended to the cache, a
Parquet table in a shared folder.

Defined results: a null text counts as empty and has no tokens. Repeated rows
stay and are encoded once. An empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import whole_text

CACHE_SCHEMA = "digest string, tokenizer string, n_tokens long"
# Runs of these become one space. No tokenizer this is used with (`words_apart`) gives a token for them.
BLANKS = "[ \\t\\n\\r]+"
# Word counts that a worker remembers; it starts anew beyond this. The counts are the same either way.
REMEMBERED = 250_000
LONGEST_REMEMBERED = 64
TOGETHER = 256
# A text of these characters only has the same tokens in lower case.
OTHER_CHARACTERS = re.compile("[^\\x00-\u012f\u0131-\u017f]")
CLOSING_MARKS = re.compile("(?<=[a-z])([.,]+)(?![^ ])")


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The library's tokenizer with neither truncation nor padding, once for each worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def words_apart(path: str) -> bool:
    """Whether the tokenizer drops white space and encodes the words between it one by one.

    Then a text has as many tokens as its words have, and each distinct word of
    a task needs encoding once. Shown on probes for the two things that could
    join words: blanks that give tokens, and words that meet over a blank.
    """
    count = lambda text: len(load_tokenizer(path).encode(text, add_special_tokens=False).ids)
    probes = ["a", "it's", "́e", "x̸", "9", "99", "...", "<|endoftext|>", "'s", "é", "中文"]
    alone = all(count(blank) == 0 for blank in (" ", "\n", "\t", "\r", "  \n"))
    return alone and all(count(f"{a}{s}{b}") == count(a) + count(b) for a in probes for b in probes for s in " \n")


def folds_words(path: str) -> bool:
    """Whether lower-casing a text, and putting a blank before a closing mark, changes no token.

    Read off the tokenizer's own steps: its normaliser has to give the same for a
    letter and its lower case, its word splitter has to part a mark from a letter.
    """
    tokenizer = load_tokenizer(path)
    normal, split = tokenizer.normalizer, tokenizer.pre_tokenizer
    if normal is None or split is None:
        return False
    letters = [chr(c) for c in range(0x21, 0x250) if not OTHER_CHARACTERS.search(chr(c)) and chr(c) != chr(c).lower()]
    pieces = lambda text: [word for word, _ in split.pre_tokenize_str(normal.normalize_str(text))]
    marks = [chr(c) for c in range(0x21, 0x250) if CLOSING_MARKS.sub(r" \1", f"a{chr(c)}") != f"a{chr(c)}"]
    return all(normal.normalize_str(f"a{c}b") == normal.normalize_str(f"a{c.lower()}b") for c in letters) and all(
        pieces(f"a{m}") == pieces("a") + pieces(m) for m in marks
    )


class TokenCounter:
    """Counts the tokens of whole texts as the library gives them."""

    def __init__(self, path: str) -> None:
        self.tokenizer = load_tokenizer(path)
        self.by_word = words_apart(path)
        self.folds = self.by_word and folds_words(path)
        self.known: dict[str, int] = {"": 0}

    def count(self, texts: list[str]) -> list[int]:
        if self.by_word:
            return [self._by_words(text) for text in texts]
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_words(self, text: str) -> int:
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if self.folds and "<|" not in text and not OTHER_CHARACTERS.search(text):
            # Fewer distinct words: the tokenizer lower-cases, and marks after a letter are words of their own to it.
            text = CLOSING_MARKS.sub(r" \1", text.lower())
        words = text.split(" ")
        known = self.known
        new = [w for w in set(words) if w not in known]
        counts = self._encode(new) if new else {}
        if len(known) + len(counts) > REMEMBERED:
            known.clear()
            known[""] = 0
            counts = self._encode(list(set(words)))
        total = sum(counts[w] if w in counts else known[w] for w in words) if counts else sum(map(known.__getitem__, words))
        known.update((w, n) for w, n in counts.items() if len(w) <= LONGEST_REMEMBERED)
        return total

    def _encode(self, words: list[str]) -> dict[str, int]:
        """Tokens of each word; many words go to the library as one text, and offsets tell whose a token is."""
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        encoded = self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)
        counts: dict[str, int] = {}
        for group, found in zip(groups, encoded):
            ends = np.cumsum([len(w) + 1 for w in group])
            starts = np.array([o[0] for o in found.offsets], np.int64)
            of = np.searchsorted(ends, starts, "right")
            counts.update(zip(group, np.bincount(of, minlength=len(group)).tolist()))
        return counts


@lru_cache(maxsize=2)
def counter_of(path: str) -> TokenCounter:
    """One counter for each worker, so that what it remembers serves all its tasks."""
    return TokenCounter(path)


def encode_counts(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """(digest, n_tokens) for rows (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer_path)
        for batch in batches:
            counts = counter.count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"]
            )

    return texts.select("digest", "text").mapInArrow(run, "digest string, n_tokens long")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none where nothing has been stored yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    limit: int = 2048,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row; new counts are appended at `cache_path`."""
    spark = docs.sparkSession
    version = file_digest(tokenizer_path)
    rows = docs.select(F.col(key).alias("__id"), whole_text(text).alias("text"))
    if words_apart(tokenizer_path):
        normal = F.regexp_replace("text", BLANKS, " ")
    else:
        normal = F.col("text")
    rows = rows.select("__id", "text", F.sha2(normal, 256).alias("digest"))
    keyed = rows.select("__id", F.octet_length("text").cast("bigint").alias("n_bytes"), "digest")
    stored = read_cache(spark, cache_path).where(F.col("tokenizer") == version)
    # One row stands for each unknown content; only its text is moved and encoded.
    misses = (
        keyed.groupBy("digest")
        .agg(F.min("__id").alias("__first"))
        .join(stored.select("digest"), "digest", "left_anti")
        .withColumnRenamed("digest", "__digest")
    )
    texts = rows.join(misses, F.col("__id").eqNullSafe(F.col("__first")) & (F.col("digest") == F.col("__digest")), "left_semi")
    fresh = encode_counts(texts, tokenizer_path).dropDuplicates(["digest"])
    fresh.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    # Runs that overlap may both have stored a digest; it counts once.
    stored = read_cache(spark, cache_path).where(F.col("tokenizer") == version)
    counts = stored.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    return keyed.join(counts, "digest", "left").select(
        F.col("__id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
