"""SentencePiece encoding and decoding by a relational lattice.

A text is cut into words and these into units, between neighbouring characters that
stand together in no piece, so that no piece can cross a cut. Each distinct unit is
encoded once: its substrings of bounded length are exploded and equi-joined to the
piece table, the hits are its lattice, grouped by unit, and a fold over the lattice
with higher-order functions picks the pieces.

Two folds: `viterbi` takes the path of the highest total score, as unigram models
want it; `merge` joins the best-scoring neighbours, as models trained by byte-pair
encoding want it. Which one is right is written in the model file; Viterbi over a
BPE model's scores gives other pieces than the library. Merges come in the order of
the scores, so one pass over the sorted lattice does, as long as all its pieces can
be made of better ones (checked against the piece table, see `loose_pieces`);
units with other pieces are merged step by step.

Texts are dealt to blocks of about `BLOCK_BYTES`, neighbours in the input together.
A block gets the pieces of its own units only, ahead of its texts, and encodes the
texts as they stream through, so neither the unit table nor a block's texts are
ever held whole in one place. Partitions grow in number with the bytes of the texts,
so that the sorts of a task stay in its memory.

Defined results: null and empty texts have no pieces and come back empty. A text
that holds the blank sign itself (U+2581) decodes to a blank there, as in the
library, so its round trip is false. Units of more than `LONGEST` code points are
folded row-wise by the same rule. Repeated rows each give their row. An empty
table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import let
from ..session import materialize, tune, work_partitions
from .frames import whole_text

SPACE = "▁"
LONGEST = 60
BLOCK_BYTES = 64 << 20
# Bytes of text for each partition of the distinct units.
UNIT_BYTES = 8 << 20
# Distinct units that a task keeps of a block before it gives them.
KEPT_UNITS = 800_000
# Distinct words that a task keeps before it cuts them (units), or with their pieces (texts).
KEPT_WORDS = 400_000
# Bytes of text that a task encodes at once.
CHUNK_BYTES = 4 << 20
WORD = re.compile(rf"{SPACE}+[^{SPACE}]*")


@dataclass(frozen=True)
class Pieces:
    """The piece table of a model: the ordinary pieces with id and score, and the place of the byte pieces."""

    table: tuple[tuple[str, int, float], ...]
    first_byte: int
    longest: int
    fold: str
    texts: tuple[bytes, ...]
    loose: frozenset[str]
    # Class of each code point, and which class may follow which inside a piece.
    classes: np.ndarray
    follows: np.ndarray


def piece_table(rows: list[tuple[str, int, float]], first_byte: int, texts: list[bytes], fold: str) -> Pieces:
    """The table of these pieces, checked to be one whose pieces end before a blank."""
    if any(a != SPACE == b for p, _, _ in rows for a, b in zip(p, p[1:])):
        raise ValueError("a piece has a blank sign after another sign, so texts cannot be cut at blanks")
    longest = max((len(p) for p, _, _ in rows), default=1)
    loose = loose_pieces(rows) if fold == "merge" else frozenset()
    return Pieces(tuple(rows), first_byte, longest, fold, tuple(texts), loose, *_followers(rows))


def _followers(rows: list[tuple[str, int, float]]) -> tuple[np.ndarray, np.ndarray]:
    pairs = {(a, b) for p, _, _ in rows for a, b in zip(p, p[1:])}
    chars = {c: i for i, c in enumerate(sorted({c for pair in pairs for c in pair}), 1)}
    # Class 0 holds the characters that stand alone in every piece.
    classes = np.zeros(0x110000, np.uint16)
    follows = np.zeros((len(chars) + 1, len(chars) + 1), bool)
    for c, i in chars.items():
        classes[ord(c)] = i
    for a, b in pairs:
        follows[chars[a], chars[b]] = True
    return classes, follows


def loose_pieces(rows: list[tuple[str, int, float]]) -> frozenset[str]:
    """Pieces that share their score with others, or that merges of better scores alone do not bring down to two parts.

    If a text has none of them, merges come in descending scores: before a piece can be
    merged, all better merges inside it are done, and leave the two parts that it is made of.
    So no merge of a lower score is ever needed to make one of a higher score possible.
    """
    score = {p: s for p, _, s in rows}
    shared = Counter(score.values())

    def made_of_better(piece: str) -> bool:
        part = list(piece)
        while len(part) > 2:
            best, i = max((score.get(a + b, -math.inf), -i) for i, (a, b) in enumerate(zip(part, part[1:])))
            if best <= score[piece]:
                return False
            part[-i : 2 - i] = [part[-i] + part[1 - i]]
        return True

    return frozenset(p for p in score if len(p) > 1 and (shared[score[p]] > 1 or not made_of_better(p)))


@lru_cache(maxsize=2)
def load_pieces(path: str) -> Pieces:
    """The table of a .model file with byte pieces; BPE models are folded by merges, others by Viterbi."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    rows = [
        (model.id_to_piece(i), i, model.get_score(i))
        for i in ids
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    texts = []
    for i in ids:
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            texts.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            texts.append(b"")
        else:
            texts.append(piece.replace(SPACE, " ").encode())
    # BPE scores are the negated ranks: whole numbers. Unigram scores are log-probabilities.
    fold = "merge" if all(s == int(s) for _, _, s in rows) else "viterbi"
    return piece_table(rows, model.piece_to_id("<0x00>"), texts, fold)


def words_of(text: str) -> list[str]:
    """The words of a text, with a blank put before it and blanks written as the blank sign; the first sign of each is left out."""
    if not text:
        return []
    if SPACE in text or "  " in text or text[0] == " ":
        return [w[1:] for w in WORD.findall(SPACE + text.replace(" ", SPACE))]
    return text.split(" ")


def cut(words: list[str], pieces: Pieces) -> tuple[list[str], list[int]]:
    """The units of all words (blank sign before them) one after the other, and for each word the number of units up to its end."""
    if not words:
        return [], []
    text = SPACE + SPACE.join(words)
    kinds = pieces.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    last = np.cumsum([len(w) + 1 for w in words]) - 1
    cuts = np.append(~pieces.follows[kinds[:-1], kinds[1:]], True)
    cuts[last] = True
    ends = np.flatnonzero(cuts)
    upto = (np.searchsorted(ends, last) + 1).tolist()
    ends = (ends + 1).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)], upto


def lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(`__unit`, `__edges`): for each unit the pieces in it, ends and starts counted from 0.

    For Viterbi an edge is (e, s, score, id); for merges it is one number, see `_packed`.
    `units` has one row for each unit and is partitioned by it, so that grouping needs no shuffle.
    """
    unit = F.col("__unit")
    n = F.length(unit)
    spark = units.sparkSession
    s, e = F.col("s"), F.col("e")
    if pieces.fold == "merge":
        known = spark.createDataFrame(_packed(pieces), "piece string, code long")
        edge = F.col("code") + F.shiftleft(s.cast("bigint"), _S) + F.shiftleft(e.cast("bigint"), _E)
    else:
        known = spark.createDataFrame(list(pieces.table), "piece string, id int, score double")
        edge = F.when(F.col("id").isNotNull(), F.struct("e", "s", "score", "id"))
    # Places, then lengths: two explodes of numbers, so that no substring is made before its row.
    places = units.select("__unit", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    spans = places.select("__unit", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - s))).alias("k"))
    rows = spans.select("__unit", "s", (s + F.col("k")).alias("e"), F.substr(unit, s + 1, F.col("k")).alias("piece"))
    # One vocabulary, whose size the model file fixes. The first character stays, known or not, so that no unit is lost.
    joined = rows.join(F.broadcast(known), "piece", "left").select("__unit", "s", "e", edge.alias("edge"))
    hits = joined.where(F.col("edge").isNotNull() | ((s == 0) & (e == 1)))
    return hits.groupBy("__unit").agg(F.collect_list("edge").alias("__edges"))


# An edge for merges: the place of its score among all (20 bits), start, end (6 bits each), 1 for a loose piece, id (30 bits).
_ORDER, _S, _E, _LOOSE = 43, 37, 31, 30


def _packed(pieces: Pieces) -> list[tuple[str, int]]:
    """Each piece with its edge number, without start and end. Numbers ascend as scores descend, then by the start."""
    order = {s: i for i, s in enumerate(sorted({s for _, _, s in pieces.table}, reverse=True))}
    if len(order) >= 1 << 20 or any(i >= 1 << _LOOSE for _, i, _ in pieces.table):
        raise ValueError("the piece table is too large for packed edges")
    return [(p, (order[s] << _ORDER) + ((p in pieces.loose) << _LOOSE) + i) for p, i, s in pieces.table]


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i)


def _start(x: Column) -> Column:
    return F.shiftrightunsigned(x, _S).bitwiseAND(F.lit(63)).cast("int")


def _end(x: Column) -> Column:
    return F.shiftrightunsigned(x, _E).bitwiseAND(F.lit(63)).cast("int")


def _between(x: Column) -> Column:
    """Bits of the places inside an edge."""
    return _bit(_end(x)) - _bit(_start(x) + 1)


def _has(b: Column, i: Column) -> Column:
    return F.call_function("shiftright", b, i).bitwiseAND(F.lit(1).cast("bigint")) == 1


def _mergeable(b: Column, x: Column) -> Column:
    """Whether the ends of edge `x` are boundaries with one other boundary between them."""
    return _has(b, _start(x)) & _has(b, _end(x)) & (F.bit_count(b.bitwiseAND(_between(x))) == 1)


def merge_fold(unit: Column, edges: Column) -> Column:
    """A bit for each boundary of the chosen pieces, by merging the best neighbours until none can be merged.

    `edges` are packed and sorted; of equal scores the leftmost wins.
    """
    n = F.length(unit)
    start = _bit(n + 1) - 1
    merged = lambda b, x: b.bitwiseAND(F.bitwise_not(_between(x)))
    in_order = F.aggregate(edges, start, lambda b, x: F.when(_mergeable(b, x), merged(b, x)).otherwise(b))

    def step(b: Column, _: Column) -> Column:
        best = F.array_min(F.filter(edges, lambda x: _mergeable(b, x)))
        return let(best, lambda x: F.coalesce(merged(b, x), b))

    # Every step merges one edge or is the last that could.
    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    loose = F.exists(edges, lambda x: x.bitwiseAND(F.lit(1 << _LOOSE)) != 0)
    return F.when(loose, F.aggregate(steps, start, step)).otherwise(in_order)


def merged_ids(unit: Column, edges: Column, bounds: Column, first_byte: int) -> Column:
    """Ids of the pieces between the boundaries; a character that is no piece gives its UTF-8 bytes."""

    def ids(b: Column) -> Column:
        taken = F.filter(edges, lambda x: _has(b, _start(x)) & _has(b, _end(x)) & (b.bitwiseAND(_between(x)) == 0))

        def of(chosen: Column) -> Column:
            low = F.lit((1 << _LOOSE) - 1)
            placed = F.sort_array(F.transform(chosen, lambda x: F.shiftleft(_start(x).cast("bigint"), 32).bitwiseOR(x.bitwiseAND(low))))
            plain = F.transform(placed, lambda x: x.bitwiseAND(low).cast("int"))
            starts = F.filter(F.sequence(F.lit(0), F.length(unit) - 1), lambda i: _has(b, i))
            opened = F.transform(
                chosen, lambda x: F.struct(_end(x).alias("e"), _start(x).alias("s"), x.bitwiseAND(low).cast("int").alias("id"))
            )
            return F.when(F.size(chosen) == F.bit_count(b) - 1, plain).otherwise(piece_ids(unit, opened, starts, first_byte))

        return let(taken, of)

    return let(bounds, ids)


def viterbi_fold(unit: Column, edges: Column, unknown: float = -1e6) -> Column:
    """Starts of the pieces on the path with the highest total score.

    The state holds, for each place so far, the best score and the starts on the way there.
    Characters that are no piece cost `unknown`.
    """
    n = F.length(unit)
    path = "struct<score: double, starts: array<int>>"

    def step(state: Column, j: Column) -> Column:
        here = F.filter(edges, lambda x: x["e"] == j)

        def extend(s: Column, score: Column) -> Column:
            before = F.get(state, s)
            return F.struct((before["score"] + score).alias("score"), F.concat(before["starts"], F.array(s)).alias("starts"))

        ways = F.transform(here, lambda x: extend(x["s"], x["score"]))
        alone = F.when(F.exists(here, lambda x: x["s"] == j - 1), F.array().cast(f"array<{path}>")).otherwise(
            F.array(extend(j - 1, F.lit(unknown)))
        )
        return F.concat(state, F.array(F.array_max(F.concat(ways, alone))))

    first = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("starts")))
    return F.aggregate(F.sequence(F.lit(1), n), first, step, lambda state: F.get(state, n)["starts"])


def piece_ids(unit: Column, edges: Column, starts: Column, first_byte: int) -> Column:
    """Ids of the pieces that begin at `starts`; a character that is no piece gives its UTF-8 bytes."""
    n = F.length(unit)

    def ids(s: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1), n)
        found = F.filter(edges, lambda x: (x["s"] == s) & (x["e"] == end))
        digits = F.hex(F.encode(F.substr(unit, s + 1, F.lit(1)), "UTF-8"))
        code = F.transform(
            F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)),
            lambda i: F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("int") + first_byte,
        )
        return F.when(F.size(found) > 0, F.array(F.get(found, F.lit(0))["id"])).otherwise(code)

    return F.flatten(F.transform(starts, ids))


def encode_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(`__unit`, `__ids`) for each of the distinct units."""
    unit, edges = F.col("__unit"), F.col("__edges")
    found = lattice(units, pieces)
    if pieces.fold == "merge":
        ids = let(F.sort_array(edges), lambda x: merged_ids(unit, x, merge_fold(unit, x), pieces.first_byte))
        return found.select("__unit", ids.alias("__ids"))
    folded = found.select("__unit", "__edges", viterbi_fold(unit, edges).alias("__starts"))
    return folded.select("__unit", piece_ids(unit, edges, F.col("__starts"), pieces.first_byte).alias("__ids"))


class RowFold:
    """The same folds for one long unit, in Python."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.score = {p: (s, i) for p, i, s in pieces.table}

    def ids(self, unit: str) -> list[int]:
        found = self._merged(unit) if self.pieces.fold == "merge" else self._best(unit)
        out: list[int] = []
        for piece in found:
            known = self.score.get(piece)
            out += [known[1]] if known else [self.pieces.first_byte + b for b in piece.encode()]
        return out

    def _merged(self, unit: str) -> list[str]:
        part: list[str] = list(unit)
        after = list(range(1, len(part) + 1))
        before = list(range(-1, len(part) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(part)
            if i >= 0 and j < len(part) and (joined := part[i] + part[j]) in self.score:
                heapq.heappush(heap, (-self.score[joined][0], i, joined))

        for i in range(len(part)):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            # Stale offers: one of the two has since been merged.
            if not part[i] or j >= len(part) or part[i] + part[j] != joined:
                continue
            part[i], part[j] = joined, ""
            after[i] = after[j]
            if after[j] < len(part):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in part if p]

    def _best(self, unit: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for j in range(1, len(unit) + 1):
            ways = [
                (best[i][0] + self.score[unit[i:j]][0], i) for i in range(max(0, j - self.pieces.longest), j) if unit[i:j] in self.score
            ]
            if not any(i == j - 1 for _, i in ways):
                ways.append((best[j - 1][0] - 1e6, j - 1))
            best.append(max(ways))
        out, j = [], len(unit)
        while j:
            out.append(unit[best[j][1] : j])
            j = best[j][1]
        return out[::-1]


def decode_ids(ids: list[int], pieces: Pieces) -> str:
    """The text of a sequence of ids, without the blank put before it."""
    return b"".join(map(pieces.texts.__getitem__, ids)).decode("utf-8", "replace")[1:]


def in_blocks(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """(`__id`, `__text`, `__block`), neighbouring rows of a file in blocks of about `BLOCK_BYTES`, and the bytes of all texts."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = materialize(docs.select(key, text), "texts")
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    rows = max(1, BLOCK_BYTES * size["n"] // max(1, size["b"] or 0)) if size["n"] else 1
    block = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / rows))
    return docs.select(F.col(key).alias("__id"), whole_text(text).alias("__text"), block.alias("__block")), size["b"] or 0


def block_units(rows: DataFrame, path: str) -> DataFrame:
    """(`__block`, `__unit`): the units of each block that the lattice encodes; a task gives each of its units once or a few times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(path)
        block, words, units = None, set(), set()
        for batch in batches:
            for at, text in zip(batch.column("__block").to_pylist(), batch.column("__text")):
                if at != block:
                    yield from _unit_batches(block, words, units, pieces)
                    block, words, units = at, set(), set()
                words.update(words_of(text.as_py()))
                if len(words) > KEPT_WORDS:
                    units.update(cut(list(words), pieces)[0])
                    words = set()
                    if len(units) > KEPT_UNITS:
                        yield from _unit_batches(block, words, units, pieces)
                        units = set()
        yield from _unit_batches(block, words, units, pieces)

    return rows.select("__block", "__text").mapInArrow(run, "__block long, __unit string")


def _unit_batches(block: int | None, words: set[str], units: set[str], pieces: Pieces) -> Iterator[pa.RecordBatch]:
    units.update(cut(list(words), pieces)[0])
    short = sorted(u for u in units if len(u) <= LONGEST)
    for i in range(0, len(short), 50_000):
        part = short[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int64()), pa.array(part)], names=["__block", "__unit"])


def packed_texts(rows: DataFrame) -> DataFrame:
    """The rows with the text compressed, for a smaller shuffle."""
    kind = dict(rows.dtypes)["__id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            blobs = [packer.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__block"), batch.column("__id"), pa.array(blobs, pa.binary())], names=["__block", "__id", "__blob"]
            )

    return rows.select("__block", "__id", "__text").mapInArrow(run, f"__block long, __id {kind}, __blob binary")


def encode_documents(
    docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row for each row: key, n_chars, n_pieces, ids_sha256 (of 32-bit little-endian ids), round_trip, and `ids` on demand."""
    spark = tune(docs.sparkSession)
    pieces = load_pieces(model_path)
    partitions = work_partitions(spark)
    rows, size = in_blocks(docs, key, text)
    kind = dict(rows.dtypes)["__id"]
    # One shuffle for the distinct units and the blocks' demands: both read the same columns, so the exchange is used again.
    units = block_units(rows, model_path).where(F.col("__unit").isNotNull())
    asked = units.repartition(max(partitions, size // UNIT_BYTES), "__unit")
    distinct = asked.groupBy("__unit").agg(F.min("__block").alias("__first")).where(F.col("__first").isNotNull())
    encoded = encode_units(distinct, pieces)
    given = asked.join(encoded, "__unit").select(
        "__block", F.lit(0).alias("__kind"), "__unit", "__ids", F.lit(None).cast(kind).alias("__id"), F.lit(None).cast("binary").alias("__blob")
    )
    texts = packed_texts(rows).select(
        "__block", F.lit(1).alias("__kind"), F.lit(None).cast("string").alias("__unit"),
        F.lit(None).cast("array<int>").alias("__ids"), "__id", "__blob",
    )
    dealt = given.unionByName(texts).repartition(max(partitions, 2 * size // BLOCK_BYTES), "__block").sortWithinPartitions("__block", "__kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load_pieces(model_path)
        fold = RowFold(own)
        unpack = zstandard.ZstdDecompressor()
        known: dict[str, bytes] = {}
        words: dict[str, bytes] = {}
        odd: set[str] = set()
        block = None
        for batch in batches:
            kinds, blocks = batch.column("__kind").to_numpy(), batch.column("__block").to_numpy()
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if blocks[a] != block:
                    known, words, odd, block = {}, {}, set(), blocks[a]
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    ids = part.column("__ids")
                    flat = ids.flatten().to_numpy().astype("<i4").tobytes()
                    ends = np.cumsum(ids.value_lengths().to_numpy()).tolist()
                    known.update(zip(part.column("__unit").to_pylist(), [flat[4 * s : 4 * e] for s, e in zip([0, *ends], ends)]))
                else:
                    for chunk in _chunks(part, unpack):
                        if len(words) > KEPT_WORDS:
                            words, odd = {}, set()
                        yield _encode_part(*chunk, known, words, odd, fold, key, with_ids)

    schema = f"`{key}` {kind}, n_chars long, n_pieces long, ids_sha256 string, round_trip boolean"
    return dealt.mapInArrow(run, schema + ", ids array<int>" * with_ids)


def _chunks(part: pa.RecordBatch, unpack) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of the rows, about `CHUNK_BYTES` at a time."""
    texts: list[str] = []
    begun = size = 0
    for i, blob in enumerate(part.column("__blob"), 1):
        raw = unpack.decompress(blob.as_py())
        texts.append(raw.decode("utf-8", "surrogatepass"))
        size += len(raw)
        if size >= CHUNK_BYTES or i == part.num_rows:
            yield part.column("__id").slice(begun, i - begun), texts
            texts, begun, size = [], i, 0


def _encode_part(
    keys: pa.Array, texts: list[str], known: dict[str, bytes], words: dict[str, bytes], odd: set[str], fold: RowFold, key: str, with_ids: bool
) -> pa.RecordBatch:
    """One row for each text. `known` has the ids of the units; `words` takes those of the words met, `odd` words that decode to others."""
    pieces = fold.pieces
    said = [words_of(t) for t in texts]
    new = list(set().union(*said).difference(words.keys()))
    units, upto = cut(new, pieces)
    coded = [known[u] if len(u) <= LONGEST else np.array(fold.ids(u), "<i4").tobytes() for u in units]
    ids = np.frombuffer(b"".join(coded), "<i4").tolist()
    all_back = decode_ids(ids, pieces) == " ".join(new).replace(SPACE, " ")
    for w, a, b in zip(new, [0, *upto], upto):
        words[w] = code = coded[a] if b - a == 1 else b"".join(coded[a:b])
        if not all_back and decode_ids(np.frombuffer(code, "<i4").tolist(), pieces) != w.replace(SPACE, " "):
            odd.add(w)
    out: list[tuple] = []
    lists: list[np.ndarray] = []
    for text, ws in zip(texts, said):
        code = b"".join(map(words.__getitem__, ws))
        ids = np.frombuffer(code, "<i4")
        # Words that decode to themselves, one by one, do so in a row.
        back = SPACE not in text and odd.isdisjoint(ws) or decode_ids(ids.tolist(), pieces) == text
        out.append((len(text), len(ids), hashlib.sha256(code).hexdigest(), back))
        if with_ids:
            lists.append(ids)
    columns = [keys, *[pa.array(c) for c in zip(*out)]]
    names = [key, "n_chars", "n_pieces", "ids_sha256", "round_trip"]
    if with_ids:
        columns.append(pa.array(lists, pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names=names)
