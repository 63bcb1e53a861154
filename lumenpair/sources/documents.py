"""Entries of large JSON documents, each document read by many tasks.

A document is scanned in byte ranges, cut at commas as a text file is cut at line ends. A
range cannot know where it begins: inside a string or not, and how deep. So a first pass
sums up every range for both cases (quotes, change and least of the depth), a prefix
over the few range rows turns that into the state at each start, and a second pass
cuts the entries. Entries that run over the end of a range are stitched together from
their pieces; nothing but an entry is ever held whole.

An escape never runs over a comma in valid JSON, so quotes and depth are all the state
there is. Documents that are not valid JSON give entries that do not parse. Of equal keys
of an object the last one stays, in the place of the first. Empty documents,
objects and lists have no entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import BROADCAST_GROUPS
from ..session import materialize, work_partitions

QUOTE, BACKSLASH, COMMA = ord('"'), ord("\\"), ord(",")
STEP = np.zeros(256, np.int8)
STEP[[ord("{"), ord("[")]] = 1
STEP[[ord("}"), ord("]")]] = -1
COMPLETE, TAIL, HEAD, MIDDLE = range(4)


def _open_quotes(data: np.ndarray) -> np.ndarray:
    """Places of the quotes that open or close a string: those after an even number of backslashes."""
    at = np.flatnonzero(data == QUOTE)
    doubtful = np.flatnonzero((at > 0) & (data[at - 1] == BACKSLASH))
    drop = []
    for k in doubtful.tolist():
        i = at[k] - 1
        while i >= 0 and data[i] == BACKSLASH:
            i -= 1
        if (at[k] - 1 - i) % 2:
            drop.append(k)
    return np.delete(at, drop)


def _in_string(data: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """Whether each byte lies in a string (quotes do not count as inside or outside of brackets), and the state at the end."""
    marks = np.zeros(len(data), np.int8)
    marks[_open_quotes(data)] = 1
    state = (np.cumsum(marks, dtype=np.int64) + int(inside)) & 1
    return state.astype(bool), bool(state[-1]) if len(state) else inside


def _stream(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """(range, bytes) of the neighbouring rows of each range; every row gets back the comma that cut it."""
    files, blocks = batch.column("__file").to_numpy(), batch.column("__block").to_numpy()
    texts = batch.column("value").to_pylist()
    cuts = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
        if a < b:
            yield (int(files[a]), int(blocks[a])), np.frombuffer((",".join(texts[a:b]) + ",").encode(), np.uint8)


def scanned(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The text between commas, with file and range; neighbours stay neighbours."""
    rows = spark.read.option("lineSep", ",").text(path)
    return rows.select(
        F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.col("_metadata.file_path").alias("source_file"), "value",
    )


def range_summaries(rows: DataFrame) -> DataFrame:
    """One row for each range: parity of quotes, change and least of the depth if it begins outside (0) or inside (1) a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for at, data in _stream(batch):
                s = found.setdefault(at, [0, 0, 0, 0, 0, 0])
                inside, _ = _in_string(data, bool(s[0]))
                steps = STEP[data].astype(np.int64)
                # In the other case all is the other way round.
                for case, mask in ((0, ~inside), (1, inside)):
                    depth = np.cumsum(np.where(mask, steps, 0))
                    s[3 + case] = min(s[3 + case], s[1 + case] + int(depth.min()))
                    s[1 + case] += int(depth[-1])
                s[0] = int(inside[-1])
                if not s[5]:
                    text = bytes(data[:4096]).decode("utf-8", "replace").lstrip("﻿ \t\r\n")
                    s[5] = ord(text[0]) if text else 0
        if found:
            keys, values = zip(*found.items())
            columns = [pa.array(c, pa.int64()) for c in (*zip(*keys), *zip(*values))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["__file", "__block", "parity", "change0", "change1", "least0", "least1", "first"]
    return rows.select("__file", "__block", "value").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def range_states(summaries: DataFrame) -> DataFrame:
    """(`__file`, `__block`, `inside`, `depth`, `least`, `is_list`): the state at the start of each range.

    The prefix runs over one small row for each range, file by file.
    """
    order = Window.partitionBy("__file").orderBy("__block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2
    known = summaries.withColumn("inside", inside)
    pick = lambda name: F.when(F.col("inside") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    known = known.select("__file", "__block", "inside", pick("change").alias("change"), pick("least").alias("below"), "first")
    depth = F.coalesce(F.sum("change").over(before), F.lit(0))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = known.withColumn("depth", depth).withColumn("top", F.first("first").over(whole))
    return placed.select(
        "__file", "__block", "inside", "depth", (F.col("depth") + F.col("below")).alias("least"), (F.col("top") == ord("[")).alias("is_list")
    )


def _with_states(rows: DataFrame, states: DataFrame) -> DataFrame:
    """The rows with the state of their range, in their order."""
    n = states.count()
    keys = ["__file", "__block"]
    if n <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(states), keys)
    numbered = rows.withColumn("__seq", F.monotonically_increasing_id())
    return numbered.join(states, keys).repartition(work_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "__seq")


class _Range:
    """The state of one range while it streams through."""

    def __init__(self, at: tuple[int, int], inside: bool, depth: int) -> None:
        self.at, self.inside, self.depth = at, inside, depth

    def advance(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(in a string, depth after the byte) for the bytes that come next."""
        string, self.inside = _in_string(data, self.inside)
        depth = self.depth + np.cumsum(np.where(string, 0, STEP[data].astype(np.int64)))
        self.depth = int(depth[-1])
        return string, depth


def _opens(data: np.ndarray, string: np.ndarray, depth: np.ndarray, name: str) -> list[int]:
    """Places of the brackets that open the list under the key `name` of the document's object."""
    brackets = np.flatnonzero((data == ord("[")) & ~string & (depth == 2))
    wanted = []
    for i in brackets.tolist():
        before = bytes(data[max(0, i - 2 * len(name.encode()) - 256) : i]).rstrip()
        if before.endswith(b":") and before[:-1].rstrip().endswith(b'"' + name.encode() + b'"'):
            wanted.append(i)
    return wanted


def list_ranges(rows: DataFrame, states: DataFrame, name: str) -> DataFrame:
    """`states` with `listed` (the document has a list under `name`) and `within` (the range begins in it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Range | None = None
        opened, still = False, False
        out: list[tuple] = []
        for batch in batches:
            start = 0
            inside, depths = batch.column("inside").to_numpy(), batch.column("depth").to_numpy()
            files, blocks = batch.column("__file").to_numpy(), batch.column("__block").to_numpy()
            for at, data in _stream(batch):
                first = start + int(np.flatnonzero((files[start:] == at[0]) & (blocks[start:] == at[1]))[0])
                start = first
                if current is None or current.at != at:
                    if current and opened:
                        out.append((*current.at, still))
                    current, opened, still = _Range(at, bool(inside[first]), int(depths[first])), False, False
                string, depth = current.advance(data)
                places = [] if opened else _opens(data, string, depth, name)
                if places:
                    opened, still = True, not (depth[places[0] :] < 2).any()
                elif still:
                    still = not (depth < 2).any()
        if current and opened:
            out.append((*current.at, still))
        if out:
            f, b, s = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(b, pa.int64()), pa.array(s)], names=["__file", "__block", "still"])

    objects = states.where(~F.col("is_list")).select("__file", "__block", "inside", "depth")
    found = _with_states(rows.select("__file", "__block", "value"), objects).mapInArrow(run, "__file long, __block long, still boolean")
    first = materialize(found, "lists").groupBy("__file").agg(F.min(F.struct("__block", "still")).alias("__open"))
    joined = states.join(first, "__file", "left")
    at = F.col("__open.__block")
    closed = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    # Closed since: a range after the opening one, and before this, that comes down to the document's object.
    since = F.max(((F.col("__block") > at) & (F.col("least") < 2)).cast("int")).over(closed)
    within = (F.col("__block") > at) & F.col("__open.still") & (F.coalesce(since, F.lit(0)) == 0)
    return joined.select(
        *states.columns, at.isNotNull().alias("listed"), F.coalesce(within, F.lit(False)).alias("within"),
        F.coalesce(F.col("__block") == at, F.lit(False)).alias("opening"),
    )


class _Cutter:
    """Cuts the entries of one range: those at depth `cut`, in the wanted list only if there is one."""

    def __init__(self, row: dict, name: str | None) -> None:
        self.state = _Range((row["__file"], row["__block"]), bool(row["inside"]), row["depth"])
        self.listed = bool(row["listed"])
        self.name, self.opening = name, bool(row["opening"])
        self.cut = 2 if self.listed else 1
        # An entry is open at the start: its piece here continues one of an earlier range.
        self.open = row["depth"] >= self.cut and (not self.listed or bool(row["within"]))
        self.continued = self.open
        self.held: list[bytes] = []
        self.n = 0

    def feed(self, data: np.ndarray) -> list[tuple[int, int, str]]:
        string, depth = self.state.advance(data)
        out: list[tuple[int, int, str]] = []
        at = 0
        while at < len(data):
            if not self.open:
                start = self._next_start(data, string, depth, at)
                if start is None:
                    return out
                self.open, at = True, start + 1
                continue
            below = np.flatnonzero(depth[at:] < self.cut)
            end = at + int(below[0]) if len(below) else len(data)
            part = slice(at, end)
            commas = at + np.flatnonzero((data[part] == COMMA) & ~string[part] & (depth[part] == self.cut))
            begin = at
            for c in commas.tolist():
                self.held.append(bytes(data[begin:c]))
                out += self._close()
                begin = c + 1
            self.held.append(bytes(data[begin:end]))
            if end < len(data):
                out += self._close()
                self.open = False
                if self.listed:
                    self.name = None  # the list has ended, and no other one is wanted
            at = end + 1
        return out

    def _next_start(self, data, string, depth, at: int) -> int | None:
        if not self.listed:
            if self.n or self.state.at[1] > 0:
                return None
            found = at + np.flatnonzero((STEP[data[at:]] == 1) & ~string[at:] & (depth[at:] == 1))
            return int(found[0]) if len(found) else None
        if self.name is None or not self.opening:
            return None
        found = [i for i in _opens(data, string, depth, self.name) if i >= at]
        return found[0] if found else None

    def _close(self) -> list[tuple[int, int, str]]:
        text = b"".join(self.held).decode()
        self.held = []
        if self.continued:
            self.continued = False
            return [(HEAD, -1, text)]
        if not text.strip():
            return []  # an empty list or object
        self.n += 1
        return [(COMPLETE, self.n - 1, text)]

    def finish(self) -> list[tuple[int, int, str]]:
        if not self.open:
            return []
        text = b"".join(self.held).decode()
        return [(MIDDLE, -1, text)] if self.continued else [(TAIL, self.n, text)]


def pieces(rows: DataFrame, states: DataFrame, name: str | None) -> DataFrame:
    """(`__file`, `__block`, `kind`, `n`, `text`): whole entries, and the pieces of those that run over the end of a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Cutter | None = None
        names = ["__file", "__block", "inside", "depth", "listed", "within", "opening"]

        def shown(at: tuple[int, int], found: list[tuple[int, int, str]]) -> Iterator[pa.RecordBatch]:
            if found:
                kinds, ns, texts = zip(*found)
                k = len(found)
                columns = [pa.array([at[0]] * k, pa.int64()), pa.array([at[1]] * k, pa.int64()), pa.array(kinds, pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(ns, pa.int64()), pa.array(texts, pa.string())], names=["__file", "__block", "kind", "n", "text"]
                )

        for batch in batches:
            files, blocks = batch.column("__file").to_numpy(), batch.column("__block").to_numpy()
            start = 0
            for at, data in _stream(batch):
                start += int(np.flatnonzero((files[start:] == at[0]) & (blocks[start:] == at[1]))[0])
                if current is None or current.state.at != at:
                    if current:
                        yield from shown(current.state.at, current.finish())
                    current = _Cutter({c: batch.column(c)[start].as_py() for c in names}, name)
                yield from shown(at, current.feed(data))
        if current:
            yield from shown(current.state.at, current.finish())

    given = _with_states(rows.select("__file", "__block", "value"), states.drop("least", "is_list"))
    return given.mapInArrow(run, "__file long, __block long, kind int, n long, text string")


def json_entries(spark: SparkSession, path: str | list[str], unwrap: str | None = None) -> DataFrame:
    """(source_file, key, record, record_index) of JSON documents: the members of an object, or the elements of a list;
    with `unwrap`, of the list that an object holds under that name.

    `record` is the entry's JSON text, or the string itself where it is one; null for a JSON null.
    """
    rows = scanned(spark, path)
    states = range_states(materialize(range_summaries(rows), "ranges"))
    if unwrap:
        states = list_ranges(rows, materialize(states, "states"), unwrap)
    else:
        states = states.select("*", *[F.lit(False).alias(c) for c in ("listed", "within", "opening")])
    states = materialize(states, "states")
    cut = materialize(pieces(rows, states, unwrap), "pieces")
    # Per range: entries that begin in it, and whether its last one runs on.
    begun = cut.groupBy("__file", "__block").agg(
        F.count_if(F.col("kind").isin(COMPLETE, TAIL)).alias("__begun"), F.max((F.col("kind") == TAIL).cast("int")).alias("__runs_on"),
        F.max(F.when(F.col("kind") == TAIL, F.col("n"))).alias("__n"),
    )
    before = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.last(F.when(F.col("__runs_on") == 1, F.struct(F.col("__block").alias("block"), F.col("__n").alias("n"))), ignorenulls=True)
    placed = begun.select(
        "__file", "__block", F.coalesce(F.sum("__begun").over(before), F.lit(0)).alias("__first"), open_.over(before).alias("__from")
    )
    files = rows.select("__file", "source_file").distinct().join(states.select("__file", "is_list", "listed").distinct(), "__file")
    ranges = materialize(placed.join(files, "__file"), "placed")
    side = F.broadcast(ranges) if ranges.count() <= BROADCAST_GROUPS else ranges
    known = cut.join(side, ["__file", "__block"])
    whole = known.where(F.col("kind") == COMPLETE).select("source_file", "is_list", "listed", (F.col("__first") + F.col("n")).alias("record_index"), "text")
    parts = known.where(F.col("kind") != COMPLETE)
    own = F.col("kind") == TAIL
    keyed = parts.select(
        "source_file", "is_list", "listed", "__file", F.when(own, F.col("__block")).otherwise(F.col("__from.block")).alias("__start"),
        F.when(own, F.col("__first") + F.col("n")).alias("__index"), "__block", "text",
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("__block", "text"))), lambda p: p["text"])
    stitched = keyed.groupBy("source_file", "is_list", "listed", "__file", "__start").agg(
        F.max("__index").alias("record_index"), F.array_join(ordered, "").alias("text")
    )
    both = whole.unionByName(stitched.select(*whole.columns))
    element = F.get(F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>"), F.lit(0))
    member = F.get(F.map_entries(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "map<string,string>")), F.lit(0))
    is_member = ~F.col("is_list") & ~F.col("listed")
    entries = both.select("source_file", "record_index", is_member.alias("__member"), element.alias("__element"), F.when(is_member, member).alias("__pair"))
    return _last_of_keys(entries)


def _last_of_keys(entries: DataFrame) -> DataFrame:
    """Elements as they are; of members with one key the last value in the first place."""
    elements = entries.where(~F.col("__member")).select(
        "source_file", F.lit(None).cast("string").alias("key"), F.col("__element").alias("record"), "record_index"
    )
    members = entries.where("__member").select("source_file", F.col("__pair.key").alias("key"), F.col("__pair.value").alias("record"), "record_index")
    once = members.groupBy("source_file", "key").agg(
        F.max(F.struct("record_index", "record")).alias("__last"), F.min("record_index").alias("record_index")
    )
    return elements.unionByName(once.select("source_file", "key", F.col("__last.record").alias("record"), "record_index"))
