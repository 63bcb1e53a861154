"""Chat formatting by quotation linking.

A message's lines are parsed into levels of quotation (the `>` signs before
them). What stands at level 0 is its own text; a run of lines of one higher level
is a quoted passage. Passages are normalised and hashed and meet the own texts,
paragraphs and lines of the messages of the same conversation; a passage belongs to the
latest earlier message that has it. The passages of level 1 tell which message is
answered. Conversations come out without quotes and in the order of replies:
sort by (conversation, root, depth, turn).

Passages and originals are put in one order for each (conversation, digest) and
walked once, so no pairs of equal passages are formed; roots and depths come from
pointer jumping, so a long conversation is never gathered in one task.

Defined results: null, empty and blank messages have no own passages and quote
nothing. A null conversation or turn has no links and no root. Rows with equal
conversation and turn are one message for linking, and all of them are returned.
A passage without original links to nothing. An empty table gives an empty
result. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .frames import whole_text

MARKS = re.compile(r"^((?:>[ \t]?)+)(.*)$", re.DOTALL)


def split_levels(text: str) -> list[tuple[int, str]]:
    """(level, text) of each run of lines at one level of quotation, in order."""
    runs: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        found = MARKS.match(line)
        level, rest = (found[1].count(">"), found[2]) if found else (0, line)
        if not runs or runs[-1][0] != level:
            runs.append((level, []))
        runs[-1][1].append(rest)
    return [(level, "\n".join(lines)) for level, lines in runs]


def normalised(passage: str) -> str:
    return " ".join(passage.split()).lower()


def passage_digest(passage: str) -> str | None:
    text = normalised(passage)
    return xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass")) if text else None


def parse_message(text: str) -> tuple[str, list[str], list[tuple[int, str]]]:
    """Own text, digests of the own passages, and (level, digest) of the quoted ones."""
    runs = split_levels(text)
    own = [passage for level, passage in runs if level == 0]
    whole = "\n".join(own)
    parts = [whole, *own, *re.split(r"\n\s*\n", whole), *whole.split("\n")]
    digests = list(dict.fromkeys(d for p in parts if (d := passage_digest(p))))
    quotes = [(level, d) for level, passage in runs if level and (d := passage_digest(passage))]
    return whole.strip("\n"), digests, quotes


def parse(messages: DataFrame) -> DataFrame:
    """`messages` (`__conv`, `__turn`, `__role`, `__text`) with `__own`, `__digests`, `__quotes`."""
    names = ["__conv", "__turn", "__role"]
    kinds = dict(messages.dtypes)
    quote = pa.struct([("level", pa.int32()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_message(t) for t in batch.column("__text").to_pylist()]
            quotes = [[{"level": n, "digest": d} for n, d in q] for _, _, q in found]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names],
                    pa.array([own for own, _, _ in found], pa.string()),
                    pa.array([d for _, d, _ in found], pa.list_(pa.string())),
                    pa.array(quotes, pa.list_(quote)),
                ],
                names=[*names, "__own", "__digests", "__quotes"],
            )

    schema = ", ".join(f"{c} {kinds[c]}" for c in names)
    return messages.mapInArrow(
        run, f"{schema}, __own string, __digests array<string>, __quotes array<struct<level: int, digest: string>>"
    )


def quote_links(parsed: DataFrame) -> DataFrame:
    """(`__conv`, `__turn`, `__level`, `__origin`): for each quoted passage the turn it comes from, null if none."""
    known = parsed.where(F.col("__conv").isNotNull() & F.col("__turn").isNotNull())
    originals = known.select("__conv", "__turn", F.explode("__digests").alias("__digest")).withColumn("__level", F.lit(0))
    quotes = known.select("__conv", "__turn", F.explode("__quotes").alias("q")).select(
        "__conv", "__turn", F.col("q.digest").alias("__digest"), F.col("q.level").alias("__level")
    )
    # At one turn quotes come first, so that no message is its own origin.
    order = Window.partitionBy("__conv", "__digest").orderBy("__turn", F.col("__level").desc())
    latest = F.last(F.when(F.col("__level") == 0, F.col("__turn")), ignorenulls=True)
    walked = originals.unionByName(quotes).withColumn(
        "__origin", latest.over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    return walked.where("__level > 0").select("__conv", "__turn", "__level", "__origin")


def thread_places(parents: DataFrame) -> DataFrame:
    """(`__conv`, `__turn`, `__root`, `__depth`) from (`__conv`, `__turn`, `__parent`), by pointer jumping.

    Each round doubles the steps that a message has gone towards its root.
    """
    up = F.coalesce("__parent", "__turn")
    state = materialize(
        parents.select("__conv", "__turn", up.alias("__root"), F.col("__parent").isNotNull().cast("int").alias("__depth")), "threads"
    )
    while True:
        above = state.select("__conv", F.col("__turn").alias("__root"), F.col("__root").alias("__next"), F.col("__depth").alias("__more"))
        after = state.join(above, ["__conv", "__root"], "left").select(
            "__conv",
            "__turn",
            F.coalesce("__next", "__root").alias("__root"),
            (F.col("__depth") + F.coalesce("__more", F.lit(0))).alias("__depth"),
            (F.col("__more") > 0).alias("__moved"),
        )
        after = materialize(after, "threads")
        if after.where("__moved").isEmpty():
            return after.drop("__moved")
        state = after.drop("__moved")


def link_conversations(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row for each message: conv, turn, role, parent_turn, root_turn, depth, n_quotes, n_linked, text without quotes."""
    rows = messages.select(
        F.col(conv).alias("__conv"), F.col(turn).alias("__turn"), F.col(role).alias("__role"), whole_text(text).alias("__text")
    )
    parsed = materialize(parse(rows), "messages")
    links = materialize(quote_links(parsed), "quotes")
    answered = links.groupBy("__conv", "__turn").agg(
        F.max(F.when(F.col("__level") == 1, F.col("__origin"))).alias("__parent"),
        F.count("__origin").alias("__linked"),
    )
    turns = parsed.select("__conv", "__turn").dropna().distinct().join(answered, ["__conv", "__turn"], "left")
    turns = materialize(turns, "turns")
    places = thread_places(turns)
    known = turns.join(places, ["__conv", "__turn"])
    return parsed.join(known, ["__conv", "__turn"], "left").select(
        F.col("__conv").alias(conv),
        F.col("__turn").alias(turn),
        F.col("__role").alias(role),
        F.col("__parent").alias("parent_turn"),
        F.col("__root").alias("root_turn"),
        F.col("__depth").cast("bigint").alias("depth"),
        F.size("__quotes").cast("bigint").alias("n_quotes"),
        F.coalesce("__linked", F.lit(0)).cast("bigint").alias("n_linked"),
        F.col("__own").alias(text),
    )


def _quoted(passage: Column, marks: str) -> Column:
    return F.concat(F.lit(marks), F.replace(passage, F.lit("\n"), F.lit("\n" + marks)), F.lit("\n"))


def as_mail(messages: DataFrame) -> DataFrame:
    """Conversations as a mail archive has them: each message quotes the one before it, and that one's quote as well.

    For messages with unique (conv_id, turn).
    """
    own = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("own"))
    before = own.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("own").alias("one"))
    earlier = own.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("own").alias("two"))
    joined = own.join(before, ["conv_id", "turn"], "left").join(earlier, ["conv_id", "turn"], "left")
    # A message quotes the one before the last only through the last.
    deep = F.when(F.col("one").isNotNull() & F.col("two").isNotNull(), _quoted(F.col("two"), "> > ")).otherwise("")
    near = F.when(F.col("one").isNotNull(), _quoted(F.col("one"), "> ")).otherwise("")
    return joined.select("conv_id", "turn", "role", F.concat(deep, near, F.col("own")).alias("text"))
