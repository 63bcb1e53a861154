"""Column helpers shared by the other function modules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` to a lambda variable so that `body` may use it many times
    while it is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hkey(*parts: Column | str | int) -> Column:
    """Deterministic 60-bit draw: first 15 hex digits of md5 over the parts joined by ':'.

    Strings are taken as literals, columns are cast to string. Equal parts give
    equal draws on every run, whatever the partitioning. The range is wide
    enough to index any table by remainder without a visible bias.
    """
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 15), 16, 10).cast("bigint")


DRAW_RANGE = 2.0**60


def existing(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The members of `names` that are columns of `df`, in the order of `names`."""
    present = set(df.columns)
    return [name for name in names if name in present]


def truthy(col: Column) -> Column:
    """Null for an empty string, else the value."""
    return F.nullif(col, F.lit(""))


def first_alias(df: DataFrame, names: Sequence[str]) -> Column:
    """First non-empty value among the alias columns that exist; null if none."""
    found = existing(df, names)
    if not found:
        return F.lit(None).cast("string")
    return F.coalesce(*[truthy(F.col(name).cast("string")) for name in found])


def rounded(col: Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(col, digits) + F.lit(0.0)
