"""Expansion of shard patterns to paths."""

from __future__ import annotations

import re
from collections.abc import Sequence

from .files import glob_paths

NUMBERS = re.compile(r"(-?\d+)\.\.(-?\d+)(?:\.\.(-?\d+))?")
LETTERS = re.compile(r"([A-Za-z])\.\.([A-Za-z])(?:\.\.(-?\d+))?")
PADDED = re.compile(r"-?0\d")


def _first_group(pattern: str) -> tuple[int, int, list[int]] | None:
    """Places of the first brace that is closed, of its partner, and of the commas directly inside."""
    open_: list[tuple[int, list[int]]] = []
    closed: list[tuple[int, int, list[int]]] = []
    for i, c in enumerate(pattern):
        if c == "{":
            open_.append((i, []))
        elif c == "," and open_:
            open_[-1][1].append(i)
        elif c == "}" and open_:
            start, commas = open_.pop()
            closed.append((start, i, commas))
            if not open_:
                break
    return min(closed, default=None)


def _walk(body: str) -> list[str] | None:
    """The members of a range, bounds included, in steps of one or as given; null if it is no range.

    The bounds give the direction. Numbers are as wide as the wider bound if one
    of the bounds has leading zeros.
    """
    if numbers := NUMBERS.fullmatch(body):
        first, last, step = numbers.groups()
        a, b = int(first), int(last)
        width = max(map(len, (first, last))) if PADDED.match(first) or PADDED.match(last) else 0
        member = lambda v: format(v, f"0{width}d")
    elif letters := LETTERS.fullmatch(body):
        a, b, step = ord(letters[1]), ord(letters[2]), letters[3]
        member = chr
    else:
        return None
    stride = abs(int(step or 1)) or 1
    count = abs(b - a) // stride + 1
    sign = 1 if b >= a else -1
    return [member(a + sign * stride * i) for i in range(count)]


def expand_braces(pattern: str) -> list[str]:
    """Every path a pattern stands for, as shells expand braces.

    Lists `{a,b{c,d}}` may be nested; ranges are numeric `{000..575..5}` or of
    letters `{a..e}`. Braces that are neither stay as they are written.
    """
    group = _first_group(pattern)
    if group is None:
        return [pattern]
    start, end, commas = group
    body = pattern[start + 1 : end]
    if commas:
        cuts = [start, *commas, end]
        options = [o for a, b in zip(cuts, cuts[1:]) for o in expand_braces(pattern[a + 1 : b])]
    else:
        options = _walk(body) or ["{" + inner + "}" for inner in expand_braces(body)]
    rest = expand_braces(pattern[end + 1 :])
    return [pattern[:start] + o + r for o in options for r in rest]


def expand_shards(pattern: str | Sequence[str]) -> list[str]:
    """Sorted distinct paths of one pattern or several; one that matches no file stays literal."""
    patterns = [pattern] if isinstance(pattern, str) else list(pattern)
    paths: set[str] = set()
    for item in patterns:
        for path in expand_braces(item):
            paths.update(glob_paths(path) or [path])
    return sorted(paths)
