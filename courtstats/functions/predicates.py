"""Null-safe predicates over several columns.

Event logs carry the same kind of text in two columns (home / visitor side);
a row matches when either side does.  A missing side never matches, so the
result is never NULL: ``coalesce(pred, false)``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtstats.functions._cols import as_cols


def _safe(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def any_col(cols, pred: Callable[[Column], Column]) -> Column:
    """True when ``pred`` holds on at least one of ``cols`` (NULL side = False)."""
    return reduce(lambda a, b: a | b, [_safe(pred(c)) for c in as_cols(cols)])


def none_col(cols, pred: Callable[[Column], Column], mode: str = "none") -> Column:
    """Negated form of :func:`any_col`.

    mode='none'    : no column matches (a missing side counts as not matching).
    mode='any_not' : at least one non-missing column does not match -- the
                     parity form of an ``if_any(..., negate=TRUE)`` filter,
                     where a missing side is dropped rather than counted.
    """
    if mode == "none":
        return ~any_col(cols, pred)
    if mode == "any_not":
        return reduce(lambda a, b: a | b,
                      [_safe(~pred(c)) for c in as_cols(cols)])
    raise ValueError(f"unknown mode {mode!r}")


_KINDS = {
    "regex": lambda p: (lambda c: c.rlike(p)),
    "contains": lambda p: (lambda c: c.contains(p)),
    "starts": lambda p: (lambda c: c.startswith(p)),
    "ends": lambda p: (lambda c: c.endswith(p)),
}


def text_any(cols, pattern: str, kind: str = "regex") -> Column:
    """Either text column matches ``pattern`` (regex by default, as in
    ``str.contains`` / ``str_detect``)."""
    return any_col(cols, _KINDS[kind](pattern))


def text_none(cols, pattern: str, kind: str = "regex", mode: str = "none") -> Column:
    return none_col(cols, _KINDS[kind](pattern), mode=mode)
