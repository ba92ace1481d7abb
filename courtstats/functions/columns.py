"""Column-list helpers evaluated on the driver over ``df.columns`` only (no data)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_range(df: DataFrame, first: str, last: str, *extra: str) -> DataFrame:
    """``select(a:b)``: the columns from ``first`` to ``last`` inclusive."""
    cols = df.columns
    i, j = cols.index(first), cols.index(last)
    return df.select(*extra, *cols[i:j + 1])


def columns_matching(df: DataFrame, pattern: str) -> list[str]:
    rx = re.compile(pattern)
    return [c for c in df.columns if rx.search(c)]


def select_regex(df: DataFrame, pattern: str) -> DataFrame:
    """Columns whose name matches the regex (search, like ``filter(regex=)``)."""
    return df.select(*columns_matching(df, pattern))


def add_suffix(df: DataFrame, cols, suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: c + suffix for c in cols})


def add_prefix(df: DataFrame, cols, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in cols})


def derive(df: DataFrame, new: dict[str, Column], after: str | None = None) -> DataFrame:
    """Add / replace columns; with ``after`` the new columns are placed right
    after that column (``mutate(.after=)``)."""
    out = df.withColumns(new)
    if after is None:
        return out
    base = [c for c in df.columns if c not in new]
    i = base.index(after) + 1
    return out.select(*base[:i], *new.keys(), *base[i:])


def drop_lenient(df: DataFrame, *cols: str) -> DataFrame:
    """Drop the columns that exist; unknown names are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def row_sum(cols) -> Column:
    """Row-wise sum with missing values counted as 0 (``sum(axis=1)``)."""
    from functools import reduce

    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in cols])
