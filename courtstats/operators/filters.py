"""Qualification filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtstats.functions.arith import safe_div
from courtstats.operators.joins import natural_join, semi_join


def qualify_share(df: DataFrame, dim: DataFrame, keys, num: str, den: str, min_share: float,
                  name: str = "g_percent", how: str = "left") -> DataFrame:
    """Join the per-key denominator (e.g. team games) and keep rows whose
    ``num / den`` reaches ``min_share`` (played >= 50 % of team games)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    dim_cols = [c for c in dim.columns if c in keys or c == den]
    j = natural_join(df, dim.select(*dim_cols), how, on=keys) if den not in df.columns else df
    return j.withColumn(name, safe_div(num, den)).filter(F.col(name) >= min_share)


def qualify_min(df: DataFrame, minimums: dict, strict: bool = False) -> DataFrame:
    """Keep rows whose columns reach the given minimums (``>=``; ``>`` when strict)."""
    conds = [(F.col(c) > v) if strict else (F.col(c) >= v) for c, v in minimums.items()]
    return df.filter(reduce(lambda a, b: a & b, conds))


def group_size_filter(df: DataFrame, keys, more_than: int) -> DataFrame:
    """Keep rows of groups with more than ``more_than`` rows
    (``group_by() %>% filter(n() > k)``): aggregate + semi join."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > more_than)
    return semi_join(df, big, keys)
