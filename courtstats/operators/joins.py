"""Joins with the semantics of data-frame libraries: natural joins on all
common columns, NULL keys matching NULL keys, merge suffixes, origin
indicators and role-playing dimensions.

Join strategy is left to Catalyst/AQE: no side gets a broadcast hint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _on(keys, null_safe: bool, la: str = "_l", ra: str = "_r"):
    def q(a, k):
        return F.col(f"{a}.`{k}`")

    conds = [(q(la, k).eqNullSafe(q(ra, k)) if null_safe else q(la, k) == q(ra, k)) for k in keys]
    return reduce(lambda a, b: a & b, conds)


def common_columns(l: DataFrame, r: DataFrame) -> list[str]:
    rc = set(r.columns)
    return [c for c in l.columns if c in rc]


def natural_join(l: DataFrame, r: DataFrame, how: str = "left", null_safe: bool = True,
                 on: list[str] | None = None) -> DataFrame:
    """Join on every common column (``left_join(x, y)`` without ``by``).

    Keys match NULL with NULL.  Output: the left columns (keys coalesced for
    full / right joins) followed by the right-only columns."""
    keys = on or common_columns(l, r)
    if not keys:
        raise ValueError("natural_join: no common columns")
    la, ra = l.alias("_l"), r.alias("_r")
    j = la.join(ra, _on(keys, null_safe), how)
    L = lambda c: F.col(f"_l.`{c}`")
    R = lambda c: F.col(f"_r.`{c}`")
    if how in ("full", "outer", "full_outer", "right", "right_outer"):
        key_cols = [F.coalesce(L(k), R(k)).alias(k) for k in keys]
    else:
        key_cols = [L(k).alias(k) for k in keys]
    kset = set(keys)
    left_rest = [L(c).alias(c) for c in l.columns if c not in kset]
    right_rest = [R(c).alias(c) for c in r.columns if c not in kset and c not in set(l.columns)]
    out = j.select(*key_cols, *left_rest, *right_rest)
    return out.select(*[c for c in l.columns], *[c for c in r.columns if c not in set(l.columns)])


def join_suffix(l: DataFrame, r: DataFrame, on, how: str = "inner",
                suffixes=("_x", "_y"), right_on=None, null_safe: bool = True) -> DataFrame:
    """Equi-join; non-key columns present on both sides get ``suffixes``; a NULL
    key matches a NULL key unless ``null_safe`` is off.

    ``on`` are left key names; ``right_on`` (default = ``on``) the right ones.
    With the same names on both sides, the key appears once."""
    on = [on] if isinstance(on, str) else list(on)
    right_on = on if right_on is None else ([right_on] if isinstance(right_on, str) else list(right_on))
    same = on == right_on
    overlap = (set(l.columns) & set(r.columns)) - (set(on) if same else set())
    ln = l.withColumnsRenamed({c: c + suffixes[0] for c in overlap})
    rn = r.withColumnsRenamed({c: c + suffixes[1] for c in overlap})
    if same:
        return natural_join(ln, rn, how, null_safe, on)
    lk = [k + suffixes[0] if k in overlap else k for k in on]
    rk = [k + suffixes[1] if k in overlap else k for k in right_on]
    cond = reduce(lambda a, b: a & b, [ln[a].eqNullSafe(rn[b]) if null_safe else ln[a] == rn[b]
                                       for a, b in zip(lk, rk)])
    return ln.join(rn, cond, how)


def role_join(df: DataFrame, dim: DataFrame, roles: dict[str, str], key: str,
              how: str = "inner", null_safe: bool = True) -> DataFrame:
    """Join the same dimension once per role: ``roles = {fk_col: prefix}``;
    the dimension's columns arrive as ``<prefix><col>``."""
    out = df
    for fk, prefix in roles.items():
        d = dim.select(*[F.col(c).alias(prefix + c) for c in dim.columns])
        on = out[fk].eqNullSafe(d[prefix + key]) if null_safe else out[fk] == d[prefix + key]
        out = out.join(d, on, how)
    return out


def merge_indicator(l: DataFrame, r: DataFrame, on, name: str = "_merge", null_safe: bool = True) -> DataFrame:
    """Full outer join with an origin column: 'left_only', 'right_only', 'both'."""
    on = [on] if isinstance(on, str) else list(on)
    lf = l.withColumn("_in_l", F.lit(True))
    rf = r.withColumn("_in_r", F.lit(True))
    j = natural_join(lf, rf, "full", null_safe, on)
    ind = (F.when(F.col("_in_l") & F.col("_in_r"), "both")
           .when(F.col("_in_l"), "left_only").otherwise("right_only"))
    return j.withColumn(name, ind).drop("_in_l", "_in_r")


def _matching(l: DataFrame, r: DataFrame, on, null_safe: bool, how: str) -> DataFrame:
    on = [on] if isinstance(on, str) else list(on)
    rr = r.select(*[F.col(k).alias("_r_" + k) for k in on])
    pair = [(l[k], rr["_r_" + k]) for k in on]
    return l.join(rr, reduce(lambda a, b: a & b, [a.eqNullSafe(b) if null_safe else a == b for a, b in pair]), how)


def anti_join(l: DataFrame, r: DataFrame, on, null_safe: bool = True) -> DataFrame:
    """Rows of ``l`` with no key match in ``r``."""
    return _matching(l, r, on, null_safe, "left_anti")


def semi_join(l: DataFrame, r: DataFrame, on, null_safe: bool = True) -> DataFrame:
    """Rows of ``l`` with a key match in ``r``."""
    return _matching(l, r, on, null_safe, "left_semi")


def row_difference(l: DataFrame, r: DataFrame) -> DataFrame:
    """Rows of ``l`` not equal (all columns, NULL = NULL) to any row of ``r``;
    duplicates in ``l`` are kept (``anti_join`` on all columns)."""
    return anti_join(l, r.select(*l.columns), l.columns, null_safe=True)
