"""Aggregations: group counts, weighted / leave-one-out means, grouping sets,
ordered string aggregation, pivots.

All aggregations are ``groupBy().agg()`` plans, so Spark runs them as a
partial (map-side) aggregate, one exchange on the keys, and a final
aggregate.  A hot key therefore sends one partial row per task, never its
raw rows.  Group results are put back onto rows by a join on the keys (AQE
splits a skewed key on the big side), not by an unbounded window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtstats.functions._cols import as_col
from courtstats.operators.rank import top_n
from courtstats.operators.sequence import DEFAULT_CHUNK, find_cuts, scan


def _keys(k):
    return [k] if isinstance(k, str) else list(k)


def group_count(df: DataFrame, keys, name: str = "count", drop_null_keys: bool = False) -> DataFrame:
    """Rows per key (``groupby().size()``); pandas drops missing keys
    (``drop_null_keys=True``), R keeps them as a group."""
    keys = _keys(keys)
    if drop_null_keys:
        df = df.dropna(subset=keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def weighted_mean(x, w) -> Column:
    """sum(x*w) / sum(w) as an aggregate expression."""
    return F.try_divide(F.sum(as_col(x) * as_col(w)), F.sum(as_col(w)))


def group_stat_onto_rows(df: DataFrame, keys, stats: dict[str, Column]) -> DataFrame:
    """Attach group aggregates to every row (``group_by() %>% mutate(sum(..))``)
    via aggregate + join on the keys."""
    keys = _keys(keys)
    agg = df.groupBy(*[F.col(k).alias("_g_" + k) for k in keys]).agg(
        *[c.alias(n) for n, c in stats.items()])
    cond = [F.col(k).eqNullSafe(F.col("_g_" + k)) for k in keys]
    return df.join(agg, cond, "left").drop(*["_g_" + k for k in keys])


def leave_one_out(df: DataFrame, partition, by: str, x, w, extreme: str = "max",
                  tiebreak=None, name: str = "avg_wo") -> DataFrame:
    """Per partition: weighted mean of ``x`` (weights ``w``) over all rows but
    the extreme one by ``by`` (the leader for ``max``, trailer for ``min``).

    One aggregation pass: totals minus the extreme row's contribution, the
    extreme row picked by ``max_by``/``min_by`` over ``(by, tiebreak)`` so
    exactly one row is removed even when values tie."""
    part = _keys(partition)
    xw, ww = (as_col(x) * as_col(w)).alias("xw"), as_col(w).alias("w")
    order = F.struct(F.col(by), *[F.col(t) for t in (tiebreak or [])])
    pick = F.max_by if extreme == "max" else F.min_by
    agg = df.groupBy(*part).agg(
        F.sum(as_col(x) * as_col(w)).alias("_sxw"), F.sum(as_col(w)).alias("_sw"),
        pick(F.struct(xw, ww), order).alias("_ex"))
    return agg.select(*part, F.try_divide(F.col("_sxw") - F.col("_ex.xw"),
                                          F.col("_sw") - F.col("_ex.w")).alias(name))


def _nan_as_missing(df: DataFrame, col: str) -> DataFrame:
    kind = dict(df.dtypes)[col]
    return df.withColumn(col, F.nanvl(F.col(col), F.lit(None).cast(kind))) if kind in ("double", "float") else df


def order_statistics(df: DataFrame, keys, col: str, positions: dict[str, Column], chunk_size=DEFAULT_CHUNK) -> DataFrame:
    """Exact order statistics per group: ``positions`` = {name: 1-based position, an expression
    of ``_n``, the group's number of non-missing values}; a position outside 1.._n gives null.

    Rows are counted per (group, value) -- partial aggregates, so a value many rows share is
    one row -- and the running count of the values finds the positions.  A group with more than
    ``chunk_size`` values is cut into ranges (see ``sequence``), so no group is in one task.
    NaN is missing.  Groups without a value are not returned."""
    keys = _keys(keys)
    d = _nan_as_missing(df.select(*keys, col), col).filter(F.col(col).isNotNull())
    counts = d.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_c"))
    s = scan(counts, keys, col, sums={"_to": "_c"}, groups={"_n": ("sum", "_c")}, cuts=find_cuts(d, keys, col, chunk_size))
    at = {n: F.when((p <= F.col("_to")) & (p > F.col("_to") - F.col("_c")), F.col(col)) for n, p in positions.items()}
    hit = reduce(lambda a, b: a | b, [x.isNotNull() for x in at.values()])
    return s.filter(hit | (F.col("_to") == F.col("_n"))).groupBy(*keys).agg(
        *[F.max(x).alias(n) for n, x in at.items()], F.max("_n").alias("_n"))


def _middle(n: Column) -> tuple[Column, Column]:
    return F.floor((n + 1) / 2), F.floor((n + 2) / 2)


def exact_median(df: DataFrame, keys, col: str, name: str = "median", chunk_size=DEFAULT_CHUNK) -> DataFrame:
    """Exact median per group (mean of the two middle values), no group in one task."""
    lo, hi = _middle(F.col("_n"))
    m = order_statistics(df, keys, col, {"_lo": lo, "_hi": hi}, chunk_size)
    return m.select(*_keys(keys), ((F.col("_lo") + F.col("_hi")) / 2).alias(name))


def leave_one_out_median(df: DataFrame, partition, by: str, x: str, extreme: str = "max", tiebreak=None,
                         name: str = "median_wo", chunk_size=DEFAULT_CHUNK) -> DataFrame:
    """Per partition: median of ``x`` over all rows but the extreme one by ``by``.

    The middle values of the rest are among the values at the middle positions of all rows and
    the next ones: a position moves up by one where the value there is not below the removed
    row's.  Null where no value is left."""
    part = _keys(partition)
    gone = (F.max_by if extreme == "max" else F.min_by)(F.struct(F.col(x).alias("x")), F.struct(F.col(by), *[F.col(t) for t in (tiebreak or [])]))
    d = _nan_as_missing(_nan_as_missing(df, by), x)
    out = d.filter(F.col(by).isNotNull()).groupBy(*[F.col(p).alias("_g_" + p) for p in part]).agg(gone.alias("_out"))
    lo, hi = _middle(F.col("_n") - 1)
    m = order_statistics(d, part, x, {"_a": lo, "_b": hi, "_a2": lo + 1, "_b2": hi + 1, "_m": _middle(F.col("_n"))[0],
                                      "_m2": _middle(F.col("_n"))[1]}, chunk_size)
    j = m.join(out, reduce(lambda a, b: a & b, [m[p].eqNullSafe(out["_g_" + p]) for p in part]), "left")
    v = F.col("_out.x")
    rest = (F.when(F.col("_a") < v, F.col("_a")).otherwise(F.col("_a2")) + F.when(F.col("_b") < v, F.col("_b")).otherwise(F.col("_b2"))) / 2
    return j.select(*part, F.when(v.isNull(), (F.col("_m") + F.col("_m2")) / 2).when(F.col("_n") > 1, rest).alias(name))


def with_mean_row(df: DataFrame, keys, label_col: str, label: str, aggs: dict[str, str]) -> DataFrame:
    """Append one summary row per ``keys`` group labelled ``label`` in
    ``label_col`` (e.g. the 'TOT' row = mean games of all teams)."""
    keys = _keys(keys)
    fns = {"avg": F.avg, "mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}
    summary = df.groupBy(*keys).agg(*[fns[f](c).alias(c) for c, f in aggs.items()]) \
                .withColumn(label_col, F.lit(label))
    return df.unionByName(summary, allowMissingColumns=True)


def ordered_listagg(col: str, order_sql: str, sep: str = ", ") -> Column:
    """Group strings joined in a given order (``paste0(collapse=)`` after
    ``arrange``), as ``listagg(col, sep) WITHIN GROUP (ORDER BY order_sql)``.
    The output is one string per group, so groups are expected to be small
    (a team's rotation); the aggregate itself is a regular partial agg."""
    sep_sql = sep.replace("'", "''")
    return F.expr(f"listagg(`{col}`, '{sep_sql}') WITHIN GROUP (ORDER BY {order_sql})")


def ordered_pieces(df: DataFrame, keys, col: str, order, sep: str = ", ", piece_rows: int = 100_000,
                   chunk_size=DEFAULT_CHUNK) -> DataFrame:
    """The strings of a group joined in ``order`` (columns, ascending, missing first), in
    pieces of ``piece_rows`` values: keys, piece (from 0), n, text.  The pieces of a group, in
    order and joined by ``sep``, are its ``ordered_listagg``; a group of up to ``piece_rows`` values is
    one piece.  Positions come from the sequence scan, so a group of any size is spread over
    tasks and no row is larger than a piece.  Missing values are left out."""
    keys = _keys(keys)
    d = scan(df.filter(F.col(col).isNotNull()), keys, order, number="_pos", chunk_size=chunk_size)
    d = d.withColumn("piece", F.floor((F.col("_pos") - 1) / piece_rows))
    return d.groupBy(*keys, "piece").agg(F.count(F.lit(1)).alias("n"), ordered_listagg(col, "_pos", sep).alias("text"))


def season_and_career(df: DataFrame, entity, season: str, aggs: list[Column]) -> DataFrame:
    """Season and career totals in one aggregation: GROUPING SETS
    ((season, entity...), (entity...)).  Career rows have ``season`` NULL and
    ``scope='career'``; season rows ``scope='season'``."""
    ent = _keys(entity)
    g = df.groupingSets([[season, *ent], ent], season, *ent).agg(
        *aggs, F.grouping(season).alias("_g"))
    return g.withColumn("scope", F.when(F.col("_g") == 1, "career").otherwise("season")).drop("_g")


def grouping_sets_leaderboard(df: DataFrame, entity, season: str, aggs: list[Column], by: str,
                              n: int, descending=True) -> DataFrame:
    """Top-n (with ties) of the season board and of the career board from one
    aggregation pass; the two boards rank separately (partition by scope)."""
    g = season_and_career(df, entity, season, aggs)
    return top_n(g, by, n, descending=descending, partition="scope")


def pivot_counts(df: DataFrame, key, col: str, values: list, fill=0) -> DataFrame:
    """Long -> wide counts with explicit column values (no extra job to find
    them) and zeros for absent cells."""
    keys = _keys(key)
    return df.groupBy(*keys).pivot(col, values).agg(F.count(F.lit(1))).na.fill(fill, subset=[str(v) for v in values])


def unpivot(df: DataFrame, ids, cols, name: str = "name", value: str = "value") -> DataFrame:
    """Wide -> long (``pivot_longer``)."""
    return df.unpivot(_keys(ids), list(cols), name, value)


def count_of_counts(df: DataFrame, inner_keys, outer_keys, min_count: int,
                    name: str = "n_groups") -> DataFrame:
    """Number of ``inner_keys`` groups with at least ``min_count`` rows, per
    ``outer_keys`` (e.g. games with 2+ dunks per player)."""
    inner = df.groupBy(*_keys(inner_keys)).agg(F.count(F.lit(1)).alias("_n"))
    return inner.filter(F.col("_n") >= min_count).groupBy(*_keys(outer_keys)) \
                .agg(F.count(F.lit(1)).alias(name))


def block_sums(df: DataFrame, keys, cols, prefix: str = "") -> DataFrame:
    """Sum of each column of a block per key (missing skipped)."""
    return df.groupBy(*_keys(keys)).agg(*[F.sum(c).alias(prefix + c) for c in cols])


def sum_cols(cols) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(as_col(c), F.lit(0)) for c in cols])
