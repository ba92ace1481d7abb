"""Ranking and top-n operators with explicit tie and missing-value semantics.

Contract
* ``ties=True`` returns the n best plus every row tied with the n-th
  (``rank() <= n``); ``ties=False`` cuts ties with ``row_number()`` over a
  total order: ``tiebreak`` columns, by default all other columns, are appended
  to the ordering, so a result never depends on the partitioning.
* Missing values sort last in both directions; NaN is treated as missing.
* A global top-n with ties takes n rows without ties first (n rows per task move);
  their values, at most n, are broadcast and all rows that have one are kept where they are.
  However many rows share the n-th value, no task gathers them.
* A top-n per partition plans as a partial ``WindowGroupLimit`` in every task before the
  exchange, so n rows per task and partition value move, and the rows tied with the n-th.
* Percentile ranks are added to the rows in one exchange by the partition: no join on a
  value and none back.  A sample of the ranked columns shows where that would not do: a
  partition of more than ``chunk_size`` rows is cut into ranges of the ranked values, and a
  value that alone has so many rows is spread over tasks and counted.  What the ranges
  hold is at most a few hundred rows, merged and broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtstats.functions._cols import as_col
from courtstats.operators.sequence import DEFAULT_CHUNK, MAX_CUTS, Cuts, _is_cut, _range_of, draw, literal_types

SALTS = 64


def _key(c, descending: bool) -> Column:
    col = as_col(c)
    return col.desc_nulls_last() if descending else col.asc_nulls_last()


def _order(by, descending, tiebreak=None) -> list[Column]:
    by = [by] if isinstance(by, (str, Column)) else list(by)
    if isinstance(descending, bool):
        descending = [descending] * len(by)
    keys = [_key(b, d) for b, d in zip(by, descending)]
    for t in tiebreak or []:
        keys.append(t if isinstance(t, Column) else F.col(t).asc_nulls_last())
    return keys


def _nan_to_null(df: DataFrame, by) -> DataFrame:
    by = [by] if isinstance(by, (str, Column)) else list(by)
    dbl = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    fix = {b: F.nanvl(F.col(b), F.lit(None).cast("double")) for b in by if isinstance(b, str) and b in dbl}
    return df.withColumns(fix) if fix else df


def _total(df: DataFrame, used, tiebreak) -> list:
    """The tie-break: as given, else every other column that can be ordered."""
    if tiebreak is not None:
        return list(tiebreak)
    used = [used] if isinstance(used, (str, Column)) else list(used)
    return [f.name for f in df.schema.fields if f.name not in [u for u in used if isinstance(u, str)]
            and f.dataType.typeName() not in ("map", "variant")]


def _parts(partition) -> list[str]:
    return [] if partition is None else ([partition] if isinstance(partition, str) else list(partition))


def top_n(df: DataFrame, by, n: int, descending=True, ties: bool = True, partition=None,
          tiebreak=None, rank_col: str | None = None) -> DataFrame:
    """n best rows (per ``partition`` when given).  Rows whose ranking value is
    missing are never returned (they sort last and a leaderboard of missing
    values is meaningless)."""
    df = _nan_to_null(df, by)
    by = [by] if isinstance(by, (str, Column)) else list(by)
    kinds = dict(zip([str(i) for i in range(len(by))], df.select(*[as_col(b).alias(str(i)) for i, b in enumerate(by)]).dtypes))
    by = [F.nanvl(b, F.lit(None).cast("double")) if isinstance(b, Column) and kinds[str(i)][1] in ("double", "float") else b
          for i, b in enumerate(by)]
    r = rank_col or "_rk"
    if ties and not _parts(partition):
        return _top_values(df, by, n, descending, r, bool(rank_col))
    w = Window.partitionBy(*_parts(partition)).orderBy(
        *_order(by, descending, None if ties else _total(df, by, tiebreak)))
    fn = F.rank() if ties else F.row_number()
    out = df.filter(as_col(by[0]).isNotNull()).withColumn(r, fn.over(w)).filter(F.col(r) <= n)
    return out if rank_col else out.drop(r)


def _top_values(df: DataFrame, by, n: int, descending, r: str, with_rank: bool) -> DataFrame:
    """All rows whose ``by`` values are among those of the n best rows."""
    cols, names = df.columns, [f"_by{i}" for i in range(len(by))]
    d = df.withColumns({k: as_col(b) for k, b in zip(names, by)}).filter(F.col(names[0]).isNotNull())
    best = d.orderBy(*_order(names, descending)).limit(n)
    # the n rows as one array of whole rows: both readers of `df` then need the same
    # columns of it, so that what is below (an aggregate) is computed once
    best = best.agg(F.collect_list(F.struct(*d.columns)).alias("_best")).select(F.explode("_best").alias("_row"))
    best = best.select(*[F.col("_row." + k).alias(k + "v") for k in names])
    w = Window.partitionBy().orderBy(*_order([k + "v" for k in names], descending))  # n rows
    best = best.withColumn(r, F.rank().over(w)).distinct()
    same = reduce(lambda a, b: a & b, [d[k].eqNullSafe(best[k + "v"]) for k in names])
    out = d.join(F.broadcast(best), same)  # at most n rows
    return out.select(*cols, r) if with_rank else out.select(*cols)


def slice_range(df: DataFrame, partition, order, lo: int, hi: int, descending=True,
                tiebreak=None) -> DataFrame:
    """Rows at positions lo..hi (1-based) of each partition, ties cut by the
    total order (``slice(6:9)``).  Missing order values sort last."""
    df = _nan_to_null(df, order)
    w = Window.partitionBy(*_parts(partition)).orderBy(*_order(order, descending, _total(df, order, tiebreak)))
    return (df.withColumn("_pos", F.row_number().over(w)).filter(F.col("_pos") <= hi)
              .filter(F.col("_pos") >= lo).drop("_pos"))


def drop_leader(df: DataFrame, partition, order, descending=True, tiebreak=None) -> DataFrame:
    """Every row but the first of each partition (``arrange() %>% slice(-1)``).

    The leader is a top-1 (one row per task and partition is shuffled); the rows
    that differ from it are an anti join; of rows equal to it in every column one goes."""
    df = _nan_to_null(df, order)
    part, cols = _parts(partition), df.columns
    w = Window.partitionBy(*part).orderBy(*_order(order, descending, _total(df, order, tiebreak)))
    lead = df.withColumn("_pos", F.row_number().over(w)).filter(F.col("_pos") == 1).drop("_pos")
    lead = lead.withColumnsRenamed({c: "_lead_" + c for c in cols})
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(lead["_lead_" + c]) for c in cols])
    again = (df.join(lead, same, "left_semi").groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
             .select(*cols, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_k")).filter(F.col("_k") > 1).drop("_k"))
    return df.join(lead, same, "left_anti").unionByName(again)


def group_argmax(df: DataFrame, partition, by, descending=True, tiebreak=None) -> DataFrame:
    """Exactly one row per partition: the best by ``by`` (ties cut by tiebreak)."""
    return top_n(df, by, 1, descending=descending, ties=False, partition=partition,
                 tiebreak=tiebreak)


def leader_flag(df: DataFrame, partition, by, name: str = "leader", descending=True) -> DataFrame:
    """Boolean column: the row holds the partition's max (or min) of ``by``
    (aggregate and null-safe join; a missing value never leads)."""
    df = _nan_to_null(df, by)
    part = _parts(partition)
    ext = (F.max if descending else F.min)(by)
    best = df.groupBy(*[F.col(p).alias("_p_" + p) for p in part]).agg(ext.alias("_ext"))
    cond = reduce(lambda a, b: a & b, [df[p].eqNullSafe(best["_p_" + p]) for p in part])
    return (df.join(best, cond, "left").withColumn(name, F.coalesce(F.col(by) == F.col("_ext"), F.lit(False)))
            .drop("_ext", *["_p_" + p for p in part]))


def prefer_total_row(df: DataFrame, keys, col: str, total: str = "TOT") -> DataFrame:
    """Keep the ``total`` row of each key when present, else the key's only
    row (first by ``col`` otherwise)."""
    w = Window.partitionBy(*keys).orderBy((F.col(col) != F.lit(total)).asc(), F.col(col).asc_nulls_last())
    return df.withColumn("_pos", F.row_number().over(w)).filter(F.col("_pos") == 1).drop("_pos")


@dataclass(frozen=True)
class RankCuts:
    """Where the values of one column are cut: ``heavy`` are the ranges (numbers of bounds at
    or below) that hold a single value with very many rows."""

    cuts: Cuts
    heavy: tuple[int, ...] = ()


def rank_cuts(df: DataFrame, cols, partition=None, chunk_size=DEFAULT_CHUNK, max_cuts: int = MAX_CUTS) -> dict[str, RankCuts]:
    """Cuts of every column from one sample of all of them."""
    cols, part = list(cols), tuple(_parts(partition))
    plain = {c: RankCuts(Cuts(part, (c, "_seq_z"))) for c in cols}
    if chunk_size is None:
        return plain
    rows, each = draw(df, [*part, *cols])
    p = len(part)
    if len(rows) * each <= chunk_size:
        return plain
    out = {}
    for i, c in enumerate(cols):
        groups: dict[str, list[tuple]] = {}
        for r in rows:
            if r[p + i] is not None:
                groups.setdefault(repr(r[:p]), []).append((r[:p], r[p + i]))
        hot = [sorted(g, key=lambda x: x[1]) for g in groups.values() if len(g) * each > chunk_size]
        step = max(chunk_size, sum(map(len, hot)) * each / max_cuts) / each  # sampled rows of a range
        bounds, heavy, keys = [], [], []
        for g in hot:
            at, since = 0, 0
            while at < len(g):
                end = at
                while end < len(g) and g[end][1] == g[at][1]:
                    end += 1
                key, v = g[at]
                if end - at > step:
                    bounds.append((*key, v, 0))
                    heavy.append(len(bounds))
                    bounds.append((*key, v, 1))
                    since = end
                elif at and end - since > step:
                    bounds.append((*key, v, 0))
                    since = at
                at = end
            keys.append(g[0][0])
        types = literal_types(df, [*part, c])
        out[c] = replace(plain[c], cuts=Cuts(part, (c, "_seq_z"), (*types, "int"), tuple(bounds), tuple(keys)), heavy=tuple(heavy))
    return out


def value_ranks(df: DataFrame, col: str, partition=None, cuts: RankCuts | None = None, chunk_size=DEFAULT_CHUNK) -> DataFrame:
    """Rows with _lo (1 + rows of the partition with a smaller value), _same (rows with the
    same value) and _n (rows with a value); all null where ``col`` is missing."""
    part = _parts(partition)
    cuts = cuts or rank_cuts(df, [col], part, chunk_size)[col]
    d, keys, bounds = df, part, cuts.cuts.bounds
    if bounds:
        # missing values are not ranked: each of them may go anywhere
        d = d.withColumn("_seq_z", F.lit(0))
        d = d.withColumn("_rng", F.when(F.col(col).isNotNull(), _range_of(d, cuts.cuts)).otherwise(-1))
        heavy = F.col("_rng").isin([-1, *cuts.heavy])
        d = d.withColumn("_salt", F.when(heavy, F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith(("map", "variant"))]),
                                                       F.lit(SALTS))).otherwise(0))
        keys = [*part, "_rng", "_salt"]
    d = d.withColumns({
        "_lo": F.rank().over(Window.partitionBy(*keys).orderBy(F.col(col).asc_nulls_last())).cast("long"),
        "_same": F.count(col).over(Window.partitionBy(*keys, col)),
        "_n": F.count(col).over(Window.partitionBy(*keys))})
    if bounds:
        ranges = d.filter(F.col(col).isNotNull() & _is_cut(d, cuts.cuts)) if part else d.filter(F.col(col).isNotNull())
        ranges = ranges.groupBy(*part, "_rng").agg(F.count(F.lit(1)).alias("_k"))
        w = Window.partitionBy(*part).orderBy("_rng")
        ranges = ranges.select(*[F.col(p).alias("_g_" + p) for p in [*part, "_rng"]], "_k",
                               (F.sum("_k").over(w) - F.col("_k")).alias("_off"), F.sum("_k").over(Window.partitionBy(*part)).alias("_all"))
        on = reduce(lambda a, b: a & b, [d[p].eqNullSafe(ranges["_g_" + p]) for p in [*part, "_rng"]])
        d = d.join(F.broadcast(ranges), on, "left")  # a row per range: at most a few hundred
        alone = F.col("_rng").isin(list(cuts.heavy)) if cuts.heavy else F.lit(False)
        d = d.withColumns({"_lo": F.when(alone, F.col("_off") + 1).otherwise(F.col("_lo") + F.coalesce("_off", F.lit(0))),
                           "_same": F.when(alone, F.col("_k")).otherwise(F.col("_same")), "_n": F.coalesce("_all", "_n")})
        d = d.drop("_rng", "_salt", "_seq_z", "_k", "_off", "_all", *["_g_" + p for p in [*part, "_rng"]])
    return d.withColumns({c: F.when(F.col(col).isNotNull(), F.col(c)) for c in ("_lo", "_same", "_n")})


def _low(descending: bool) -> Column:
    """Lowest tied position in the direction asked for."""
    return F.col("_n") - F.col("_lo") - F.col("_same") + 2 if descending else F.col("_lo")


def pct_rank(df: DataFrame, cols, method: str = "average", partition=None, descending=False,
             suffix: str = "_pct_rank", chunk_size=DEFAULT_CHUNK) -> DataFrame:
    """Percentile rank of each column over its non-missing values.

    method='average': mean of tied positions / n (``rank(pct=True)``)
    method='min'    : lowest tied position / n (``rank(method='min', pct=True)``)
    Missing stays missing.  ``cols`` may be a list; each gets ``<c><suffix>``.  All columns share
    one sample and, where no partition is cut, one exchange."""
    if method not in ("average", "min"):
        raise ValueError(method)
    cols = [cols] if isinstance(cols, str) else list(cols)
    out = _nan_to_null(df, cols)
    cuts = rank_cuts(out, cols, partition, chunk_size)
    for c in cols:
        low = _low(descending)
        place = low / F.col("_n") if method == "min" else (low + low + F.col("_same") - 1) / F.lit(2.0) / F.col("_n")
        out = value_ranks(out, c, partition, cuts[c]).withColumn(c + suffix, place).drop("_lo", "_same", "_n")
    return out


def percent_rank_ignore_null(df: DataFrame, col: str, name: str, partition=None,
                             descending: bool = False, chunk_size=DEFAULT_CHUNK, cuts: RankCuts | None = None) -> DataFrame:
    """(min_rank - 1) / (n - 1) over the non-missing values of each partition
    (``dplyr::percent_rank``); missing stays missing; a single non-missing
    value gets 0.0."""
    d = value_ranks(_nan_to_null(df, col), col, partition, cuts, chunk_size)
    val = F.when(F.col("_n") > 1, (_low(descending) - 1) / (F.col("_n") - 1)).when(F.col("_n") == 1, F.lit(0.0))
    return d.withColumn(name, val).drop("_lo", "_same", "_n")
