"""Ordered-sequence scans that survive a hot partition key.

An event log is ordered inside a partition key (a game).  ``scan`` computes running
sums, fills, neighbouring rows and whole-partition values of such sequences in one
exchange: rows are dealt by (key, range) and every range is windowed by itself.

``find_cuts`` looks where ranges are needed at all.  It reads the key and order columns
once, takes a random sample of ``SAMPLE`` rows of them and cuts every key that holds more
than ``chunk_size`` rows (by the sample) at quantiles of its own order values, so
that ranges hold about the same number of rows whatever the values look like.  A
key below that size stays whole; without a key to cut the plan is the plain window.  At
most ``MAX_CUTS`` cuts are made: with one key of a third of 10^12 rows a range holds
1.3 * 10^9 rows, sorted by a spilling sort; give a larger ``MAX_CUTS`` where that is too much.

What crosses a cut -- totals, the last or next non-missing value, the rows next to the
cut, the values of the whole partition -- is one summary row per range of a cut key,
merged over the ranges and joined back by broadcast: at most 2 * ``MAX_CUTS`` rows.

The order may be one column or several, of any atomic type: number, text, date, time, ...
Missing order values come first.  Rows with the same key and order values have no order
among themselves and are never parted by a cut; name more columns to order them.

Results do not depend on the cuts: missing partition keys are a partition of their
own, a missing measure adds nothing to a running sum (which is missing until the first
value), and any neighbour offset is allowed.  ``chunk_size=None`` is the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = "_seq_chunk"
DEFAULT_CHUNK = 1 << 20
SAMPLE = 8192
MAX_CUTS = 256
_MERGE = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def _as_list(x):
    return [x] if isinstance(x, str) else list(x)


@dataclass(frozen=True)
class Cuts:
    """Range limits of the cut keys of one log: ``bounds`` are (key..., order...) values,
    a row's range is the number of bounds at or below it; ``hot`` the keys cut."""

    part: tuple[str, ...]
    order: tuple[str, ...]
    types: tuple[str, ...] = ()
    bounds: tuple[tuple, ...] = ()
    hot: tuple[tuple, ...] = ()


def _comparable(df: DataFrame, names) -> list[Column]:
    """The columns as values that go to the driver and back into a literal unchanged, in
    the same order: times as microseconds."""
    kind = dict(df.dtypes)
    as_is = {"timestamp": lambda c: F.unix_micros(c), "timestamp_ntz": lambda c: c.cast("string")}
    return [as_is.get(kind[n], lambda c: c)(F.col(n)) for n in names]


def draw(df: DataFrame, names, sample: int = SAMPLE) -> tuple[list[tuple], float]:
    """A uniform random sample of at most ``sample`` rows of the named columns, in
    order, and the number of rows one of them stands for (all rows, and 1, where the
    input is no larger).  One pass; no task and not the driver holds more than ``sample`` rows."""
    cols = [c.alias(f"_{i}") for i, c in enumerate(_comparable(df, names))]
    rows = df.select(*cols, F.rand(7).alias("_r")).orderBy("_r").limit(sample)
    rows = rows.orderBy(*[f"_{i}" for i in range(len(cols))]).collect()
    each = 1.0 if len(rows) < sample else (sample - 1) / max(r["_r"] for r in rows) / sample
    return [tuple(r)[:-1] for r in rows], each


def literal_types(df: DataFrame, names) -> tuple[str, ...]:
    return tuple(t for _, t in df.select(*_comparable(df, names)).dtypes)


def find_cuts(df: DataFrame, partition, order, chunk_size=DEFAULT_CHUNK, sample: int = SAMPLE,
              max_cuts: int = MAX_CUTS) -> Cuts:
    """Cuts for keys of more than ``chunk_size`` rows, from a random sample of the key
    and order columns.  The sample decides how rows are dealt, never a result."""
    part, order = tuple(_as_list(partition)), tuple(_as_list(order))
    if chunk_size is None:
        return Cuts(part, order)
    rows, each = draw(df, part + order, sample)
    groups: dict[str, list[tuple]] = {}
    for r in rows:
        groups.setdefault(repr(r[:len(part)]), []).append(r)
    hot = [g for g in groups.values() if len(g) * each > chunk_size]
    size = max(chunk_size, sum(map(len, hot)) * each / max_cuts)
    bounds, cut = [], []
    for g in hot:
        n = int(min(len(g), -(-len(g) * each // size)))
        at = sorted({i * len(g) // n for i in range(1, n)})
        inner = [g[i] for j, i in enumerate(at) if repr(g[i]) != repr(g[at[j - 1] if j else 0])]
        if inner:
            bounds += inner
            cut.append(g[0][:len(part)])
    return Cuts(part, order, literal_types(df, part + order), tuple(bounds), tuple(cut))


def _range_of(df: DataFrame, cuts: Cuts) -> Column:
    """Number of bounds at or below the row: a search tree of comparisons."""
    row = F.struct(*_comparable(df, cuts.part + cuts.order))

    def tree(lo, hi):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        bound = F.struct(*[F.lit(v).cast(t) for v, t in zip(cuts.bounds[mid], cuts.types)])
        return F.when(row >= bound, tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(cuts.bounds))


def _is_cut(df: DataFrame, cuts: Cuts) -> Column:
    cols = _comparable(df, cuts.part)
    same = [reduce(lambda a, b: a & b, [c.eqNullSafe(F.lit(v).cast(t)) for c, v, t in zip(cols, key, cuts.types)],
                   F.lit(True)) for key in cuts.hot]
    return reduce(lambda a, b: a | b, same)


def scan(df: DataFrame, partition, order, sums: dict | None = None, down: dict | None = None, up: dict | None = None,
         near: dict | None = None, groups: dict | None = None, number: str | None = None,
         chunk_size=DEFAULT_CHUNK, cuts: Cuts | None = None) -> DataFrame:
    """Add columns to the rows of every partition, in ``order``:

    * ``sums``   {new: column}: sum up to and including the row;
    * ``down`` / ``up`` {new: column}: last / next non-missing value, the row's own first;
    * ``near``   {new: (column, offset)}: value of the offset-th next (+) or previous (-) row;
    * ``groups`` {new: (sum|max|min|count, column)}: value over the whole partition;
    * ``number`` new: position of the row, from 1.

    ``cuts`` of an earlier :func:`find_cuts` over the same rows may be given, so that a
    log that is scanned several times is sampled once; without it the input is sampled."""
    part, order = _as_list(partition), _as_list(order)
    sums, down, up, near, groups = (dict(x or {}) for x in (sums, down, up, near, groups))
    if number:
        df = df.withColumn("_seq_one", F.lit(1).cast("long"))
        sums[number] = "_seq_one"
    if cuts is None:
        cuts = find_cuts(df, part, order, chunk_size)
    elif (cuts.part, cuts.order) != (tuple(part), tuple(order)):
        raise ValueError(f"cuts of {cuts.part}, {cuts.order} do not fit {part}, {order}")
    keys = part
    if cuts.bounds:
        df, keys = df.withColumn(_CHUNK, _range_of(df, cuts)), [*part, _CHUNK]
    ahead = Window.partitionBy(*keys).orderBy(*[F.col(o).asc_nulls_first() for o in order])
    back = Window.partitionBy(*keys).orderBy(*[F.col(o).desc_nulls_last() for o in order])
    so_far = (Window.unboundedPreceding, 0)
    new = {n: F.sum(c).over(ahead.rowsBetween(*so_far)) for n, c in sums.items()}
    new |= {n: F.last(c, ignorenulls=True).over(ahead.rowsBetween(*so_far)) for n, c in down.items()}
    new |= {n: F.last(c, ignorenulls=True).over(back.rowsBetween(*so_far)) for n, c in up.items()}
    new |= {n: (F.lead(c, o) if o > 0 else F.lag(c, -o)).over(ahead) for n, (c, o) in near.items()}
    new |= {n: _MERGE[f](c).over(Window.partitionBy(*keys)) for n, (f, c) in groups.items()}
    if not cuts.bounds:
        return df.withColumns(new).drop("_seq_one")
    if near:
        new |= {"_seq_rn": F.row_number().over(ahead), "_seq_nr": F.row_number().over(back)}
    # new columns may replace the ones they are taken from: those are kept aside
    src = sorted({*sums.values(), *down.values(), *up.values(), *(c for c, _ in near.values()), *(c for _, c in groups.values())})
    local = df.withColumns({"_seq_v_" + c: F.col(c) for c in src}).withColumns(new)
    return _carry(local, part, order, cuts, sums, down, up, near, groups).drop(
        _CHUNK, "_seq_rn", "_seq_nr", "_seq_one", *["_seq_v_" + c for c in src])


def _carry(local, part, order, cuts, sums, down, up, near, groups) -> DataFrame:
    """Add to the ranges of cut keys what the other ranges of the key hold."""
    val = lambda c: F.col("_seq_v_" + c)
    far_on = max([o for _, o in near.values() if o > 0], default=0)
    far_back = max([-o for _, o in near.values() if o < 0], default=0)
    # the order as a struct: a missing order value still ranks (first)
    at = [x for o in order for x in (F.col(o).isNotNull(), F.col(o))]
    held = lambda c: F.when(val(c).isNotNull(), F.struct(*[a.alias(f"_{i}") for i, a in enumerate(at)], val(c).alias("_v")))
    row = F.struct(F.col("_seq_rn"), *[val(c).alias("_v_" + c) for c in sorted({c for c, _ in near.values()})]) if near else None
    aggs = [F.sum(val(c)).alias(f"_seq_s_{n}") for n, c in sums.items()]
    aggs += [F.max(held(c)).getField("_v").alias(f"_seq_d_{n}") for n, c in down.items()]
    aggs += [F.min(held(c)).getField("_v").alias(f"_seq_u_{n}") for n, c in up.items()]
    aggs += [_MERGE[f](val(c)).alias(f"_seq_g_{n}") for n, (f, c) in groups.items()]
    if near:
        aggs += [F.array_sort(F.collect_list(F.when(F.col("_seq_rn") <= far_on, row))).alias("_seq_head"),
                 F.array_sort(F.collect_list(F.when(F.col("_seq_nr") <= far_back, row))).alias("_seq_tail")]
    each = local.filter(_is_cut(local, cuts)).groupBy(*part, _CHUNK).agg(*aggs)
    w = Window.partitionBy(*part).orderBy(_CHUNK)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    merged = [F.sum(f"_seq_s_{n}").over(before).alias(f"_seq_s_{n}") for n in sums]
    merged += [F.last(f"_seq_d_{n}", ignorenulls=True).over(before).alias(f"_seq_d_{n}") for n in down]
    merged += [F.first(f"_seq_u_{n}", ignorenulls=True).over(after).alias(f"_seq_u_{n}") for n in up]
    merged += [(F.sum if f == "count" else _MERGE[f])(f"_seq_g_{n}").over(Window.partitionBy(*part)).alias(f"_seq_g_{n}")
               for n, (f, _) in groups.items()]
    if near:  # a range has a row at least: as many ranges as the largest offset are enough
        merged += [F.flatten(F.collect_list("_seq_head").over(w.rowsBetween(1, max(far_on, 1)))).alias("_seq_next"),
                   F.flatten(F.collect_list("_seq_tail").over(w.rowsBetween(-max(far_back, 1), -1))).alias("_seq_prev")]
    small = each.select(*[F.col(k).alias("_seq_k_" + k) for k in [*part, _CHUNK]], *merged)
    on = reduce(lambda a, b: a & b, [local[k].eqNullSafe(small["_seq_k_" + k]) for k in [*part, _CHUNK]])
    out = local.join(F.broadcast(small), on, "left")  # at most 2 * MAX_CUTS rows
    fixed = {n: F.coalesce(F.col(n) + F.col(f"_seq_s_{n}"), F.col(n), F.col(f"_seq_s_{n}")) for n in sums}
    fixed |= {n: F.coalesce(F.col(n), F.col(f"_seq_d_{n}")) for n in down}
    fixed |= {n: F.coalesce(F.col(n), F.col(f"_seq_u_{n}")) for n in up}
    fixed |= {n: F.coalesce(F.col(f"_seq_g_{n}"), F.col(n)) for n in groups}
    for n, (c, o) in near.items():
        if o > 0:  # past the range's end: the (o - rows left)-th row of the next ranges
            over, there = F.col("_seq_nr") <= o, F.try_element_at("_seq_next", (F.lit(o) - F.col("_seq_nr") + 1).cast("int"))
        else:
            over, there = F.col("_seq_rn") <= -o, F.try_element_at("_seq_prev", (F.col("_seq_rn") - F.lit(-o) - 1).cast("int"))
        fixed[n] = F.when(over, there.getField("_v_" + c)).otherwise(F.col(n))
    return out.withColumns(fixed).drop(*small.columns)


def running_sum(df: DataFrame, partition, order, cols, chunk_size=DEFAULT_CHUNK, suffix: str = "_run",
                cuts: Cuts | None = None) -> DataFrame:
    """Add ``<col><suffix>`` = sum of ``col`` over rows up to and including the
    current one, per partition, in ``order``."""
    return scan(df, partition, order, sums={c + suffix: c for c in _as_list(cols)}, chunk_size=chunk_size, cuts=cuts)


def fill(df: DataFrame, partition, order, cols, direction: str = "down", chunk_size=DEFAULT_CHUNK,
         cuts: Cuts | None = None) -> DataFrame:
    """Replace missing values by the last (``down``) or next (``up``)
    non-missing value of the same partition, in ``order`` (tidyr ``fill``)."""
    if direction not in ("down", "up"):
        raise ValueError(direction)
    return scan(df, partition, order, **{direction: {c: c for c in _as_list(cols)}}, chunk_size=chunk_size, cuts=cuts)


def neighbours(df: DataFrame, partition, order, spec: dict, chunk_size=DEFAULT_CHUNK,
               cuts: Cuts | None = None) -> DataFrame:
    """Add values of other rows: ``spec = {new_name: (col, offset)}`` with offset
    +k = the k-th next row (``lead``), -k = the k-th previous row (``lag``)."""
    return scan(df, partition, order, near=spec, chunk_size=chunk_size, cuts=cuts)
