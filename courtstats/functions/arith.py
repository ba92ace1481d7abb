"""Division with explicit missing / infinite semantics.

Spark in ANSI mode raises on x/0 and ``try_divide`` gives NULL; the analysis
scripts this library reproduces divide with IEEE rules (x/0 = +-Inf).  A
ranking that must put a zero-denominator row first needs the IEEE form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtstats.functions._cols import as_col


def safe_div(num, den, mode: str = "null") -> Column:
    """Divide ``num`` by ``den`` as doubles.

    mode='null': x/0 -> NULL.
    mode='ieee': x/0 -> +Inf or -Inf by the sign of x, 0/0 -> NULL (NaN is
                 mapped to NULL so it never sorts above +Inf).
    mode='zero': x/0 -> 0.0 (guarded career percentages).
    """
    n = as_col(num).cast("double")
    d = as_col(den).cast("double")
    q = F.try_divide(n, d)
    if mode == "null":
        return q
    if mode == "zero":
        return F.when(d == 0, F.lit(0.0)).otherwise(q)
    if mode == "ieee":
        inf = F.lit(float("inf"))
        return (
            F.when((d == 0) & (n > 0), inf)
            .when((d == 0) & (n < 0), -inf)
            .otherwise(q)
        )
    raise ValueError(f"unknown division mode {mode!r}")
