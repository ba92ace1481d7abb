"""Query catalogue: name -> (Spark builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole driver tables; the oracle is the same computation in DuckDB SQL over the
same parquet files (views defined in ``oracle_views``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c) -> Column:
    """Round a double output to 6 places (oracle comparison)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


SIDES = ("HOMEDESCRIPTION", "VISITORDESCRIPTION")


def sql_any(template: str) -> str:
    """SQL: predicate on either description column (NULL side = no match)."""
    return "(" + " OR ".join("coalesce(" + template.format(c=c) + ", false)" for c in SIDES) + ")"


def sql_none(template: str) -> str:
    return "(NOT " + sql_any(template) + ")"


def load_all():
    """Import the query modules so they register."""
    from courtstats.plans import (  # noqa: F401
        awards_boards, awards_box, awards_events, q_relational, q_sources,
    )
