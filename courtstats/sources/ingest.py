"""Ingest helpers: multi-source unions with lineage, id backfill, header
repair and link extraction -- all as Spark jobs over the data itself."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def union_sources(frames: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """UNION ALL by column name of several sources (missing columns become
    NULL), each row tagged with its source name (season loads, per-team
    scrapes appended in a loop)."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def read_many(spark: SparkSession, paths: list[str], schema, fmt: str = "parquet",
              lineage: str = "source_file") -> DataFrame:
    """One scan over many files (instead of a read-and-append loop), with the
    file each row came from."""
    df = spark.read.format(fmt).schema(schema).load(paths)
    return df.withColumn(lineage, F.col("_metadata.file_path"))


def missing_ids(present: DataFrame, expected: DataFrame, key: str, name: str = "id") -> DataFrame:
    """Backfill check: expected ids absent from ``present`` ('missing') and present
    ids that are not expected ('unexpected'): two anti joins on the key."""
    want = expected.select(F.col(key).alias(name)).distinct()
    have = present.select(F.col(key).alias(name)).distinct()
    missing = want.join(have, name, "left_anti").withColumn("status", F.lit("missing"))
    unexpected = have.join(want, name, "left_anti").withColumn("status", F.lit("unexpected"))
    return missing.unionByName(unexpected)


def snake_case(name: str) -> str:
    """``janitor::clean_names`` style: lower snake case, a leading digit gets an
    ``x`` prefix (``2021-22`` -> ``x2021_22``), '%' becomes 'percent'."""
    s = name.replace("%", "_percent_")
    s = re.sub(r"([a-z])([A-Z])", r"\1_\2", s)
    s = re.sub(r"[^0-9A-Za-z]+", "_", s).strip("_").lower()
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def clean_names(df: DataFrame) -> DataFrame:
    """Rename every column to snake case, de-duplicating with ``_2``, ``_3``."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        n = snake_case(c)
        if n in seen:
            seen[n] += 1
            n = f"{n}_{seen[n]}"
        else:
            seen[n] = 1
        out.append(n)
    return df.toDF(*out)


HREF = r'href="([^"]*)"'


def page_links(pages: DataFrame, pattern: str | None = None, html: str = "html",
               key: str = "page_id") -> DataFrame:
    """Distinct link targets per page, optionally filtered by a regex."""
    links = pages.select(key, F.explode(F.regexp_extract_all(F.col(html), F.lit(HREF), 1)).alias("link"))
    links = links.distinct()
    return links.filter(F.col("link").rlike(pattern)) if pattern else links


def first_link(pages: DataFrame, pattern: str, html: str = "html", key: str = "page_id") -> DataFrame:
    """The first link target of every page, in the order of its text, that matches the
    regex; pages without one are left out."""
    links = F.filter(F.regexp_extract_all(F.col(html), F.lit(HREF), 1), lambda x: x.rlike(pattern))
    return pages.select(key, F.get(links, F.lit(0)).alias("link")).filter(F.col("link").isNotNull())
