"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors are compared only within a label.  Copies collapse to classes first (one
row per label and vector, with its number of copies).  The classes of a label
are dealt to blocks of about ``block_rows``; every pair of blocks is one tile, a
group of two blocks.  In a tile, unit vectors u are quantised to int8 codes q
with a scale s, and e = |u - s q| is kept per vector.  For two vectors

    |u.v - s_u s_v q_u.q_v|  <=  e_u + e_v + e_u e_v,

so a pair whose integer product plus that bound is under the threshold is out;
all others are recomputed in double precision from the vectors as given.  The
integer products are exact: they run as float32 while d * 127**2 < 2**24, as
float64 beyond.

A tile returns, per class, the number of linked vectors and a spanning forest of
its links (never the pairs themselves), so a dense group of n vectors yields
O(n) rows per tile.

Defined cases: a null label, a null or zero vector, and a vector that holds a null
or non-finite component link with nothing (n_links 0, own component); vectors of
different lengths are not compared; copies of a vector link with each other;
repeated rows are separate vectors; a null vec_id is not a component id unless its
group has no other; an empty table gives an empty result; other columns are
ignored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtstats.llm.common import components, materialise

THRESHOLD = 0.98
BLOCK_ROWS = 2048


def _unit_codes(x: np.ndarray):
    """Unit vectors, int8 codes, scales and error bounds of the rows of ``x``."""
    big = np.abs(x).max(axis=1, keepdims=True)
    u = x / big
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    s = np.abs(u).max(axis=1) / 127.0
    q = np.rint(u / s[:, None]).astype(np.int8)
    e = np.sqrt(((u - s[:, None] * q) ** 2).sum(axis=1)) + 1e-9
    return q, s, e


def _tile(x: np.ndarray, y: np.ndarray, threshold: float, same: bool, rows: int = 1024):
    """Index pairs (i, j) with cosine of x[i], y[j] at or above the threshold."""
    kind = np.float32 if x.shape[1] * 127 ** 2 < 1 << 24 else np.float64
    qx, sx, ex = _unit_codes(x)
    qy, sy, ey = (qx, sx, ex) if same else _unit_codes(y)
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    qy_t = qy.astype(kind).T
    for a in range(0, len(x), rows):
        near = (qx[a:a + rows].astype(kind) @ qy_t).astype(np.float64)
        near *= sx[a:a + rows, None]
        near *= sy[None, :]
        near += ex[a:a + rows, None] * (1 + ey[None, :]) + ey[None, :]
        i, j = np.nonzero(near >= threshold)
        i += a
        if same:
            i, j = i[i < j], j[i < j]
        for b in range(0, len(i), 1 << 15):
            p, r = i[b:b + (1 << 15)], j[b:b + (1 << 15)]
            ok = (x[p] * y[r]).sum(axis=1) / (nx[p] * ny[r]) >= threshold
            yield p[ok], r[ok]


def _forest(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the links into ``parent`` (roots point to themselves; the least index wins)."""
    while len(i):
        a, b = parent[i], parent[j]
        hi, lo = np.maximum(a, b), np.minimum(a, b)
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
        keep = parent[i] != parent[j]
        i, j = i[keep], j[keep]


def classes(vectors: DataFrame) -> DataFrame:
    """One row per label and usable vector: key, vector, copies, low (least vec_id)."""
    v = F.col("embedding")
    fine = v.isNotNull() & F.col("label").isNotNull() & F.forall(
        F.coalesce(v, F.array().cast(vectors.schema["embedding"].dataType)),
        lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    some = F.exists(v, lambda c: c != 0)
    return (vectors.where(fine & some).groupBy("label", "embedding")
            .agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"))
            .withColumn("key", F.xxhash64("label", "embedding")))


def tiles(cls: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """Rows (key, linked, other): linked > 0: that many vectors linked with the
    class; other: a class it is joined with in the tile's forest."""
    import pyarrow as pa

    dims = cls.withColumn("dim", F.size("embedding"))
    n = (dims.groupBy("label", "dim").agg(F.count("*").alias("n"))
         .select(F.col("label").alias("_l"), F.col("dim").alias("_d"), F.ceil(F.col("n") / block_rows).alias("blocks")))
    dealt = (dims.join(n, (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d")))
             .withColumn("block", F.pmod("key", "blocks")))
    dealt = (dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("label", "dim", F.least("block", "with").alias("ti"), F.greatest("block", "with").alias("tj"),
                     (F.col("block") <= F.col("with")).alias("first"), "key", "copies",
                     F.col("embedding").cast("array<double>").alias("vec")))

    def one(tab: pa.Table) -> pa.Table:
        key = tab.column("key").to_numpy()
        copies = tab.column("copies").to_numpy()
        vec = tab.column("vec").combine_chunks()
        x = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(key), -1)
        first = tab.column("first").to_numpy()
        same = tab.column("ti")[0].as_py() == tab.column("tj")[0].as_py()
        left = np.arange(len(key)) if same else np.flatnonzero(first)
        right = left if same else np.flatnonzero(~first)
        linked, parent = np.zeros(len(key), np.int64), np.arange(len(key))
        if len(left) and len(right):
            for i, j in _tile(x[left], x[right], threshold, same):
                i, j = left[i], right[j]
                np.add.at(linked, i, copies[j])
                np.add.at(linked, j, copies[i])
                _forest(parent, i, j)
        out = np.flatnonzero(linked)
        return pa.table({"key": key[out], "linked": linked[out], "other": key[parent[out]]})

    return dealt.groupBy("label", "dim", "ti", "tj").applyInArrow(one, "key long, linked long, other long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select("vec_id", "embedding", "label")
    cls = materialise(classes(rows), "embed-classes")
    found = materialise(tiles(cls, threshold, block_rows), "embed-links")
    linked = found.groupBy("key").agg(F.sum("linked").alias("linked"))
    root = components(found.select("key", "other")).toDF("key", "root")
    full = (cls.join(linked, "key", "left").join(root, "key", "left")
            .withColumn("root", F.coalesce("root", "key")))
    low = full.groupBy("root").agg(F.min("low").alias("component"))
    full = full.join(low, "root").select(
        F.col("label").alias("_l"), F.col("embedding").alias("_v"), "component",
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).cast("long").alias("links"))
    out = rows.join(full, (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_v")), "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
                      F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id")
                      ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e)
  AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) x ON x.a = vec_id
LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) y ON y.a = vec_id
"""
