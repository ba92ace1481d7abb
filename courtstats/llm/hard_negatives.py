"""Hard negatives by rotated one-bit codes with rigorous score intervals.

The score of two rows is the inner product of their integer vectors floor(256 x).
Anchors are searched against all rows; an anchor's positives are its best rows of the
same label, and for each positive the best rows of other labels whose score lies
between ``low`` and ``high`` percent of the positive's are its hard negatives.

Index, one row per vector: the integer vector v is rotated by a seeded orthonormal matrix
(r = R v) and kept as one bit a dimension, b = sign(r) / sqrt(d), with its alignment
a = <b, r>.  What that code misses, r - a b, gets a one-bit code and alignment of its own, and so
on: ``LEVELS`` codes, and the length e of what they all miss.  An anchor q is rotated the
same way and cut into ``PLANES`` bit planes, so <b, q> is a weighted sum of
popcounts, exact up to the rounding t of the planes.  As the rest is normal to the last b,

    |<v, q> - sum of a <b, q>|  <=  e * sqrt(|q|^2 - <last b, q>^2)        (Cauchy-Schwarz)

which holds for every pair, not on average.  A row whose interval cannot reach the
anchor's best ones (by the lower ends of the others) or its score bands is out; all
others are scored in integers.  So results are exact whatever the codes are worth.

Rows and anchors are dealt to blocks; every block of anchors meets every block of rows
in a group of its own, which returns at most k rows per anchor (and band).  Labels play no
part in the dealing, so a label of a third of all rows is spread like any other.

Defined cases: rows with a null id, null label, null vector, or a null or non-finite
component take no part; "other rows" are those of another id, repeated rows of one
id count one by one, and repeated anchors each have rows of their own in the result; vectors of different
lengths do not meet; components are limited to the largest size at which a score of d
of them fits a long (2**28 for 64 dimensions, |x| up to a million); an
empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtstats.llm.common import materialise

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
BLOCK = 8192
LEVELS, PLANES = 6, 8
SEED = 13
CHUNK = 1 << 21  # cells of a score matrix held at once

INDEX = "uid long, vec_id long, label long, anchor boolean, dim int, ints binary, code binary, align binary, rest double"
HIT = "uid long, band int, other long, score long"


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def limit(dim: int) -> int:
    """Largest component: ``dim`` products of two such fit a long."""
    return int(min(2 ** 31 - 1, np.sqrt(2.0 ** 62 / max(dim, 1))))


def integers(x: np.ndarray) -> np.ndarray:
    big = limit(x.shape[1])
    return np.clip(np.floor(SCALE * x.astype(np.float64)), -big, big).astype(np.int64)


def encode(v: np.ndarray):
    """Codes (rows, levels, uint64 words), alignments (rows, levels) and length of the
    rest of integer vectors."""
    n, d = v.shape
    codes, align = np.zeros((n, LEVELS, -(-d // 64)), np.uint64), np.zeros((n, LEVELS))
    if not d:
        return codes, align, np.zeros(n)
    r = v @ rotation(d).T
    for level in range(LEVELS):
        bits = np.zeros((n, -(-d // 64) * 64), np.uint8)
        bits[:, :d] = r > 0
        codes[:, level] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        align[:, level] = np.abs(r).sum(axis=1) / np.sqrt(d)
        r = r - (align[:, level] / np.sqrt(d))[:, None] * np.where(r > 0, 1.0, -1.0)
    return codes, align, np.sqrt((r * r).sum(axis=1))


def planes(q: np.ndarray):
    """Anchors for popcounts: bit planes of the rotated vectors, step, low end, sum of the
    rounded components, L1 error of the rounding, length."""
    d = q.shape[1]
    r = q @ rotation(d).T
    lo, step = r.min(axis=1), np.maximum(np.ptp(r, axis=1) / ((1 << PLANES) - 1), 1e-12)
    level = np.rint((r - lo[:, None]) / step[:, None]).astype(np.int64)
    rounded = lo[:, None] + step[:, None] * level
    bits = np.zeros((len(q), PLANES, -(-d // 64) * 64), np.uint8)
    bits[:, :, :d] = (level[:, None, :] >> np.arange(PLANES)[None, :, None]) & 1
    words = np.packbits(bits, axis=2, bitorder="little").view(np.uint64)
    return words, step, lo, rounded.sum(axis=1), np.abs(r - rounded).sum(axis=1), np.sqrt((r * r).sum(axis=1))


def intervals(index, at: slice, code: np.ndarray, align: np.ndarray, rest: np.ndarray, d: int):
    """Lower and upper ends of the scores of anchors ``at`` with all rows."""
    words, step, lo, total, off, size = (x[at] for x in index)
    slip = (off / np.sqrt(d))[:, None]
    mid, wide = np.zeros((len(step), len(code))), 0.0
    for level in range(LEVELS):
        c = code[:, level]
        ones = np.bitwise_count(c).sum(axis=1, dtype=np.int64)
        hits = np.zeros(mid.shape, np.float32)  # whole numbers below 2**24: exact
        for p in range(PLANES):
            for w in range(c.shape[1]):
                hits += np.float32(1 << p) * np.bitwise_count(words[:, p, w, None] & c[None, :, w])
        # <b, q> from the set bits: twice their sum less the sum of all components
        dot = (2 * (lo[:, None] * ones[None, :] + step[:, None] * hits) - total[:, None]) / np.sqrt(d)
        mid += align[:, level] * dot
        wide = wide + align[:, level] * slip
    sure = np.maximum(np.abs(dot) - slip, 0)
    wide = wide + rest * np.sqrt(np.maximum((size * size)[:, None] - sure * sure, 0))
    wide += 1e-9 * (size[:, None] * (align.sum(axis=1) + rest) + 1) + 1e-6  # rounding of this arithmetic
    return mid - wide, mid + wide


def kth_largest(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of every row; -inf where a row has fewer."""
    if x.shape[1] < k:
        return np.full(len(x), -np.inf)
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer scores: as doubles while every sum stays below 2**53."""
    big = max(np.abs(q).max(initial=0), 1) * max(np.abs(v).max(initial=0), 1) * max(q.shape[1], 1)
    if float(big) < 2.0 ** 53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def best(score: np.ndarray, ok: np.ndarray, ids: np.ndarray, k: int):
    """Per row of ``score`` its k largest where ``ok``, ties by smaller id: (row, column)."""
    top = kth_largest(np.where(ok, score.astype(np.float64), -np.inf), k)
    # doubles may merge neighbours beyond 2**53: the margin keeps them, the sort decides
    near = top - np.where(np.isfinite(top), np.abs(top) * 1e-15 + 0, 0)
    i, j = np.nonzero(ok & (score >= np.maximum(near, -2.0 ** 63)[:, None]))
    order = np.lexsort((ids[j], -score[i, j], i))
    i, j = i[order], j[order]
    first = np.arange(len(i)) - np.searchsorted(i, i)
    return i[first < k], j[first < k]


def bands(positive: np.ndarray, low: int, high: int):
    """Least and greatest integer scores between low and high percent of a positive's."""
    return -(-low * positive // 100), high * positive // 100


def _ints(col, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.int32).reshape(len(col), dim).astype(np.int64)


def _near(index, q, v, code, align, rest, mask, k):
    """Blocks of anchors with the exact scores of the rows in question: (slice, columns,
    scores, ok).  ``mask(at)``: which pairs count; ``k`` best are wanted."""
    d = q.shape[1]
    size = max(1, CHUNK // max(len(v), 1))
    for a in range(0, len(q), size):
        at = slice(a, a + size)
        ok = mask(at)
        if d:
            lo, hi = intervals(index, at, code, align, rest, d)
            ok = k(at, lo, hi, ok)
        cols = np.flatnonzero(ok.any(axis=0))
        if len(cols):
            yield at, cols, scores(q[at], v[cols]), ok[:, cols]


def _search(rows: pa.Table, anchors: pa.Table, pos: int, neg: int, low: int, high: int):
    """One block of rows against one block of anchors; anchors with ``bands`` (scores of
    their positives) look for negatives, others for positives."""
    out = {"uid": [], "band": [], "other": [], "score": []}
    negatives = "bands" in anchors.column_names
    dims = np.asarray(rows["dim"]) if rows.num_rows and anchors.num_rows else np.zeros(0, int)
    for dim in np.unique(dims):
        r = rows.filter(pa.array(dims == dim))
        a = anchors.filter(pa.array(np.asarray(anchors["a_dim"]) == dim))
        if not a.num_rows:
            continue
        dim = int(dim)
        v = _ints(r["ints"], dim)
        code = np.frombuffer(b"".join(r["code"].to_pylist()), np.uint64).reshape(len(v), LEVELS, -(-dim // 64))
        q = _ints(a["a_ints"], dim)
        align = np.frombuffer(b"".join(r["align"].to_pylist()), np.float64).reshape(len(v), LEVELS)
        rest = np.asarray(r["rest"])
        ids, label = np.asarray(r["vec_id"]), np.asarray(r["label"])
        a_id, a_label, uid = np.asarray(a["anchor_id"]), np.asarray(a["a_label"]), np.asarray(a["uid"])
        index = planes(q) if dim else None

        def add(at, i, j, score, cols, band):
            out["uid"].append(uid[at][i])
            out["band"].append(np.full(len(i), band, np.int32))
            out["other"].append(ids[cols[j]])
            out["score"].append(score[i, j])

        if not negatives:
            for lab in np.intersect1d(a_label, label):
                own, mine = np.flatnonzero(label == lab), np.flatnonzero(a_label == lab)
                part = tuple(x[mine] for x in index) if dim else None

                def reach(at, lo, hi, ok):
                    floor = kth_largest(np.where(ok, lo, -np.inf), pos)
                    return ok & (hi >= floor[:, None])

                for at, cols, score, ok in _near(part, q[mine], v[own], code[own], align[own], rest[own],
                                                 lambda at: a_id[mine][at][:, None] != ids[own][None, :], reach):
                    i, j = best(score, ok, ids[own[cols]], pos)
                    add(np.arange(len(q))[mine][at], i, j, score, own[cols], 0)
        else:
            got = a["bands"].to_pylist()
            width = max(len(x) for x in got)
            lows, highs = np.ones((len(got), width), np.int64), np.zeros((len(got), width), np.int64)  # empty bands
            for n, x in enumerate(got):
                lows[n, :len(x)], highs[n, :len(x)] = bands(np.asarray(x, np.int64), low, high)

            def inside(at, lo, hi, ok):
                keep = np.zeros_like(ok)
                for b in range(width):
                    least, most = lows[at, b, None], highs[at, b, None]
                    sure = ok & (lo >= least) & (hi <= most)
                    floor = kth_largest(np.where(sure, lo, -np.inf), neg)
                    keep |= ok & (hi >= least) & (lo <= most) & (hi >= floor[:, None]) & (least <= most)
                return keep

            for at, cols, score, ok in _near(index, q, v, code, align, rest,
                                             lambda at: a_label[at][:, None] != label[None, :], inside):
                for b in range(width):
                    fits = ok & (score >= lows[at, b, None]) & (score <= highs[at, b, None])
                    i, j = best(score, fits, ids[cols], neg)
                    add(np.arange(len(q))[at], i, j, score, cols, b)
    return pa.table({k: np.concatenate(x) if x else np.zeros(0, np.int32 if k == "band" else np.int64)
                     for k, x in out.items()})


def index(vectors: DataFrame, anchor: Column) -> DataFrame:
    """The written index: one row per vector that takes part (see the head)."""
    x = F.col("embedding")
    fine = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    d = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & fine).select(
        F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long"), F.col("label").cast("long"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), x.cast("array<double>").alias("embedding"))

    def pack(batches):
        for b in batches:
            col = b.column("embedding")
            off = np.asarray(col.offsets)
            flat = np.asarray(col.values)
            dims = np.diff(off)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                v = integers(flat[off[at][:, None] + np.arange(dim)[None, :]].reshape(len(at), dim))
                code, align, rest = encode(v)
                ints = v.astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    **{c: b.column(c).take(pa.array(at)) for c in ("uid", "vec_id", "label", "anchor")},
                    "dim": np.full(len(at), dim, np.int32), "ints": [x.tobytes() for x in ints],
                    "code": [x.tobytes() for x in code],
                    "align": [x.tobytes() for x in align], "rest": rest})

    return materialise(d.mapInArrow(pack, INDEX), "negatives")


def _blocks(n: int, block: int) -> int:
    return max(1, -(-n // block))


def _grid(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, block: int, args) -> DataFrame:
    """Every block of rows with every block of anchors, each pair a group."""
    across, down = _blocks(n_rows, block), _blocks(n_anchors, block)

    def dealt(d, key, n):
        return d.withColumn(key, F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int"))

    r = dealt(rows, "rb", across).withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).select(
        "rb", "ab", "vec_id", "label", "dim", "ints", "code", "align", "rest")
    a = dealt(anchors, "a_ab", down).withColumn("a_rb", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    return r.groupBy("rb", "ab").cogroup(a.groupBy("a_rb", "a_ab")).applyInArrow(lambda x, y: _search(x, y, *args), HIT)


def _first(hits: DataFrame, keys, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "other")
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors``: vec_id, embedding (array), label; ``anchor``: which rows are anchors."""
    rows = index(vectors, anchor)
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
    args = (positives, negatives, low, high)
    anchors = rows.where("anchor").select("uid", F.col("vec_id").alias("anchor_id"), F.col("label").alias("a_label"),
                                          F.col("dim").alias("a_dim"), F.col("ints").alias("a_ints"))
    found = _first(_grid(rows, anchors, n_rows, n_anchors, block, args), ["uid"], positives)
    pos = materialise(found.select("uid", (F.col("place") - 1).cast("int").alias("band"), F.col("other").alias("positive_id"),
                                   F.col("score").alias("positive_score")), "negatives")
    wanted = pos.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("band", "positive_score"))).alias("p")).select(
        F.col("uid").alias("_u"), F.col("p.positive_score").alias("bands"))  # at most `positives` a row
    anchors = anchors.join(wanted, F.col("uid") == F.col("_u")).drop("_u")
    hits = _first(_grid(rows, anchors, n_rows, n_anchors, block, args), ["uid", "band"], negatives)
    names = rows.where("anchor").select(F.col("uid").alias("_a"), F.col("vec_id").alias("anchor_id"))
    pos = pos.withColumnsRenamed({"uid": "_u", "band": "_b"})
    out = hits.join(pos, (F.col("uid") == F.col("_u")) & (F.col("band") == F.col("_b"))).join(names, F.col("uid") == F.col("_a"))
    return out.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("other").alias("negative_id"),
                      "positive_score", F.col("score").alias("negative_score"))


ORACLE = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES})
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) <= {NEGATIVES}"""
