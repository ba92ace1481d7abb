"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a word is a maximal run of characters other than these six
SPACE = r"[\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share
    (``spark.checkpoint.dir``).  Only where no folder is configured at all
    (local tests) one is made below the system's temporary folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="llm-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    survives lost executors, and is computed once for all its readers."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def word_count(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    t = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(text.isNull() | (t == ""), F.lit(0)).otherwise(F.size(F.split(t, SPACE))).cast("long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star / small-star rounds.

    ``edges``: two long columns (u, v), any order, repeats allowed.  Returns
    (u, root) for every node that is not itself the smallest id (``root``) of its
    component.  Every round is a few aggregations and
    equi-joins on node ids and is written to the shared folder.  The joins are
    sort-merge joins by hint: no list of nodes goes through the driver."""
    e = edges.toDF("u", "v").where("u <> v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")

    def mark(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(low.toDF("u", "v")).distinct(), "cc")
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select("u", F.col("v").alias("root"))


# ---------------------------------------------------------------- numpy, inside tasks

_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    have = _POW.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        one = np.ones(n, np.uint64)
        p, q = one.copy(), one.copy()
        p[1:], q[1:] = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        have = _POW[base] = (np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64))
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


BASE_A, BASE_B = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class RangeHash:
    """Hashes of any range of a symbol sequence, from prefix sums modulo 2**64."""

    def __init__(self, symbols: np.ndarray, base: int):
        n = len(symbols)
        self.up, down = powers(base, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * down[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64))


def byte_symbols(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(buf: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of concatenated texts; ``cut``: offsets
    where a new text begins (words never cross them)."""
    solid = ~_IS_SPACE[buf]
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = cut[(cut > 0) & (cut < len(buf))]
    first[inner] |= solid[inner]
    last[inner - 1] |= solid[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def binary_column(col) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as (all bytes, offsets); null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    a = pc.fill_null(col, "").cast(pa.large_binary())
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    data = a.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def slices(batch, max_bytes: int, column: str = "text"):
    """Cut a record batch into runs of rows of about ``max_bytes`` of text
    (a longer text makes a run of its own)."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, 0
    for i, s in enumerate(size):
        if i > at and total + s > max_bytes:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += s
    if batch.num_rows > at:
        yield batch.slice(at)
