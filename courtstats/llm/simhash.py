"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments: of two fingerprints that
differ in at most three bits, one segment pair differs in at most one.  Every
distinct fingerprint is indexed under each segment as it is and under its 32
one-wildcard variants (the segment with one bit deleted).  Equal segments meet
under the exact key; segments that differ in bit i meet under variant i, one
having the bit set and the other not.  Candidates are verified on all 64 bits
and the links' components are the groups.

Copies collapse to one row per distinct fingerprint before any join, so a group
of identical texts of any size is one index row.

All joins are sort-merge joins by hint: every side grows with the documents, and
Spark estimates the index (65 rows of a fingerprint) at the size of its fingerprints,
so that it would send an index of hundreds of MB through the driver.

Defined cases: words and shingles as in the contract (lower-cased A-Z, three
words, repeats count, XXH64 seed 42); fewer than three words: the whole sequence
is the only shingle; null or blank texts: fingerprint zero, linked like any
other; repeated rows share a fingerprint; a null doc_id never is a component's
smallest id unless all ids are null; an empty table gives an empty result;
columns other than doc_id and text are ignored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtstats.llm.common import components, materialise

SHINGLE_WORDS, MAX_BITS, SEED = 3, 3, 42
SEGMENT_BITS = 32


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of one text (signed, as Spark keeps it)."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: lowers A-Z only, splits on the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = end - size
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(start[:len(words) - shingle + 1].tolist(),
                                                                     end[shingle - 1:].tolist())]
    ones = np.zeros(64, np.int64)
    h = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at:at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``keep`` columns and ``fp`` of every row."""
    import pyarrow as pa

    src = docs.select(*keep, F.coalesce("text", F.lit("")).cast("binary").alias("_t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.drop("_t").schema) + ", fp long"

    def run(batches):
        for b in batches:
            fp = [fingerprint(t.as_py(), shingle) for t in b.column("_t")]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(fp, pa.int64())], [*keep, "fp"])

    return src.mapInArrow(run, schema)


def _segment(fp: Column, part: int) -> Column:
    return F.shiftrightunsigned(fp, part * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """All pairs (a, b) of distinct ``fp`` that differ in at most ``max_bits`` <= 3 bits."""
    if max_bits > 3:
        raise ValueError("two segments guarantee at most three bits")
    parts = F.array(*[F.struct(F.lit(p).alias("part"), _segment(F.col("fp"), p).alias("seg")) for p in (0, 1)])
    seg = distinct.select("fp", F.inline(parts))
    exact = seg.select("fp", "part", F.col("seg").alias("key"))
    same = (exact.alias("x").join(exact.alias("y").hint("merge"), ["part", "key"])
            .where("x.fp < y.fp").select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))
    bits = seg.select("fp", "part", "seg", F.explode(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1))).alias("bit"))
    one = F.expr("shiftleft(1L, bit)")
    bits = bits.select("fp", "part", "bit", (F.col("seg").bitwiseAND(one) != 0).alias("on"),
                       F.col("seg").bitwiseAND(F.bitwise_not(one)).alias("key"))
    flip = (bits.where("on").alias("x").join(bits.where("not on").alias("y").hint("merge"), ["part", "bit", "key"])
            .select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")))
    return (same.unionByName(flip)
            .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).distinct())


def groups(docs: DataFrame, keep: list[str], shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``keep`` columns, fp, root (smallest fingerprint reachable) and component_id
    (smallest doc_id reachable)."""
    rows = materialise(fingerprints(docs, keep, shingle), "simhash")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    root = components(links(distinct.select("fp"), max_bits)).toDF("fp", "root")
    distinct = distinct.join(root.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = distinct.groupBy("root").agg(F.min("low").alias("component_id"))
    named = distinct.join(least.hint("merge"), "root").select("fp", "root", "component_id")
    return rows.join(named.hint("merge"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    return groups(docs, ["doc_id"], shingle, max_bits).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, that with its smallest
    doc_id.  Of rows sharing that id, the smallest fingerprint, then the smallest
    row hash stays; of rows equal in every column one stays; a group without any
    id keeps one row likewise."""
    cols = list(docs.columns)
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in cols])
    d = docs.select(F.struct(*cols).alias("__row"), "doc_id", "text", F.xxhash64(*cols, nulls).alias("__h"))
    fps = groups(d, ["doc_id", "__h"], shingle, max_bits)
    heads = (fps.groupBy("root", "doc_id", "__h", "fp").agg(F.count("*").alias("n"))
             .groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", F.col("__h").alias("h"), "n")).alias("o"))
             .select(F.col("o.doc_id").alias("__id"), F.col("o.h").alias("__k"), F.col("o.n").alias("__n")))
    heads = materialise(heads, "simhash-heads").hint("merge")
    match = F.col("__h").eqNullSafe(F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    one = d.join(heads.where("__n = 1"), match, "left_semi")
    many = d.join(heads.where("__n > 1"), match, "left_semi").dropDuplicates(["__h"])
    return one.unionByName(many).select("__row.*")
