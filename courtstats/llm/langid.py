"""Language ID by nearest centroid.

A text becomes a TF-IDF vector of its character 1-, 2- and 3-grams (case folded,
anything but letters is one blank) hashed to ``DIMS`` dimensions, with
logarithmic term counts, scaled to length one.  Every language has up to
``CLUSTERS`` centroids (spherical k-means on a bounded sample of its labelled
texts); the prediction is the language of the nearest centroid by cosine.  A text
further from every centroid than any training text was from its own, by more than
``MARGIN`` of cosine, is rejected; under ``SHORT`` letters that floor falls in
proportion to the letters, as short texts have few n-grams.

Fitting reads a bounded, documented sample: per language the ``SAMPLE`` labelled
training documents with the smallest id hash; each language is clustered in one
task of that many vectors of ``DIMS`` numbers.  Scoring reads every text whole.

Defined cases: null texts and texts without a letter: ``und``, score 0, rejected;
empty training set: everything is ``und``; ties go to the first language in code
point order; repeated rows are scored separately; a null doc_id counts as the
empty text in the crc32; columns other than doc_id, text and lang are ignored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtstats.llm.common import crc_mod, materialise, slices

DIMS, CLUSTERS, SAMPLE, ROUNDS, SEED = 4096, 4, 400, 8, 42
MAX_LANGUAGES = 10_000  # their cuts go to every task; more are no languages
MARGIN, SHARPNESS, SHORT = 0.1, 20.0, 200
CHUNK, SLICE = 1 << 19, 1 << 20


def _letter_table() -> np.ndarray:
    """Code point -> folded code point of a letter, 0 for anything else."""
    table = np.zeros(0x30000, np.uint32)
    for c in range(0x30000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: list[np.ndarray] = []


def counts(text: str, dims: int = DIMS) -> tuple[np.ndarray, int]:
    """Hashed n-gram counts of one whole text and its number of letters."""
    if not _TABLE:
        _TABLE.append(_letter_table())
    total, letters = np.zeros(dims, np.float64), 0
    for at in range(0, len(text), CHUNK):
        piece = text[max(0, at - 2):at + CHUNK]  # grams that cross a cut are counted once
        cp = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.where(cp < len(_TABLE[0]), _TABLE[0][np.minimum(cp, len(_TABLE[0]) - 1)], 0)
        solid = x != 0
        skip = min(at, 2)
        letters += int(solid[skip:].sum())
        keep = solid.copy()  # a run of other characters is one blank
        keep[1:] |= solid[:-1]
        fresh = np.arange(len(x)) >= skip
        x, fresh = x[keep].astype(np.uint64), fresh[keep]
        mul = np.uint64(0x9E3779B97F4A7C15)
        one = (x + np.uint64(1)) * mul
        two = (one[:-1] ^ (x[1:] + np.uint64(7))) * mul
        three = (two[:-1] ^ (x[2:] + np.uint64(13))) * mul
        for n, g in ((1, one), (2, two), (3, three)):
            live = fresh[n - 1:] & ((x[n - 1:] != 0) if n == 1 else True)
            total += np.bincount((g[live] >> np.uint64(40)).astype(np.int64) % dims, minlength=dims)
    return total, letters


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=-1, keepdims=True)), 1e-12)


def _kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; seeds are far from each other, so reruns agree."""
    k = min(k, len(x))
    c = [_unit(x.mean(axis=0))]
    while len(c) < k:
        c.append(x[np.argmin((x @ np.array(c).T).max(axis=1))])
    c = np.array(c)
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.array([_unit(x[near == i].mean(axis=0)) if (near == i).any() else c[i] for i in range(k)])
    return c


def fit(docs: DataFrame, sample: int = SAMPLE, dims: int = DIMS, clusters: int = CLUSTERS) -> dict:
    """The model: names, centroids, idf and the cosine floor per length."""
    import pandas as pd

    train = (docs.select("doc_id", "lang", "text")
             .where((crc_mod("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    # the ``sample`` rows of every language with the smallest hashes of id and text: counts of the
    # hashes' upper 12 bits tell where to cut, counts of the next 12 bits where to cut there, so a
    # window sees at most 4,096 counts of a language, and in the end little more than what is kept
    h = F.xxhash64("doc_id", "text")
    upper, lower = F.shiftrightunsigned("_h", 52), F.shiftrightunsigned("_h", 40).bitwiseAND(F.lit(4095).cast("long"))
    hashed = materialise(train.select("lang", h.alias("_h")), "langid")

    def cut(counted: DataFrame, name: str) -> DataFrame:
        upto = F.col("_before") + F.sum("_k").over(Window.partitionBy("lang").orderBy("_b"))
        low = counted.withColumn("_upto", upto).where(F.col("_upto") - F.col("_k") < sample)
        return low.groupBy(F.col("lang").alias("_l")).agg(
            F.max("_b").alias(name), F.max_by(F.col("_upto") - F.col("_k"), "_b").alias("_seen"))

    first = materialise(cut(hashed.groupBy("lang", upper.alias("_b")).agg(F.count("*").alias("_k"), F.lit(0).alias("_before")), "_cut"), "langid")
    if first.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    there = hashed.join(F.broadcast(first), (F.col("lang") == F.col("_l")) & (upper == F.col("_cut")))
    second = cut(there.groupBy("lang", lower.alias("_b")).agg(F.count("*").alias("_k"), F.max("_seen").alias("_before")), "_fine")
    cuts = materialise(first.drop("_seen").join(second.drop("_seen"), "_l"), "langid")  # a row per language
    near = train.withColumn("_h", h).join(F.broadcast(cuts), (F.col("lang") == F.col("_l")) & (
        (upper < F.col("_cut")) | ((upper == F.col("_cut")) & (lower <= F.col("_fine")))))
    one = near.dropDuplicates(["lang", "doc_id", "_h"])  # rows that repeat one another count once
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    rows = one.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample)

    def vectors(frames):
        for f in frames:
            got = [counts(t, dims) for t in f.text]
            yield pd.DataFrame({"lang": f.lang, "n": [n for _, n in got],
                                "v": [c.astype("<f4").tobytes() for c, _ in got]})

    vec = rows.select("lang", "text").mapInPandas(vectors, "lang string, n long, v binary").where("n > 0")

    def cluster(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["n", "v"])
        raw = np.log1p(np.stack([np.frombuffer(v, "<f4") for v in f.v]).astype(np.float64))
        return pd.DataFrame({"lang": [f.lang.iloc[0]], "n": [len(f)], "df": [(raw > 0).sum(axis=0).astype("<f8").tobytes()],
                             "raw": [raw.astype("<f4").tobytes()]})

    packed = vec.groupBy("lang").applyInPandas(cluster, "lang string, n long, df binary, raw binary")
    packed = materialise(packed, "langid")  # one row of bounded size per language
    df, n = np.zeros(dims), 0
    for r in packed.select("n", "df").toLocalIterator():
        df, n = df + np.frombuffer(r.df, "<f8"), n + r.n
    idf = np.log((1 + n) / (1 + df)) + 1

    def centres(frames):
        for f in frames:
            for r in f.itertuples():
                x = _unit(np.frombuffer(r.raw, "<f4").reshape(r.n, dims).astype(np.float64) * idf)
                c = _kmeans(x, clusters, ROUNDS)
                yield pd.DataFrame({"lang": [r.lang], "k": [len(c)], "c": [c.astype("<f4").tobytes()],
                                    "floor": [float((x @ c.T).max(axis=1).min())]})

    made = sorted(packed.mapInPandas(centres, "lang string, k int, c binary, floor double").collect(),
                  key=lambda r: r.lang)
    return {"langs": [r.lang for r in made], "idf": idf, "floor": min((r.floor for r in made), default=2.0) - MARGIN,
            "of": np.repeat(np.arange(len(made)), [r.k for r in made]) if made else np.zeros(0, int),
            "centres": np.concatenate([np.frombuffer(r.c, "<f4").reshape(r.k, dims) for r in made]).astype(np.float64)
            if made else np.zeros((0, dims))}


def _label(texts: list, m: dict):
    """Per text: language, score, rejected."""
    first = np.flatnonzero(np.r_[True, m["of"][1:] != m["of"][:-1]]) if len(m["of"]) else None
    for at in range(0, len(texts), 256):
        got = [counts(t or "", len(m["idf"])) for t in texts[at:at + 256]]
        if first is None:
            yield from (("und", 0.0, True) for _ in got)
            continue
        cos = _unit(np.log1p(np.stack([c for c, _ in got])) * m["idf"]) @ m["centres"].T
        best = np.maximum.reduceat(cos, first, axis=1)
        top, high = best.argmax(axis=1), best.max(axis=1)
        share = 1 / np.exp(SHARPNESS * (best - high[:, None])).sum(axis=1)
        for i, (_, n) in enumerate(got):
            yield ((m["langs"][top[i]], float(share[i]), bool(high[i] < m["floor"] * min(1.0, n / SHORT))) if n
                   else ("und", 0.0, True))


def predict(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """``keep`` columns, lang_pred, score (share of the nearest language among
    all, by exp(SHARPNESS * cosine)) and rejected."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most CLUSTERS vectors per language
    src = docs.select(*keep, F.col("text").alias("_t"))
    schema = (", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.drop("_t").schema)
              + ", lang_pred string, score double, rejected boolean")

    def run(batches):
        for b in batches:
            got = [g for part in slices(b, SLICE, "_t") for g in _label(part.column("_t").to_pylist(), shared.value)]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + cols,
                                             [*keep, "lang_pred", "score", "rejected"])

    return src.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    return predict(docs, fit(docs), ["doc_id"]).withColumn("held_out", crc_mod("doc_id", 4) == 2)


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches):
        for b in batches:
            for part in slices(b, SLICE):
                out = [g[2] for g in _label(part.column("text").to_pylist(), shared.value)]
                yield part.filter(pa.array([not x for x in out], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
