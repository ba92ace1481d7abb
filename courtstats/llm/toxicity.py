"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are the words, lower-cased, without leading and trailing characters other
than letters and digits.  A token's score is its log-odds between toxic and
other training texts under a Dirichlet prior in proportion to the corpus
(``PRIOR`` pseudo-tokens), shrunk towards zero by ``SHRINK`` posterior standard
deviations (``FEW_SHRINK`` where that leaves no token above zero), minus ``DRIFT``; so ordinary text drifts down and the classic
statistics of maximal segments hold.  A linear scan (Ruzzo and Tompa) finds all
maximal-scoring passages of a text.  Under ordinary text a passage of score s in m
tokens has E-value K m exp(-lambda s): lambda solves sum p exp(lambda s) = 1 over the
clean tokens, K is the maximum-likelihood estimate from the clean texts' best
passages.  Passages with E <= ``SIGNIFICANT`` count; a text's evidence is the sum
of their -ln(1 - exp(-E)), and a logistic fit on the training labels turns log(1 + evidence)
into the score.

Fitting reads a bounded, documented sample: at most ``SAMPLE`` labelled training
documents, those with the smallest id hash; so the token table is bounded too.
Scoring reads every text whole.

Defined cases: null and empty texts have no passage and get the score of no
evidence; without labelled training rows, or with one label only, every score is
the share of toxic labels (0 without labels); several labels of one id count as
their maximum; repeated rows are scored separately; a null doc_id counts as
the empty text in the crc32 and matches no label; columns other than doc_id and
text are ignored."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtstats.llm.common import crc_mod, materialise

SAMPLE, PRIOR, SHRINK, DRIFT, SIGNIFICANT, CUT = 20_000, 0.05, 2.5, 0.5, 0.05, 0.7
LEAST_COUNT = 3
#: shrinkage where too few labels let no token speak for label 1 under ``SHRINK``
FEW_SHRINK = 1.0
EDGE = bytes(c for c in range(128) if not chr(c).isalnum())


def tokens(text: bytes) -> list[bytes]:
    return [t for t in (w.strip(EDGE) for w in text.lower().split()) if t]


def segments(scores: np.ndarray, floor: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, start, end) of a text whose tokens
    score ``floor`` except at ``scores``' positions.  ``scores``: rows (position,
    score) of the tokens scoring otherwise, by position.  Linear time."""
    stack: list[list[float]] = []  # left sum, right sum, start, end
    total, at = 0.0, 0
    for pos, s in scores:
        pos = int(pos)
        total += floor * (pos - at)
        at = pos + 1
        left, total = total, total + s
        if s <= 0:
            continue
        new = [left, total, pos, pos + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= new[0]:
                j -= 1
            if j < 0 or stack[j][1] >= new[1]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(r - l, int(a), int(b)) for l, r, a, b in stack]


def passages(text: bytes, model: dict) -> tuple[list[tuple[float, int, int]], int]:
    """Maximal segments and number of tokens of one text."""
    words = tokens(text)
    get = model["token"].get
    hits = [(i, s) for i, s in enumerate(map(get, words)) if s is not None]
    return segments(hits, model["floor"]), len(words)


def evidence(segs: list, n: int, model: dict) -> float:
    """Sum of -ln p over the significant passages."""
    total = 0.0
    for s, _, _ in segs:
        e = model["k"] * max(n, 1) * math.exp(-min(model["lambda"] * s, 700.0))
        if e <= SIGNIFICANT:
            total += -math.log(max(-math.expm1(-e), 1e-300))
    return total


def _lambda(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1 (the mean of s is negative)."""
    if not (s > 0).any():
        return 1.0
    low, high = 0.0, 1.0
    while float((p * np.exp(np.minimum(high * s, 700))).sum()) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        if float((p * np.exp(np.minimum(mid * s, 700))).sum()) < 1:
            low = mid
        else:
            high = mid
    return max(high, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method for P(y) = 1 / (1 + exp(-(a + b x))), b >= 0, with a light ridge.
    A step that does not lower the loss is halved: on (nearly) separable labels full
    steps overshoot and never come back."""
    def loss(a, b):
        z = a + b * x
        return float((np.logaddexp(0, z) - y * z).sum() + 5e-4 * (a * a + b * b))

    base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    a, b, now = base, 0.0, loss(base, 0.0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -700, 700)))
        w = p * (1 - p) + 1e-9
        g = np.array([(y - p).sum() - 1e-3 * a, ((y - p) * x).sum() - 1e-3 * b])
        h = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        while np.abs(step).max() > 1e-9 and not (new := loss(a + step[0], b + step[1])) < now:
            step = step / 2
        if np.abs(step).max() <= 1e-9:
            break
        a, b, now = a + step[0], b + step[1], new
    return (float(a), float(b)) if b > 0 else (base, 0.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    import pandas as pd

    lab = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    # a sample of texts, not of ids: an id that repeats brings no more rows than any other
    text = F.coalesce("text", F.lit(""))
    train = docs.where(crc_mod("doc_id", 3) != 1).select("doc_id", text.alias("text"), F.xxhash64(text).alias("_t"))
    pick = lab.join(train.select("doc_id", "_t").distinct(), "doc_id").orderBy(F.xxhash64("doc_id", "_t"), "doc_id", "_t").limit(sample)
    pick = pick.withColumnsRenamed({"doc_id": "_d", "_t": "_p"})
    # at most ``sample`` rows: small enough to send to the texts
    rows = train.join(F.broadcast(pick), (F.col("doc_id") == F.col("_d")) & (F.col("_t") == F.col("_p")))
    rows = materialise(rows.dropDuplicates(["doc_id", "_t"]).select("y", F.col("text").cast("binary").alias("text")), "toxic-train")

    def split(frames):
        for f in frames:
            got = [Counter(tokens(bytes(t))) for t in f.text]
            yield pd.DataFrame({"y": f.y, "t": [list(g) for g in got], "n": [list(g.values()) for g in got]})

    said = (rows.mapInPandas(split, "y int, t array<binary>, n array<long>")
            .select("y", F.inline(F.arrays_zip("t", "n"))))
    table = materialise(said.groupBy("t").agg(
        F.sum(F.col("y").cast("long")).alias("d1"), F.count("*").alias("d"),
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c0")), "toxic-tokens")
    base = rows.agg(F.avg("y"), F.count("*")).first()
    n1, n, clean = table.agg(F.sum("d1"), F.sum("d"), F.sum("c0")).first()
    model = {"token": {}, "floor": -DRIFT, "lambda": 1.0, "k": 1.0, "a": None, "b": 0.0, "rate": float(base[0] or 0)}
    if not n1 or n1 == n:
        return model
    n0, prior = n - n1, PRIOR * n
    # log-odds with an informative prior: alpha of a token = PRIOR * its texts
    got = table.where(f"d >= {LEAST_COUNT}").toPandas()  # bounded by the sample
    d1, d = got.d1.to_numpy(float), got.d.to_numpy(float)
    d0, alpha = d - d1, PRIOR * d
    odds = np.log((d1 + alpha) / (n1 + prior - d1 - alpha)) - np.log((d0 + alpha) / (n0 + prior - d0 - alpha))
    sd = np.sqrt(1 / (d1 + alpha) + 1 / (d0 + alpha))
    for shrink in (SHRINK, FEW_SHRINK):
        s = np.sign(odds) * np.maximum(np.abs(odds) - shrink * sd, 0) - DRIFT
        if (s > 0).any():
            break
    own = np.abs(s + DRIFT) > 0
    model["token"] = {bytes(t): float(v) for t, v in zip(got.t[own], s[own])}
    c0 = got.c0.to_numpy(float)
    clean = max(float(clean), 1.0)
    p = np.append(c0, max(clean - c0.sum(), 0)) / clean
    model["lambda"] = _lambda(p, np.append(s, -DRIFT))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def best(frames):
        for f in frames:
            got = [passages(bytes(t), shared.value) for t in f.text]
            yield pd.DataFrame({"y": f.y, "n": [m for _, m in got], "segs": [[x[0] for x in g] for g, _ in got]})

    seen = rows.mapInPandas(best, "y int, n long, segs array<double>").toPandas()  # bounded by the sample
    fair = seen[(seen.y == 0) & (seen.n > 0)]
    model["k"] = len(fair) / max(sum(n * math.exp(-model["lambda"] * max(g, default=0.0))
                                      for n, g in zip(fair.n, fair.segs)), 1e-9)
    x = np.array([math.log1p(evidence([(v, 0, 0) for v in g], n, model)) for n, g in zip(seen.n, seen.segs)])
    model["a"], model["b"] = _logistic(x, seen.y.to_numpy(float))
    return model


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, predicted, n_passages, best (start and end token of the
    strongest significant passage)."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("_t"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = shared.value
        for b in batches:
            score, count, start, end = [], [], [], []
            for t in b.column("_t"):
                segs, n = passages(t.as_py(), m)
                ev = evidence(segs, n, m)
                score.append(m["rate"] if m["a"] is None
                             else 1 / (1 + math.exp(-max(-30.0, min(30.0, m["a"] + m["b"] * math.log1p(ev))))))
                sig = [g for g in segs if evidence([g], n, m) > 0]
                top = max(sig, default=None)
                count.append(len(sig))
                start.append(top and top[1])
                end.append(top and top[2])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(score, pa.float64()), pa.array([int(s >= CUT) for s in score], pa.int32()),
                 pa.array(count, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                ["doc_id", "score", "predicted", "n_passages", "first_token", "end_token"])

    return src.mapInArrow(run, f"doc_id {kind}, score double, predicted int, n_passages int, first_token int, end_token int")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return predict(docs, fit(docs, labels)).withColumn("held_out", crc_mod("doc_id", 3) == 1)
