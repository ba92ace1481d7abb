"""Language-model scoring by the marginal likelihood of a subword lattice.

The vocabulary is that of an existing tokenizer file (its path is a parameter; the
file is read on the driver and never copied).  Its scores order the pieces; the
first weights are 1 / (rank + 2.7) in that order.  ``ROUNDS`` rounds of expectation
maximisation over all training word types, weighted by their corpus counts, turn them into
unigram probabilities (smoothed, together with one end symbol).  A text's probability
sums over all segmentations of all its words: forward recursion in log space,
vectorised over words of the same length.  Single bytes are pieces, so every text has
a segmentation.

The base model is the add-0.1 unigram model over words and the end symbol.  Counts of
at most ``TOP`` of the most frequent words go to every task (a fixed bound); all other words of a
document meet the count table in an equi-join, so the result is exact at any
vocabulary size and no hot key enters the join.

Defined cases: null and empty texts consist of the end symbol; no training
documents: every count is 0; repeated rows are separate; a null doc_id counts as
the empty text in the crc32; an empty table gives an empty result; columns other
than doc_id and text are ignored."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtstats.llm.common import BASE_A, byte_symbols, crc_mod, materialise, mixed, powers

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
TOP, ROUNDS, SMOOTH, FLUSH, LONG = 300_000, 2, 0.1, 200_000, 200
LN10 = float(np.log(10))


def pieces_of(path: str = VOCABULARY) -> tuple[list[bytes], np.ndarray]:
    """Pieces as byte strings (a leading blank marks a word's first piece) and
    their first log weights."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    scored: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i):
            continue
        b = sp.id_to_piece(i).replace("▁", " ").encode()
        if b and b" " not in b[1:] and b.lower() == b:
            scored[b] = max(scored.get(b, -1e30), sp.get_score(i))
    order = sorted(scored, key=lambda b: (-scored[b], b))
    order += [bytes([c]) for c in range(256) if bytes([c]) not in scored]
    w = 1 / (np.arange(len(order)) + 2.7)
    return order, np.log(w / w.sum())


class Lattice:
    """All segmentations of words into weighted pieces."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.most = max(map(len, pieces))
        key = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(key)
        self.keys, self.place = key[order], order
        self.logp = np.asarray(logp, np.float64)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _hash(p: bytes) -> np.uint64:
        s = byte_symbols(np.frombuffer(p, np.uint8))
        return mixed(np.array([(s * powers(BASE_A, len(s))[1][:len(s)]).sum(dtype=np.uint64)]) + np.uint64(len(p)))[0]

    def arcs(self, text: np.ndarray):
        """Arcs of equally long words (rows of bytes): (i, j, rows, pieces)."""
        m, n = text.shape
        up, down = powers(BASE_A, n + 1)
        sums = np.zeros((n + 1, m), np.uint64)
        np.cumsum(byte_symbols(text).T * down[:n, None], axis=0, out=sums[1:])
        for j in range(1, n + 1):
            for i in range(max(0, j - self.most), j):
                h = mixed((sums[j] - sums[i]) * up[i] + np.uint64(j - i))
                row = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
                if not len(row):
                    continue
                at = np.minimum(np.searchsorted(self.keys, h[row]), len(self.keys) - 1)
                ok = self.keys[at] == h[row]
                if ok.any():
                    yield i, j, row[ok], self.place[at[ok]]

    def forward(self, text: np.ndarray, arcs=None) -> np.ndarray:
        """Log of the sum over segmentations, for every prefix: (n + 1, words)."""
        a = np.full((text.shape[1] + 1, text.shape[0]), -np.inf)
        a[0] = 0
        for i, j, row, piece in self.arcs(text) if arcs is None else arcs:
            a[j, row] = np.logaddexp(a[j, row], a[i, row] + self.logp[piece])
        return a

    def expected(self, text: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
        """Add the pieces' expected counts over the words, times ``weight``."""
        arcs = list(self.arcs(text))
        a = self.forward(text, arcs)
        b = np.full_like(a, -np.inf)
        b[-1] = 0
        for i, j, row, piece in reversed(arcs):
            through = b[j, row] + self.logp[piece]
            share = np.exp(a[i, row] + through - a[-1, row]) * weight[row]
            total += np.bincount(piece, weights=share, minlength=len(total))
            b[i, row] = np.logaddexp(b[i, row], through)

    def long_word(self, word: bytes, weight: float = 0.0, total: np.ndarray | None = None) -> float:
        """As ``forward``, for one long word: arcs vectorised over the places, then
        one pass over them; with ``total`` also the expected counts."""
        s = byte_symbols(np.frombuffer(b" " + word, np.uint8))
        n = len(s)
        up, down = powers(BASE_A, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(s * down[:n], out=sums[1:])
        into: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for k in range(1, min(self.most, n) + 1):
            h = mixed((sums[k:] - sums[:n + 1 - k]) * up[:n + 1 - k] + np.uint64(k))
            row = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, h[row]), len(self.keys) - 1)
            ok = self.keys[at] == h[row]
            for i, p in zip(row[ok].tolist(), self.place[at[ok]].tolist()):
                into[i + k].append((i, p))
        a = np.full(n + 1, -np.inf)
        a[0] = 0
        for j in range(1, n + 1):
            a[j] = np.logaddexp.reduce([a[i] + self.logp[p] for i, p in into[j]])
        if total is not None:
            b = np.full(n + 1, -np.inf)
            b[n] = 0
            for j in range(n, 0, -1):
                for i, p in into[j]:
                    through = b[j] + self.logp[p]
                    total[p] += weight * np.exp(a[i] + through - a[n])
                    b[i] = np.logaddexp(b[i], through)
        return float(a[n])

    def words(self, words: list[bytes], chunk: int = 8192) -> np.ndarray:
        """Log marginal probability of each word."""
        out = np.empty(len(words))
        for idx, text in same_length(words, chunk):
            out[idx] = self.forward(text)[-1]
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self.long_word(w)
        return out


def same_length(words: list[bytes], chunk: int):
    """Blocks of equally long words up to LONG bytes: (places, bytes with the leading blank)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    order = order[:np.searchsorted(size[order], LONG, side="right")]
    if not len(order):
        return
    cut = np.flatnonzero(np.r_[True, np.diff(size[order]) > 0, True])
    for a, b in zip(cut[:-1], cut[1:]):
        n = int(size[order[a]]) + 1
        step = max(1, min(chunk, (1 << 19) // n))
        for c in range(a, b, step):
            idx = order[c:min(b, c + step)]
            text = np.frombuffer(b"".join(b" " + words[k] for k in idx), np.uint8)
            yield idx, text.reshape(len(idx), n)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over whole texts; every task adds up what it can hold first."""
    import pyarrow as pa

    def run(batches):
        def out(seen):
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                              ["word", "c"])
        seen: Counter = Counter()
        for b in batches:
            for t in b.column("_t"):
                seen.update(t.as_py().lower().split())
                if len(seen) > FLUSH:
                    yield out(seen)
                    seen = Counter()
        yield out(seen)

    src = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("_t"))
    return src.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(types: DataFrame, top: int) -> DataFrame:
    """The words above a count that at most ``top`` words reach: the count is read
    off a histogram in steps of 2 ** (1 / 16), so no task sends more than it keeps."""
    step = F.floor(F.log2("c") * 16).cast("int")
    least, total = None, 0
    for r in sorted(types.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.s):
        total += r.n
        if total > top:
            break
        least = r.s
    return types.where(F.lit(False) if least is None else step >= least)


def fit(docs: DataFrame, vocabulary: str = VOCABULARY, top: int = TOP, rounds: int = ROUNDS) -> dict:
    """Count table and lattice weights from the training documents."""
    import pyarrow as pa

    spark = docs.sparkSession
    train = docs.where(crc_mod("doc_id", 10) != 0)
    ends = train.count()
    types = materialise(word_counts(train), "lm-words")
    n, v = types.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    pieces, logp = pieces_of(vocabulary)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, logp))  # the vocabulary

        def run(batches):
            lattice = Lattice(*shared.value)
            total = np.zeros(len(lattice.logp))
            for b in batches:
                words, c = b.column("word").to_pylist(), b.column("c").to_numpy().astype(float)
                for idx, text in same_length(words, 8192):
                    lattice.expected(text, c[idx], total)
                for k, w in enumerate(words):
                    if len(w) > LONG:
                        lattice.long_word(w, c[k], total)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["piece", "e"])

        got = types.mapInArrow(run, "piece int, e double").groupBy("piece").agg(F.sum("e").alias("e")).collect()
        e = np.full(len(pieces), SMOOTH)
        for r in got:
            e[r.piece] += r.e
        whole = e.sum() + ends + SMOOTH
        logp = np.log(e / whole)
    end = np.log((ends + SMOOTH) / whole) if rounds else 0.0
    head = frequent(types, top).collect()  # at most ``top`` rows
    return {"types": types, "n": int(n) + ends, "v": int(v) + (ends > 0), "ends": ends, "pieces": pieces, "logp": logp,
            "end": float(end), "top": {bytes(r.word): r.c for r in head}}


def score(docs: DataFrame, vocabulary: str = VOCABULARY, top: int = TOP, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score."""
    import pyarrow as pa

    m = fit(docs, vocabulary, top, rounds)
    shared = docs.sparkSession.sparkContext.broadcast({k: m[k] for k in ("pieces", "logp", "end", "top", "ends")})
    src = docs.select("doc_id", (crc_mod("doc_id", 10) == 0).alias("held_out"),
                      F.coalesce("text", F.lit("")).cast("binary").alias("_t"))
    kind = src.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "known", "base", "score", "rest", "times"]

    def run(batches):
        x = shared.value
        lattice, head = Lattice(x["pieces"], x["logp"]), x["top"]
        for b in batches:
            texts = b.column("_t")
            at = 0
            while at < len(texts):
                ids: dict[bytes, int] = {}
                each, size, start = [], 0, at
                while at < len(texts) and size < 1 << 22:
                    t = texts[at].as_py().lower()
                    size += len(t) + 1
                    each.append(np.array([ids.setdefault(w, len(ids)) for w in t.split()], np.int64))
                    at += 1
                words = list(ids)
                logp = lattice.words(words) / LN10
                c = np.array([head.get(w, -1) for w in words], np.float64)
                base = np.log10(np.maximum(c, 0) + 0.1)
                tokens, known, low, full, rest, times = [], [], [], [], [], []
                for own in each:
                    have = c[own] >= 0
                    tokens.append(len(own) + 1)
                    known.append(int(have.sum()) + (x["ends"] > 0))
                    low.append(float(base[own[have]].sum() + np.log10(x["ends"] + 0.1)))
                    full.append(float(logp[own].sum() + x["end"] / LN10))
                    k, n = np.unique(own[~have], return_counts=True)
                    rest.append([words[i] for i in k])
                    times.append(n.tolist())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(start, at - start), b.column("held_out").slice(start, at - start),
                     pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(low, pa.float64()),
                     pa.array(full, pa.float64()), pa.array(rest, pa.list_(pa.binary())),
                     pa.array(times, pa.list_(pa.int64()))], names)

    rows = src.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, "
                               "rest array<binary>, times array<long>")
    rows = materialise(rows.withColumn("uid", F.monotonically_increasing_id()), "lm-docs")
    rest = (rows.select("uid", F.inline(F.arrays_zip(F.col("rest").alias("word"), F.col("times").alias("k"))))
            .join(m["types"], "word", "left").groupBy("uid")
            .agg(F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("more"),
                 F.sum(F.when(F.col("c") > 0, F.col("k"))).alias("also")))
    norm = float(np.log10(m["n"] + 0.1 * (m["v"] + 1)))
    return rows.drop("rest", "times").join(rest, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"),
        F.lit(m["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"), "score")
