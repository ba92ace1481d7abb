"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are compared lower-cased and without leading and trailing characters other than
letters and digits.  The test items are taken in blocks of ``BLOCK_ITEMS`` by item hash,
so what a task holds is bounded; every block meets all documents.  Every ``GRAM``-word
gram of an item is a seed, however frequent it is: which grams an edited copy keeps does
not depend on their frequency.  One pass finds the seeds in every document, cuts the
document about them into windows, skips windows whose words cannot reach the threshold,
and aligns the others (match 2, mismatch -1, gap -1).  A window whose score is at least
``THRESHOLD`` of the item's best possible score, or that of ``PASSAGE`` matching words, is
contaminated; a document and an item form one row, with their best window.  A copy that keeps no ``GRAM`` consecutive words
has no seed and is not found.

Defined cases: null and empty texts are never contaminated; items without a word are
skipped; items shorter than ``GRAM`` words are their own single gram; repeated
items and repeated rows give a row each (a row of the result for each row of the
documents); an empty table on either side gives an empty result; columns other than
doc_id, item_id and text are ignored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtstats.llm.common import BASE_A, BASE_B, RangeHash, binary_column, byte_symbols, slices, word_bounds

GRAM, THRESHOLD, PASSAGE, BLOCK_ITEMS = 3, 0.5, 13, 5_000
MATCH, MISMATCH, GAP = 2, -1, -1
SLICE, HITS = 1 << 19, 1 << 19

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_PLAIN = np.array([chr(c).isalnum() if c < 128 else True for c in range(256)])


def words(buf: np.ndarray, off: np.ndarray):
    """Hashes of the folded words of concatenated texts and the text of each word;
    words without a letter or digit are left out.  Works on blocks of words, so
    that a very long text takes little more than itself."""
    start, end = word_bounds(buf, off)
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE)))
        base = int(start[i])
        part = buf[base:end[j - 1]]
        at = np.arange(len(part), dtype=np.int32)
        plain = _PLAIN[part]
        after = np.minimum.accumulate(np.where(plain, at, np.int32(len(part)))[::-1])[::-1]  # next plain byte
        before = np.maximum.accumulate(np.where(plain, at, np.int32(-1)))
        s = after[start[i:j] - base].astype(np.int64)
        e = before[end[i:j] - base - 1].astype(np.int64) + 1
        keep = s < e
        s, e = s[keep], e[keep]
        hashes.append(RangeHash(byte_symbols(_FOLD[part]), BASE_A).of(s, e))
        places.append(s + base)
        i = j
    return np.concatenate(hashes), np.searchsorted(off, np.concatenate(places), side="right") - 1


def grams(h: np.ndarray, doc: np.ndarray, n: int = GRAM):
    """Hashes of n consecutive words of one text, and their first words' places."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:len(h) - n + 1] == doc[n - 1:])
    return RangeHash(h, BASE_B).of(at, at + n), at


def align(item: np.ndarray, text: np.ndarray) -> int:
    """Best local alignment score (Smith-Waterman, linear gaps), row by row: gaps
    along a row are a running maximum."""
    step = np.arange(len(text) + 1) * -GAP
    prev, best = np.zeros(len(text) + 1, np.int64), 0
    for w in item:
        row = np.zeros(len(text) + 1, np.int64)
        row[1:] = np.maximum(prev[:-1] + np.where(text == w, MATCH, MISMATCH), prev[1:] + GAP)
        np.maximum(row, 0, out=row)
        prev = np.maximum.accumulate(row + step) - step
        best = max(best, int(prev.max()))
    return best


def least(size):
    """The score from which an item of so many words counts as found."""
    return np.ceil(np.minimum(THRESHOLD * MATCH * size, MATCH * PASSAGE)).astype(np.int64)


class Lookup:
    """Set of 64-bit hashes: a bit filter in front of a sorted array."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray):
        """Places in ``h`` of members, and their ranks in ``keys``."""
        at = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        rank = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[rank] == h[at]
        return at[ok], rank[ok]


def _items(rows) -> list[tuple]:
    """(item_id, word hashes, gram hashes) of the items that have words."""
    out = []
    for r in rows:
        t = np.frombuffer((r.text or "").encode(), np.uint8)
        h, d = words(t, np.array([0, len(t)]))
        if len(h):
            n = min(GRAM, len(h))
            out.append((r.item_id, h, grams(h, d, n)[0], n))
    return out


def _index(items: list[tuple]):
    """By gram size: the items' grams, and the items that hold each."""
    index = {}
    for n in sorted({i[3] for i in items}):
        own = [k for k, i in enumerate(items) if i[3] == n]
        seeds = [np.unique(items[k][2]) for k in own]
        look = Lookup(np.concatenate(seeds))
        rank = np.concatenate([np.searchsorted(look.keys, s) for s in seeds])
        item = np.repeat(own, [len(s) for s in seeds])
        order = np.lexsort((item, rank))
        index[n] = look, np.searchsorted(rank[order], np.arange(len(look.keys) + 1)), item[order]
    return index


def _windows(h: np.ndarray, d: np.ndarray, edges: np.ndarray, n: int, entry, size: np.ndarray):
    """(items, texts, starts, ends) of the windows about seeds that are near each other,
    from about HITS seeds at a time.  An alignment that reaches the threshold has at most
    ``reach`` words (all matches, and gaps down to the threshold), so it lies in the window
    of any seed it holds."""
    look, start, owner = entry
    g, first = grams(h, d, n)
    at, rank = look.find(g)
    place = first[at]
    doc, count = d[place], start[rank + 1] - start[rank]
    total = np.cumsum(count)
    i = 0
    while i < len(place):
        j = max(i + 1, int(np.searchsorted(total, total[i] - count[i] + HITS, side="right")))
        if j < len(place):  # whole texts, where one does not exceed it
            whole = int(np.searchsorted(doc, doc[j]))
            j = whole if whole > i else j
        c = count[i:j]
        k = owner[np.arange(c.sum()) + np.repeat(start[rank[i:j]] - (np.cumsum(c) - c), c)]
        p, t = np.repeat(place[i:j], c), np.repeat(doc[i:j], c)
        order = np.lexsort((p, k, t))
        k, p, t = k[order], p[order], t[order]
        reach = (1 + MATCH) * size[k] - least(size[k])
        new = np.flatnonzero(np.concatenate([[True], (np.diff(k) != 0) | (np.diff(t) != 0) | (np.diff(p) > reach[1:])]))
        last = np.append(new[1:], len(k)) - 1
        yield (k[new], t[new], np.maximum(edges[t[new]], p[new] - reach[new]),
               np.minimum(edges[t[new] + 1], p[last] + reach[new]))
        i = j


def _pieces(k, t, a, z, size):
    """The windows; a long one as overlapping pieces."""
    step = 2 * ((1 + MATCH) * size[k] - least(size[k]))
    many = -(-(z - a) // step)
    k, t, a, z, step = (np.repeat(x, many) for x in (k, t, a, z, step))
    c = a + step * (np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many))
    return k, t, np.maximum(a, c - step // 2), np.minimum(z, c + step)


def _bounds(word: np.ndarray, pairs: np.ndarray, things: int, k: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """An upper bound of each piece's alignment score: the best stretch where words of
    the item count as matches and all others as mismatches or gaps."""
    out = np.zeros(len(k), np.int64)
    total = np.cumsum(e - s)
    i = 0
    while i < len(k):
        j = max(i + 1, int(np.searchsorted(total, total[i] - (e[i] - s[i]) + HITS, side="right")))
        long = e[i:j] - s[i:j]
        off = np.cumsum(long) - long
        piece = np.repeat(np.arange(j - i), long)
        w = word[np.arange(len(piece)) + np.repeat(s[i:j] - off, long)]
        known = np.flatnonzero(w >= 0)
        pair = w[known] * things + k[i:j][piece[known]]
        gain = np.full(len(piece), max(MISMATCH, GAP), np.int64)
        gain[known[pairs[np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)] == pair]] = MATCH
        up = np.cumsum(gain) - (MATCH + 1) * (len(piece) + 1) * piece  # every piece below those before it
        out[i:j] = np.maximum.reduceat(up - np.minimum.accumulate(up - gain), off)
        i = j
    return out


def _result(docs: DataFrame, keep: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", item_id long, align_score long, share double, first_word long"


def _find(docs: DataFrame, items: list[tuple], keep: list[str]) -> DataFrame:
    import pyarrow as pa

    vocab = Lookup(np.concatenate([i[1] for i in items]))
    pairs = np.unique(np.concatenate([np.searchsorted(vocab.keys, i[1]) * len(items) + k for k, i in enumerate(items)]))
    shared = docs.sparkSession.sparkContext.broadcast(
        ([(i[0], i[1]) for i in items], _index(items), vocab, pairs))

    def run(batches):
        things, index, vocab, pairs = shared.value
        size = np.array([len(w) for _, w in things])
        for b in batches:
            out, base = [], 0
            for part in slices(b, SLICE):
                h, d = words(*binary_column(part.column("text")))
                edges = np.searchsorted(d, np.arange(part.num_rows + 1))
                word = np.full(len(h), -1, np.int64)
                at, rank = vocab.find(h)
                word[at] = rank
                best: dict[tuple[int, int], tuple[int, int]] = {}
                for n, entry in index.items():
                    for window in _windows(h, d, edges, n, entry, size):
                        k, t, s, e = _pieces(*window, size)
                        top = np.minimum(_bounds(word, pairs, len(things), k, s, e), MATCH * size[k])
                        for x in np.flatnonzero(top >= least(size[k])).tolist():
                            pair = int(t[x]), int(k[x])
                            if pair in best and top[x] <= best[pair][0]:
                                continue
                            score = align(things[pair[1]][1], h[s[x]:e[x]])
                            if pair not in best or score > best[pair][0]:
                                best[pair] = score, int(s[x] - edges[pair[0]])
                for (doc, k), (score, place) in sorted(best.items()):
                    m = len(things[k][1])
                    if score >= least(m):
                        out.append((base + doc, things[k][0], score, score / (MATCH * m), place))
                base += part.num_rows
            cols = list(zip(*out)) or [()] * 5
            row = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(row) for c in keep), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.int64())],
                [*keep, "item_id", "align_score", "share", "first_word"])

    return docs.select(*keep, "text").mapInArrow(run, _result(docs, keep))


def contaminated(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS,
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of the document, item_id, align_score, share (of the item's best possible score) and
    first_word (the aligned window's first word in the document) of every
    contaminated pair."""
    keep = list(keep)
    d = docs.select(*keep, F.col("text"))
    b = benchmark.select("item_id", "text")
    blocks = max(1, -(-b.count() // block_items))
    out = None
    for i in range(blocks):
        rows = b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect()  # about block_items rows
        items = _items(rows)
        if items:
            found = _find(d, items, keep)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], _result(d, keep))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns.  A row is told
    by its id and a hash of all its columns: rows that share the id of a contaminated
    row, or have none like it, stay unless they are equal to it."""
    cols = list(docs.columns)
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in cols])
    d = docs.select(F.struct(*cols).alias("__row"), "doc_id", "text", F.xxhash64(*cols, nulls).alias("__h"))
    bad = contaminated(d, benchmark, keep=("doc_id", "__h")).select(F.col("doc_id").alias("__id"), F.col("__h").alias("__k")).distinct()
    same = d["__h"].eqNullSafe(bad["__k"]) & d["doc_id"].eqNullSafe(bad["__id"])
    return d.join(bad, same, "left_anti").select("__row.*")
