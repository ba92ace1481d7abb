"""Which windows of ``width`` consecutive symbols (bytes or words) also start earlier?

Shared frame of the two exact-substring operators; they differ in how a bucket of texts
that share content is searched (``search``).

1. Anchors.  Every window has one anchor: its ``gram`` symbols with the smallest hash
   (leftmost of equals), so equal windows have equal anchors at equal places.
   Consecutive windows with the same anchor are one run; a run is a row of two
   64-bit hashes (anchor, whole content) and a position.  Copies inside a batch
   collapse before the shuffle.
2. Rows meet by anchor.  A run whose content also starts earlier is repeated as a
   whole.  Where an anchor has one content only, nothing else can match.  All other
   contents -- first occurrences that share an anchor but differ -- need their text.
3. Their texts go to buckets by anchor (about ``BUCKET`` bytes each, as many as the data
   needs) and ``search`` finds equal windows from the texts themselves.  An anchor with
   more than ``HOT`` contents (the edge of a passage that a large part of all documents
   share) is split finer: its windows are keyed by their whole content instead, where
   equal windows meet as in step 2.

Positions are ordered by (doc_id, start); rows that share a doc_id and a text are one
document, other rows that share a doc_id are ordered by text hash; a null doc_id comes
first.  The text is shuffled once: all joins are on the same document key."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtstats.llm.common import (
    BASE_A, BASE_B, RangeHash, binary_column, byte_symbols, materialise, mixed, slices, word_bounds,
)

HOT, BUCKET, SEGMENT, SLICE = 10_000, 2 << 20, 1 << 19, 1 << 20
NO_ID = -(1 << 63)
#: a run: anchor hash; content hash with its number of windows and a mark for known
#: repeats in the low bits; document id; text hash; first window (texts of up to two
#: billion symbols)
RUN = "h long, c long, dk long, th long, first int"
SPAN = "dk long, th long, first long, n int"


@dataclass(frozen=True)
class Spec:
    """``search(texts, width)``: texts are symbol arrays; returns (text, offset, class,
    length) of the places where content of ``width`` symbols and more repeats in the bucket: places
    of one class hold the same ``length`` symbols.  ``prefilter``: only the stretches of texts whose
    windows occur twice by hash are searched."""

    width: int
    gram: int
    words: bool
    search: Callable
    prefilter: bool = True

    def symbols(self, buf: np.ndarray, off: np.ndarray):
        """Symbol hashes (a function of a range) and the texts' offsets in symbols."""
        if not self.words:
            return (lambda a, b: byte_symbols(buf[a:b])), off
        start, end = word_bounds(buf, off)

        def part(a, b):
            if a >= b:
                return np.zeros(0, np.uint64)
            s, e = start[a:b], end[a:b]
            return RangeHash(byte_symbols(buf[s[0]:e[-1]]), BASE_A).of(s - s[0], e - s[0])

        return part, np.searchsorted(start, off)

    def runs(self, buf: np.ndarray, off: np.ndarray):
        """Runs of the windows of concatenated texts: anchor hash, content hash, text,
        first window, number of windows."""
        sym, off = self.symbols(buf, off)
        w, k = self.width, self.gram
        total = int(off[-1]) - w + 1
        out = []
        for a in range(0, max(total, 0), SEGMENT):
            z = min(total, a + SEGMENT)
            s = sym(a, z + w - 1)
            anchors, whole = RangeHash(s, BASE_A), RangeHash(s, BASE_B)
            at = np.arange(len(s) - k + 1)
            h = anchors.of(at, at + k)
            low = (h & ~np.uint64((1 << 24) - 1)) | at.astype(np.uint64)  # smallest hash, then leftmost
            step, wide = 1, w - k + 1
            while step * 2 <= wide:
                low = np.minimum(low[:-step], low[step:])
                step *= 2
            if wide > step:
                low = np.minimum(low[:step - wide], low[wide - step:])
            pick = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
            doc = np.searchsorted(off, np.arange(a, z), side="right") - 1
            fine = np.arange(a, z) + w <= off[doc + 1]
            new = np.ones(len(pick), bool)
            new[1:] = (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1]) | (fine[1:] != fine[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(pick))
            first, last = first[fine[first]], last[fine[first]]
            out.append((h[pick[first]], whole.of(first, last + w - 1), doc[first], a + first - off[doc[first]], last - first))
        return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5

    def cut(self, text: bytes):
        """Function (first window, windows) -> text of a run."""
        if not self.words:
            return lambda first, n: text[first:first + n + self.width - 1]
        words = text.split()
        return lambda first, n: b" ".join(words[first:first + n + self.width - 1])

    def texts(self, raw: list[bytes]) -> list[np.ndarray]:
        if not self.words:
            return [np.frombuffer(t, np.uint8) for t in raw]
        ids: dict[bytes, int] = {}
        return [np.array([ids.setdefault(w, len(ids)) for w in t.split(b" ")], np.int64) for t in raw]


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("dk"),
                       F.xxhash64(text).alias("th"))


def _runs(docs: DataFrame, spec: Spec) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ids, ths = b.column("dk").to_numpy(), b.column("th").to_numpy()
            got, base = [], 0
            for part in slices(b, SLICE):
                h, c, d, first, n = spec.runs(*binary_column(part.column("text")))
                got.append((h, c, d + base, first, n))
                base += part.num_rows
            if not got:
                continue
            h, c, d, first, n = (np.concatenate(x) for x in zip(*got))
            h, c = h.astype(np.uint64), c.astype(np.uint64)
            dup = np.zeros(len(h), bool)
            key = h ^ mixed(c)
            _, inv, many = np.unique(key, return_inverse=True, return_counts=True)
            some = np.flatnonzero(many[inv] > 1)  # copies within the batch: the earliest goes on
            order = some[np.lexsort((first[some], ths[d[some]], ids[d[some]], c[some], h[some]))]
            same = (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])
            later = order[1:][same]
            # rows that repeat a document stand at the same position: not earlier
            head = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(order)), 0))[1:][same] if len(order) else later
            head = order[head]
            later = later[(ids[d[later]] != ids[d[head]]) | (ths[d[later]] != ths[d[head]]) | (first[later] != first[head])]
            dup[later] = True
            h = np.where(dup, mixed(key + first.astype(np.uint64) + ids[d].astype(np.uint64)), h)
            yield packed(h, c, ids[d], ths[d], first, n, dup)

    return docs.select("dk", "th", "text").mapInArrow(run, RUN)


def packed(h, c, dk, th, first, n, dup):
    import pyarrow as pa

    c = (c.astype(np.uint64) & ~np.uint64(511)) | (n.astype(np.uint64) << np.uint64(1)) | dup.astype(np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(h.astype(np.uint64).view(np.int64)), pa.array(c.view(np.int64)),
                                       pa.array(dk.astype(np.int64)), pa.array(th.astype(np.int64)),
                                       pa.array(first.astype(np.int32))], ["h", "c", "dk", "th", "first"])


def _marked(runs: DataFrame) -> DataFrame:
    """Runs that are repeated (kind 0), that need their text (1) or a finer split (2).
    One exchange, by anchor, and one sort serve both windows."""
    place = F.struct("dk", "th", "first")
    same = Window.partitionBy("h", "c").orderBy("dk", "th", "first")
    anchor = Window.partitionBy("h")
    r = (runs.repartition("h").withColumn("low", F.first(place).over(same)).withColumn("nth", F.row_number().over(same))
         .withColumn("many", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(anchor)))
    repeated = (F.col("c").bitwiseAND(F.lit(1)) == 1) | (F.col("low") < place)
    kind = (F.when(repeated, 0).when((F.col("nth") > 1) | (F.col("many") < 2), F.lit(None))
            .when(F.col("many") > HOT, 2).otherwise(1))
    return r.withColumn("kind", kind).where("kind is not null").select(
        "kind", F.when(F.col("kind") > 0, F.col("h")).alias("h"), "dk", "th", F.col("first").cast("long").alias("first"),
        F.shiftright(F.col("c").bitwiseAND(F.lit(511)), 1).cast("int").alias("n"))


def _with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Each document once, with its runs.  The documents keep the columns that
    ``remove`` joins, so that one exchange of the texts serves all joins."""
    per = rows.groupBy("dk", "th").agg(F.collect_list(F.struct("h", "first", "n")).alias("runs"))
    return docs.join(per, ["dk", "th"])


def _texts(joined: DataFrame, spec: Spec) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for part in slices(b, SLICE):
                rows = []
                for dk, th, text, runs in zip(*(part.column(c).to_pylist() for c in ("dk", "th", "text", "runs"))):
                    cut = spec.cut(text.encode())
                    rows += [(r["h"], dk, th, r["first"], r["n"], cut(r["first"], r["n"])) for r in runs]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("h", "dk", "th", "first", "n", "text"), r)) for r in rows],
                    pa.schema([("h", pa.int64()), ("dk", pa.int64()), ("th", pa.int64()), ("first", pa.int64()),
                               ("n", pa.int32()), ("text", pa.binary())]))

    return joined.mapInArrow(run, "h long, dk long, th long, first long, n int, text binary")


def _single(joined: DataFrame, spec: Spec) -> DataFrame:
    """Every window of the runs of a hot anchor as a run of its own, keyed by its content."""

    def run(batches):
        w = spec.width
        for b in batches:
            for part in slices(b, SLICE):
                out = []
                for dk, th, text, runs in zip(*(part.column(c).to_pylist() for c in ("dk", "th", "text", "runs"))):
                    buf = np.frombuffer(text.encode(), np.uint8)
                    sym, off = spec.symbols(buf, np.array([0, len(buf)]))
                    for r in runs:
                        s = sym(r["first"], r["first"] + r["n"] + w - 1)
                        at = np.arange(r["n"])
                        out.append((RangeHash(s, BASE_A).of(at, at + w), RangeHash(s, BASE_B).of(at, at + w),
                                    np.full(len(at), dk), np.full(len(at), th), r["first"] + at))
                if out:
                    h, c, dk, th, first = (np.concatenate(x) for x in zip(*out))
                    yield packed(h, c, dk, th, first, np.ones(len(h), int), np.zeros(len(h), bool))

    return joined.mapInArrow(run, RUN)


def _filtered(texts: list[np.ndarray], width: int):
    """Texts cut down to the stretch of windows whose hash occurs twice in the bucket:
    (text, first kept window, symbols)."""
    size = np.array([len(t) for t in texts])
    off = np.r_[0, np.cumsum(size)]
    joint = np.concatenate(texts)
    h = RangeHash(mixed(joint.astype(np.uint64) + np.uint64(1)), BASE_B)
    n = size - width + 1
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = off[owner] + at
    _, inv, many = np.unique(h.of(start, start + width), return_inverse=True, return_counts=True)
    hit = many[inv] > 1
    owner, at = owner[hit], at[hit]
    if not len(owner):
        return []
    lead = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    ends = np.r_[lead[1:], len(owner)] - 1
    return [(int(owner[i]), int(at[i]), texts[owner[i]][at[i]:at[j] + width]) for i, j in zip(lead, ends)]


def _searched(texts: DataFrame, spec: Spec, buckets: int) -> DataFrame:
    import pyarrow as pa

    def one(tab: pa.Table) -> pa.Table:
        texts = spec.texts(tab.column("text").to_pylist())
        kept = _filtered(texts, spec.width) if spec.prefilter else [(i, 0, t) for i, t in enumerate(texts)]
        dk = th = first = n = np.zeros(0, np.int64)
        if kept:
            text, at, cls, long = spec.search([t for _, _, t in kept], spec.width)
            row = np.array([k for k, _, _ in kept])[text]
            first = tab.column("first").to_numpy()[row] + np.array([s for _, s, _ in kept])[text] + at
            dk, th = tab.column("dk").to_numpy()[row], tab.column("th").to_numpy()[row].astype(np.int64)
            order = np.lexsort((first, th, dk, cls))
            dk, th, first, cls, n = dk[order], th[order], first[order], cls[order], long[order] - spec.width + 1
            lead = np.maximum.accumulate(np.where(np.r_[True, cls[1:] != cls[:-1]], np.arange(len(cls)), 0))
            later = (dk != dk[lead]) | (th != th[lead]) | (first != first[lead])
            dk, th, first, n = dk[later], th[later], first[later], n[later]
        if len(first):  # windows that follow or overlap one another are one row
            order = np.lexsort((first, th, dk))
            dk, th, first, n = dk[order], th[order], first[order], n[order]
            doc = np.cumsum(np.r_[0, (dk[1:] != dk[:-1]) | (th[1:] != th[:-1])])
            far = int((first + n).max()) + 1  # every document in a range of its own
            end = np.maximum.accumulate(first + n + doc * far)
            cut = np.flatnonzero(np.r_[True, (first + doc * far)[1:] > end[:-1]])
            tail = np.r_[cut[1:], len(first)] - 1
            dk, th, first, n = dk[cut], th[cut], first[cut], end[tail] - (first + doc * far)[cut]
        return pa.table({"dk": pa.array(dk.astype(np.int64)), "th": pa.array(th.astype(np.int64)),
                         "first": pa.array(first.astype(np.int64)), "n": pa.array(n.astype(np.int32))})

    return (texts.withColumn("bucket", F.pmod("h", F.lit(buckets))).drop("h").groupBy("bucket").applyInArrow(one, SPAN))


def spans(docs: DataFrame, spec: Spec) -> DataFrame:
    """(dk, th, first, n): the windows first .. first + n - 1 of a document also start earlier."""
    d = keyed(docs)
    marked = materialise(_marked(_runs(d, spec)), "repeats")
    size = 7 if spec.words else 1
    need = marked.where("kind = 1").agg(F.sum((F.col("n") + spec.width - 1) * size)).first()[0] or 0
    found = _searched(_texts(_with_text(d, marked.where("kind = 1")), spec), spec, -(-int(need) // BUCKET) or 1)
    fine = _marked(_single(_with_text(d, marked.where("kind = 2")), spec)).where("kind = 0")
    return (marked.where("kind = 0").select("dk", "th", "first", "n").unionByName(found)
            .unionByName(fine.select("dk", "th", "first", "n")))


def cover(first: np.ndarray, n: np.ndarray, width: int, total: int) -> np.ndarray:
    """Symbols covered by the windows, as a mask."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + n + width - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def remove(docs: DataFrame, spec: Spec) -> DataFrame:
    """One row per document: doc_id, total, n_removed, n_spans (symbols, runs of removed
    symbols), kept (what is left, as binary)."""
    import pyarrow as pa

    per = (spans(docs, spec).groupBy("dk", "th")
           .agg(F.collect_list(F.struct("first", "n")).alias("spans")))  # of one document
    joined = keyed(docs).join(per, ["dk", "th"], "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            total, gone, parts, digest = [], [], [], []
            for text, sp in zip(b.column("text"), b.column("spans")):
                raw = text.as_py().encode()
                unit = raw.split() if spec.words else raw
                sp = sp.as_py() or []
                total.append(len(unit))
                if sp:
                    mask = cover(np.array([s["first"] for s in sp]), np.array([s["n"] for s in sp]), spec.width, len(unit))
                    gone.append(int(mask.sum()))
                    parts.append(int((mask[1:] & ~mask[:-1]).sum() + mask[0]))
                    kept = [unit[i] for i in np.flatnonzero(~mask)] if spec.words else np.frombuffer(raw, np.uint8)[~mask].tobytes()
                else:
                    gone.append(0)
                    parts.append(0)
                    kept = unit
                digest.append(hashlib.sha256(b" ".join(kept) if spec.words else kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(parts, pa.int64()),
                 pa.array(digest, pa.string())], ["doc_id", "total", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, f"doc_id {kind}, total long, n_removed long, n_spans long, kept_sha256 string")
