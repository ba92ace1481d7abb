"""Repeated byte strings from merged Burrows-Wheeler transforms.

Texts that share content (see ``repeats``) meet in buckets of bounded size.  A bucket
is cut into shards of about ``SHARD`` bytes; every shard's suffixes are sorted once
and leave their Burrows-Wheeler transform.  The shards are merged without sorting
suffixes of different shards against each other: an interleave vector says from which shard
each suffix of the merged order comes, and one round of refinement (a stable
counting sort by the transforms' symbols) turns an interleave that is right for the first k
bytes into one that is right for k + 1.  The round in which two neighbours first part
gives their common prefix; after ``width`` rounds, or as soon as a round changes
nothing, the blocks that still hold together are the repeated intervals.

Defined cases: null text counts as empty, empty and short texts have no repeated
string; repeated rows (same doc_id, same text) are one document and get the same
result; other rows that share a doc_id are ordered by text hash; a null doc_id comes
before all others; an empty table gives an empty result; columns other than doc_id
and text are ignored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtstats.llm.repeats import Spec, remove

WIDTH, GRAM, SHARD = 100, 32, 1 << 17
_PACK = 7  # symbols of 9 bits in a 64-bit key


def suffix_order(sym: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of texts laid end to end, each closed by a 0; suffixes
    that are equal to their end stand in order of their texts (prefix doubling)."""
    n = len(sym)
    pad = np.concatenate([sym.astype(np.uint64), np.zeros(_PACK, np.uint64)])
    key, alive = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(_PACK):
        key = (key << np.uint64(9)) | np.where(alive, pad[j:j + n], 0).astype(np.uint64)
        alive &= pad[j:j + n] != 0
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.r_[True, (k[1:] != k[:-1]) | ~alive[order[1:]]]  # a closed suffix is alone
    span = _PACK
    while not new.all():
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        alone = new & np.r_[new[1:], True]
        rest = np.flatnonzero(~alone)  # places of suffixes that are not yet told apart
        ids = order[rest]
        pair = rank[ids] * n + rank[np.minimum(ids + span, n - 1)]
        by = np.argsort(pair, kind="stable")
        order[rest] = ids[by]
        p = pair[by]
        new[rest[1:]] |= p[1:] != p[:-1]
        span *= 2
    return order


class Shard:
    def __init__(self, texts: list[np.ndarray], first: int):
        size = np.array([len(t) + 1 for t in texts])
        self.start = np.cumsum(size) - size
        sym = np.zeros(size.sum(), np.uint16)
        for s, t in zip(self.start, texts):
            sym[s:s + len(t)] = t.astype(np.uint16) + 1
        self.text = np.repeat(np.arange(len(texts)), size)
        self.order = suffix_order(sym, self.text)
        before = sym[self.order - 1]
        before[np.isin(self.order, self.start)] = 0
        self.bwt, self.first, self.size = before, first, size

    def places(self, rank: np.ndarray):
        """Text, offset and length left of the suffixes with these ranks."""
        at = self.order[rank]
        t = self.text[at]
        off = at - self.start[t]
        return self.first + t, off, self.size[t] - 1 - off


def merge(shards: list[Shard], width: int):
    """Interleave, block numbers and common prefixes of the merged order, right for
    the first ``width`` bytes."""
    sizes = [len(s.bwt) for s in shards]
    texts = [len(s.start) for s in shards]
    small = np.uint8 if len(shards) < 256 else np.uint16
    z = np.repeat(np.arange(len(shards)), sizes).astype(small)
    ends = np.repeat(np.arange(len(shards)), texts).astype(small)  # the empty suffixes, in order of their texts
    bwt = np.concatenate([s.bwt for s in shards])
    closed = len(ends)
    block = np.zeros(len(z), np.int64)
    prefix = np.full(len(z), -1, np.int16)
    for k in range(width):
        sym = np.empty_like(bwt)
        sym[np.argsort(z, kind="stable")] = bwt
        src = np.argsort(sym, kind="stable")[closed:]
        z2 = np.concatenate([ends, z[src]])
        new = np.ones(len(z), bool)
        s, b = sym[src], block[src]
        new[closed + 1:] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        fresh = new & (prefix < 0)
        done = not fresh.any() and (z2 == z).all()
        prefix[fresh] = k
        z, block = z2, np.cumsum(new)
        if done:
            break
    return z, block, prefix


def repeated(texts: list[np.ndarray], width: int):
    """(text, offset, class) of the strings of ``width`` bytes that occur twice."""
    shards, part, size, first = [], [], 0, 0
    for i, t in enumerate(texts):
        part.append(t)
        size += len(t) + 1
        if size >= SHARD or i == len(texts) - 1:
            shards.append(Shard(part, first))
            first, part, size = i + 1, [], 0
    z, block, _ = merge(shards, width)
    many = np.bincount(block)[block] > 1
    text, off, cls = [], [], []
    for s, shard in enumerate(shards):
        slot = np.flatnonzero(z == s)  # the shard's suffixes in its own order
        own = many[slot]
        t, o, left = shard.places(np.flatnonzero(own))
        fine = left >= width
        text.append(t[fine])
        off.append(o[fine])
        cls.append(block[slot[own]][fine])
    return np.concatenate(text), np.concatenate(off), np.concatenate(cls)


def places(texts: list[np.ndarray], width: int):
    """``repeated`` with the length of the content: one window each."""
    text, off, cls = repeated(texts, width)
    return text, off, cls, np.full(len(text), width)


def spec(width: int = WIDTH, gram: int = GRAM) -> Spec:
    return Spec(width, gram, False, places)


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove(docs, spec(width, gram)).select(
        "doc_id", F.col("total").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


#: the same in DuckDB SQL, where no two rows share a doc_id (windows by hashes of 64 bits, put
#: together from those of 1, 2, 4, ... bytes)
ORACLE = """
WITH t AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes FROM documents),
u AS (SELECT doc_id, unnest(bytes) AS b, generate_subscripts(bytes, 1) AS pos FROM t),
h1 AS (SELECT *, hash(b) AS h1 FROM u),
h2 AS (SELECT *, hash(h1, lead(h1, 1) OVER (PARTITION BY doc_id ORDER BY pos)) AS h2 FROM h1),
h4 AS (SELECT *, hash(h2, lead(h2, 2) OVER (PARTITION BY doc_id ORDER BY pos)) AS h4 FROM h2),
h8 AS (SELECT * EXCLUDE (h1, h2), hash(h4, lead(h4, 4) OVER (PARTITION BY doc_id ORDER BY pos)) AS h8 FROM h4),
h16 AS (SELECT *, hash(h8, lead(h8, 8) OVER (PARTITION BY doc_id ORDER BY pos)) AS h16 FROM h8),
h32 AS (SELECT *, hash(h16, lead(h16, 16) OVER (PARTITION BY doc_id ORDER BY pos)) AS h32 FROM h16),
h64 AS (SELECT *, hash(h32, lead(h32, 32) OVER (PARTITION BY doc_id ORDER BY pos)) AS h64 FROM h32),
h100 AS (SELECT doc_id, b, pos, hash(h64, lead(h32, 64) OVER o, lead(h4, 96) OVER o) AS h, lead(b, 99) OVER o IS NOT NULL AS whole
  FROM h64 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
later AS (SELECT doc_id, b, pos, whole AND row_number() OVER (PARTITION BY h, whole ORDER BY doc_id, pos) > 1 AS again FROM h100),
gone AS (SELECT doc_id, b, pos, max(again::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) = 1 AS gone FROM later),
edge AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS first FROM gone),
cut AS (
  SELECT doc_id, count_if(gone) AS n_removed, count_if(first) AS n_spans, string_agg(b, '' ORDER BY pos) FILTER (NOT gone) AS kept
  FROM edge GROUP BY doc_id)
SELECT doc_id, CAST(len(bytes) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM t LEFT JOIN cut USING (doc_id)"""
