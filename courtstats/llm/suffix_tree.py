"""Repeated word sequences from prefix-partitioned suffix trees.

Texts that share content (see ``repeats``) meet in buckets of bounded size.  A bucket's
suffixes are split by prefixes of variable length: a group of more than ``GROUP``
suffixes is split by its next word, again and again, until every group fits (or
shares a whole ``width`` of words: one deep node holds it then).  Every group is one
subtree: its suffixes, sorted to the ends of their texts, and their common prefixes give the
internal nodes.  A node of at least ``width`` words whose leaves are preceded by different
words is a maximal repeat: all its places but the first are repeated over the node's
whole length.  A node whose leaves all follow the same word is part of a longer one.

Defined cases: as in ``bwt_dedup``, with words for bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtstats.llm.repeats import Spec, remove

WIDTH, GRAM, GROUP = 20, 8, 2_000


class Joined:
    """The words of a bucket's texts in one array: ``left`` words from each place to the
    end of its text, ``owner`` text of each place."""

    def __init__(self, texts: list[np.ndarray]):
        size = np.array([len(t) for t in texts], np.int64)
        self.words = np.concatenate(texts).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        self.start = np.cumsum(size) - size
        self.owner = np.repeat(np.arange(len(texts)), size)
        self.left = np.repeat(np.cumsum(size), size) - np.arange(len(self.words))

    def columns(self, own: np.ndarray, a: int, b: int) -> np.ndarray:
        """Words a .. b of the suffixes; beyond the end of a text a mark of its own."""
        at = own[:, None] + np.arange(a, b)[None, :]
        inside = np.arange(a, b)[None, :] < self.left[own][:, None]
        return np.where(inside, self.words[np.minimum(at, len(self.words) - 1)], -1 - self.owner[own][:, None])

    def before(self, own: np.ndarray) -> np.ndarray:
        """The word before each place; a mark of its own at the start of a text."""
        first = own == self.start[self.owner[own]]
        return np.where(first, -1 - self.owner[own], self.words[np.maximum(own - 1, 0)])


def groups(joined: Joined, start: np.ndarray, width: int, group: int = GROUP):
    """Suffix starts split by variable-length prefixes: (prefix length, starts)."""
    todo = [(0, start)]
    while todo:
        depth, own = todo.pop()
        if len(own) <= group or depth == width:
            yield depth, own
            continue
        word = joined.words[own + depth]  # all have ``width`` words left
        order = np.argsort(word, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(word[order]) != 0, True])
        todo += [(depth + 1, own[order[a:b]]) for a, b in zip(cut[:-1], cut[1:]) if b - a > 1]


def subtree(joined: Joined, own: np.ndarray, depth: int):
    """Sorted suffixes of one group and the common prefixes of neighbours, whatever their
    length (-1 before the first)."""
    longest = int(joined.left[own].max())
    table = joined.columns(own, depth, longest + 1)  # to the end marks: no two suffixes are equal
    order = np.lexsort(table.T[::-1])
    table = table[order]
    common = (table[1:] != table[:-1]).argmax(axis=1) + depth
    return own[order], np.r_[-1, common]


def internal_nodes(common: np.ndarray):
    """Internal nodes (depth, first leaf, last leaf) of the tree over sorted suffixes."""
    stack: list[tuple[int, int]] = []
    for i, c in enumerate(np.r_[common[1:], -1].tolist()):
        first = i
        while stack and stack[-1][0] > c:
            depth, first = stack.pop()
            yield depth, first, i
        if not stack or stack[-1][0] < c:
            stack.append((c, first))


def deep_nodes(texts: list[np.ndarray], width: int):
    """(joined texts, depth, leaves) of the internal nodes of at least ``width`` words that
    are maximal to the left."""
    joined = Joined(texts)
    start = np.flatnonzero(joined.left >= width)
    for depth, own in groups(joined, start, width, GROUP):
        if len(own) < 2:
            continue
        leaf, common = subtree(joined, own, depth)
        if common.max() < width:
            continue
        before = joined.before(leaf)
        turns = np.r_[0, np.cumsum(before[1:] != before[:-1])]
        for d, a, b in internal_nodes(common):
            if d >= width and turns[b] > turns[a]:
                yield joined, d, leaf[a:b + 1]


def maximal_repeats(texts: list[np.ndarray], width: int):
    """(text, offset, class, length) of every place of every maximal repeat."""
    at, cls, long, joined = [], [], [], None
    for n, (joined, depth, leaf) in enumerate(deep_nodes(texts, width)):
        at.append(leaf)
        cls.append(np.full(len(leaf), n))
        long.append(np.full(len(leaf), depth))
    if joined is None:
        return (np.zeros(0, np.int64),) * 4
    at = np.concatenate(at)
    text = joined.owner[at]
    return text, at - joined.start[text], np.concatenate(cls), np.concatenate(long)


def spec(width: int = WIDTH, gram: int = GRAM) -> Spec:
    return Spec(width, gram, True, maximal_repeats, prefilter=False)


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    return remove(docs, spec(width, gram)).select(
        "doc_id", F.col("total").alias("n_words"), "n_removed", "kept_sha256")


#: the same in DuckDB SQL, where no two rows share a doc_id (windows by hashes of 64 bits, put
#: together from those of 1, 2, 4, ... words)
ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM t),
h1 AS (SELECT *, hash(word) AS h1 FROM u),
h2 AS (SELECT *, hash(h1, lead(h1, 1) OVER (PARTITION BY doc_id ORDER BY pos)) AS h2 FROM h1),
h4 AS (SELECT *, hash(h2, lead(h2, 2) OVER (PARTITION BY doc_id ORDER BY pos)) AS h4 FROM h2),
h8 AS (SELECT *, hash(h4, lead(h4, 4) OVER (PARTITION BY doc_id ORDER BY pos)) AS h8 FROM h4),
h16 AS (SELECT *, hash(h8, lead(h8, 8) OVER (PARTITION BY doc_id ORDER BY pos)) AS h16 FROM h8),
h20 AS (SELECT doc_id, word, pos, hash(h16, lead(h4, 16) OVER o) AS h, lead(word, 19) OVER o IS NOT NULL AS whole
  FROM h16 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
later AS (SELECT doc_id, word, pos, whole AND row_number() OVER (PARTITION BY h, whole ORDER BY doc_id, pos) > 1 AS again FROM h20),
gone AS (SELECT doc_id, word, pos, max(again::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM later),
kept AS (SELECT doc_id, count_if(gone) AS n, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)"""
