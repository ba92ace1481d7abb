"""Risk-controlled quality rules, conversation trie and hard negatives against brute-force
versions, with their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtstats.llm import conv_trie, hard_negatives, quality_rules as Q
from courtstats.sources.tables import table

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


# --- quality rules ---------------------------------------------------------------------------

def py_counts(text):
    text = text or ""
    w = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i:i + 5])].append(i)
    hit = {p for ps in at.values() if len(ps) > 1 for i in ps for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit),
            "n_capitals": sum("A" <= c <= "Z" for c in text), "n_marks": sum(c in "!?" for c in text)}


EDGE = ["", None, " \t\n\r\x0b\x0c", "one two three four", "a b c d e", "a b c d e " * 2, "x x x x x x", "l\nl\n\n \n l\nL",
        "é\U0001F600 ü*#|<>&%$ !? ÀB", "w " * 30_000, " ".join(f"t{i % 997}" for i in range(20_000)), "a\x85b c d e f g"]


def test_counts_of_texts(spark):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(EDGE)], "doc_id long, text string, _w string")
    for r in Q.counts(d.unionByName(d)).collect():
        assert {c: r[c] for c in py_counts("")} == py_counts(EDGE[r.doc_id]), EDGE[r.doc_id]


def test_binomial_tail_is_exact(spark):
    cases = [(0, 5), (3, 400), (0, 1000), (7, 1000), (9, 1000), (12, 3000), (150, 20_000), (10, 10), (790, 100_000)]
    rate = Q.ALPHA / len(Q.RULES)
    d = spark.createDataFrame(cases, "k long, n long")
    for r in d.select("k", "n", Q.binomial_tail(F.col("k"), F.col("n"), rate).alias("p")).collect():
        logs = [math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(rate)
                + (r.n - i) * math.log1p(-rate) for i in range(r.k + 1)]
        want = sum(map(math.exp, logs))
        assert r.p == (1.0 if r.k >= r.n * rate else pytest.approx(want, rel=1e-6))


def py_cutoffs(docs, labels, alpha, delta):
    """docs: (doc_id, text, lang); labels: (doc_id, quality)."""
    q = defaultdict(list)
    for i, x in labels:
        q[i].append(x)
    by = defaultdict(list)
    for i, t, lang in docs:
        c = py_counts(t)
        if i is not None and min((x for x in q[i] if x is not None), default=0) == 1 and c["n_words"] >= 10 and 100 * c["n_repeat_words"] <= 20 * c["n_words"]:
            by[lang].append(c)
    rate, out = alpha / len(Q.RULES), {}
    for lang, good in by.items():
        tests = []
        for r, (x, y, cs) in Q.RULES.items():
            for c in cs:
                k, n = sum(1 for g in good if g[y] and 100 * g[x] >= c * g[y]), len(good)
                p = 1.0 if k >= n * rate else sum(
                    math.comb(n, i) * rate ** i * (1 - rate) ** (n - i) for i in range(k + 1))
                tests.append((p, r, -c, k, n))
        tests.sort()
        for i, (p, r, c, k, n) in enumerate(tests):
            if p * (len(tests) - i) > delta / len(by):
                break
            if (lang, r) not in out or out[lang, r][0] > -c:
                out[lang, r] = (-c, n, k)
    return out


@pytest.fixture(scope="module")
def labelled():
    """Three strata; junk by symbols or repeated lines; some good texts with a few symbols."""
    rnd = random.Random(4)
    docs, labels = [], []
    for i in range(900):
        lang = [None, "en", "en", "de"][i % 4]
        w = [rnd.choice("abcdefghij") * rnd.randint(1, 6) + str(rnd.randint(0, 999)) for _ in range(30)]
        good = i % 5 > 0
        if not good:
            w = [x + "###" for x in w] if i % 2 else w[:10] + ["AB!!"] * 3
        elif i % 60 == 1:
            w[3] += "*"
        docs.append((i if i % 97 else None, "\n".join(" ".join(w[j:j + 6]) for j in range(0, 30, 6)), lang))
        labels.append((i, int(good)))
    docs += [(5001, None, "en"), (5002, "", None), (5003, "$ " * 40, "fr"), docs[7], docs[7]]
    labels += [(3, 0), (None, 1), (5003, 1), (6, None)]
    return docs, labels


def test_verdicts_against_brute_force(spark, labelled):
    docs, labels = labelled
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("n_words", F.lit("clash")).withColumn("rule", F.lit(1))
    lab = spark.createDataFrame(labels, "doc_id long, quality int").withColumn("lang", F.lit("zz"))
    alpha, delta = 0.3, 0.2
    want = py_cutoffs(docs, labels, alpha, delta)
    assert want and {lang for lang, _ in want} >= {"en", None}
    stats = Q.counts(d.select("doc_id", "text", "lang"))
    got = {(r.stratum, r.rule): (r.cutoff, r.n_good, r.n_lost) for r in Q.cutoffs(stats, lab, alpha=alpha, delta=delta).collect()}
    assert got == want

    def verdict(t, lang):
        c = py_counts(t)
        base = c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
        fails = [] if base else [r for r, (x, y, _) in Q.RULES.items() if (lang, r) in want and c[y] and 100 * c[x] >= want[lang, r][0] * c[y]]
        return base, not base and not fails, fails
    rows = Q.judge(d, lab, alpha=alpha, delta=delta).collect()
    assert len(rows) == len(docs)
    key = lambda x: tuple(map(str, x))
    assert sorted([(r.doc_id, r.lang, r.n_words, r.base_failed, r.kept, r.failed_rules) for r in rows], key=key) == sorted(
        [(i, lang, py_counts(t)["n_words"], *verdict(t, lang)) for i, t, lang in docs], key=key)
    assert sum(not r.kept for r in rows if not r.base_failed) > 50


def test_many_strata_and_no_labels(spark, labelled, monkeypatch):
    docs, labels = labelled
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = lambda x: sorted(map(str, x.collect()))
    one = rows(Q.judge(d, lab, alpha=0.3, delta=0.2))
    monkeypatch.setattr(Q, "MAX_BROADCAST", 0)
    assert rows(Q.judge(d, lab, alpha=0.3, delta=0.2)) == one
    none = Q.judge(d, lab.limit(0)).collect()
    assert len(none) == len(docs) and all(r.kept != r.base_failed for r in none)
    assert Q.judge(d.limit(0), lab).count() == 0


def test_few_good_documents_are_lost(spark):
    """What the bounds promise, over repeated draws: true loss above alpha in at most about delta of them."""
    rnd = np.random.default_rng(3)
    alpha, delta, bad = 0.1, 0.2, 0
    true = {c: (1 - c / 100) for c in range(101)}  # symbols share is uniform: P(x >= c %) = 1 - c / 100
    for draw in range(6):
        x = rnd.integers(0, 101, 3000)
        d = spark.createDataFrame([(i, int(s)) for i, s in enumerate(x)], "doc_id long, n_symbols long").select(
            "doc_id", "n_symbols", F.lit("s").alias("lang"), F.lit(100).cast("long").alias("n_words"),
            *[F.lit(0).cast("long").alias(c) for c in ("n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "word_chars")])
        lab = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
        found = {r.rule: r.cutoff for r in Q.cutoffs(d, lab, alpha=alpha, delta=delta).collect()}
        bad += true[found["symbols"]] > alpha if "symbols" in found else 0
    assert bad <= 3


# --- conversation trie --------------------------------------------------------------------------

def py_trie(rows, heads=4, block=20):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{role}|{text}".encode()).hexdigest(), role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    nodes, words = defaultdict(list), lambda t: len(WORD.findall(t))
    ends = defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        path = tuple(own.get(c - int(math.fmod(c, block)), [])[:h] + v[h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
        ends[path].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    total = {}
    for p in sorted(nodes, key=len, reverse=True):
        own_saved = (len(nodes[p]) - 1) * (words(p[-1][1]) if p else 0)
        total[p] = (sum(total[k][0] for k in kids[p]) if kids[p] else 1, own_saved + sum(total[k][1] for k in kids[p]))
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids[p]), *total[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in nodes.items())


def trie_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_trie_against_brute_force(spark, monkeypatch):
    base = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    extra = [(None, 1, "user", "lost"), (900, None, None, None), (900, None, "user", "a b"), (900, 2, "user", "a b"), (900, 2, "user", "a b"),
             (900, 2, "bot", "c"), (-7, 0, "user", "neg"), (-7, 1, "user", "neg two"), (901, 5, "user", " \t"), (902, 1, "x", "y" * 5000)]
    extra += [(1000 + i, t, "user", f"same {t} text") for i in range(90) for t in range(4)]          # a third is copies
    extra += [(2000, t, "user" if t % 2 else "bot", f"turn {t // 3}") for t in range(300)]           # one long chain
    extra += [(3000 + i, t, "user", f"turn {t if t < 120 else i}") for i in range(3) for t in range(130)]
    rows = base + extra
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("depth", "k1", "m", "words", "h"):
        d = d.withColumn(c, F.lit("clash"))
    monkeypatch.setattr(conv_trie, "PIECE", 16)   # many pieces of an ends list
    monkeypatch.setattr(conv_trie, "MANY", 5)     # some parents are broadcast
    assert trie_rows(conv_trie.trie(d)) == py_trie(rows)


def test_trie_without_turns_or_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conv_trie.trie(spark.createDataFrame([], schema)).count() == 0
    assert conv_trie.trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).count() == 0
    short = [c for c in range(1, 60) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:2]
    rows = [(c, 0, "a", "b") for c in short]  # their block's first conversation is absent: no turns are left
    assert trie_rows(conv_trie.trie(spark.createDataFrame(rows, schema))) == py_trie(rows) and len(py_trie(rows)) == 1


@pytest.mark.parametrize("shape", ["chain", "star", "random", "caterpillar", "binary"])
def test_subtree_totals_by_contraction(spark, shape):
    n, rnd = 260, random.Random(shape)
    up = {"chain": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: rnd.randrange(i),
          "caterpillar": lambda i: i - 1 if i % 2 else max(i - 2, 0), "binary": lambda i: (i - 1) // 2}[shape]
    parent = [None] + [up(i) for i in range(1, n)]
    depth = [0] * n
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    value = [rnd.randrange(100) for _ in range(n)]
    total = list(value)
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
    d = spark.createDataFrame([(i, -i, p, None if p is None else -p, depth[i], value[i]) for i, p in enumerate(parent)],
                              "k1 long, k2 long, p1 long, p2 long, depth long, v long")
    got = {r.k1: r.v for r in conv_trie.subtree_totals(d, ["v"]).collect()}
    assert got == dict(enumerate(total))


# --- hard negatives -----------------------------------------------------------------------------

def py_negatives(rows, pos, neg, low, high):
    ok = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows
          if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, v in ok:
        if i % 50:
            continue
        def score(w):
            return sum(a * b for a, b in zip(v, w))
        met = [(-score(w), j, other == lab) for j, other, w in ok if j != i and len(w) == len(v)]
        for ps, p, _ in sorted(x for x in met if x[2])[:pos]:
            found = sorted((s, j) for s, j, same in met if not same and low * -ps <= 100 * -s <= high * -ps)[:neg]
            out += [(i, p, k + 1, j, -ps, -s) for k, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(64) / 8], int(rng.integers(0, 4))) for i in range(400)]
    rows += [(i, [float(np.float32(x)) for x in rng.standard_normal(70) / 8], i % 2) for i in range(500, 560)]  # other length
    rows += [(600, rows[0][1], 1), (601, rows[0][1], 2), (602, rows[0][1], 3), (600, rows[0][1], 1), (600, rows[3][1], 1),
             (None, rows[1][1], 1), (650, None, 1), (651, rows[2][1], None), (652, [float("nan")] * 64, 1), (653, [float("inf")] * 64, 1),
             (654, [None] * 64, 1), (700, [0.0] * 64, 1), (750, [], 1), (751, [], 2), (752, [], 1), (800, [1000.0] * 64, 1), (801, [-999.5] * 64, 2)]
    return rows


@pytest.mark.parametrize("block", [8192, 60])
def test_hard_negatives_against_brute_force(spark, vectors, block):
    d = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    for c in ("uid", "code", "dim", "rb", "band", "score"):
        d = d.withColumn(c, F.lit("clash"))
    got = hard_negatives.mine(d, F.col("vec_id") % 50 == 0, block=block)
    assert sorted(tuple(r) for r in got.collect()) == py_negatives(vectors, 5, 3, 50, 95)
    few = hard_negatives.mine(d, F.col("vec_id") % 50 == 0, positives=2, negatives=40, low=10, high=120, block=block)
    assert sorted(tuple(r) for r in few.collect()) == py_negatives(vectors, 2, 40, 10, 120)


def test_hard_negatives_of_nothing(spark):
    d = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(d, F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(one, F.col("vec_id") % 50 == 0).count() == 0  # no positive, so no band


@pytest.mark.parametrize("d", [1, 7, 64, 65, 130])
def test_intervals_hold_for_every_pair(d):
    rng = np.random.default_rng(d)
    v = np.concatenate([rng.integers(-300, 300, (200, d)), np.zeros((2, d), int), np.full((2, d), 40_000), rng.integers(-3, 3, (50, d))])
    code, align, rest = hard_negatives.encode(v)
    lo, hi = hard_negatives.intervals(hard_negatives.planes(v), slice(None), code, align, rest, d)
    exact = v @ v.T
    assert (lo <= exact).all() and (exact <= hi).all()
    if d == 64:  # and they are narrow enough to leave rows out
        part = hi[:200, :200] - lo[:200, :200]
        assert part.mean() < 2.5 * exact[:200, :200][~np.eye(200, dtype=bool)].std()
