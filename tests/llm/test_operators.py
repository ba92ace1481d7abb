"""Training-data operators against brute-force versions on small fixtures, and the
defined edge cases: nulls, empty and long texts, ties, repeated rows, empty tables,
extra columns with clashing names."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtstats.llm import (
    bwt_dedup, decontam, embed_dedup, langid, lattice_lm, mixing, repeats, secret_scan, simhash, suffix_tree, toxicity,
)
from courtstats.llm.common import components
from courtstats.sources.tables import table
from courtstats.testing import compare, duck_connect

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest driver table plus edge rows; extra columns clash with inner names."""
    base = table(spark, SF, "documents")
    rng = np.random.default_rng(7)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "ox"], 30_000))
    edge = [(None, "no id here at all", "en", None, 17), (7001, None, "en", "src1", 0), (7002, "", "en", "src2", 0),
            (7003, " \t\n ", None, None, 4), (7004, "12 34 56", "en", "src1", 8), (7005, long, "en", "src0", len(long)),
            (7006, "same text twice over", "en", "src3", 20), (7006, "same text twice over", "en", "src3", 20),
            (7007, "aa bb", "en", "src3", 5), (7007, "cc dd ee ff", "en", "src3", 11),
            (7008, "x" * 5000, None, "src1", 5000), (7009, "\U0001F600 é " * 40, None, "src1", 160)]
    d = base.unionByName(frame(base.sparkSession, edge))
    for c in ("fp", "h", "size", "score", "key", "word", "found", "target", "__n", "_t", "uid", "label"):
        d = d.withColumn(c, F.lit(f"x{c}"))
    return d.cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def crc(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def key(r):
    return tuple((x is None, str(x)) for x in r)


# ---------------------------------------------------------------- op1

def test_segments_are_all_maximal():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = rng.integers(-3, 4, 12).astype(float)
        got = sorted((a, b, v) for v, a, b in toxicity.segments(list(enumerate(s)), 0.0))

        def brute(lo, hi):  # the best stretch, then the rest on both sides
            best = None
            for a, b in itertools.combinations(range(lo, hi + 1), 2):
                v = s[a:b].sum()
                if v > 0 and (best is None or v > best[0] or v == best[0] and b - a < best[2] - best[1]):
                    best = v, a, b
            return [] if best is None else brute(lo, best[1]) + [best] + brute(best[2], hi)
        assert sum(v for _, _, v in got) == pytest.approx(sum(v for v, _, _ in brute(0, 12)))
        assert all(v == pytest.approx(s[a:b].sum()) for a, b, v in got)


def test_segments_skip_floor():
    full = [(i, -0.5) for i in range(20)]
    full[3], full[5], full[17] = (3, 2.0), (5, 3.0), (17, 1.0)
    few = [x for x in full if x[1] > 0]
    assert toxicity.segments(full, -0.5) == toxicity.segments(few, -0.5)


def test_toxicity(spark, docs, rows, empty):
    labels = table(spark, SF, "labels")
    out = toxicity.score(docs, labels).collect()
    assert len(out) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) for r in out)
    assert toxicity.score(empty, labels).count() == 0
    none = toxicity.score(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    lab = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    out = toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels")).where("held_out").collect()
    hit = Counter((lab[r.doc_id], r.predicted) for r in out if r.doc_id in lab)
    assert hit[1, 1] / (hit[1, 1] + hit[1, 0]) > 0.7
    assert hit[1, 1] / (hit[1, 1] + hit[0, 1]) > 0.9


@pytest.mark.parametrize("n1, low, high, noise", [(20, 3, 6.5, 3), (200, 3, 3, 3), (20, 1.5, 3, 0)])
def test_toxicity_fit_of_separable_labels(n1, low, high, noise):
    x = np.r_[np.zeros(2000 - noise), np.full(noise, 1.4), np.linspace(low, high, n1)]
    a, b = toxicity._logistic(x, np.r_[np.zeros(2000), np.ones(n1)])
    assert b > 1 and a < 0 < a + b * low
    a, b = toxicity._logistic(x, np.r_[np.ones(n1), np.zeros(2000)])
    assert b == 0 and a == pytest.approx(math.log((n1 + 1) / 2001))


@pytest.mark.parametrize("n", [60, 3000])
def test_toxicity_ranks_held_out_rows(spark, n):
    """Toxic words tell the labels apart, over few and over many labelled rows."""
    rng = np.random.default_rng(3)
    words, bad = [f"w{i}" for i in range(400)], ["scum", "trash", "moron"]
    toxic = [i % 6 == 0 for i in range(n)]
    text = [" ".join([*rng.choice(words, 30), *([*bad] if y else []), *rng.choice(words, 30)]) for y in toxic]
    docs = frame(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(text)])
    out = toxicity.score(docs, frame(spark, [(i, int(y)) for i, y in enumerate(toxic)], "doc_id long, toxic int")).where("held_out").collect()
    pairs = [(p.score, q.score) for p in out if toxic[p.doc_id] for q in out if not toxic[q.doc_id]]
    assert len(pairs) > 20 and sum(p > q for p, q in pairs) > 0.9 * len(pairs)


# ---------------------------------------------------------------- op2, op6

def brute_repeats(rows, words, width):
    seen, out = {}, {}
    for i, t in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        unit = t.encode().split() if words else t.encode()
        mask = np.zeros(len(unit), bool)
        for a in range(len(unit) - width + 1):
            k = tuple(unit[a:a + width]) if words else unit[a:a + width]
            k = hashlib.blake2b(repr(k).encode()).digest()
            if seen.setdefault(k, (i, a)) != (i, a):
                mask[a:a + width] = True
        kept = (b" ".join(u for u, m in zip(unit, mask) if not m) if words
                else np.frombuffer(unit, np.uint8)[~mask].tobytes())
        spans = int((mask[1:] & ~mask[:-1]).sum() + mask[:1].sum())
        out[i, t] = (len(unit), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [10_000, 2])
def test_repeated_substrings(spark, rows, docs, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    text = {}
    for i, t in rows:
        text.setdefault(i, []).append(t)
    only = docs.where("doc_id is null or doc_id <> 7007")  # two texts of one id have no order in the contract
    for mod, words, width in ((bwt_dedup, False, 100), (suffix_tree, True, 20)):
        want = brute_repeats([r for r in rows if r[0] != 7007], words, width)
        out = mod.dedup(only).collect()
        assert len(out) == len(rows) - 2
        for r in out:
            w = want[r.doc_id, text[r.doc_id][0] or ""]
            n = r.n_words if words else r.n_bytes
            assert (n, r.n_removed, r.kept_sha256) == (w[0], w[1], w[3]), r.doc_id
            if not words:
                assert r.n_spans == w[2]


def test_repeated_substrings_empty(empty):
    assert bwt_dedup.dedup(empty).count() == 0
    assert suffix_tree.dedup(empty).count() == 0


def windows_of(texts, width):
    want = {}
    for i, x in enumerate(texts):
        for a in range(len(x) - width + 1):
            want.setdefault(x[a:a + width].tobytes(), set()).add((i, a))
    return [v for v in want.values() if len(v) > 1]


def some_texts(kind, width, seed=5):
    rng = np.random.default_rng(seed)
    texts = [np.array(rng.integers(97, 100, n), kind) for n in rng.integers(width, 60, 40)]
    texts += texts[:6] + [texts[3][2:], np.concatenate([texts[4], texts[5]])]
    return texts + [np.arange(100, 100 + width, dtype=kind)] * 12  # more copies than a group holds, without an end of their own


@pytest.mark.parametrize("width", [3, 8, 20])
def test_merged_transforms_against_hashing(monkeypatch, width):
    monkeypatch.setattr(bwt_dedup, "SHARD", 120)
    texts, got = some_texts(np.uint8, width), {}
    for t, o, c in zip(*bwt_dedup.repeated(texts, width)):
        got.setdefault(int(c), set()).add((int(t), int(o)))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, windows_of(texts, width)))


@pytest.mark.parametrize("width,group", [(3, 10), (8, 10), (20, 4), (20, 2000)])
def test_suffix_trees_against_hashing(monkeypatch, width, group):
    """Maximal repeats cover, but for their first places, just the windows that start earlier too;
    every one is as long as its places agree and not part of a longer one."""
    monkeypatch.setattr(suffix_tree, "GROUP", group)
    texts = some_texts(np.int64, width, width + group)
    found = {}
    for t, o, c, n in zip(*suffix_tree.maximal_repeats(texts, width)):
        found.setdefault(int(c), []).append((int(t), int(o), int(n)))
    got, want = set(), set()
    for places in found.values():
        n = places[0][2]
        content = {texts[t][o:o + n].tobytes() for t, o, _ in places}
        assert n >= width and len(places) > 1 and len(content) == 1 and {m for _, _, m in places} == {n}
        after = {tuple(texts[t][o + n:o + n + 1]) or (t, "end") for t, o, _ in places}
        before = {tuple(texts[t][o - 1:o]) if o else (t, "start") for t, o, _ in places}
        assert len(after) > 1 and len(before) > 1
        got |= {(t, o + i) for t, o, _ in sorted(places)[1:] for i in range(n)}
    for places in windows_of(texts, width):
        want |= {(t, o + i) for t, o in sorted(places)[1:] for i in range(width)}
    assert got == want
    joined = suffix_tree.Joined(texts)
    parts = list(suffix_tree.groups(joined, np.flatnonzero(joined.left >= width), width, group))
    assert group > 1000 or width < 8 or len({d for d, _ in parts}) > 1  # prefixes of several lengths


def test_merged_order_is_the_suffix_order():
    rng = np.random.default_rng(9)
    texts = [np.array(rng.integers(97, 99, n), np.uint8) for n in rng.integers(1, 30, 12)]
    shards = [bwt_dedup.Shard(texts[a:a + 4], a) for a in (0, 4, 8)]
    z, _, prefix = bwt_dedup.merge(shards, 64)
    seen, order = [0] * 3, []
    for s in z:
        t, o, _ = shards[s].places(np.array([seen[s]]))
        seen[s] += 1
        order.append((int(t[0]), int(o[0])))
    want = sorted(((i, a) for i, x in enumerate(texts) for a in range(len(x) + 1)),
                  key=lambda p: (texts[p[0]][p[1]:].tobytes(), p[0]))
    assert order == want
    for (a, b), (c, d), k in zip(want, want[1:], prefix[1:]):
        x, y = texts[a][b:].tobytes(), texts[c][d:].tobytes()
        assert k == next((i for i, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))


# ---------------------------------------------------------------- op3

def test_language(spark, docs, rows, empty):
    out = langid.identify(docs).collect()
    assert len(out) == len(rows)
    known = {r.lang for r in docs.select("lang").distinct().collect()} - {None}
    text = {i: t for i, t in rows}
    for r in out:
        assert r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1
        has = any(c.isalpha() for c in text[r.doc_id] or "")
        assert (r.lang_pred in known) if has else (r.lang_pred == "und" and r.rejected and r.score == 0)
    assert langid.identify(empty).count() == 0
    kept = langid.drop_rejected(docs)
    assert kept.columns == docs.columns
    gone = sorted(r.doc_id for r in out if r.rejected and r.doc_id is not None)
    assert sorted(r.doc_id for r in docs.select("doc_id").subtract(kept.select("doc_id")).collect()) == sorted(set(gone))


def test_language_held_out_accuracy(spark):
    d = table(spark, "/root/testdata/sf0.1", "documents")
    model = langid.fit(d)
    out = langid.predict(d, model, ["doc_id", "lang"]).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    right, n, rejected = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"),
                                 F.avg(F.col("rejected").cast("int"))).first()
    assert right > 0.97 and rejected < 0.005


def test_language_counts_do_not_depend_on_chunks(monkeypatch):
    text = "Größe und Maß -- 12 été, " * 50
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "CHUNK", 97)
    cut = langid.counts(text)
    assert whole[1] == cut[1] and np.abs(whole[0] - cut[0]).sum() < 0.02 * whole[0].sum()


# ---------------------------------------------------------------- op4

def test_mix_over_groups_of_shards(spark, monkeypatch):
    """A source of many groups of shards: totals come near the targets, no document beyond twice its size."""
    monkeypatch.setattr(mixing, "FAN", 3)
    d = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("en").alias("lang"),
                                 F.when(F.col("id") % 7 > 0, F.lit("a")).otherwise(F.lit("b")).alias("source"),
                                 F.repeat(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" ")), (F.col("id") % 40).cast("int")).alias("text"))
    out = mixing.mix(d, shard_words=2000).collect()
    assert len(out) == 3000 and all(0 <= r.taken <= 2 * r.size for r in out)
    for source in "ab":
        mine = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) < 0.01 * mine[0].target
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(d.repartition(5), shard_words=2000).collect()), key=str)


def test_mix_matches_sql_and_targets(spark, docs, empty):
    con = duck_connect(SF)
    con.register("edge", docs.select("doc_id", "text", "source").toArrow())
    for block, shard in ((16, 250_000), (5, 900)):
        ok, msg = compare(mixing.mix(docs, block_words=block, shard_words=shard), con,
                          mixing.oracle(block_words=block, shard_words=shard, table="edge"))
        assert ok, msg
    out = mixing.mix(docs).collect()
    assert sorted(map(key, out)) == sorted(map(key, mixing.mix(docs.repartition(7)).collect()))
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    total, per = sum(r.size for r in out), Counter()
    for r in out:
        per[r.source] += r.taken
    goal = {r.source: r.target for r in out}
    assert sum(goal.values()) == pytest.approx(1.5 * total)
    assert all(abs(per[s] - t) <= 40 for s, t in goal.items())
    assert mixing.mix(empty).count() == 0


def test_apportion_is_sainte_lague(spark):
    rng = np.random.default_rng(2)
    w = [float(x) for x in rng.integers(1, 1000, 30)]
    for seats in (1, 7, 200):
        got = mixing.apportion(frame(spark, [(i, x, seats, 10 ** 6) for i, x in enumerate(w)],
                                     "name int, weight double, seats long, most long"), [], ["name"]).collect()
        best = sorted(((-x / (2 * k - 1), i) for i, x in enumerate(w) for k in range(1, seats + 1)))[:seats]
        assert Counter(i for _, i in best) == Counter({r.name: r.quota for r in got if r.quota})


# ---------------------------------------------------------------- op5

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(t):
    a = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
    k = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    h = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return a, k, h


def test_secrets(spark, docs, rows, empty):
    rng = np.random.default_rng(4)
    blob = "".join(rng.choice(list("ABCDEFGHabcdefghijklmnop0123456789+/QRSTUVWXYZqrstuvwxyzIJKLMNOP"), 44))
    more = frame(spark, [
        (8001, '\U0001F600 token="abcdefgh12" x secret: token : abcdefghij API_KEY=A1.b2_c3-d4 AKIAABCDEFGHIJKL', None, None, 0),
        (8002, "é" * 9 + "deadbeef" * 5 + ' passwd= "short" Password:12345678', None, None, 0),
        (8003, f"key {blob} done " * 2, None, None, 0), (8004, "a" * 40 + "1 ordinary" + "ly" * 30 + "2", None, None, 0)])
    out = secret_scan.scan(docs.select(*more.columns).unionByName(more)).collect()
    text = {**dict(rows), **{r.doc_id: r.text for r in more.collect()}}
    for r in out:
        if r.doc_id == 7007:
            continue
        a, k, h = base_spans(text[r.doc_id] or "")
        base = ",".join(f"{secret_scan.KINDS[x]}:{s}:{e}" for s, x, e in sorted(a + k + h))
        assert (r.n_assign, r.n_access, r.n_hex) == (len(a), len(k), len(h)), r.doc_id
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    spans = {r.doc_id: r.spans for r in out}
    assert spans[8003].count("random") == 2 and "random" not in spans[8004]
    assert secret_scan.scan(empty).count() == 0


def test_secrets_glued_to_names(spark):
    rng = np.random.default_rng(11)
    base62 = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")

    def random(n, more=""):
        return "".join(rng.choice(base62 + list(more), n - 2)) + "7k"
    shapes = [("export AWS_SECRET_ACCESS_KEY=", random(40, "+/"), ""), ("session=", random(28), "; path"),
              ("GET https://host/x?auth=", random(32), "&b=1"), ("see files/a_b/", random(32), " there"),
              ("long_name-of_a_key/", random(30, "-_"), "=="), ("A=b=c=", random(32), "=/etc/some_path"),
              ("/srv/data/files/of/that/user/", random(28), "/and/some/other/folder/of/words"), ("blank ", random(32), " end")]
    d = frame(spark, [(i, a + t + z, None, None, 0) for i, (a, t, z) in enumerate(shapes)]
              + [(99, "a_long_name/of-some_thing/in=the_configuration/file-of_words/" * 3, None, None, 0)])
    for r in secret_scan.scan(d).collect():
        spans = [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("random")]
        if r.doc_id == 99:
            assert not spans
            continue
        a, t, _ = shapes[r.doc_id]
        assert len(spans) == 1 and spans[0][0] <= len(a) and len(a) + len(t) <= spans[0][1], (a, r.spans)
        assert spans[0][0] == len(a) or r.doc_id in (3, 4, 6), (a, r.spans)  # these may hold a piece of the path
    clean = {r.doc_id: r.text for r in secret_scan.redact(d).collect()}
    assert clean[1] == "session=[secret]; path" and clean[2] == "GET https://host/x?auth=[secret]&b=1"


def test_secrets_of_letters_or_digits_only(spark):
    rng = np.random.default_rng(12)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    keys = {i: "".join(rng.choice(list(a), n)) for i, (a, n) in enumerate(
        [(lower, 48), (upper, 48), (lower + upper, 32), (digits, 31), (lower + upper, 40), (upper + "234567", 48)])}
    plain = {20: lower + lower, 21: "=" * 30 + "-" * 30 + "_" * 30, 22: "z" * 40, 23: "0" * 31,
             24: "internationalisationcommitteerepresentatives"}
    d = frame(spark, [(i, f"one {t} two", None, None, 0) for i, t in (keys | plain).items()])
    got = {r.doc_id: r.spans for r in secret_scan.scan(d).collect()}
    assert got == {i: f"random:4:{4 + len(t)}" for i, t in keys.items()} | {i: "" for i in plain}


def test_redaction(spark, docs, empty):
    d = frame(spark, [(1, "x token=abcdefgh12 y " + "0123456789abcdef" * 2, "en", "s", 53), (2, "clean", "en", "s", 5),
                      (3, None, None, None, None), (4, "token=" + "0123456789abcdef" * 2, "en", "s", 38)]).withColumn("a", F.lit(1))
    got = {r.doc_id: r for r in secret_scan.redact(d).collect()}
    assert got[1].text == "x [secret] y [secret]" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "clean" and got[3].text is None and got[4].text == "[secret]" and got[2].a == 1
    assert secret_scan.redact(empty).columns == empty.columns


# ---------------------------------------------------------------- op7

def test_lattice_sums_all_segmentations():
    p = {b" ": .1, b"a": .2, b"b": .2, b" a": .1, b"ab": .3, b" ab": .1}
    lat = lattice_lm.Lattice(list(p), np.log(list(p.values())))

    def brute(t):
        return 1.0 if not t else sum(v * brute(t[len(k):]) for k, v in p.items() if t.startswith(k))
    words = [b"ab", b"abab", b"ba", b"aabbab", b""]
    assert np.exp(lat.words(words)) == pytest.approx([brute(b" " + w) for w in words])
    long = b"abba" * 100
    text = np.frombuffer(b" " + long, np.uint8)[None]
    one, many = np.zeros(6), np.zeros(6)
    assert lat.long_word(long, 2.0, one) == pytest.approx(lat.forward(text)[-1][0])
    lat.expected(text, np.array([2.0]), many)
    assert one == pytest.approx(many)


def test_lm_scores(spark, docs, rows, empty):
    out = lattice_lm.score(docs, top=50).collect()
    count, end = Counter(), "<end>"
    for i, t in rows:
        if crc(i, 10):
            count.update((t or "").encode().lower().split())
            count[end] += 1
    n, v = sum(count.values()), len(count)
    norm = math.log10(n + .1 * (v + 1))
    text = {i: (t or "").encode().lower().split() + [end] for i, t in rows if i != 7007}
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (crc(r.doc_id, 10) == 0) and r.train_tokens == n
        if r.doc_id == 7007:
            continue
        w = text[r.doc_id]
        assert (r.n_tokens, r.n_known) == (len(w), sum(count[x] > 0 for x in w))
        assert r.base_score == pytest.approx(sum(math.log10(count[x] + .1) - norm for x in w))
        assert r.score < 0 and math.isfinite(r.score)
    assert lattice_lm.score(empty).count() == 0


# ---------------------------------------------------------------- op8

def brute_fp(t):
    import xxhash

    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    ones = [sum(xxhash.xxh64(g, seed=42).intdigest() >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def brute_components(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in nodes}


def test_simhash(docs, rows, empty):
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    fps = {}
    for i, t in rows:
        fps.setdefault(brute_fp(t), []).append(i)
    comp = brute_components(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 3)
    low = {}
    for f, ids in fps.items():
        known = [i for i in [*ids, low.get(comp[f])] if i is not None]
        low[comp[f]] = min(known, default=None)
    want = sorted(((i, format(f, "016x"), low[comp[f]]) for f, ids in fps.items() for i in ids), key=key)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in out], key=key) == want
    kept = simhash.first_of_groups(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(comp.values()))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.first_of_groups(empty).count() == 0


def test_simhash_sends_nothing_through_the_driver(spark):
    links = simhash.links(frame(spark, [(i * 2654435761,) for i in range(200)], "fp long"))
    links.collect()
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()


def test_simhash_links_meet_at_three_bits(spark):
    rng = np.random.default_rng(8)
    base = [int(x) for x in rng.integers(-2 ** 62, 2 ** 62, 15)]
    near = [b ^ sum(1 << int(k) for k in rng.choice(62, n, replace=False)) for b in base for n in (1, 2, 3, 4)]
    every = sorted(set(base + near))
    got = {(r.a, r.b) for r in simhash.links(frame(spark, [(x,) for x in every], "fp long")).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a, b in itertools.combinations(every, 2) if ((a ^ b) & mask).bit_count() <= 3}


def test_components(spark):
    rng = np.random.default_rng(6)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 150, (110, 2))] + [(i, i + 1) for i in range(200, 260)]
    got = {r.u: r.root for r in components(frame(spark, e, "u long, v long")).collect()}
    pairs = {frozenset(x) for x in e}
    want = brute_components(sorted({x for p in e for x in p}), lambda a, b: frozenset((a, b)) in pairs)
    assert got == {k: v for k, v in want.items() if k != v}


# ---------------------------------------------------------------- op9

def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    vec = [b + 0.09 * rng.normal(size=16) for b in base for _ in range(8)] + [base[0]] * 5 + [-base[1], base[2] * 3]
    data = [(i, [float(np.float32(x)) for x in v], int(i % 2)) for i, v in enumerate(vec)]
    data += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0] * 15 + [None], 1),
             (904, data[0][1], None), (905, [float("inf")] * 16, 0), (906, data[3][1][:8], 1), (907, data[3][1][:8], 1),
             (908, data[4][1], 0), (908, data[4][1], 0), (None, data[5][1], 1)]
    d = frame(spark, data, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit("k"))
    ok = [(n, i, np.array(v, float), lab) for n, (i, v, lab) in enumerate(data) if lab is not None and v
          and None not in v and np.isfinite(v).all() and any(v)]
    links = {}
    for (m, i, a, x), (n, j, b, y) in itertools.combinations(ok, 2):
        if x == y and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.98:
            links.setdefault(m, set()).add(n)
            links.setdefault(n, set()).add(m)
    comp = brute_components(range(len(data)), lambda m, n: n in links.get(m, ()))
    low = {}
    for n, r in comp.items():
        if data[n][0] is not None:
            low[r] = min(low.get(r, 10 ** 9), data[n][0])
    want = sorted(((data[n][0], len(links.get(n, ())), low.get(comp[n]), data[n][0] == low.get(comp[n]))
                   for n in range(len(data))), key=key)
    for block in (2048, 7):
        out = embed_dedup.near_duplicates(d, block_rows=block).collect()
        assert sorted([tuple(r) for r in out], key=key) == want
    assert sum(w[1] for w in want) > 50
    assert embed_dedup.near_duplicates(d.limit(0)).count() == 0


def test_int8_bound_is_rigorous():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 24)) * rng.exponential(size=(200, 1))
    q, s, e = embed_dedup._unit_codes(x)
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    gap = np.abs(u @ u.T - (s[:, None] * q.astype(float)) @ (s[:, None] * q.astype(float)).T)
    assert (gap <= e[:, None] + e[None, :] + e[:, None] * e[None, :]).all()


# ---------------------------------------------------------------- op10

def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return int(h.max())


def test_words_do_not_depend_on_blocks(monkeypatch):
    buf = np.frombuffer("a, ..b!! (Cé) --- x1 \t##d## e".encode() * 30, np.uint8)
    off = np.array([0, 11, len(buf)])
    whole = decontam.words(buf, off)
    monkeypatch.setattr(decontam, "SLICE", 7)
    cut = decontam.words(buf, off)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all() and len(whole[0]) > 100


def test_alignment():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = (rng.integers(0, 4, rng.integers(1, 15)).astype(np.uint64) for _ in range(2))
        assert decontam.align(a, b) == brute_align(a, b)


def test_decontamination(spark, docs, rows, empty):
    bench = table(spark, SF, "benchmark")
    item = bench.orderBy("item_id").first().text
    w = item.split()
    edited = [x if i % 6 else "changed" for i, x in enumerate(w)]
    more = frame(spark, [(9001, "before it all " + " ".join(edited) + " after", None, None, 0), (9002, "### " + item.upper(), None, None, 0),
                         (9003, " ".join(w[:3]), None, None, 0)])
    d = docs.select(*more.columns).unionByName(more)
    text = [(r.doc_id, r.text) for r in d.collect()]
    odd = frame(spark, [(501, None), (502, ""), (503, "tiny one"), (503, "tiny one")], "item_id long, text string")
    out = decontam.contaminated(d, bench.unionByName(odd))
    got = {(r.doc_id, r.item_id) for r in out.collect()}

    def words(t):
        t = np.frombuffer((t or "").encode(), np.uint8)
        return decontam.words(t, np.array([0, len(t)]))[0]
    want = set()
    for b in bench.collect():
        x = words(b.text)
        for i, t in text:
            y = words(t)
            if np.isin(x, y).sum() >= len(x) / 2 and decontam.align(x, y) >= len(x):
                want.add((i, b.item_id))
    first = bench.orderBy("item_id").first().item_id
    assert {(9001, first), (9002, first)} <= got and got == want
    assert decontam.contaminated(d, bench, block_items=3).select("doc_id", "item_id").distinct().count() == len(want)
    kept = decontam.drop_contaminated(d, bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in text} - {i for i, _ in want}
    shared = frame(spark, [(None, item, None, None, 0), (None, "a clean text without id", None, None, 0), (5, "clean", None, None, 0),
                           (5, item, "en", None, 0), (5, item, "en", None, 0), (5, None, None, None, 0)])
    assert sorted(r.text or "" for r in decontam.drop_contaminated(shared, bench).collect()) == ["", "a clean text without id", "clean"]
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(d, bench.limit(0)).count() == 0


def test_edited_copies_in_many_documents(spark):
    w = [f"word{i}" for i in range(40)]
    keep = lambda hold: " ".join(x if hold(i) else f"other{i}" for i, x in enumerate(w))
    texts = {i: f"Text {i} begins. " + keep(lambda i: i % 5) + f" Text {i} ends." for i in range(150)}
    texts[150] = "whole " + " ".join(w)  # the grams that the edits broke are rare, not missing
    texts[151] = "most " + keep(lambda i: i % 5 or i > 20)
    texts |= {i: " ".join(w[5:8]) + f" phrase of text {i}" for i in range(200, 400)}
    texts[400] = " ".join(f"{x} more{i}" for i, x in enumerate(w[:-3])) + " " + " ".join(w[-3:])  # insertions before the seed
    bench = frame(spark, [(1, " ".join(w)), (2, "nothing like it anywhere here")], "item_id long, text string")
    d = frame(spark, list(texts.items()), "doc_id long, text string")
    for docs in (d, d.where("doc_id < 150")):
        got = {r.doc_id: r.align_score for r in decontam.contaminated(docs, bench).collect()}
        want = {i: decontam.align(*(decontam.words(b := np.frombuffer(t.encode(), np.uint8), np.array([0, len(b)]))[0]
                                    for t in (" ".join(w), texts[i]))) for i in (r.doc_id for r in docs.collect())}
        assert got == {i: s for i, s in want.items() if s >= 40} and set(range(150)) <= set(got)


def test_windows_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    items = [(i, x, decontam.grams(x, np.zeros(len(x), np.int64))[0], 3) for i, x in
             enumerate(rng.integers(0, 5, m).astype(np.uint64) for m in (4, 9, 20))]
    h, d = rng.integers(0, 9, 3000).astype(np.uint64), np.repeat([0, 1, 3, 4], [5, 95, 2400, 500])
    edges, size = np.searchsorted(d, np.arange(6)), np.array([4, 9, 20])
    pairs = np.unique(np.concatenate([x.astype(np.int64) * 3 + i for i, x, _, _ in items]))

    def run():
        cover, best = set(), Counter()
        for w in decontam._windows(h, d, edges, 3, decontam._index(items)[3], size):
            k, t, s, e = decontam._pieces(*w, size)
            top = decontam._bounds(h.astype(np.int64), pairs, 3, k, s, e)
            for i, j, a, z, b in zip(k.tolist(), t.tolist(), s.tolist(), e.tolist(), top.tolist()):
                score = decontam.align(items[i][1], h[a:z])
                assert b >= score and (d[a:z] == j).all()
                cover |= {(i, x) for x in range(a, z)}
                best[i, j] = max(best[i, j], score)
        return cover, best
    whole = run()
    monkeypatch.setattr(decontam, "HITS", 7)
    assert run() == whole and len(whole[1]) > 6


def test_long_passage_of_a_longer_item(spark):
    w = [f"word{i}" for i in range(59)]
    bench = frame(spark, [(1, " ".join(w))], "item_id long, text string")
    d = frame(spark, [(n, "before it " + " ".join(w[20:20 + n]) + " and after") for n in (12, 13, 25)], "doc_id long, text string")
    assert {r.doc_id: r.align_score for r in decontam.contaminated(d, bench).collect()} == {13: 26, 25: 50}


def test_long_texts_with_very_many_matches(spark):
    """A megabyte of hex letters with one key, and of short assignments: linear in the text."""
    import time

    prose = "bead cafe " * 50_000 + "0123456789abcdef" * 2 + " face " * 80_000
    short = "token=a " * 60_000 + "token=abcdefgh1 " + "AKIA1 " * 40_000 + "AKIA" + "Z" * 12
    d = frame(spark, [(1, prose, None, None, 0), (2, short, None, None, 0)])
    secret_scan.scan(d.limit(1).withColumn("text", F.lit("warm"))).collect()
    t = time.time()
    got = {r.doc_id: r for r in secret_scan.scan(d).collect()}
    assert time.time() - t < 60
    assert (got[1].n_hex, got[2].n_assign, got[2].n_access) == (1, 1, 1)
    at = short.index("token=abcdefgh1")
    want = f"assign:{at}:{at + 15},access:{len(short) - 16}:{len(short)}"
    assert got[2].base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_offsets_in_blocks(spark):
    values = [list(range(n)) for n in (0, 1, 5, 127, 128, 129, 1000)]
    d = spark.createDataFrame([(v,) for v in values], "v array<int>")
    for r in d.select("v", secret_scan._offsets(F.col("v")).alias("o")).collect():
        assert r.o == [sum(r.v[:i]) for i in range(len(r.v))]
