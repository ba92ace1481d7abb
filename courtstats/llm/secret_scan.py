"""Secret scan: three base patterns plus a randomness test battery.

Base kinds are found leftmost and non-overlapping per kind: ``assign``
(keyword, separator, value), ``access`` (AKIA...) and ``hex`` runs; matches that
are too short are dropped after matching.  The battery adds kind ``random``: pieces
of 20 or more key characters whose encoding is inferred (decimal, letters of one
case or of both, hex, base32, base36, base62, base64) and which

* pass three tests of uniform randomness over that alphabet -- chi-squared
  frequency, Wald-Wolfowitz runs about the alphabet's middle, lag-one serial
  correlation; the smallest of the three p-values times three is at least ``pass_p``;
* are discoveries against ordinary text: under text whose characters repeat with
  rate ``text_repeat`` the chi-squared statistic has a mean and spread that grow with
  the length, and the lower-tail p-values of all candidates of the table go through
  Benjamini-Hochberg at ``fdr`` (on a grid of 1/20 decades, each rounded up, so never
  less strict).

A run of key characters is tested in its maximal pieces of one encoding: '=' ends a piece,
and where there are '/', '+', '_' or '-', the pieces of base64, of URL-safe base64 and of
letters and digits alone are each a test (equal ones once).  So a key glued to a name or
a path is tested by itself.  Of found pieces inside one another the longest counts.

Only DataFrame functions are used.  Offsets are code points, ends exclusive.

Defined cases: a null text is an empty text (no spans, hash of the empty text);
repeated rows are separate rows and each counts as a test; an empty table
gives an empty result; columns other than doc_id and text are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtstats.llm.common import materialise

# fixed values: the base patterns, their least lengths and the alphabets
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # 16 characters and more: the class is greedy, a shorter match holds no longer one
HEX = r"[0-9a-f]{32,}"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
PIECES = (r"[A-Za-z0-9+/]{20,}=*", r"[A-Za-z0-9_-]{20,}=*", r"[A-Za-z0-9]{20,}=*")
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    (r"^[0-9]+$", DIGITS),
    (r"^[a-z]+$", LOWER),
    (r"^[A-Z]+$", UPPER),
    (r"^[A-Za-z]+$", UPPER + LOWER),
    (r"^[0-9a-f]+$", "0123456789abcdef"),
    (r"^[0-9A-F]+$", "0123456789ABCDEF"),
    (r"^[A-Z2-7]+=*$", UPPER + "234567"),
    (r"^[0-9a-z]+$", DIGITS + LOWER),
    (r"^[0-9A-Z]+$", DIGITS + UPPER),
    (r"^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    (r"^[0-9A-Za-z+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    (r"^[0-9A-Za-z_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
)

PASS_P, FDR, TEXT_REPEAT = 0.001, 0.01, 0.075
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _before(values: Column) -> Column:
    """The sum of the values before each value."""
    none = F.expr("cast(array() as array<int>)")
    return F.aggregate(values, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda acc, v: F.struct(
        (acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _offsets(values: Column, block: int = 128) -> Column:
    """As ``_before``, for long arrays: in blocks, so that little is copied (appending to
    an array copies it)."""
    def blocks(v):
        many = F.greatest(F.ceil(F.size(v) / block).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), many - 1), lambda b: F.slice(v, b * block + 1, F.lit(block)))

    def joined(parts):
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.zip_with(parts, _before(totals), lambda p, o: F.transform(_before(p), lambda x: x + o)))
    return _let(values, lambda v: _let(blocks(v), joined))


def _matches(text: Column, pattern: str, value: int = 0) -> Column:
    """All matches as structs (start, hit, val): the pieces between the matches give the
    offsets.  Rows without a match cost one failing search."""
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    vals = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else hits

    def placed(g, h, v):
        steps = F.zip_with(F.slice(g, F.lit(1), F.size(h)), h, lambda a, b: a + F.length(b))
        spots = F.zip_with(_offsets(steps), g, lambda a, b: a + b)  # one gap more than matches
        return F.transform(F.arrays_zip(F.slice(spots, F.lit(1), F.size(h)).alias("start"), h.alias("hit"), v.alias("val")),
                           lambda m: F.struct(m["start"].alias("start"), m["hit"].alias("hit"), m["val"].alias("val")))
    found = _let(F.struct(gaps.alias("g"), hits.alias("h"), vals.alias("v")), lambda x: placed(x["g"], x["h"], x["v"]))
    return F.when(text.rlike(pattern), found).otherwise(
        F.expr("cast(array() as array<struct<start:int,hit:string,val:string>>)"))


def _spans(found: Column, kind: str, field: str) -> Column:
    keep = F.filter(found, lambda m: F.length(m[field]) >= LEAST[kind])
    return F.transform(keep, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                                                (m["start"] + F.length(m["hit"])).alias("end"))).cast(SPAN)


def _upper(z: Column) -> Column:
    """Upper tail of the normal distribution (logistic form, error below 2e-4,
    a smooth decreasing tail beyond)."""
    return 1 / (1 + F.exp(1.5976 * z + 0.070565 * z * z * z))


def _candidates(text: Column) -> Column:
    """Structs (start, hit) of the candidates: runs of key characters, those with other
    characters than letters and digits as their maximal pieces of one encoding."""
    def pieces(m: Column) -> Column:
        cut = F.array_distinct(F.flatten(F.array(*[F.transform(_matches(m["hit"], p), lambda x: F.struct(
            (m["start"] + x["start"]).alias("start"), x["hit"].alias("hit"))) for p in PIECES])))
        return F.when(m["hit"].rlike("[+/_=-]"), cut).otherwise(
            F.array(F.struct(m["start"].alias("start"), m["hit"].alias("hit"))))
    return F.flatten(F.transform(_matches(text, CANDIDATE), pieces))


def battery(token: Column) -> Column:
    """Struct (fits, p0) of one candidate: ``fits``: it passes the three tests;
    ``p0``: how likely ordinary text of its length would look as uniform.  Null
    p0: not a candidate (no encoding, or neither a letter nor a digit)."""
    body = F.rtrim(token, F.lit("="))
    alphabet = None
    for pattern, letters in ENCODINGS:
        c = body.rlike(pattern)
        alphabet = F.when(c, F.lit(letters)) if alphabet is None else alphabet.when(c, F.lit(letters))
    return F.transform(F.array(F.struct(body.alias("t"), alphabet.alias("a"))), _stats)[0]


def _stats(x: Column) -> Column:
    t, a = x["t"], x["a"]
    n, k = F.length(t).cast("double"), F.length(a).cast("double")
    at = F.transform(F.split(t, ""), lambda c: F.instr(a, c))
    # chi-squared: each character adds the count of its own kind
    same = F.aggregate(F.split(t, ""), F.lit(0.0),
                       lambda s, c: s + (F.length(t) - F.length(F.replace(t, c, F.lit("")))).cast("double"))
    chi = same * k / n - n
    df = k - 1
    cube = F.pow(F.greatest(chi, F.lit(1e-9)) / df, F.lit(1 / 3))
    p1 = _upper((cube - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    pairs = F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1),
                       lambda u, v: F.struct(u.alias("u"), v.alias("v")))
    turns = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.when(
        (p["u"] > k / 2) != (p["v"] > k / 2), F.lit(1.0)).otherwise(F.lit(0.0)))
    p2 = 2 * _upper(F.abs((turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)))
    mid = (k + 1) / 2
    lag = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["u"] - mid) * (p["v"] - mid))
    p3 = 2 * _upper(F.abs(lag / ((k * k - 1) / 12) / F.sqrt(n - 1)))
    # ordinary text: characters repeat with rate r; mean and spread of the same statistic
    r = F.lit(TEXT_REPEAT)
    mean = (1 + (n - 1) * F.greatest(r, 1.5 / k)) * k - n
    sd = F.sqrt(2 * r * (1 - r) * n * (n - 1)) * k / n
    p0 = _upper((mean - chi) / sd)
    ok = a.isNotNull() & t.rlike("[0-9A-Za-z]") & (n >= 20)
    return F.struct((F.least(p1, p2, p3) * 3 >= PASS_P).alias("fits"), F.when(ok, p0).alias("p0"))


def _grid(p: Column) -> Column:
    """Step of the p-value grid: the p-value lies at or below 10 ** (-step / 20)."""
    return F.least(F.floor(-20 * F.log10(F.greatest(p, F.lit(1e-15)))), F.lit(300)).cast("int")


def _found(docs: DataFrame, keep: Column, fdr: float) -> DataFrame:
    """``keep`` as _row, base spans by kind (a, k, h), base and found."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(keep.alias("_row"),
                    _spans(_matches(text, ASSIGN, 1), "assign", "val").alias("a"),
                    _spans(_matches(text, ACCESS), "access", "hit").alias("k"),
                    _spans(_matches(text, HEX), "hex", "hit").alias("h"),
                    _candidates(text).alias("c"))
    d = d.withColumn("c", F.transform("c", lambda m: F.struct(
        m["start"].alias("start"), (m["start"] + F.length(m["hit"])).alias("end"), battery(m["hit"]).alias("b"))))
    d = materialise(d.withColumn("c", F.filter("c", lambda m: m["b"]["p0"].isNotNull())), "secrets")
    # Benjamini-Hochberg on a grid of p-values: at most 301 rows
    grid = (d.select(F.explode("c").alias("x")).groupBy(_grid(F.col("x.b.p0")).alias("g"))
            .agg(F.count("*").alias("n")))
    line = (grid.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))
            .withColumn("below", F.sum("n").over(Window.orderBy(F.col("g").desc())))
            .where(F.pow(F.lit(10.0), -F.col("g") / 20) <= fdr * F.col("below") / F.col("total"))
            .agg(F.min("g")).first()[0])  # one number
    line = F.lit(line if line is not None else 1000)
    d = d.withColumn("base", F.array_sort(F.concat("a", "k", "h")))
    extra = F.filter("c", lambda m: m["b"]["fits"] & (_grid(m["b"]["p0"]) >= line)
                     & ~F.exists("base", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
    extra = F.transform(F.array(extra), lambda x: F.filter(x, lambda m: ~F.exists(x, lambda o: (
        o["start"] <= m["start"]) & (m["end"] <= o["end"]) & (m["end"] - m["start"] < o["end"] - o["start"]))))[0]
    extra = F.transform(extra, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"),
                                                  m["end"].alias("end"))).cast(SPAN)
    return d.withColumn("found", F.array_sort(F.concat("base", extra)))


def _said(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256,
    spans (kind:start:end by start, then kind as listed, comma-joined), found
    (the spans as structs)."""
    return _found(docs, F.struct("doc_id"), fdr).select(
        "_row.doc_id", F.size("a").cast("long").alias("n_assign"), F.size("k").cast("long").alias("n_access"),
        F.size("h").cast("long").alias("n_hex"), F.sha2(_said(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _said(F.col("found")).alias("spans"), "found")


def redact(docs: DataFrame, mark: str = "[secret]", fdr: float = FDR) -> DataFrame:
    """``docs`` with every found span (overlapping ones as one) replaced by
    ``mark``; n_chars, if there, becomes the new length.  Documents without spans,
    null texts included, are unchanged."""
    d = _found(docs, F.struct(*[F.col(c) for c in docs.columns]), fdr)
    text = F.col("_row.text")

    def step(acc, s):
        gap = F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"])))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= acc["at"], gap).otherwise(acc["out"]).alias("out"))

    none = F.expr("cast(array() as array<string>)")
    clean = F.aggregate("found", F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: F.array_join(
        F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, F.length(text)))), mark))
    d = d.withColumn("_clean", F.when(F.size("found") > 0, clean))
    out = {"text": F.coalesce(F.col("_clean"), text),
           "n_chars": F.when(F.col("_clean").isNotNull(), F.length("_clean").cast("long")).otherwise(
               F.col("_row.n_chars")) if "n_chars" in docs.columns else None}
    return d.select(*[out[c].alias(c) if c in out else F.col(f"_row.{c}") for c in docs.columns])


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def oracle(fdr: float = FDR) -> str:
    """``scan`` (without ``found``) in DuckDB SQL."""
    def found(name, source, column, pattern, value=0):
        return f"""{name} AS (
  SELECT * EXCLUDE (gaps, hits, vals), hits[i] AS hit, vals[i] AS val, CAST(
    list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT) AS at0
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT * EXCLUDE ({column}), string_split_regex({column}, {_sql(pattern)}) AS gaps, regexp_extract_all({column}, {_sql(pattern)}) AS hits,
      regexp_extract_all({column}, {_sql(pattern)}, {value}) AS vals FROM {source} WHERE regexp_matches({column}, {_sql(pattern)})) x) y)"""

    def upper(z):
        return f"(1 / (1 + exp(1.5976 * ({z}) + 0.070565 * pow({z}, 3))))"
    alphabet = " ".join(f"WHEN regexp_matches(t, {_sql(p)}) THEN {_sql(a)}" for p, a in ENCODINGS)
    pieces = ",\n".join(found(f"piece{i}", "odd", "run", p) for i, p in enumerate(PIECES))
    every = " UNION ".join(f"SELECT rid, start0 + at0 AS s, hit FROM piece{i}" for i in range(len(PIECES)))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
{found("m0", "d", "x", ASSIGN, 1)},
{found("m1", "d", "x", ACCESS)},
{found("m2", "d", "x", HEX)},
base AS (
  SELECT rid, at0 AS s, 0 AS kind, at0 + length(hit) AS e FROM m0 WHERE length(val) >= {LEAST["assign"]}
  UNION ALL SELECT rid, at0, 1, at0 + length(hit) FROM m1 WHERE length(hit) >= {LEAST["access"]}
  UNION ALL SELECT rid, at0, 2, at0 + length(hit) FROM m2 WHERE length(hit) >= {LEAST["hex"]}),
{found("runs", "d", "x", CANDIDATE)},
odd AS (SELECT rid, at0 AS start0, hit AS run FROM runs WHERE regexp_matches(hit, '[+/_=-]')),
{pieces},
cand AS (SELECT rid, at0 AS s, hit FROM runs WHERE NOT regexp_matches(hit, '[+/_=-]') UNION ALL SELECT * FROM ({every}) z),
tok AS (SELECT rid, s, s + length(hit) AS e, rtrim(hit, '=') AS t FROM cand),
alpha AS (SELECT *, CASE {alphabet} END AS a, string_split(t, '') AS chars FROM tok),
nums AS (
  SELECT *, CAST(length(t) AS DOUBLE) AS n, CAST(length(a) AS DOUBLE) AS k, list_transform(chars, lambda c: instr(a, c)) AS at1
  FROM alpha WHERE a IS NOT NULL AND regexp_matches(t, '[0-9A-Za-z]') AND length(t) >= 20),
sums AS (
  SELECT *, list_sum(list_transform(chars, lambda c: length(t) - length(replace(t, c, '')))) * k / n - n AS chi, k - 1 AS df, (k + 1) / 2 AS mid,
    list_sum(list_transform(range(1, len(at1)), lambda i: CASE WHEN (at1[i] > k / 2) <> (at1[i + 1] > k / 2) THEN 1.0 ELSE 0.0 END)) AS turns,
    list_sum(list_transform(range(1, len(at1)), lambda i: (at1[i] - (k + 1) / 2) * (at1[i + 1] - (k + 1) / 2))) AS lag1
  FROM nums),
zs AS (
  SELECT *, (pow(greatest(chi, 1e-9) / df, 1.0 / 3) - (1 - 2 / (9 * df))) / sqrt(2 / (9 * df)) AS z1,
    abs((turns - (n - 1) / 2) / sqrt((n - 1) / 4)) AS z2, abs(lag1 / ((k * k - 1) / 12) / sqrt(n - 1)) AS z3,
    (((1 + (n - 1) * greatest({TEXT_REPEAT}::DOUBLE, 1.5::DOUBLE / k)) * k - n) - chi)
      / (sqrt(2 * {TEXT_REPEAT}::DOUBLE * (1 - {TEXT_REPEAT}::DOUBLE) * n * (n - 1)) * k / n) AS z0
  FROM sums),
ps AS (
  SELECT rid, s, e, least({upper("z1")}, 2 * {upper("z2")}, 2 * {upper("z3")}) * 3 >= {PASS_P} AS fits,
    CAST(least(floor(-20 * log10(greatest({upper("z0")}, 1e-15))), 300) AS INTEGER) AS g FROM zs),
grid AS (SELECT g, count(*) AS n FROM ps GROUP BY g),
line AS (
  SELECT coalesce(min(g), 1000) AS line FROM (SELECT g, sum(n) OVER () AS total, sum(n) OVER (ORDER BY g DESC) AS below FROM grid) q
  WHERE pow(10.0, -g / 20) <= {fdr!r} * below / total),
open_ AS (
  SELECT DISTINCT rid, s, e FROM ps WHERE fits AND g >= (SELECT line FROM line)
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = ps.rid AND b.s < ps.e AND ps.s < b.e)),
extra AS (
  SELECT rid, s, 3 AS kind, e FROM open_ o WHERE NOT EXISTS (
    SELECT 1 FROM open_ w WHERE w.rid = o.rid AND w.s <= o.s AND o.e <= w.e AND o.e - o.s < w.e - w.s)),
said AS (
  SELECT rid, string_agg(['assign', 'access', 'hex', 'random'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) AS spans,
    string_agg(['assign', 'access', 'hex', 'random'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS base,
    count_if(kind = 0) AS a, count_if(kind = 1) AS k, count_if(kind = 2) AS h
  FROM (SELECT * FROM base UNION ALL SELECT * FROM extra) y GROUP BY rid)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(k, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN said USING (rid)"""
