"""Quality rules with risk-controlled thresholds.

A rule is a ratio of two counts of a text, in percent, that is high in poor texts; it
rejects a document at or above a cutoff.  Cutoffs are not set by hand: for every
stratum (language) they are the strictest of a fixed grid for which labelled good
documents prove that few good ones are lost.

* Holdout: documents that ``labels`` calls good (quality 1; where an id has several
  labels, all of them) and that pass the base rules, per stratum.
* Test: rule r at cutoff c rejects k of the stratum's n good ones.  The hypothesis "its
  false rejection rate is above ``alpha`` / number of rules" has the exact binomial
  p-value P(Bin(n, alpha / rules) <= k); a p-value at or below d is the same as a
  Clopper-Pearson upper bound at level 1 - d at or below the rate.
* Correction: Holm's step-down over all (rule, cutoff) tests of a stratum, at
  ``delta`` / number of strata.

So with probability 1 - ``delta`` over the labels, every stratum loses at most ``alpha`` of
its good documents (that pass the base rules) by all rules together.  A stratum with
too few labels for any proof gets no cutoff and keeps all its documents.

Only DataFrame functions are used.  Counts of a text come from one pass without a
shuffle; labelled documents are counted per (id, stratum, steps) before they meet the labels,
so an id that holds a third of all rows is few rows in the join.

Defined cases: a null text is empty (no words, base rules failed); a null language is a
stratum of its own; documents without a label or with a null id are not in the
holdout but get a verdict; repeated rows are separate documents; empty tables (also
empty labels: no cutoffs) give results with no rows or base verdicts only; columns
other than doc_id, text, the stratum, and labels' doc_id and quality are ignored."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtstats.llm.common import SPACE, materialise

BLANK = " \t\n\x0b\x0c\r"
# fixed values: the contract's symbols and base limits
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT, WINDOW = 10, 20, 5

#: rule -> (count, of, cutoffs in percent, the strictest first)
RULES = {
    "symbols": ("n_symbols", "n_words", (1, 2, 3, 5, 8, 12, 20, 30, 40, 50, 75, 100)),
    "repeats": ("n_repeat_words", "n_words", (1, 2, 3, 4, 5, 6, 8, 10, 12, 14, 16, 18)),
    "lines": ("n_dup_lines", "n_lines", (5, 10, 15, 20, 25, 30, 35, 40, 50, 60, 70, 80)),
    "capitals": ("n_capitals", "word_chars", (4, 6, 8, 10, 15, 20, 25, 30, 40, 50, 60, 80)),
    "marks": ("n_marks", "n_words", (1, 2, 3, 5, 8, 12, 20, 30, 40, 50, 75, 100)),
    "length": ("word_chars", "n_words", (750, 800, 850, 900, 950, 1000, 1100, 1200, 1300, 1400, 1600, 2000)),
}
ALPHA, DELTA = 0.05, 0.05
#: more strata than this are joined, not broadcast
MAX_BROADCAST, SALTS = 10_000, 32
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, letters: str) -> Column:
    return F.length(F.translate(text, letters, ""))


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of their texts (longs): n_words, word_chars, n_symbols,
    n_lines, n_dup_lines, n_repeat_words, n_capitals, n_marks; the text goes."""
    t = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(t, F.lit(BLANK))
    d = docs.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("_w")
    d = d.select(
        *[c for c in docs.columns if c != "text"], n.alias("n_words"), _without(t, BLANK).alias("word_chars"),
        (F.length(t) - _without(t, SYMBOLS)).alias("n_symbols"), lines.alias("_l"),
        (F.length(t) - _without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_capitals"),
        (F.length(t) - _without(t, "!?")).alias("n_marks"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))),
                                        lambda i: F.xxhash64(F.slice("_w", i, F.lit(WINDOW)))))
        .otherwise(F.array().cast("array<bigint>")).alias("_h"))
    # windows of texts that repeat one, in order of their hash: equal ones are neighbours
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform(
        "_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter(F.transform("_s", lambda e, i: F.when(
        (e["h"] == F.get("_s", i - 1)["h"]) | (e["h"] == F.get("_s", i + 1)["h"]), e["i"])), lambda i: i.isNotNull())
    d = d.withColumn("_p", F.sort_array(again))
    covered = F.aggregate("_p", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda acc, p: F.struct(
        (p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n")), lambda acc: acc["n"])
    long = {"n_lines": F.size("_l"), "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
            "n_repeat_words": F.coalesce(covered, F.lit(0))}
    long |= {c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_capitals", "n_marks")}
    return d.withColumns({c: x.cast("long") for c, x in long.items()}).drop("_l", "_h", "_s", "_p")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def _step(rule: str) -> Column:
    """How many cutoffs of the rule the document meets."""
    x, y, cutoffs = RULES[rule]
    met = [F.when((F.col(y) > 0) & (100 * F.col(x) >= c * F.col(y)), 1).otherwise(0) for c in cutoffs]
    return sum(met[1:], met[0])


def _log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series at x + 9."""
    z = x + 9
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) \
        + 1 / (1260 * F.pow(z, 5))
    return series - sum([F.log(x + i) for i in range(2, 9)], F.log(x + 1))


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k); 1 where k is at or above the mean (the value is about a
    half or more there).  Terms are summed from the k-th downwards until they no longer count."""
    k, n = k.cast("double"), n.cast("double")
    last = (_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(rate)
            + (n - k) * math.log1p(-rate))
    steps = F.least(k, F.lit(60) + 12 * F.sqrt(n * rate)).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), steps), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda acc, j: F.struct((acc["t"] * (k - j) / (n - k + j + 1) * ((1 - rate) / rate)).alias("t"),
                                (acc["s"] + acc["t"]).alias("s")), lambda acc: acc["s"])
    return F.when(k < n * rate, F.exp(last) * total).otherwise(F.lit(1.0))


def cutoffs(counted: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA,
            delta: float = DELTA) -> DataFrame:
    """One row per (stratum, rule) that has a proven cutoff: stratum, rule, cutoff
    (percent, the strictest proven), n_good, n_lost (good ones it rejects)."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("_q")).where("_q = 1").select(F.col("doc_id").alias("_id"))
    names = list(RULES)
    few = (counted.where(~base_failed()).groupBy("doc_id", F.col(stratum).alias("stratum"), *[_step(r).alias(r) for r in names])
           .agg(F.count("*").alias("_n")))
    few = few.join(good, few["doc_id"] == good["_id"], "left_semi")
    long = few.select("stratum", "_n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in names]))
                      .alias("x")).groupBy("stratum", "x.rule", "x.step").agg(F.sum("_n").alias("n"))
    seen = materialise(long, "quality")  # strata x rules x steps
    strata = seen.select("stratum").distinct().count()
    size = max(len(c) for _, _, c in RULES.values())
    grid = F.explode(F.sequence(F.lit(1), F.lit(size))).alias("at")  # cutoff number `at` rejects steps >= at
    lost = (seen.groupBy("stratum", "rule").agg(F.sum("n").alias("n_good"), F.collect_list(F.struct("step", "n")).alias("_s"))
            .select("stratum", "rule", "n_good", "_s", grid)
            .withColumn("n_lost", F.aggregate(F.filter("_s", lambda s: s["step"] >= F.col("at")), F.lit(0).cast("long"),
                                              lambda a, s: a + s["n"])).drop("_s"))
    tests = lost.withColumn("p", binomial_tail(F.col("n_lost"), F.col("n_good"), alpha / len(RULES)))
    # Holm: the i-th smallest p-value of m times (m - i + 1), and all before it, within the level
    w = Window.partitionBy("stratum").orderBy("p", "rule", F.col("at").desc())
    m = sum(len(c) for _, _, c in RULES.values())
    tests = tests.withColumn("_i", F.row_number().over(w)).withColumn("_h", F.col("p") * (m + 1 - F.col("_i")))
    proven = tests.withColumn("_h", F.max("_h").over(w.rowsBetween(Window.unboundedPreceding, 0))) \
                  .where(F.col("_h") <= delta / max(strata, 1))
    # a rule's steps count its cutoffs from the strictest
    value = F.element_at(F.element_at(F.create_map(*[x for r in names for x in (
        F.lit(r), F.array(*[F.lit(c) for c in RULES[r][2]]))]), F.col("rule")), F.col("at"))
    return (proven.withColumn("cutoff", value).groupBy("stratum", "rule")
            .agg(F.min(F.struct("cutoff", "n_good", "n_lost")).alias("_b")).select("stratum", "rule", "_b.*"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document: doc_id, the stratum, the counts, base_failed, kept, and
    failed_rules (array of rule names, empty where none or the base rules failed)."""
    stats = materialise(counts(docs.select("doc_id", "text", stratum)), "quality")
    found = materialise(cutoffs(stats, labels, stratum, alpha, delta), "quality")
    limits = found.groupBy(F.col("stratum").alias("_stratum")).agg(
        *[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias("_c_" + r) for r in RULES])
    on = F.col(stratum).eqNullSafe(F.col("_stratum"))
    if found.count() <= MAX_BROADCAST:
        d = stats.join(F.broadcast(limits), on, "left")
    else:  # a stratum of a third of all rows is spread over SALTS
        limits = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        d = stats.withColumn("_part", F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(SALTS)).cast("int"))
        d = d.join(limits, on & (F.col("_part") == F.col("_salt")), "left")
    fails = [F.when((F.col(y) > 0) & (100 * F.col(x) >= F.col("_c_" + r) * F.col(y)), F.lit(r)) for r, (x, y, _) in RULES.items()]
    d = d.withColumn("base_failed", base_failed()).withColumn(
        "failed_rules", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*fails))))
    return d.select("doc_id", stratum, *COUNTS, "base_failed",
                    (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules")


def oracle(alpha: float = ALPHA, delta: float = DELTA) -> str:
    """The same in DuckDB SQL."""
    m = sum(len(c) for _, _, c in RULES.values())
    rate = alpha / len(RULES)
    step = ",\n".join(
        f"SELECT rid, doc_id, lang, '{r}' AS rule, " + " + ".join(
            f"CASE WHEN {y} > 0 AND 100 * {x} >= {c} * {y} THEN 1 ELSE 0 END" for c in cs) + f" AS step, {x} AS x, {y} AS y FROM base"
        for r, (x, y, cs) in RULES.items()).replace(",\nSELECT", "\nUNION ALL SELECT")
    values = ", ".join(f"('{r}', {i + 1}, {c})" for r, (_, _, cs) in RULES.items() for i, c in enumerate(cs))
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM t),
u AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
win AS (
  SELECT rid, pos, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN concat_ws(' ', word, lead(word, 1) OVER o,
         lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) END AS win
  FROM u WINDOW o AS (PARTITION BY rid ORDER BY pos)),
twice AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, win) AS n FROM win WHERE win IS NOT NULL),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(pos, pos + 5)) AS p FROM twice WHERE n > 1) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
base AS (
  SELECT t.rid, doc_id, lang, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals,
    len(regexp_extract_all(text, '[!?]')) AS n_marks,
    len(words) < {MIN_WORDS} OR 100 * coalesce(rep.n, 0) > {MAX_REPEAT} * len(words) AS base_failed
  FROM t JOIN w USING (rid) JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
steps AS ({step}),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
seen AS (SELECT lang, rule, step, x FROM steps JOIN (SELECT rid FROM base WHERE NOT base_failed) b USING (rid) WHERE doc_id IN (SELECT doc_id FROM good)),
grid(rule, nth, cutoff) AS (VALUES {values}),
tests AS (
  SELECT lang, rule, nth, cutoff, count(*) AS n, CAST(count_if(step >= nth) AS BIGINT) AS k FROM seen JOIN grid USING (rule) GROUP BY ALL),
pvals AS (
  SELECT *, CASE WHEN k < n * {rate!r} THEN list_sum(list_transform(range(0, k + 1), lambda i:
      exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate!r}) + (n - i) * ln(1 - {rate!r})))) ELSE 1 END AS p
  FROM tests),
holm AS (
  SELECT *, max(h) OVER (PARTITION BY lang ORDER BY i) AS worst FROM (
    SELECT *, p * ({m} + 1 - row_number() OVER o) AS h, row_number() OVER o AS i
    FROM pvals WINDOW o AS (PARTITION BY lang ORDER BY p, rule, nth DESC))),
limits AS (
  SELECT lang, rule, min(cutoff) AS cutoff FROM holm
  WHERE worst <= {delta!r} / (SELECT count(DISTINCT coalesce('l' || lang, 'none')) FROM seen) GROUP BY lang, rule),
bad AS (
  SELECT DISTINCT s.rid FROM steps s JOIN limits l ON l.rule = s.rule AND l.lang IS NOT DISTINCT FROM s.lang
  WHERE s.y > 0 AND 100 * s.x >= l.cutoff * s.y)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND bad.rid IS NULL AS kept
FROM base LEFT JOIN bad USING (rid)"""
