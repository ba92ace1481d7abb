"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources get weights in code-point order; the mix holds ``ratio`` times all
words; a source's target stops at ``cap`` times its size and the excess goes to
the others by weight.  Targets become integer numbers of equal blocks of
``block_words`` words by the highest quotients weight / (2k - 1): first per
source, then per group of ``FAN`` shards, then per shard.  A document's shard is a hash of
its id and its text, so rows that share an id are spread.  A shard lays its documents
out in a seeded order as one run of words cut into blocks; a quota of f * N + r of N blocks takes
every block f times and r blocks, picked by a seeded permutation, once more.

Only DataFrame functions are used.  The one global order is over one row per
source; a source is split into shards of about ``shard_words`` words, so a hot
source is many windows, and of its shards at most ``FAN`` are in one.

Defined cases: a null or blank text has size 0 and is taken 0 times; a null
source is a source of its own, last in order; a null doc_id is ordered as the
text ``null``; repeated rows are separate documents; an empty table gives an
empty result; columns other than doc_id, text and source are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtstats.llm.common import materialise, word_count

WEIGHTS = (3, 1, 2)
RATIO, CAP = 1.5, 2.0
BLOCK_WORDS = 16
SHARD_WORDS = 250_000
FAN = 4096  # shards of one group: a source's blocks go to groups of shards first
SEED = 42
#: a prime above any number of blocks in a shard: i -> step * i + shift is a permutation
STEP = 2_147_483_629


def targets(sizes: DataFrame, weights=WEIGHTS, ratio=RATIO, cap=CAP) -> DataFrame:
    """(source, source_size) -> source, source_size, target.

    With sources in order of (limit / weight), a prefix of them meets its
    limit; the rest share what is left by weight."""
    n = len(weights)
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    s = (sizes.withColumn("_at", F.row_number().over(by_code) - 1)
         .withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                        (F.col("_at") % n + 1).cast("int")))
         .withColumn("_lim", F.col("source_size") * F.lit(float(cap)))
         .withColumn("_r", F.col("_lim") / F.col("_w")))
    order = Window.orderBy("_r", "_at")
    every = Window.partitionBy(F.lit(1))
    s = (s.withColumn("_before", F.coalesce(F.sum("_lim").over(order.rowsBetween(Window.unboundedPreceding, -1)),
                                            F.lit(0.0)))
         .withColumn("_left", F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("_all", F.sum("source_size").over(every) * F.lit(float(ratio)))
         .withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_left"))
         .withColumn("_full", F.col("_r") <= F.col("_level"))
         .withColumn("_rank", F.row_number().over(order))
         .withColumn("_share", F.min_by(F.when(~F.col("_full"), F.col("_level")),
                                        F.when(~F.col("_full"), F.col("_rank"))).over(every)))
    free = F.col("_rank") >= F.min(F.when(~F.col("_full"), F.col("_rank"))).over(every)
    return s.select("source", "source_size",
                    F.when(F.coalesce(free, F.lit(False)), F.col("_share") * F.col("_w"))
                    .otherwise(F.col("_lim")).alias("target"))


def apportion(parts: DataFrame, group: list[str], name: list[str]) -> DataFrame:
    """Highest-quotient apportionment of ``seats`` (per group) over rows with
    ``weight`` (> 0) and at most ``most`` seats each; ties go to the earlier
    ``name``.  Adds ``quota``.

    A share q of M seats over S rows ends within q * S / (2 M) + 1 of q, so only
    the quotients about q compete (``margin`` is twice that); seats below are sure."""
    g = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    p = (parts.withColumn("_q", F.col("seats") * F.col("weight") / F.sum("weight").over(g))
         .withColumn("_m", (F.count("*").over(g) + 1) * F.col("_q") / F.greatest(F.col("seats"), F.lit(1)) + 2)
         .withColumn("_lo", F.least(F.greatest(F.floor(F.col("_q") - F.col("_m")), F.lit(0)), F.col("most")).cast("long"))
         .withColumn("_hi", F.least(F.ceil(F.col("_q") + F.col("_m")), F.col("most")).cast("long"))
         .withColumn("_open", F.col("seats") - F.sum("_lo").over(g)))
    seats = p.withColumn("_k", F.explode_outer(F.when(F.col("_hi") > F.col("_lo"),
                                                      F.sequence(F.col("_lo") + 1, F.col("_hi")))))
    order = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))).orderBy(
        (F.col("weight") / (2 * F.col("_k") - 1)).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in name], "_k")
    won = seats.withColumn("_won", F.col("_k").isNotNull() & (F.row_number().over(order) <= F.col("_open")))
    return (won.groupBy(*parts.columns, "_lo")
            .agg(F.sum(F.col("_won").cast("long")).alias("_n"))
            .withColumn("quota", F.col("_lo") + F.col("_n")).drop("_lo", "_n"))


def mix(docs: DataFrame, weights=WEIGHTS, ratio=RATIO, cap=CAP, block_words=BLOCK_WORDS,
        shard_words=SHARD_WORDS, seed=SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    b = F.lit(block_words).cast("long")
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                                    F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("_text"))
                        .withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(
                            F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")))
                        .withColumn("_t", F.md5(F.concat("_h", F.col("_text")).cast("binary"))).drop("_text"), "mix")
    want = materialise(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")),
                               weights, ratio, cap), "mix-targets")
    # whole blocks of the mix, dealt to the sources by highest quotients
    whole = Window.partitionBy(F.lit(1))
    by_source = apportion(
        want.where("target > 0").select("source", F.col("target").alias("weight"), F.col("source_size").alias("words"))
        .withColumn("seats", F.round(F.sum("words").over(whole) * F.lit(min(float(ratio), float(cap))) / b).cast("long"))
        .drop("words")
        .withColumn("most", F.lit(1 << 60).cast("long")), [], ["source"]
    ).select(F.col("source").alias("_s"), F.col("quota").alias("seats"))
    placed = (sized.join(want.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
              .withColumn("shard", F.pmod(F.conv(F.substring("_t", 1, 15), 16, 10).cast("long"),
                                          F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(shard_words))))))
    shards = (placed.groupBy("source", "shard").agg(F.sum("size").alias("words")).where("words > 0")
              .withColumn("blocks", F.ceil(F.col("words") / b).cast("long")).withColumn("part", F.floor(F.col("shard") / FAN)))
    # by highest quotients to groups of at most FAN shards, then to the shards of each group, so
    # that no window holds all shards of a source
    parts = shards.groupBy("source", "part").agg(F.sum("words").cast("double").alias("weight"), (2 * F.sum("blocks")).alias("most"))
    parts = (apportion(parts.join(by_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), ["source"], ["part"])
             .select(F.col("source").alias("_s"), F.col("part").alias("_p"), F.col("quota").alias("seats")))
    quotas = (apportion(
        shards.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
        .select("source", "part", "shard", F.col("words").cast("double").alias("weight"), "seats",
                (2 * F.col("blocks")).alias("most"), "blocks"),
        ["source", "part"], ["shard"])
        .select(F.col("source").alias("_s"), F.col("shard").alias("_p"), "quota", "blocks"))
    run = Window.partitionBy("source", "shard").orderBy("_h", "doc_id", "size", "_t")
    laid = (placed.withColumn("_end", F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_at", F.col("_end") - F.col("size"))
            .join(quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_p")), "left"))
    shift = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("null")), F.lit(":"),
                                              F.col("shard").cast("string")).cast("binary")), 1, 7), 16, 10).cast("long")
    laid = laid.withColumn("_extra", F.col("quota") % F.col("blocks")).withColumn("_shift", shift)

    def more(total, i):
        part = F.least((i + 1) * b, F.col("_end")) - F.greatest(i * b, F.col("_at"))
        return total + F.when(F.pmod(i * F.lit(STEP) + F.col("_shift"), F.col("blocks")) < F.col("_extra"),
                              part).otherwise(F.lit(0).cast("long"))

    once = F.aggregate(F.sequence(F.floor(F.col("_at") / b), F.floor((F.col("_end") - 1) / b)),
                       F.lit(0).cast("long"), more)
    return laid.select(
        "doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"),
        F.when((F.col("size") == 0) | F.col("quota").isNull(), F.lit(0).cast("long"))
        .otherwise(F.floor(F.col("quota") / F.col("blocks")) * F.col("size") + once).cast("long").alias("taken"))


def oracle(weights=WEIGHTS, ratio=RATIO, cap=CAP, block_words=BLOCK_WORDS, shard_words=SHARD_WORDS, seed=SEED,
           table="documents") -> str:
    """The same mix in DuckDB SQL (for sources of at most ``FAN`` shards)."""
    w = "[" + ", ".join(f"{float(x)}::DOUBLE" for x in weights) + "]"

    def seats(src, group, name):
        part = f"PARTITION BY {group}" if group else ""
        return f"""SELECT * EXCLUDE (k, won, lo, hi, open_, m, q), (any_value(lo) + sum(won))::BIGINT AS quota FROM (
          SELECT *, (k IS NOT NULL AND row_number() OVER ({part} ORDER BY weight / (2 * k - 1) DESC NULLS LAST,
                     {name} ASC NULLS LAST, k) <= open_)::INT AS won FROM (
            SELECT *, unnest(CASE WHEN hi > lo THEN range(lo + 1, hi + 1) ELSE [NULL] END) AS k FROM (
              SELECT *, seats - sum(lo) OVER ({part}) AS open_ FROM (
                SELECT *, least(greatest(floor(q - m), 0), most)::BIGINT AS lo, least(ceil(q + m), most)::BIGINT AS hi FROM (
                  SELECT *, (count(*) OVER ({part}) + 1) * q / greatest(seats, 1) + 2 AS m FROM (
                    SELECT *, seats * weight / sum(weight) OVER ({part}) AS q FROM ({src}))))))) GROUP BY ALL"""

    return rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')) AS h, md5(h || md5(coalesce(text, ''))) AS t FROM {table}),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS at_ FROM s0),
s2 AS (SELECT *, list_extract({w}, (at_ % {len(weights)} + 1)::INT) AS w, source_size * {float(cap)}::DOUBLE AS lim FROM s1),
s3 AS (SELECT *, lim / w AS r FROM s2),
s4 AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY r, at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_,
    sum(w) OVER (ORDER BY r, at_ ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_,
    sum(source_size) OVER () * {float(ratio)}::DOUBLE AS all_, row_number() OVER (ORDER BY r, at_) AS rank_ FROM s3),
s5 AS (SELECT *, (all_ - before_) / left_ AS level_ FROM s4),
s6 AS (SELECT *, min(CASE WHEN r > level_ THEN rank_ END) OVER () AS cut FROM s5),
want AS (SELECT source, source_size, CASE WHEN rank_ >= cut
    THEN max(CASE WHEN rank_ = cut THEN level_ END) OVER () * w ELSE lim END AS target FROM s6),
by_source AS (SELECT source, quota FROM ({seats(f'''SELECT source, target AS weight,
    round(sum(source_size) OVER () * {min(float(ratio), float(cap))}::DOUBLE / {block_words})::BIGINT AS seats, (1::BIGINT << 60) AS most FROM want WHERE target > 0''', '', 'source')})),
placed AS (SELECT d.*, source_size, target,
    (('0x' || substr(t, 1, 15))::BIGINT % greatest(1, ceil(source_size / {float(shard_words)})::BIGINT))::BIGINT AS shard
    FROM sized d JOIN want t ON d.source IS NOT DISTINCT FROM t.source),
shards AS (SELECT source, shard, sum(size)::BIGINT AS words FROM placed GROUP BY ALL HAVING words > 0),
quotas AS ({seats(f'''SELECT a.source, shard, words::DOUBLE AS weight, q.quota AS seats,
    2 * ceil(words / {float(block_words)})::BIGINT AS most, ceil(words / {float(block_words)})::BIGINT AS blocks
    FROM shards a JOIN by_source q ON a.source IS NOT DISTINCT FROM q.source''', 'source', 'shard')}),
laid AS (SELECT *, end_ - size AS at_ FROM (SELECT *, sum(size) OVER (PARTITION BY source, shard
    ORDER BY h, doc_id, size, t ROWS UNBOUNDED PRECEDING)::BIGINT AS end_ FROM placed)),
full_ AS (SELECT l.*, quota, blocks, quota % blocks AS extra,
    ('0x' || substr(md5('{seed}:' || coalesce(l.source, 'null') || ':' || l.shard::VARCHAR), 1, 7))::BIGINT AS shift
    FROM laid l LEFT JOIN quotas q ON l.source IS NOT DISTINCT FROM q.source AND l.shard = q.shard)
SELECT doc_id, source, size, source_size, round(target, 6) AS target,
  CASE WHEN size = 0 OR quota IS NULL THEN 0 ELSE (quota // blocks) * size + coalesce(list_sum(list_transform(
    range(at_ // {block_words}, (end_ - 1) // {block_words} + 1),
    lambda i: CASE WHEN (i * {STEP} + shift) % blocks < extra
      THEN least((i + 1) * {block_words}, end_) - greatest(i * {block_words}, at_) ELSE 0 END)), 0) END::BIGINT AS taken
FROM full_"""
