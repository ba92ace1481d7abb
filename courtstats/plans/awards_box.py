"""Player-season and team-season awards (box-score, on/off, contracts,
rotations) over the ``player_season`` / ``team_season`` views."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtstats.functions.arith import safe_div
from courtstats.functions.text import nth_word, parse_number
from courtstats.operators.aggregate import leave_one_out, ordered_listagg, sum_cols, unpivot
from courtstats.operators.filters import group_size_filter, qualify_min, qualify_share
from courtstats.operators.joins import natural_join
from courtstats.operators.rank import (
    group_argmax, leader_flag, pct_rank, percent_rank_ignore_null, rank_cuts, slice_range, top_n,
)
from courtstats.plans import oracle_views as O
from courtstats.plans import views as V
from courtstats.plans.registry import r6, register

SEASON = "season"


def _ps_ts(spark, sf):
    pts = V.box(spark, sf)
    return V.player_season(spark, sf, pts=pts), V.team_season(spark, sf, pts=pts)


def _qualified(spark, sf, share):
    """player_season with g_percent = g / team games, kept when >= share."""
    ps, ts = _ps_ts(spark, sf)
    return qualify_share(ps, ts, ["tm", SEASON], "g", "g_total", share)


_Q = O.BOX_ALL + """,
q AS (
  SELECT p.*, t.g_total, p.g / t.g_total AS g_percent
  FROM player_season p LEFT JOIN team_season t ON t.tm = p.tm AND t.season = p.season
)"""

# --- L1-L4: per-36 rate leaders (season) and career -------------------------------

RATE_STATS = ["stl", "blk", "ast", "trb"]


@register("award_rate_leaders", O.with_views(_Q, body="""
SELECT season, stat, player, round(rate, 6) AS rate FROM (
  SELECT season, player, 'stl' AS stat, stl / mp * 36 AS rate FROM q WHERE g_percent >= 0.7
  UNION ALL SELECT season, player, 'blk', blk / mp * 36 FROM q WHERE g_percent >= 0.7
  UNION ALL SELECT season, player, 'ast', ast / mp * 36 FROM q WHERE g_percent >= 0.7
  UNION ALL SELECT season, player, 'trb', trb / mp * 36 FROM q WHERE g_percent >= 0.7) x
WHERE rate IS NOT NULL
QUALIFY rank() OVER (PARTITION BY season, stat ORDER BY rate DESC) <= 10"""))
def award_rate_leaders(spark, sf):
    q = _qualified(spark, sf, 0.7)
    rates = q.select(SEASON, "player", *[(safe_div(s, "mp") * 36).alias(s) for s in RATE_STATS])
    long = unpivot(rates, [SEASON, "player"], RATE_STATS, "stat", "rate")
    return top_n(long, "rate", 10, partition=[SEASON, "stat"]).withColumn("rate", r6("rate"))


@register("award_rate_leaders_career", O.with_views(O.PLAYER_SEASON, body="""
SELECT stat, player_id, round(rate, 6) AS rate FROM (
  SELECT player_id, 'stl' AS stat, sum(stl) / sum(mp) * 36 AS rate FROM player_season GROUP BY player_id
    HAVING sum(mp) >= 75 AND sum(mp) / sum(g) >= 12
  UNION ALL SELECT player_id, 'blk', sum(blk) / sum(mp) * 36 FROM player_season GROUP BY player_id
    HAVING sum(mp) >= 75 AND sum(mp) / sum(g) >= 12
  UNION ALL SELECT player_id, 'ast', sum(ast) / sum(mp) * 36 FROM player_season GROUP BY player_id
    HAVING sum(mp) >= 75 AND sum(mp) / sum(g) >= 12
  UNION ALL SELECT player_id, 'trb', sum(trb) / sum(mp) * 36 FROM player_season GROUP BY player_id
    HAVING sum(mp) >= 75 AND sum(mp) / sum(g) >= 12) x
QUALIFY rank() OVER (PARTITION BY stat ORDER BY rate DESC) <= 10"""))
def award_rate_leaders_career(spark, sf):
    ps = V.player_season(spark, sf)
    car = ps.groupBy("player_id").agg(*[F.sum(c).alias(c) for c in (*RATE_STATS, "mp", "g")])
    car = car.filter((F.col("mp") >= 75) & (F.col("mp") / F.col("g") >= 12))
    rates = car.select("player_id", *[(safe_div(s, "mp") * 36).alias(s) for s in RATE_STATS])
    long = unpivot(rates, ["player_id"], RATE_STATS, "stat", "rate")
    return top_n(long, "rate", 10, partition="stat").withColumn("rate", r6("rate"))


# --- L5 / L6 / L52: percentile-rank composite ------------------------------------

COMPOSITE = ["stl", "blk", "ast", "trb", "pf", "fg"]


def _composite(spark, sf):
    q = _qualified(spark, sf, 0.5)
    per36 = q.select(SEASON, "player_id", "player",
                     *[(safe_div(c, "mp") * 36).alias(c) for c in COMPOSITE])
    ranked = pct_rank(per36, COMPOSITE, method="average", partition=SEASON)
    return ranked.withColumn("sum", sum_cols([c + "_pct_rank" for c in COMPOSITE]))


_COMPOSITE_SQL = _Q + ",\nper36 AS (SELECT season, player_id, player, " + ", ".join(
    f"{c} / mp * 36 AS {c}" for c in COMPOSITE) + " FROM q WHERE g_percent >= 0.5),\nranked AS (SELECT *, " + ", ".join(
    f"(rank() OVER (PARTITION BY season ORDER BY {c}) + (count(*) OVER (PARTITION BY season, {c}) - 1) / 2.0)"
    f" / count({c}) OVER (PARTITION BY season) AS {c}_pct_rank" for c in COMPOSITE) + " FROM per36),\ncomp AS (SELECT *, " + " + ".join(
    f"{c}_pct_rank" for c in COMPOSITE) + " AS sum FROM ranked)"


def _composite_out(df):
    cols = ["season", "player", "sum"] + [c + "_pct_rank" for c in COMPOSITE]
    return df.select(*[r6(c).alias(c) if c == "sum" or c.endswith("_pct_rank") else c for c in cols])


def _composite_sql_out(extra):
    cols = ", ".join(["season", "player", "round(sum, 6) AS sum"] +
                     [f"round({c}_pct_rank, 6) AS {c}_pct_rank" for c in COMPOSITE])
    return O.with_views(_COMPOSITE_SQL, body=f"SELECT {cols} FROM comp {extra}")


@register("award_composite_low", _composite_sql_out(
    "QUALIFY rank() OVER (PARTITION BY season ORDER BY sum ASC) <= 10"))
def award_composite_low(spark, sf):
    return _composite_out(top_n(_composite(spark, sf), "sum", 10, descending=False, partition=SEASON))


@register("award_composite_high", _composite_sql_out(
    "QUALIFY rank() OVER (PARTITION BY season ORDER BY sum DESC) <= 10"))
def award_composite_high(spark, sf):
    return _composite_out(top_n(_composite(spark, sf), "sum", 10, partition=SEASON))


@register("award_rank_export", _composite_sql_out(""))
def award_rank_export(spark, sf):
    return _composite_out(_composite(spark, sf))


@register("pct_rank_avg", _composite_sql_out(""))
def pct_rank_avg(spark, sf):
    return _composite_out(_composite(spark, sf))


@register("composite_score", _composite_sql_out(""))
def composite_score(spark, sf):
    return _composite_out(_composite(spark, sf))


# --- L23 / E3 / C11: min-method percentile, top half, composite without ties -------

@register("award_late_composite", O.with_views(O.PLAYER_SEASON, body="""
, l1 AS (SELECT season, player_id, player, fga, x3p_ar, ts_percent,
         rank() OVER (PARTITION BY season ORDER BY fga) / count(fga) OVER (PARTITION BY season) AS fga_percentile
         FROM player_season),
l2 AS (SELECT *, rank() OVER (PARTITION BY season ORDER BY x3p_ar) / count(x3p_ar) OVER (PARTITION BY season) AS freq_percentile,
              rank() OVER (PARTITION BY season ORDER BY ts_percent) / count(ts_percent) OVER (PARTITION BY season) AS eff_percentile
       FROM l1 WHERE fga_percentile > 0.5)
SELECT season, player_id, round(fga_percentile, 6) AS fga_percentile, round(freq_percentile, 6) AS freq_percentile,
       round(eff_percentile, 6) AS eff_percentile,
       round(fga_percentile + freq_percentile + eff_percentile, 6) AS sum_percentiles
FROM l2 QUALIFY row_number() OVER (PARTITION BY season
    ORDER BY fga_percentile + freq_percentile + eff_percentile DESC, player_id) <= 10""".replace("\n, l1", ",\nl1", 1)))
def award_late_composite(spark, sf):
    ps = V.player_season(spark, sf, pts=V.box(spark, sf)).select(SEASON, "player_id", "player", "fga", "x3p_ar", "ts_percent")
    a = pct_rank(ps, "fga", method="min", partition=SEASON, suffix="_percentile")
    a = a.filter(F.col("fga_percentile") > 0.5)
    a = pct_rank(a, ["x3p_ar", "ts_percent"], method="min", partition=SEASON, suffix="_pctl") \
        .withColumnsRenamed({"x3p_ar_pctl": "freq_percentile", "ts_percent_pctl": "eff_percentile"})
    a = a.withColumn("sum_percentiles", F.col("fga_percentile") + F.col("freq_percentile") + F.col("eff_percentile"))
    out = top_n(a, "sum_percentiles", 10, ties=False, partition=SEASON, tiebreak=["player_id"])
    return out.select(SEASON, "player_id", *[r6(c).alias(c) for c in (
        "fga_percentile", "freq_percentile", "eff_percentile", "sum_percentiles")])


@register("pct_rank_min", O.with_views(O.PLAYER_SEASON, body="""
SELECT season, player_id, round(rank() OVER (PARTITION BY season ORDER BY fga) / count(fga) OVER (PARTITION BY season), 6)
       AS fga_percentile FROM player_season"""))
def pct_rank_min(spark, sf):
    ps = V.player_season(spark, sf, pts=V.box(spark, sf)).select(SEASON, "player_id", "fga")
    a = pct_rank(ps, "fga", method="min", partition=SEASON, suffix="_percentile")
    return a.select(SEASON, "player_id", r6("fga_percentile").alias("fga_percentile"))


@register("top_half", O.with_views(O.PLAYER_SEASON, body="""
SELECT season, player_id, fga FROM player_season
QUALIFY rank() OVER (PARTITION BY season ORDER BY fga) / count(fga) OVER (PARTITION BY season) > 0.5"""))
def top_half(spark, sf):
    ps = V.player_season(spark, sf, pts=V.box(spark, sf)).select(SEASON, "player_id", "fga")
    a = pct_rank(ps, "fga", method="min", partition=SEASON, suffix="_percentile")
    return a.filter(F.col("fga_percentile") > 0.5).select(SEASON, "player_id", "fga")


# --- L26: real sixth man ----------------------------------------------------------

_SMOY_SQL = _Q + """,
smoy AS (
  SELECT * FROM q WHERE g_percent >= 0.5 AND tm <> 'TOT' AND mp / g IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY tm, season ORDER BY mp / g DESC, player_id) BETWEEN 6 AND 9
)"""


def _smoy(spark, sf):
    q = _qualified(spark, sf, 0.5).filter(F.col("tm") != "TOT").withColumn("mp_per_game", safe_div("mp", "g"))
    q = q.filter(F.col("mp_per_game").isNotNull())
    s = slice_range(q, ["tm", SEASON], "mp_per_game", 6, 9, tiebreak=["player_id"])
    return s.filter(F.col("gs") / F.col("g") <= 0.5)


@register("award_sixth_man", O.with_views(_SMOY_SQL, body="""
SELECT season, player, tm, g, gs, round(mp / g, 6) AS mp_per_game, round(vorp, 6) AS vorp FROM smoy
WHERE gs / g <= 0.5 QUALIFY rank() OVER (PARTITION BY season ORDER BY vorp DESC) <= 5"""))
def award_sixth_man(spark, sf):
    s = top_n(_smoy(spark, sf), "vorp", 5, partition=SEASON)
    return s.select(SEASON, "player", "tm", "g", "gs", r6("mp_per_game").alias("mp_per_game"), r6("vorp").alias("vorp"))


@register("slice_range", O.with_views(_SMOY_SQL, body="SELECT season, tm, player_id FROM smoy"))
def slice_range_q(spark, sf):
    q = _qualified(spark, sf, 0.5).filter(F.col("tm") != "TOT").withColumn("mp_per_game", safe_div("mp", "g"))
    q = q.filter(F.col("mp_per_game").isNotNull())
    return slice_range(q, ["tm", SEASON], "mp_per_game", 6, 9, tiebreak=["player_id"]).select(SEASON, "tm", "player_id")


# --- L27 / L28 / L29 / L39: thresholds + leaderboards --------------------------------

@register("award_best_pct", O.with_views(O.PLAYER_SEASON, body="""
SELECT season, player, tm, x3p, round(x3p / x3pa, 6) AS x3p_percent FROM player_season
WHERE x3p >= 2 AND x3pa > 0 QUALIFY rank() OVER (PARTITION BY season ORDER BY x3p / x3pa DESC) <= 5"""))
def award_best_pct(spark, sf):
    ps = qualify_min(V.player_season(spark, sf), {"x3p": 2}).withColumn("x3p_percent", safe_div("x3p", "x3pa"))
    return top_n(ps, "x3p_percent", 5, partition=SEASON).select(
        SEASON, "player", "tm", "x3p", r6("x3p_percent").alias("x3p_percent"))


@register("award_worst_pct", O.with_views(O.PLAYER_SEASON, body="""
SELECT season, player, tm, x2p, round(x2p / x2pa, 6) AS x2p_percent FROM player_season
WHERE fg >= 3 AND x2pa > 0 QUALIFY rank() OVER (PARTITION BY season ORDER BY x2p / x2pa ASC) <= 5"""))
def award_worst_pct(spark, sf):
    ps = qualify_min(V.player_season(spark, sf), {"fg": 3}).withColumn("x2p_percent", safe_div("x2p", "x2pa"))
    return top_n(ps, "x2p_percent", 5, descending=False, partition=SEASON).select(
        SEASON, "player", "tm", "x2p", r6("x2p_percent").alias("x2p_percent"))


@register("award_most_minutes", O.with_views(_Q, body="""
SELECT season, player, tm, round(mp / g, 6) AS mp_per_game FROM q WHERE g_percent >= 0.7
QUALIFY rank() OVER (PARTITION BY season ORDER BY mp / g DESC) <= 5"""))
def award_most_minutes(spark, sf):
    q = _qualified(spark, sf, 0.7).withColumn("mp_per_game", safe_div("mp", "g"))
    return top_n(q, "mp_per_game", 5, partition=SEASON).select(
        SEASON, "player", "tm", r6("mp_per_game").alias("mp_per_game"))


@register("award_attempt_share", O.with_views(O.PLAYER_SEASON, body="""
SELECT season, player, tm, round(x3p_ar, 6) AS x3p_ar FROM player_season WHERE x3p >= 2
QUALIFY rank() OVER (PARTITION BY season ORDER BY x3p_ar DESC) <= 5"""))
def award_attempt_share(spark, sf):
    ps = qualify_min(V.player_season(spark, sf), {"x3p": 2})
    return top_n(ps, "x3p_ar", 5, partition=SEASON).select(SEASON, "player", "tm", r6("x3p_ar").alias("x3p_ar"))


# --- L36 / L37: FGA per assist with IEEE division ----------------------------------

_RATIO_SQL = _Q + """,
ratio AS (SELECT season, player, tm, fga, ast,
          CASE WHEN ast = 0 AND fga > 0 THEN 'Infinity'::DOUBLE WHEN ast = 0 THEN NULL ELSE fga / ast END AS fga_per_ast
          FROM q WHERE g_percent >= 0.5)"""


def _ratio(spark, sf):
    q = _qualified(spark, sf, 0.5)
    return q.select(SEASON, "player", "tm", "fga", "ast", safe_div("fga", "ast", "ieee").alias("fga_per_ast"))


@register("award_ratio_high", O.with_views(_RATIO_SQL, body="""
SELECT season, player, tm, fga, ast, round(fga_per_ast, 6) AS fga_per_ast FROM ratio
WHERE fga_per_ast IS NOT NULL QUALIFY rank() OVER (PARTITION BY season ORDER BY fga_per_ast DESC) <= 5"""))
def award_ratio_high(spark, sf):
    return top_n(_ratio(spark, sf), "fga_per_ast", 5, partition=SEASON).withColumn("fga_per_ast", r6("fga_per_ast"))


@register("award_ratio_low", O.with_views(_RATIO_SQL, body="""
SELECT season, player, tm, fga, ast, round(fga_per_ast, 6) AS fga_per_ast FROM ratio
WHERE fga_per_ast IS NOT NULL QUALIFY rank() OVER (PARTITION BY season ORDER BY fga_per_ast ASC) <= 5"""))
def award_ratio_low(spark, sf):
    return top_n(_ratio(spark, sf), "fga_per_ast", 5, descending=False, partition=SEASON) \
        .withColumn("fga_per_ast", r6("fga_per_ast"))


# --- L38: fouls per 36 ---------------------------------------------------------------

@register("award_fouls_rate", O.with_views(_Q, body="""
SELECT season, player, tm, mp, pf, round(pf / mp * 36, 6) AS fouls_per_36_minutes FROM q
WHERE g_percent >= 0.5 AND mp / g >= 12
QUALIFY rank() OVER (PARTITION BY season ORDER BY pf / mp * 36 DESC) <= 5"""))
def award_fouls_rate(spark, sf):
    q = _qualified(spark, sf, 0.5).filter(F.col("mp") / F.col("g") >= 12)
    q = q.withColumn("fouls_per_36_minutes", safe_div("pf", "mp") * 36)
    return top_n(q, "fouls_per_36_minutes", 5, partition=SEASON).select(
        SEASON, "player", "tm", "mp", "pf", r6("fouls_per_36_minutes").alias("fouls_per_36_minutes"))


# --- L31: points as share of counting stats --------------------------------------------

_SHARE_SQL = _Q + """,
share AS (SELECT season, player, tm, pts, trb, ast, stl, blk,
          pts / nullif(pts + trb + ast + stl + blk, 0) AS pts_as_percent_of_other_stats FROM q WHERE g_percent >= 0.7)"""


def _share(spark, sf):
    q = _qualified(spark, sf, 0.7)
    tot = sum_cols(["pts", "trb", "ast", "stl", "blk"])
    return q.select(SEASON, "player", "tm", "pts", "trb", "ast", "stl", "blk",
                    safe_div("pts", tot).alias("pts_as_percent_of_other_stats"))


@register("award_share_of_total", O.with_views(_SHARE_SQL, body="""
SELECT season, player, tm, pts, trb, ast, stl, blk, round(pts_as_percent_of_other_stats, 6) AS pts_as_percent_of_other_stats
FROM share WHERE pts_as_percent_of_other_stats IS NOT NULL
QUALIFY rank() OVER (PARTITION BY season ORDER BY pts_as_percent_of_other_stats DESC) <= 5"""))
def award_share_of_total(spark, sf):
    return top_n(_share(spark, sf), "pts_as_percent_of_other_stats", 5, partition=SEASON) \
        .withColumn("pts_as_percent_of_other_stats", r6("pts_as_percent_of_other_stats"))


@register("share_of_total", O.with_views(_SHARE_SQL, body="""
SELECT season, player, round(pts_as_percent_of_other_stats, 6) AS pts_as_percent_of_other_stats FROM share"""))
def share_of_total(spark, sf):
    return _share(spark, sf).select(SEASON, "player", r6("pts_as_percent_of_other_stats").alias("pts_as_percent_of_other_stats"))


# --- L30: best fifth starter ---------------------------------------------------------------

_FIFTH_SQL = _Q + """,
starters AS (
  SELECT *, gs / g_total AS start_percent FROM q WHERE gs / g_total >= 0.5 AND tm <> 'TOT'
),
big AS (SELECT * FROM starters WHERE (tm, season) IN (
  SELECT (tm, season) FROM starters GROUP BY tm, season HAVING count(*) > 2)),
fifth AS (SELECT * FROM big QUALIFY rank() OVER (PARTITION BY tm, season ORDER BY vorp ASC) <= 1)"""


@register("award_best_fifth", O.with_views(_FIFTH_SQL, body="""
SELECT season, player, pos, tm, g_total, gs, round(mp / g, 6) AS mp_per_game, round(vorp, 6) AS vorp FROM fifth
QUALIFY rank() OVER (PARTITION BY season ORDER BY vorp DESC) <= 5"""))
def award_best_fifth(spark, sf):
    ps, ts = _ps_ts(spark, sf)
    q = ps.join(ts.select("tm", SEASON, "g_total"), ["tm", SEASON], "left")
    q = q.withColumn("start_percent", safe_div("gs", "g_total"))
    q = q.filter((F.col("start_percent") >= 0.5) & (F.col("tm") != "TOT"))
    q = group_size_filter(q, ["tm", SEASON], 2)
    fifth = top_n(q, "vorp", 1, descending=False, partition=["tm", SEASON])
    out = top_n(fifth, "vorp", 5, partition=SEASON)
    return out.select(SEASON, "player", "pos", "tm", "g_total", "gs",
                      r6(safe_div("mp", "g")).alias("mp_per_game"), r6("vorp").alias("vorp"))


@register("group_size_filter", O.with_views(_FIFTH_SQL, body="SELECT season, tm, player_id FROM big"))
def group_size_filter_q(spark, sf):
    ps, ts = _ps_ts(spark, sf)
    q = ps.join(ts.select("tm", SEASON, "g_total"), ["tm", SEASON], "left")
    q = q.filter((safe_div("gs", "g_total") >= 0.5) & (F.col("tm") != "TOT"))
    return group_size_filter(q, ["tm", SEASON], 2).select(SEASON, "tm", "player_id")


# --- L32: empty calories (percent_rank within position, ignoring missing) ------------------

_EMPTY_SQL = _Q + """,
e0 AS (SELECT season, player_id, player, split_part(pos, '-', 1) AS pos, tm, ts_percent, usg_percent, vorp
       FROM q WHERE g_percent >= 0.5),
e1 AS (SELECT *,
  CASE WHEN ts_percent IS NULL THEN NULL
       WHEN count(ts_percent) OVER (PARTITION BY pos, season) > 1 THEN
         (rank() OVER (PARTITION BY pos, season, ts_percent IS NULL ORDER BY ts_percent DESC) - 1)
         / (count(ts_percent) OVER (PARTITION BY pos, season) - 1) ELSE 0.0 END AS ts_rank,
  CASE WHEN usg_percent IS NULL THEN NULL
       WHEN count(usg_percent) OVER (PARTITION BY pos, season) > 1 THEN
         (rank() OVER (PARTITION BY pos, season, usg_percent IS NULL ORDER BY usg_percent ASC) - 1)
         / (count(usg_percent) OVER (PARTITION BY pos, season) - 1) ELSE 0.0 END AS usg_rank,
  CASE WHEN vorp IS NULL THEN NULL
       WHEN count(vorp) OVER (PARTITION BY pos, season) > 1 THEN
         (rank() OVER (PARTITION BY pos, season, vorp IS NULL ORDER BY vorp DESC) - 1)
         / (count(vorp) OVER (PARTITION BY pos, season) - 1) ELSE 0.0 END AS vorp_rank
  FROM e0),
e2 AS (SELECT *, ts_rank + usg_rank + vorp_rank AS empty_stats FROM e1)"""


def _empty(spark, sf):
    q = _qualified(spark, sf, 0.5).select(SEASON, "player_id", "player", nth_word("pos", 1, "-").alias("pos"),
                                          "tm", "ts_percent", "usg_percent", "vorp")
    part = ["pos", SEASON]
    cuts = rank_cuts(q, ["ts_percent", "usg_percent", "vorp"], part)
    q = percent_rank_ignore_null(q, "ts_percent", "ts_rank", part, descending=True, cuts=cuts["ts_percent"])
    q = percent_rank_ignore_null(q, "usg_percent", "usg_rank", part, cuts=cuts["usg_percent"])
    q = percent_rank_ignore_null(q, "vorp", "vorp_rank", part, descending=True, cuts=cuts["vorp"])
    return q.withColumn("empty_stats", F.col("ts_rank") + F.col("usg_rank") + F.col("vorp_rank"))


_EMPTY_COLS = ["ts_rank", "usg_rank", "vorp_rank", "empty_stats"]


@register("award_empty_calories", O.with_views(_EMPTY_SQL, body="SELECT season, player, pos, tm, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in _EMPTY_COLS) + """ FROM e2
QUALIFY rank() OVER (PARTITION BY season ORDER BY empty_stats DESC NULLS LAST) <= 5 AND empty_stats IS NOT NULL"""))
def award_empty_calories(spark, sf):
    e = top_n(_empty(spark, sf), "empty_stats", 5, partition=SEASON)
    return e.select(SEASON, "player", "pos", "tm", *[r6(c).alias(c) for c in _EMPTY_COLS])


@register("percent_rank_group", O.with_views(_EMPTY_SQL, body="SELECT season, player_id, pos, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in _EMPTY_COLS) + " FROM e2"))
def percent_rank_group(spark, sf):
    return _empty(spark, sf).select(SEASON, "player_id", "pos", *[r6(c).alias(c) for c in _EMPTY_COLS])


# --- L33 / L34 / F13: on/off gap with / without the extreme player ------------------------

_ONOFF_SQL = O.BOX_ALL + """,
pf AS (
  SELECT p.*, t.g_total, p.g / t.g_total AS g_percent, p.mp / p.g AS w8
  FROM player_team_season_named p JOIN team_season t ON t.tm = p.tm AND t.season = p.season
  WHERE p.tm <> 'TOT' AND p.g / t.g_total >= 0.5 AND p.mp / p.g >= 10
),
tavg AS (SELECT tm, season, sum(net_plus_minus_per_100_poss * w8) / sum(w8) AS tm_avg_weight_npm,
                sum(net_plus_minus_per_100_poss * w8) AS sxw, sum(w8) AS sw FROM pf GROUP BY tm, season),
lead_row AS (SELECT tm, season, net_plus_minus_per_100_poss * w8 AS xw, w8 FROM pf
             QUALIFY row_number() OVER (PARTITION BY tm, season ORDER BY net_plus_minus_per_100_poss DESC, player_id DESC) = 1),
trail_row AS (SELECT tm, season, net_plus_minus_per_100_poss * w8 AS xw, w8 FROM pf
             QUALIFY row_number() OVER (PARTITION BY tm, season ORDER BY net_plus_minus_per_100_poss ASC, player_id ASC) = 1),
wo_lead AS (SELECT a.tm, a.season, (a.sxw - l.xw) / nullif(a.sw - l.w8, 0) AS avg_wo_leader
            FROM tavg a JOIN lead_row l ON l.tm = a.tm AND l.season = a.season),
wo_trail AS (SELECT a.tm, a.season, (a.sxw - l.xw) / nullif(a.sw - l.w8, 0) AS avg_wo_trailer
             FROM tavg a JOIN trail_row l ON l.tm = a.tm AND l.season = a.season),
gap_best AS (
  SELECT p.season, p.player, p.tm, p.g, p.mp, p.net_plus_minus_per_100_poss, a.tm_avg_weight_npm, w.avg_wo_leader,
         a.tm_avg_weight_npm - w.avg_wo_leader AS npm_diff
  FROM pf p JOIN tavg a ON a.tm = p.tm AND a.season = p.season
  JOIN wo_lead w ON w.tm = p.tm AND w.season = p.season
  QUALIFY rank() OVER (PARTITION BY p.tm, p.season ORDER BY p.net_plus_minus_per_100_poss DESC) = 1
),
gap_worst AS (
  SELECT p.season, p.player, p.tm, p.g, p.mp, p.net_plus_minus_per_100_poss, a.tm_avg_weight_npm, w.avg_wo_trailer,
         a.tm_avg_weight_npm - w.avg_wo_trailer AS npm_diff
  FROM pf p JOIN tavg a ON a.tm = p.tm AND a.season = p.season
  JOIN wo_trail w ON w.tm = p.tm AND w.season = p.season
  QUALIFY rank() OVER (PARTITION BY p.tm, p.season ORDER BY p.net_plus_minus_per_100_poss ASC) = 1
)"""


def _onoff(spark, sf, extreme):
    pts = V.box(spark, sf)
    ts = V.team_season(spark, sf, pts=pts)
    named = pts.join(V._customer_dim(spark, sf).select("player_id", "player"), "player_id", "left")
    p = named.filter(F.col("tm") != "TOT").join(ts.select("tm", SEASON, "g_total"), ["tm", SEASON])
    p = p.filter((F.col("g") / F.col("g_total") >= 0.5) & (F.col("mp") / F.col("g") >= 10))
    p = p.withColumn("w8", F.col("mp") / F.col("g"))
    npm = "net_plus_minus_per_100_poss"
    tavg = p.groupBy("tm", SEASON).agg(
        (F.sum(F.col(npm) * F.col("w8")) / F.sum("w8")).alias("tm_avg_weight_npm"))
    name = "avg_wo_leader" if extreme == "max" else "avg_wo_trailer"
    tb = ["player_id"]
    wo = leave_one_out(p, ["tm", SEASON], npm, npm, "w8", extreme=extreme, tiebreak=tb, name=name)
    ext = top_n(p, npm, 1, descending=(extreme == "max"), partition=["tm", SEASON])
    out = ext.join(tavg, ["tm", SEASON]).join(wo, ["tm", SEASON])
    out = out.withColumn("npm_diff", F.col("tm_avg_weight_npm") - F.col(name))
    return out.select(SEASON, "player", "tm", "g", "mp", npm, "tm_avg_weight_npm", name, "npm_diff")


def _onoff_round(df, name):
    return df.select(SEASON, "player", "tm", "g", "mp", *[r6(c).alias(c) for c in (
        "net_plus_minus_per_100_poss", "tm_avg_weight_npm", name, "npm_diff")])


def _onoff_sql(view, name, order):
    cols = ", ".join(f"round({c}, 6) AS {c}" for c in ("net_plus_minus_per_100_poss", "tm_avg_weight_npm", name, "npm_diff"))
    return O.with_views(_ONOFF_SQL, body=f"""
SELECT season, player, tm, g, mp, {cols} FROM {view}
QUALIFY rank() OVER (PARTITION BY season ORDER BY npm_diff {order} NULLS LAST) <= 5 AND npm_diff IS NOT NULL""")


@register("award_gap_best", _onoff_sql("gap_best", "avg_wo_leader", "DESC"))
def award_gap_best(spark, sf):
    return _onoff_round(top_n(_onoff(spark, sf, "max"), "npm_diff", 5, partition=SEASON), "avg_wo_leader")


@register("award_gap_worst", _onoff_sql("gap_worst", "avg_wo_trailer", "ASC"))
def award_gap_worst(spark, sf):
    return _onoff_round(top_n(_onoff(spark, sf, "min"), "npm_diff", 5, descending=False, partition=SEASON),
                        "avg_wo_trailer")


@register("leave_one_out", O.with_views(_ONOFF_SQL, body="""
SELECT tm, season, round(avg_wo_leader, 6) AS avg_wo_leader FROM wo_lead"""))
def leave_one_out_q(spark, sf):
    pts = V.box(spark, sf)
    ts = V.team_season(spark, sf, pts=pts)
    p = pts.filter(F.col("tm") != "TOT").join(ts.select("tm", SEASON, "g_total"), ["tm", SEASON])
    p = p.filter((F.col("g") / F.col("g_total") >= 0.5) & (F.col("mp") / F.col("g") >= 10))
    p = p.withColumn("w8", F.col("mp") / F.col("g"))
    npm = "net_plus_minus_per_100_poss"
    wo = leave_one_out(p, ["tm", SEASON], npm, npm, "w8", extreme="max", tiebreak=["player_id"], name="avg_wo_leader")
    return wo.select("tm", SEASON, r6("avg_wo_leader").alias("avg_wo_leader"))


@register("full_natural", O.with_views(_ONOFF_SQL, body="""
SELECT coalesce(b.season, w.season) AS season, coalesce(b.tm, w.tm) AS tm,
       round(b.avg_wo_leader, 6) AS avg_wo_leader, round(w.avg_wo_trailer, 6) AS avg_wo_trailer
FROM wo_lead b FULL JOIN wo_trail w ON b.tm = w.tm AND b.season = w.season"""))
def full_natural(spark, sf):
    pts = V.box(spark, sf)
    ts = V.team_season(spark, sf, pts=pts)
    p = pts.filter(F.col("tm") != "TOT").join(ts.select("tm", SEASON, "g_total"), ["tm", SEASON])
    p = p.filter((F.col("g") / F.col("g_total") >= 0.5) & (F.col("mp") / F.col("g") >= 10))
    p = p.withColumn("w8", F.col("mp") / F.col("g"))
    npm = "net_plus_minus_per_100_poss"
    b = leave_one_out(p, ["tm", SEASON], npm, npm, "w8", "max", ["player_id"], "avg_wo_leader")
    w = leave_one_out(p, ["tm", SEASON], npm, npm, "w8", "min", ["player_id"], "avg_wo_trailer")
    j = natural_join(b, w, "full")
    return j.select(SEASON, "tm", r6("avg_wo_leader").alias("avg_wo_leader"), r6("avg_wo_trailer").alias("avg_wo_trailer"))


# --- L40 / L41 / L42: team expectations ----------------------------------------------------

@register("award_over_expected", O.with_views(O.TEAM_SEASON, body="""
SELECT season, tm, w, round(pw, 6) AS pw FROM team_season WHERE tm <> 'TOT'
QUALIFY rank() OVER (PARTITION BY season ORDER BY w - pw DESC) <= 3"""))
def award_over_expected(spark, sf):
    t = V.team_season(spark, sf).filter(F.col("tm") != "TOT").withColumn("pyth_diff", F.col("w") - F.col("pw"))
    return top_n(t, "pyth_diff", 3, partition=SEASON).select(SEASON, "tm", "w", r6("pw").alias("pw"))


@register("award_under_expected", O.with_views(O.TEAM_SEASON, body="""
SELECT season, tm, w, round(pw, 6) AS pw FROM team_season WHERE tm <> 'TOT'
QUALIFY rank() OVER (PARTITION BY season ORDER BY w - pw ASC) <= 3"""))
def award_under_expected(spark, sf):
    t = V.team_season(spark, sf).filter(F.col("tm") != "TOT").withColumn("pyth_diff", F.col("w") - F.col("pw"))
    return top_n(t, "pyth_diff", 3, descending=False, partition=SEASON).select(SEASON, "tm", "w", r6("pw").alias("pw"))


@register("award_below_forecast", O.with_views(O.TEAM_SEASON, body="""
SELECT season, tm, round(w_l_o_u, 6) AS w_l_o_u, result, round(w_l_o_u - wins, 6) AS diff FROM (
  SELECT season, tm, pw AS w_l_o_u,
         CAST(w AS VARCHAR) || '-' || CAST(l AS VARCHAR) || CASE WHEN w < pw THEN ', under' ELSE ', over' END AS result,
         CAST(w AS DOUBLE) AS wins
  FROM team_season WHERE tm <> 'TOT') x
WHERE regexp_matches(result, 'under')
QUALIFY rank() OVER (PARTITION BY season ORDER BY w_l_o_u - wins DESC) <= 3"""))
def award_below_forecast(spark, sf):
    t = V.team_season(spark, sf).filter(F.col("tm") != "TOT")
    # a scraped "W-L, over/under" text column and the line, parsed back as text would be
    t = t.select(SEASON, "tm", F.col("pw").alias("w_l_o_u"), F.concat(
        F.col("w").cast("string"), F.lit("-"), F.col("l").cast("string"),
        F.when(F.col("w") < F.col("pw"), F.lit(", under")).otherwise(F.lit(", over"))).alias("result"))
    t = t.filter(F.col("result").rlike("under"))
    t = t.withColumn("wins", parse_number(nth_word("result", 1, "-")))
    t = t.withColumn("diff", F.col("w_l_o_u") - F.col("wins"))
    return top_n(t, "diff", 3, partition=SEASON).select(
        SEASON, "tm", r6("w_l_o_u").alias("w_l_o_u"), "result", r6("diff").alias("diff"))


# --- L49: challenge success rate (orders stand in for challenge reviews) ---------------------

@register("award_success_rate", """
SELECT team_challenged, count(*) AS num_challenges,
       count_if(regexp_matches(challenge_outcome, 'Successful')) AS successful_challenges,
       round(count_if(regexp_matches(challenge_outcome, 'Successful')) / count(*), 6) AS success_rate
FROM (SELECT o_orderpriority AS team_challenged,
             CASE WHEN o_orderstatus = 'F' THEN 'Successful' ELSE 'Unsuccessful' END AS challenge_outcome
      FROM orders) c
GROUP BY 1 QUALIFY rank() OVER (ORDER BY successful_challenges / num_challenges DESC) <= 5""")
def award_success_rate(spark, sf):
    from courtstats.sources.tables import table

    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("team_challenged"),
        F.when(F.col("o_orderstatus") == "F", "Successful").otherwise("Unsuccessful").alias("challenge_outcome"))
    g = o.groupBy("team_challenged").agg(
        F.count(F.lit(1)).alias("num_challenges"),
        F.count_if(F.col("challenge_outcome").rlike("Successful")).alias("successful_challenges"))
    g = g.withColumn("success_rate", F.col("successful_challenges") / F.col("num_challenges"))
    return top_n(g, "success_rate", 5).withColumn("success_rate", r6("success_rate"))


# --- L51: career totals with guarded percentages -----------------------------------------------

CAREER_COLS = ["g", "gs", "mp", "fg", "fga", "x3p", "x3pa", "ft", "fta", "trb", "ast", "pts"]


@register("award_career_totals", O.with_views(O.PLAYER_SEASON, body="""
SELECT player_id, min(season) AS first_seas, max(season) AS last_seas, """ + ", ".join(
    f"CAST(sum({c}) AS {'DOUBLE' if c == 'mp' else 'BIGINT'}) AS career_{c}" for c in CAREER_COLS) + """,
  CASE WHEN sum(fga) = 0 THEN 0.0 ELSE round(sum(fg) / sum(fga), 6) END AS career_fg_percent,
  CASE WHEN sum(x3pa) = 0 THEN 0.0 ELSE round(sum(x3p) / sum(x3pa), 6) END AS career_x3p_percent,
  CASE WHEN sum(fta) = 0 THEN 0.0 ELSE round(sum(ft) / sum(fta), 6) END AS career_ft_percent
FROM player_season GROUP BY player_id"""))
def award_career_totals(spark, sf):
    ps = V.player_season(spark, sf)
    car = ps.groupBy("player_id").agg(F.min(SEASON).alias("first_seas"), F.max(SEASON).alias("last_seas"),
                                      *[F.sum(c).alias("career_" + c) for c in CAREER_COLS])
    return car.withColumns({
        f"career_{a}_percent": r6(safe_div(f"career_{a}", f"career_{b}", "zero"))
        for a, b in (("fg", "fga"), ("x3p", "x3pa"), ("ft", "fta"))})


@register("career_span", O.with_views(O.PLAYER_SEASON, body="""
SELECT player_id, min(season) AS first_seas, max(season) AS last_seas, count(*) AS seasons
FROM player_season GROUP BY player_id"""))
def career_span(spark, sf):
    ps = V.player_season(spark, sf)
    return ps.groupBy("player_id").agg(F.min(SEASON).alias("first_seas"), F.max(SEASON).alias("last_seas"),
                                       F.count(F.lit(1)).alias("seasons"))


# --- L35: contract value (salary text, cap by season) ----------------------------------------

MIN_SALARY = 20000

_CONTRACT_SQL = O.BOX_ALL + "," + O.CAP + """,
contracts AS (SELECT player_id, tm, season, CAST(mp * 1000 + pts * 100 AS BIGINT) AS salary
              FROM player_team_season WHERE tm <> 'TOT'),
sal AS (
  SELECT c.player_id, c.season, c.tm, p.player, p.experience, p.age, c.salary, p.vorp,
         p.vorp / c.salary * 1000000 AS vorp_per_million, c.salary / k.cap AS percent_of_cap
  FROM contracts c JOIN player_season p ON p.player_id = c.player_id AND p.season = c.season
  LEFT JOIN cap k ON k.season = c.season
  WHERE p.vorp IS NOT NULL
)"""


def _contracts(spark, sf):
    pts = V.player_team_season(spark, sf).filter(F.col("tm") != "TOT")
    # the landed contracts table carries salaries as text ("$1,234,567")
    raw = pts.select("player_id", "tm", SEASON, F.concat(F.lit("$"), F.format_number(
        (F.col("mp") * 1000 + F.col("pts") * 100).cast("long"), 0)).alias("salary_text"))
    c = raw.withColumn("salary", parse_number("salary_text").cast("long")).drop("salary_text")
    ps = V.player_season(spark, sf).select("player_id", SEASON, "player", "experience", "age", "vorp")
    j = c.join(ps, ["player_id", SEASON]).join(V.cap(spark, sf), SEASON, "left")
    j = j.filter(F.col("vorp").isNotNull())
    return j.withColumns({"vorp_per_million": F.col("vorp") / F.col("salary") * 1000000,
                          "percent_of_cap": F.col("salary") / F.col("cap")})


@register("award_contract_value", O.with_views(_CONTRACT_SQL, body=f"""
SELECT season, player, tm, salary, round(vorp, 6) AS vorp, round(vorp_per_million, 6) AS vorp_per_million,
       round(percent_of_cap, 9) AS percent_of_cap
FROM sal WHERE experience > 4 AND salary > {MIN_SALARY}
QUALIFY rank() OVER (PARTITION BY season ORDER BY vorp_per_million DESC) <= 10"""))
def award_contract_value(spark, sf):
    j = _contracts(spark, sf).filter((F.col("experience") > 4) & (F.col("salary") > MIN_SALARY))
    t = top_n(j, "vorp_per_million", 10, partition=SEASON)
    return t.select(SEASON, "player", "tm", "salary", r6("vorp").alias("vorp"),
                    r6("vorp_per_million").alias("vorp_per_million"),
                    F.round("percent_of_cap", 9).alias("percent_of_cap"))


@register("cap_share", O.with_views(_CONTRACT_SQL, body="""
SELECT season, count(*) AS n, round(max(percent_of_cap), 9) AS max_share FROM sal GROUP BY season"""))
def cap_share(spark, sf):
    return _contracts(spark, sf).groupBy(SEASON).agg(F.count(F.lit(1)).alias("n"),
                                                     F.round(F.max("percent_of_cap"), 9).alias("max_share"))


@register("parse_number", O.with_views(_CONTRACT_SQL, body="""
SELECT player_id, tm, season, salary FROM contracts"""))
def parse_number_q(spark, sf):
    pts = V.player_team_season(spark, sf).filter(F.col("tm") != "TOT")
    raw = pts.select("player_id", "tm", SEASON, F.concat(F.lit("$"), F.format_number(
        (F.col("mp") * 1000 + F.col("pts") * 100).cast("long"), 0)).alias("salary_text"))
    return raw.select("player_id", "tm", SEASON, parse_number("salary_text").cast("long").alias("salary"))


# --- L50: positional rotations ---------------------------------------------------------------

# Nation keys of the 'West' conference (the rest are 'East').
WEST = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]
POSITIONS = {"guard_percent": ("pg_percent", "sg_percent"), "wing_small_percent": ("sg_percent", "sf_percent"),
             "wing_big_percent": ("sf_percent", "pf_percent"), "big_percent": ("pf_percent", "c_percent")}


def _positions(spark, sf):
    pts = V.player_team_season(spark, sf).filter(F.col("tm") != "TOT")
    dim = V._customer_dim(spark, sf).select("player_id", "player")
    p = pts.join(dim, "player_id", "left").na.fill(
        {c: 0.0 for c in ("pg_percent", "sg_percent", "sf_percent", "pf_percent", "c_percent")})
    p = p.withColumns({k: F.col(a) + F.col(b) for k, (a, b) in POSITIONS.items()})
    long = unpivot(p.select("player_id", "player", "tm", SEASON, "g", "mp", "vorp", *POSITIONS),
                   ["player_id", "player", "tm", SEASON, "g", "mp", "vorp"], list(POSITIONS), "position", "value")
    best = top_n(long, "value", 1, partition=["player_id", "tm", SEASON])
    height = (F.lit(66) + F.col("player_id") % 23)
    best = best.withColumn("position", F.when(height >= 84, "big_percent").when(height <= 72, "guard_percent")
                           .otherwise(F.col("position")))
    best = best.withColumn("position_2", nth_word("position", 1, "_"))
    best = group_argmax(best, ["player_id", "tm", SEASON, "position_2"], "value", tiebreak=["position"])
    lead = group_argmax(best, ["tm", SEASON, "position_2"], "vorp", tiebreak=["player_id"]) \
        .select("player_id", "tm", SEASON, "position_2", F.lit(True).alias("leader"))
    return best.join(lead, ["player_id", "tm", SEASON, "position_2"], "left").na.fill({"leader": False})


def _rotations(spark, sf):
    p = _positions(spark, sf)
    wo = p.filter(~F.col("leader")).groupBy("tm", SEASON, "position_2").agg(
        F.round(F.sum("vorp"), 6).alias("pos_vorp_wo_leader"))
    rot = p.groupBy("tm", SEASON, "position_2").agg(
        ordered_listagg("player", "vorp DESC, player_id ASC").alias("rotation"))
    conf = V.teams(spark, sf).select("tm", F.when(F.substring("tm", 2, 2).cast("int").isin(WEST), "West")
                                     .otherwise("East").alias("conference"))
    return rot.join(wo, ["tm", SEASON, "position_2"], "left").join(conf, "tm", "left")


_ROT_SQL = O.PLAYER_TEAM_SEASON + "," + O.CUSTOMER_DIM + "," + O.TEAMS + """,
pos0 AS (
  SELECT p.player_id, d.player, p.tm, p.season, p.g, p.mp, p.vorp,
    coalesce(pg_percent, 0) + coalesce(sg_percent, 0) AS guard_percent,
    coalesce(sg_percent, 0) + coalesce(sf_percent, 0) AS wing_small_percent,
    coalesce(sf_percent, 0) + coalesce(pf_percent, 0) AS wing_big_percent,
    coalesce(pf_percent, 0) + coalesce(c_percent, 0) AS big_percent
  FROM player_team_season p LEFT JOIN customer_dim d ON d.player_id = p.player_id WHERE p.tm <> 'TOT'
),
pos1 AS (UNPIVOT pos0 ON guard_percent, wing_small_percent, wing_big_percent, big_percent INTO NAME position VALUE value),
pos2 AS (SELECT * FROM pos1 QUALIFY rank() OVER (PARTITION BY player_id, tm, season ORDER BY value DESC) <= 1),
pos3 AS (SELECT * EXCLUDE (position), CASE WHEN 66 + player_id % 23 >= 84 THEN 'big_percent'
                 WHEN 66 + player_id % 23 <= 72 THEN 'guard_percent' ELSE position END AS position FROM pos2),
pos4 AS (SELECT *, split_part(position, '_', 1) AS position_2 FROM pos3
         QUALIFY row_number() OVER (PARTITION BY player_id, tm, season, split_part(position, '_', 1)
                                    ORDER BY value DESC, position) = 1),
leaders AS (SELECT player_id, tm, season, position_2 FROM pos4
            QUALIFY row_number() OVER (PARTITION BY tm, season, position_2 ORDER BY vorp DESC, player_id) = 1),
pos5 AS (SELECT p.*, l.player_id IS NOT NULL AS leader FROM pos4 p LEFT JOIN leaders l
         ON l.player_id = p.player_id AND l.tm = p.tm AND l.season = p.season AND l.position_2 = p.position_2),
rot AS (
  SELECT r.tm, r.season, r.position_2, r.rotation, w.pos_vorp_wo_leader,
         CASE WHEN CAST(substr(r.tm, 2, 2) AS INTEGER) IN (""" + ", ".join(map(str, WEST)) + """) THEN 'West' ELSE 'East' END AS conference
  FROM (SELECT tm, season, position_2, listagg(player, ', ' ORDER BY vorp DESC, player_id ASC) AS rotation
        FROM pos5 GROUP BY 1, 2, 3) r
  LEFT JOIN (SELECT tm, season, position_2, round(sum(vorp), 6) AS pos_vorp_wo_leader FROM pos5 WHERE NOT leader GROUP BY 1, 2, 3) w
    ON w.tm = r.tm AND w.season = r.season AND w.position_2 = r.position_2
)"""


@register("award_rotations", O.with_views(_ROT_SQL, body="""
SELECT tm, season, position_2, conference, rotation, round(pos_vorp_wo_leader, 6) AS pos_vorp_wo_leader FROM rot
WHERE pos_vorp_wo_leader IS NOT NULL
QUALIFY rank() OVER (PARTITION BY season, position_2, conference ORDER BY pos_vorp_wo_leader DESC) <= 5"""))
def award_rotations(spark, sf):
    r = top_n(_rotations(spark, sf), "pos_vorp_wo_leader", 5, partition=[SEASON, "position_2", "conference"])
    return r.select("tm", SEASON, "position_2", "conference", "rotation",
                    r6("pos_vorp_wo_leader").alias("pos_vorp_wo_leader"))


@register("ordered_listagg", O.with_views(_ROT_SQL, body="SELECT tm, season, position_2, rotation FROM rot"))
def ordered_listagg_q(spark, sf):
    return _rotations(spark, sf).select("tm", SEASON, "position_2", "rotation")


@register("sum_wo_leader", O.with_views(_ROT_SQL, body="""
SELECT tm, season, position_2, round(pos_vorp_wo_leader, 6) AS pos_vorp_wo_leader FROM rot"""))
def sum_wo_leader(spark, sf):
    return _rotations(spark, sf).select("tm", SEASON, "position_2", r6("pos_vorp_wo_leader").alias("pos_vorp_wo_leader"))


@register("leader_flag", O.with_views(_ROT_SQL, body="""
SELECT tm, season, player_id, position_2, coalesce(vorp = max(vorp) OVER (PARTITION BY tm, season, position_2), false) AS leader
FROM pos4"""))
def leader_flag_q(spark, sf):
    p = _positions(spark, sf).drop("leader")
    return leader_flag(p, ["tm", SEASON, "position_2"], "vorp").select("tm", SEASON, "player_id", "position_2", "leader")


@register("top_groups_expanded", O.with_views(_ROT_SQL, body="""
, top AS (SELECT * FROM rot WHERE pos_vorp_wo_leader IS NOT NULL
          QUALIFY rank() OVER (PARTITION BY season, position_2, conference ORDER BY pos_vorp_wo_leader DESC) <= 5)
SELECT t.position_2, t.conference, t.season, t.tm, p.player_id, p.player, p.g, p.mp, round(p.vorp, 6) AS vorp,
       round(t.pos_vorp_wo_leader, 6) AS pos_vorp_wo_leader
FROM top t JOIN pos5 p ON p.tm = t.tm AND p.season = t.season AND p.position_2 = t.position_2""".replace("\n, top", ",\ntop", 1)))
def top_groups_expanded_q(spark, sf):
    """Every (position, conference) cell of :func:`top_groups_expanded`."""
    return top_groups_expanded(spark, sf)


def top_groups_expanded(spark, sf, position=None, conf=None):
    """K3: the top 5 groups of a (position, conference) cell -- or of every cell --
    by the sum without the leader, re-expanded to their members, best group
    and best member first."""
    r = _rotations(spark, sf)
    if position is not None:
        r = r.filter(F.col("position_2") == position)
    if conf is not None:
        r = r.filter(F.col("conference") == conf)
    top = top_n(r, "pos_vorp_wo_leader", 5, partition=[SEASON, "position_2", "conference"])
    members = _positions(spark, sf).select("tm", SEASON, "position_2", "player_id", "player", "g", "mp", "vorp")
    j = top.join(members, ["tm", SEASON, "position_2"])
    return j.select("position_2", "conference", SEASON, "tm", "player_id", "player", "g", "mp", r6("vorp").alias("vorp"),
                    r6("pos_vorp_wo_leader").alias("pos_vorp_wo_leader")) \
            .orderBy(SEASON, "position_2", "conference", F.desc("pos_vorp_wo_leader"), "tm", F.desc("vorp"), "player_id")
