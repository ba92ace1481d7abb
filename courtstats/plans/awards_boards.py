"""Season and career boards: every event and box-score award a second time, by
season and over the whole career, and the sequence operators in chunked form."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtstats.functions.arith import safe_div
from courtstats.functions.predicates import text_any
from courtstats.functions.text import game_season, height_inches, split_typed
from courtstats.operators import events as EV
from courtstats.operators.aggregate import exact_median, grouping_sets_leaderboard
from courtstats.operators.rank import leader_flag, slice_range, top_n
from courtstats.operators.sequence import fill, neighbours, running_sum
from courtstats.plans import oracle_views as O
from courtstats.plans import views as V
from courtstats.plans.awards_box import _CONTRACT_SQL, _Q, _contracts, _qualified
from courtstats.plans.awards_events import (
    _BLOCKED_DUNKS_SQL, _MADE_ALLEY_SQL, _SM_SQL, EVENT_COUNT_PATTERN, S, _blocked_dunks, _rx, _text_kind,
)
from courtstats.plans.q_relational import _BIO_SQL, _bio
from courtstats.plans.registry import r6, register, sql_any
from courtstats.sources.tables import table

SEASON = "season"

# --- event boards: one grouping-sets pass gives season and career ------------------------


def _event_sql(source: str, entity: str, views: str = O.PBP, count: str = "count(*)", n: int = 10, extra: str = "") -> str:
    scope = "CASE WHEN grouping(SEASON) = 1 THEN 'career' ELSE 'season' END"
    return O.with_views(views, body=f"""
SELECT SEASON, {entity}{extra and ', ' + extra}, CAST({count} AS BIGINT) AS count, {scope} AS scope FROM ({source}) x
GROUP BY GROUPING SETS ((SEASON, {entity}{extra and ', ' + extra}), ({entity}{extra and ', ' + extra}))
QUALIFY rank() OVER (PARTITION BY {scope}{extra and ', ' + extra} ORDER BY {count} DESC) <= {n}""")


def _board(df, entity, n=10, agg=None):
    return grouping_sets_leaderboard(df, entity, "SEASON", [(agg if agg is not None else F.count(F.lit(1))).alias("count")],
                                     "count", n)


@register("award_blocked_dunks_by_blocker_boards", _event_sql(_BLOCKED_DUNKS_SQL, "PLAYER3_NAME"))
def award_blocked_dunks_by_blocker_boards(spark, sf):
    return _board(_blocked_dunks(spark, sf), "PLAYER3_NAME")


@register("award_blocked_dunks_by_shooter_boards", _event_sql(_BLOCKED_DUNKS_SQL, "PLAYER1_NAME"))
def award_blocked_dunks_by_shooter_boards(spark, sf):
    return _board(_blocked_dunks(spark, sf), "PLAYER1_NAME")


@register("award_pair_boards", _event_sql(
    f"SELECT SEASON, least(PLAYER1_NAME, PLAYER2_NAME) AS p1, greatest(PLAYER1_NAME, PLAYER2_NAME) AS p2 FROM ({_MADE_ALLEY_SQL}) a",
    "p1, p2"))
def award_pair_boards(spark, sf):
    made = V.log(spark, sf).filter(text_any(S, "Alley")).filter(~text_any(S, "MISS", kind="starts")).filter(
        F.col("PLAYER2_NAME").isNotNull())
    return _board(made.select("SEASON", F.least("PLAYER1_NAME", "PLAYER2_NAME").alias("p1"),
                              F.greatest("PLAYER1_NAME", "PLAYER2_NAME").alias("p2")), ["p1", "p2"])


@register("award_event_count_boards", _event_sql(
    f"""SELECT SEASON, PLAYER1_NAME, coalesce(nullif(regexp_extract(HOMEDESCRIPTION, '{EVENT_COUNT_PATTERN}', 0), ''),
        nullif(regexp_extract(VISITORDESCRIPTION, '{EVENT_COUNT_PATTERN}', 0), '')) AS kind
        FROM pbp WHERE {sql_any(_rx(EVENT_COUNT_PATTERN))}""", "PLAYER1_NAME", extra="kind"))
def award_event_count_boards(spark, sf):
    from courtstats.operators.aggregate import season_and_career

    log = V.log(spark, sf).filter(text_any(S, EVENT_COUNT_PATTERN)).withColumn("kind", _text_kind(EVENT_COUNT_PATTERN))
    g = season_and_career(log, ["PLAYER1_NAME", "kind"], "SEASON", [F.count(F.lit(1)).alias("count")])
    return top_n(g, "count", 10, partition=["scope", "kind"])


_SM_SEASON = _SM_SQL.replace("f.GAME_ID\n", "f.GAME_ID, f.SEASON\n")


@register("award_same_moment_fouls_boards", _event_sql("SELECT * FROM matches", "PLAYER1_NAME_x", _SM_SEASON))
def award_same_moment_fouls_boards(spark, sf):
    return _board(EV.same_moment_counts(V.log(spark, sf), extra=["SEASON"]), "PLAYER1_NAME_x", agg=F.sum("n"))


@register("award_same_moment_drawn_boards", _event_sql("SELECT * FROM matches", "PLAYER1_NAME_y", _SM_SEASON))
def award_same_moment_drawn_boards(spark, sf):
    return _board(EV.same_moment_counts(V.log(spark, sf), extra=["SEASON"]), "PLAYER1_NAME_y", agg=F.sum("n"))


@register("award_same_moment_drawn_rate", O.with_views(_SM_SQL, body=f"""
SELECT m.PLAYER1_NAME_y AS player, m.drawn, a.attempts, round(m.drawn / a.attempts, 6) AS drawn_per_attempt
FROM (SELECT PLAYER1_NAME_y, count(*) AS drawn FROM matches GROUP BY 1) m
JOIN (SELECT PLAYER1_NAME, count(*) AS attempts FROM pbp WHERE {sql_any(_rx('3PT'))} GROUP BY 1) a
  ON a.PLAYER1_NAME = m.PLAYER1_NAME_y
QUALIFY rank() OVER (ORDER BY m.drawn / a.attempts DESC) <= 5"""))
def award_same_moment_drawn_rate(spark, sf):
    """Fouls drawn on threes per three-point attempt."""
    log = V.log(spark, sf)
    drawn = EV.same_moment_counts(log).groupBy(F.col("PLAYER1_NAME_y").alias("player")).agg(F.sum("n").alias("drawn"))
    tries = log.filter(text_any(S, "3PT")).groupBy(F.col("PLAYER1_NAME").alias("_p")).agg(F.count(F.lit(1)).alias("attempts"))
    j = drawn.join(tries, drawn["player"] == tries["_p"]).withColumn("drawn_per_attempt", safe_div("drawn", "attempts"))
    return top_n(j, "drawn_per_attempt", 5).select("player", "drawn", "attempts", r6("drawn_per_attempt").alias("drawn_per_attempt"))


# --- career boards of box-score awards ------------------------------------------------------

#: name: (value over the career, least total, best first)
CAREER = {
    "award_best_pct_career": (lambda t: F.try_divide(t("x3p"), t("x3pa")), lambda t: t("x3p") >= 5, True),
    "award_worst_pct_career": (lambda t: F.try_divide(t("x2p"), t("x2pa")), lambda t: t("fg") >= 8, False),
    "award_most_minutes_career": (lambda t: t("mp"), lambda t: t("g") >= 1, True),
    "award_minutes_per_game_career": (lambda t: t("mp") / t("g"), lambda t: t("g") >= 3, True),
    "award_share_of_total_career": (lambda t: F.try_divide(t("pts"), t("pts") + t("trb") + t("ast") + t("stl") + t("blk")), lambda t: t("g") >= 3, True),
    "award_ratio_high_career": (lambda t: t("fga") / t("ast"), lambda t: (t("ast") > 0) & (t("g") >= 3), True),
    "award_ratio_low_career": (lambda t: t("fga") / t("ast"), lambda t: (t("ast") > 0) & (t("g") >= 3), False),
}

_CAREER_TOTALS = O.PLAYER_SEASON + """,
totals AS (
  SELECT player_id, CAST(sum(x3p) AS DOUBLE) x3p, sum(x3pa) x3pa, CAST(sum(x2p) AS DOUBLE) x2p, sum(x2pa) x2pa, sum(fg) fg,
    CAST(sum(fga) AS DOUBLE) fga, sum(mp) mp, sum(g) g, CAST(sum(pts) AS DOUBLE) pts, sum(trb) trb, sum(ast) ast, sum(stl) stl, sum(blk) blk
  FROM player_season GROUP BY player_id)"""
CAREER_SQL = {
    "award_best_pct_career": """
SELECT player_id, round(x3p / x3pa, 6) AS value FROM totals WHERE x3p >= 5 AND x3pa > 0
QUALIFY rank() OVER (ORDER BY x3p / x3pa DESC) <= 10""",
    "award_worst_pct_career": """
SELECT player_id, round(x2p / x2pa, 6) AS value FROM totals WHERE fg >= 8 AND x2pa > 0
QUALIFY rank() OVER (ORDER BY x2p / x2pa) <= 10""",
    "award_most_minutes_career": """
SELECT player_id, round(mp, 6) AS value FROM totals WHERE g >= 1 QUALIFY rank() OVER (ORDER BY mp DESC) <= 10""",
    "award_minutes_per_game_career": """
SELECT player_id, round(mp / g, 6) AS value FROM totals WHERE g >= 3 QUALIFY rank() OVER (ORDER BY mp / g DESC) <= 10""",
    "award_share_of_total_career": """
SELECT player_id, round(pts / (pts + trb + ast + stl + blk), 6) AS value FROM totals WHERE g >= 3 AND pts + trb + ast + stl + blk > 0
QUALIFY rank() OVER (ORDER BY pts / (pts + trb + ast + stl + blk) DESC) <= 10""",
    "award_ratio_high_career": """
SELECT player_id, round(fga / ast, 6) AS value FROM totals WHERE ast > 0 AND g >= 3 QUALIFY rank() OVER (ORDER BY fga / ast DESC) <= 10""",
    "award_ratio_low_career": """
SELECT player_id, round(fga / ast, 6) AS value FROM totals WHERE ast > 0 AND g >= 3 QUALIFY rank() OVER (ORDER BY fga / ast) <= 10""",
}
CAREER_TOTALS = ("x3p", "x3pa", "x2p", "x2pa", "fg", "fga", "mp", "g", "pts", "trb", "ast", "stl", "blk")


def _career(name, value, least, best):
    def build(spark, sf):
        g = V.player_season(spark, sf).groupBy("player_id").agg(*[F.sum(c).cast("double").alias(c) for c in CAREER_TOTALS])
        g = g.filter(least(F.col)).withColumn("value", value(F.col))
        return top_n(g, "value", 10, descending=best).select("player_id", r6("value").alias("value"))

    register(name, O.with_views(_CAREER_TOTALS, body=CAREER_SQL[name]))(build)


for _name, (_value, _least, _best) in CAREER.items():
    _career(_name, _value, _least, _best)


_BENCH_SQL = _Q + """,
bench AS (SELECT * FROM (SELECT * FROM q WHERE g_percent >= 0.5 AND tm <> 'TOT' AND mp / g IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY tm, season ORDER BY mp / g DESC, player_id) BETWEEN 6 AND 9) x WHERE gs / g <= 0.5)"""


def _bench(spark, sf):
    q = _qualified(spark, sf, 0.5).filter(F.col("tm") != "TOT").withColumn("mp_per_game", safe_div("mp", "g"))
    s = slice_range(q.filter(F.col("mp_per_game").isNotNull()), ["tm", SEASON], "mp_per_game", 6, 9, tiebreak=["player_id"])
    return s.filter(F.col("gs") / F.col("g") <= 0.5)


@register("award_sixth_man_points", O.with_views(_BENCH_SQL, body="""
SELECT season, player, tm, round(pts / g, 6) AS pts_per_game FROM bench
QUALIFY rank() OVER (PARTITION BY season ORDER BY pts / g DESC) <= 5"""))
def award_sixth_man_points(spark, sf):
    b = _bench(spark, sf).withColumn("pts_per_game", safe_div("pts", "g"))
    return top_n(b, "pts_per_game", 5, partition=SEASON).select(SEASON, "player", "tm", r6("pts_per_game").alias("pts_per_game"))


@register("award_sixth_man_career", O.with_views(_BENCH_SQL, body="""
SELECT player_id, count(*) AS seasons, round(sum(vorp), 6) AS vorp FROM bench GROUP BY player_id
QUALIFY rank() OVER (ORDER BY round(sum(vorp), 6) DESC) <= 10"""))
def award_sixth_man_career(spark, sf):
    c = _bench(spark, sf).groupBy("player_id").agg(F.count(F.lit(1)).alias("seasons"), r6(F.sum("vorp")).alias("vorp"))
    return top_n(c, "vorp", 10)


@register("award_best_fifth_career", O.with_views(_Q, body="""
SELECT player_id, count(*) AS seasons, round(sum(vorp), 6) AS vorp FROM (
  SELECT * FROM q WHERE gs / g_total >= 0.5 AND tm <> 'TOT'
  QUALIFY row_number() OVER (PARTITION BY tm, season ORDER BY mp DESC, player_id) = 5) x
GROUP BY player_id QUALIFY rank() OVER (ORDER BY round(sum(vorp), 6) DESC) <= 10"""))
def award_best_fifth_career(spark, sf):
    """Fifth starters (by minutes), their seasons and value added over the career."""
    q = _qualified(spark, sf, 0.0).filter((safe_div("gs", "g_total") >= 0.5) & (F.col("tm") != "TOT"))
    f = slice_range(q, ["tm", SEASON], "mp", 5, 5, tiebreak=["player_id"])
    c = f.groupBy("player_id").agg(F.count(F.lit(1)).alias("seasons"), r6(F.sum("vorp")).alias("vorp"))
    return top_n(c, "vorp", 10)


_REB_CAREER = O.PLAYER_SEASON + ",\n" + _BIO_SQL + """,
car AS (SELECT p.player_id, sum(p.stl) AS stl, sum(p.trb) AS trb, any_value(b.PLAYER_HEIGHT_INCHES) AS height
        FROM player_season p JOIN bio b ON b.PLAYER_ID = p.player_id GROUP BY p.player_id HAVING sum(p.trb) >= 25)"""


def _reb_career(spark, sf):
    c = V.player_season(spark, sf).groupBy("player_id").agg(F.sum("stl").alias("stl"), F.sum("trb").alias("trb"))
    b = _bio(spark, sf).withColumnsRenamed({"PLAYER_ID": "player_id", "PLAYER_HEIGHT_INCHES": "height"})
    return c.filter("trb >= 25").join(b, "player_id").withColumn("share", safe_div("stl", "trb"))


@register("award_share_low_career", O.with_views(_REB_CAREER, body="""
SELECT player_id, round(stl / trb, 6) AS share FROM car WHERE height > 78 QUALIFY rank() OVER (ORDER BY stl / trb) <= 10"""))
def award_share_low_career(spark, sf):
    r = _reb_career(spark, sf).filter("height > 78")
    return top_n(r, "share", 10, descending=False).select("player_id", r6("share").alias("share"))


@register("award_share_high_career", O.with_views(_REB_CAREER, body="""
SELECT player_id, round(stl / trb, 6) AS share FROM car QUALIFY rank() OVER (ORDER BY stl / trb DESC) <= 10"""))
def award_share_high_career(spark, sf):
    """All heights."""
    return top_n(_reb_career(spark, sf), "share", 10).select("player_id", r6("share").alias("share"))


# --- contracts: per-cap board and career roll-up ----------------------------------------------

@register("award_contract_cap_share", O.with_views(_CONTRACT_SQL, body="""
SELECT season, player, tm, round(vorp / (percent_of_cap * 100), 6) AS vorp_per_cap_percent FROM sal
WHERE experience > 4 AND percent_of_cap > 0
QUALIFY rank() OVER (PARTITION BY season ORDER BY round(vorp / (percent_of_cap * 100), 6) DESC) <= 10"""))
def award_contract_cap_share(spark, sf):
    j = _contracts(spark, sf).filter((F.col("experience") > 4) & (F.col("percent_of_cap") > 0))
    j = j.withColumn("vorp_per_cap_percent", r6(F.col("vorp") / (F.col("percent_of_cap") * 100)))
    return top_n(j, "vorp_per_cap_percent", 10, partition=SEASON).select(SEASON, "player", "tm", "vorp_per_cap_percent")


@register("award_contract_value_career", O.with_views(_CONTRACT_SQL, body="""
SELECT player_id, CAST(sum(salary) AS BIGINT) AS salary, round(sum(vorp), 6) AS vorp,
       round(sum(vorp) / sum(salary) * 1000000, 6) AS vorp_per_million
FROM (SELECT player_id, season, sum(salary) AS salary, any_value(vorp) AS vorp FROM sal GROUP BY 1, 2) x
GROUP BY player_id HAVING count(*) >= 2
QUALIFY rank() OVER (ORDER BY round(sum(vorp) / sum(salary) * 1000000, 6) DESC) <= 10"""))
def award_contract_value_career(spark, sf):
    """Several contracts in a season are one; value per million over the career."""
    s = _contracts(spark, sf).groupBy("player_id", SEASON).agg(F.sum("salary").alias("salary"), F.max("vorp").alias("vorp"))
    c = s.groupBy("player_id").agg(F.count(F.lit(1)).alias("n"), F.sum("salary").alias("salary"), F.sum("vorp").alias("vorp"))
    c = c.filter("n >= 2").withColumn("vorp_per_million", r6(F.col("vorp") / F.col("salary") * 1000000))
    return top_n(c, "vorp_per_million", 10).select("player_id", "salary", r6("vorp").alias("vorp"), "vorp_per_million")


# --- median form of the on/off gap ----------------------------------------------------------

@register("award_gap_median", O.with_views(_Q, body="""
, p AS (SELECT * FROM q WHERE tm <> 'TOT' AND g_percent >= 0.5 AND mp / g >= 10),
m AS (SELECT tm, season, median(net_plus_minus_per_100_poss) AS med, max(net_plus_minus_per_100_poss) AS best
      FROM p GROUP BY tm, season)
SELECT p.season, p.tm, p.player, round(m.best, 6) AS best, round(m.med, 6) AS median, round(m.best - m.med, 6) AS gap
FROM p JOIN m ON m.tm = p.tm AND m.season = p.season AND p.net_plus_minus_per_100_poss = m.best
QUALIFY rank() OVER (PARTITION BY p.season ORDER BY round(m.best - m.med, 6) DESC) <= 5""".replace("\n, p AS", ",\np AS", 1)))
def award_gap_median(spark, sf):
    """Best player against the median player of the team."""
    npm = "net_plus_minus_per_100_poss"
    p = _qualified(spark, sf, 0.5).filter((F.col("tm") != "TOT") & (F.col("mp") / F.col("g") >= 10))
    m = exact_median(p, ["tm", SEASON], npm)
    best = leader_flag(p, ["tm", SEASON], npm).filter("leader").withColumn("best", F.col(npm))
    j = best.select("tm", SEASON, "player", "best").join(m, ["tm", SEASON])
    j = j.withColumn("gap", r6(F.col("best") - F.col("median")))
    return top_n(j, "gap", 5, partition=SEASON).select(SEASON, "tm", "player", r6("best").alias("best"),
                                                       r6("median").alias("median"), "gap")


# --- text helpers on whole tables ---------------------------------------------------------------

@register("height_text", """
SELECT c_custkey, CAST(5 + c_custkey % 3 AS INTEGER) * 12 + CAST(c_custkey % 12 AS INTEGER) AS inches,
       CAST(5 + c_custkey % 3 AS INTEGER) AS feet, CAST(c_custkey % 12 AS INTEGER) AS inch FROM customer""")
def height_text(spark, sf):
    """"6-7" to inches, and split into typed columns."""
    c = table(spark, sf, "customer").select("c_custkey", F.concat_ws(
        "-", (F.lit(5) + F.col("c_custkey") % 3).cast("string"), (F.col("c_custkey") % 12).cast("string")).alias("height"))
    c = c.withColumn("inches", height_inches("height"))
    return split_typed(c, "height", "-", {"feet": "int", "inch": "int"}).drop("height")


@register("game_season", """
SELECT yr, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 100 >= 46 THEN 1900 ELSE 2000 END + CAST(o_orderkey % 100 AS INTEGER) AS yr
FROM orders) x GROUP BY yr""")
def game_season_q(spark, sf):
    """Season of a ten-digit game id with a two-digit year."""
    o = table(spark, sf, "orders").select(F.concat(
        F.lit("002"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit("00001")).alias("gid"))
    return o.groupBy(game_season("gid").alias("yr")).agg(F.count(F.lit(1)).alias("n"))


# --- sequence operators with cuts inside every game ------------------------------------------------

CHUNK = 7


@register("running_sum_chunked", O.with_views(O.PBP, body="""
SELECT GAME_ID, EVENTNUM, CAST(sum(PLAYER2_ID) OVER (PARTITION BY SEASON ORDER BY EVENTNUM
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM pbp"""))
def running_sum_chunked(spark, sf):
    d = running_sum(V.log(spark, sf), "SEASON", "EVENTNUM", ["PLAYER2_ID"], chunk_size=CHUNK)
    return d.select("GAME_ID", "EVENTNUM", F.col("PLAYER2_ID_run").cast("long").alias("total"))


@register("fill_chunked", O.with_views(O.PBP, body="""
SELECT GAME_ID, EVENTNUM, last_value(SCORE IGNORE NULLS) OVER (PARTITION BY GAME_ID ORDER BY EVENTNUM
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS score, first_value(PLAYER3_ID IGNORE NULLS) OVER (
  PARTITION BY PLAYER2_ID ORDER BY EVENTNUM ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_blocker FROM pbp"""))
def fill_chunked(spark, sf):
    """Down inside games, up inside a key that is often missing."""
    d = fill(V.pbp(spark, sf), "GAME_ID", "EVENTNUM", "SCORE", "down", chunk_size=CHUNK)
    d = fill(d, "PLAYER2_ID", "EVENTNUM", "PLAYER3_ID", "up", chunk_size=CHUNK)
    return d.select("GAME_ID", "EVENTNUM", F.col("SCORE").alias("score"), F.col("PLAYER3_ID").alias("next_blocker"))


@register("neighbours_chunked", O.with_views(O.PBP, body="""
SELECT GAME_ID, EVENTNUM, lead(PLAYER1_ID, 1) OVER w AS n1, lag(PLAYER3_ID, 2) OVER w AS p2, lead(SCORE, 9) OVER w AS n9
FROM pbp WINDOW w AS (PARTITION BY GAME_ID ORDER BY EVENTNUM)"""))
def neighbours_chunked(spark, sf):
    d = neighbours(V.pbp(spark, sf), "GAME_ID", "EVENTNUM",
                   {"n1": ("PLAYER1_ID", 1), "p2": ("PLAYER3_ID", -2), "n9": ("SCORE", 9)}, chunk_size=CHUNK)
    return d.select("GAME_ID", "EVENTNUM", "n1", "p2", "n9")
