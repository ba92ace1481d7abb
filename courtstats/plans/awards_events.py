"""Event-log awards and sequence-operator queries on the ``pbp`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtstats.functions.predicates import text_any
from courtstats.operators import events as EV
from courtstats.operators.aggregate import count_of_counts, group_count
from courtstats.operators.joins import row_difference
from courtstats.operators.rank import top_n
from courtstats.plans import oracle_views as O
from courtstats.plans import views as V
from courtstats.plans.registry import r6, register, sql_any, sql_none

S = list(EV.SIDES)


def _starts(p):
    return "starts_with({c}, '" + p + "')"


def _rx(p):
    return "regexp_matches({c}, '" + p + "')"


def _ends(p):
    return "ends_with({c}, '" + p + "')"


def _blocked_dunks(spark, sf):
    log = V.log(spark, sf)
    return (log.filter(text_any(S, "MISS", kind="starts")).filter(text_any(S, "Dunk"))
               .filter(text_any(S, "BLOCK")))


_BLOCKED_DUNKS_SQL = (f"SELECT * FROM pbp WHERE {sql_any(_starts('MISS'))} AND {sql_any(_rx('Dunk'))}"
                      f" AND {sql_any(_rx('BLOCK'))}")


@register("award_blocked_dunks_by_blocker", O.with_views(O.PBP, body=f"""
SELECT PLAYER3_NAME, count(*) AS count FROM ({_BLOCKED_DUNKS_SQL}) b GROUP BY PLAYER3_NAME
QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 10"""))
def award_blocked_dunks_by_blocker(spark, sf):
    return top_n(group_count(_blocked_dunks(spark, sf), "PLAYER3_NAME"), "count", 10)


@register("award_blocked_dunks_by_shooter", O.with_views(O.PBP, body=f"""
SELECT PLAYER1_NAME, count(*) AS count FROM ({_BLOCKED_DUNKS_SQL}) b GROUP BY PLAYER1_NAME
QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 10"""))
def award_blocked_dunks_by_shooter(spark, sf):
    return top_n(group_count(_blocked_dunks(spark, sf), "PLAYER1_NAME"), "count", 10)


@register("filter_chain", O.with_views(O.PBP, body=f"""
SELECT GAME_ID, EVENTNUM, PERIOD, PLAYER1_NAME, PLAYER3_NAME FROM ({_BLOCKED_DUNKS_SQL}) b"""))
def filter_chain(spark, sf):
    return _blocked_dunks(spark, sf).select("GAME_ID", "EVENTNUM", "PERIOD", "PLAYER1_NAME", "PLAYER3_NAME")


# L13-L16: one entry, the text pattern is the parameter.
EVENT_COUNT_PATTERN = "Charge|Goaltending|Kick|3 Second"


def _text_kind(pattern):
    """The part of the home text that matches, else that of the visitor text."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.col(c), pattern, 0), F.lit("")) for c in S])


@register("award_event_count", O.with_views(O.PBP, body=f"""
SELECT kind, PLAYER1_NAME, count(*) AS count FROM (
  SELECT coalesce(nullif(regexp_extract(HOMEDESCRIPTION, '{EVENT_COUNT_PATTERN}', 0), ''),
                  nullif(regexp_extract(VISITORDESCRIPTION, '{EVENT_COUNT_PATTERN}', 0), '')) AS kind,
         PLAYER1_NAME FROM pbp WHERE {sql_any(_rx(EVENT_COUNT_PATTERN))}) x
GROUP BY kind, PLAYER1_NAME
QUALIFY rank() OVER (PARTITION BY kind ORDER BY count(*) DESC) <= 10"""))
def award_event_count(spark, sf, pattern=EVENT_COUNT_PATTERN):
    log = V.log(spark, sf).filter(text_any(S, pattern))
    log = log.withColumn("kind", _text_kind(pattern))
    return top_n(group_count(log, ["kind", "PLAYER1_NAME"]), "count", 10, partition="kind")


@register("any_text_match", O.with_views(O.PBP, body=f"""
SELECT count(*) AS n_rows, count(DISTINCT GAME_ID) AS n_games FROM pbp WHERE {sql_any(_rx('S.FOUL'))}"""))
def any_text_match(spark, sf):
    log = V.log(spark, sf).filter(text_any(S, "S.FOUL"))
    return log.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("GAME_ID").alias("n_games"))


@register("any_text_prefix", O.with_views(O.PBP, body=f"""
SELECT PERIOD, count(*) AS misses FROM pbp WHERE {sql_any(_starts('MISS'))} GROUP BY PERIOD"""))
def any_text_prefix(spark, sf):
    log = V.log(spark, sf).filter(text_any(S, "MISS", kind="starts"))
    return log.groupBy("PERIOD").agg(F.count(F.lit(1)).alias("misses"))


@register("none_text_prefix", O.with_views(O.PBP, body=f"""
SELECT PERIOD, count(*) AS made FROM pbp WHERE {sql_any(_rx('PTS'))} AND {sql_none(_starts('MISS'))}
GROUP BY PERIOD"""))
def none_text_prefix(spark, sf):
    from courtstats.functions.predicates import text_none

    log = V.log(spark, sf).filter(text_any(S, "PTS")).filter(text_none(S, "MISS", kind="starts"))
    return log.groupBy("PERIOD").agg(F.count(F.lit(1)).alias("made"))


@register("regex_match", O.with_views(O.PBP, body=f"""
SELECT count_if({sql_any(_rx('S.FOUL'))}) AS regex_hits,
       count_if({sql_any("contains({c}, 'S.FOUL')")}) AS literal_hits,
       count_if({sql_any(_ends('Rebound'))}) AS ends_hits FROM pbp"""))
def regex_match(spark, sf):
    log = V.log(spark, sf)
    return log.agg(F.count_if(text_any(S, "S.FOUL")).alias("regex_hits"),
                   F.count_if(text_any(S, "S.FOUL", kind="contains")).alias("literal_hits"),
                   F.count_if(text_any(S, "Rebound", kind="ends")).alias("ends_hits"))


# --- I8 / L9-L11: alley-oop duos, passers, finishers -------------------------

_MADE_ALLEY_SQL = (f"SELECT * FROM pbp WHERE {sql_any(_rx('Alley'))} AND {sql_none(_starts('MISS'))}"
                   " AND PLAYER2_NAME IS NOT NULL")


@register("award_pair", O.with_views(O.PBP, body=f"""
SELECT least(PLAYER1_NAME, PLAYER2_NAME) AS p1, greatest(PLAYER1_NAME, PLAYER2_NAME) AS p2,
       count(*) AS count FROM ({_MADE_ALLEY_SQL}) a GROUP BY 1, 2
QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 10"""))
def award_pair(spark, sf):
    return top_n(EV.pair_leaderboard(V.log(spark, sf)), "count", 10)


@register("pair_leaderboard", O.with_views(O.PBP, body=f"""
SELECT least(PLAYER1_NAME, PLAYER2_NAME) AS p1, greatest(PLAYER1_NAME, PLAYER2_NAME) AS p2,
       count(*) AS count FROM ({_MADE_ALLEY_SQL}) a GROUP BY 1, 2"""))
def pair_leaderboard(spark, sf):
    return EV.pair_leaderboard(V.log(spark, sf))


@register("pair_key", O.with_views(O.PBP, body="""
SELECT least(PLAYER1_ID, PLAYER2_ID) AS lo, greatest(PLAYER1_ID, PLAYER2_ID) AS hi, count(*) AS n
FROM pbp GROUP BY 1, 2"""))
def pair_key(spark, sf):
    """Row-wise min / max of two columns; a missing side is ignored."""
    log = V.log(spark, sf)
    return log.groupBy(F.least("PLAYER1_ID", "PLAYER2_ID").alias("lo"),
                       F.greatest("PLAYER1_ID", "PLAYER2_ID").alias("hi")).agg(F.count(F.lit(1)).alias("n"))


def _season_career_role(spark, sf, role):
    """Passer (PLAYER2) / finisher (PLAYER1) of made alley-oops, by season and
    career from one grouping-sets pass."""
    from courtstats.operators.aggregate import grouping_sets_leaderboard

    log = V.log(spark, sf).filter(text_any(S, "Alley")).filter(
        ~text_any(S, "MISS", kind="starts")).filter(F.col("PLAYER2_NAME").isNotNull())
    return grouping_sets_leaderboard(log, role, "SEASON", [F.count(F.lit(1)).alias("count")], "count", 5)


def _season_career_sql(role):
    return O.with_views(O.PBP, body=f"""
SELECT SEASON, {role}, count(*) AS count,
       CASE WHEN grouping(SEASON) = 1 THEN 'career' ELSE 'season' END AS scope
FROM ({_MADE_ALLEY_SQL}) a GROUP BY GROUPING SETS ((SEASON, {role}), ({role}))
QUALIFY rank() OVER (PARTITION BY CASE WHEN grouping(SEASON) = 1 THEN 'career' ELSE 'season' END
                     ORDER BY count(*) DESC) <= 5""")


@register("award_passer", _season_career_sql("PLAYER2_NAME"))
def award_passer(spark, sf):
    return _season_career_role(spark, sf, "PLAYER2_NAME")


@register("award_finisher", _season_career_sql("PLAYER1_NAME"))
def award_finisher(spark, sf):
    return _season_career_role(spark, sf, "PLAYER1_NAME")


@register("grouping_sets_leaderboard", _season_career_sql("PLAYER1_NAME"))
def grouping_sets_leaderboard(spark, sf):
    return _season_career_role(spark, sf, "PLAYER1_NAME")


# --- I1 / I2 / I3: score timeline, clutch, segment differential --------------

_TIMELINE_SQL = """,
tl_fill AS (
  SELECT *,
    last_value(SCORE IGNORE NULLS) OVER (PARTITION BY GAME_ID ORDER BY EVENTNUM
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f_score,
    last_value(SCOREMARGIN IGNORE NULLS) OVER (PARTITION BY GAME_ID ORDER BY EVENTNUM
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f_margin
  FROM pbp
),
timeline AS (
  SELECT * EXCLUDE (SCORE, SCOREMARGIN, f_score, f_margin),
    coalesce(f_score, '0 - 0') AS SCORE,
    CASE WHEN coalesce(f_margin, 'TIE') = 'TIE' THEN 0 ELSE TRY_CAST(f_margin AS INTEGER) END AS SCOREMARGIN,
    TRY_CAST(split_part(coalesce(f_score, '0 - 0'), ' - ', 1) AS INTEGER) AS visitor_score,
    TRY_CAST(split_part(coalesce(f_score, '0 - 0'), ' - ', 2) AS INTEGER) AS home_score
  FROM tl_fill
),
timeline_c AS (
  SELECT *, ((PERIOD = 4 AND abs(SCOREMARGIN) <= 5 AND
              TRY_CAST(split_part(PCTIMESTRING, ':', 1) AS INTEGER) * 60
              + TRY_CAST(split_part(PCTIMESTRING, ':', 2) AS INTEGER) <= 300) OR PERIOD > 4) AS clutch
  FROM timeline
)"""
TIMELINE = O.PBP + _TIMELINE_SQL


def _scored(spark, sf):
    """The score timeline and the cuts of its log (sampled once)."""
    cuts = V.pbp_cuts(spark, sf)
    return EV.score_timeline(V.pbp(spark, sf, cuts), cuts=cuts), cuts


def _timeline(spark, sf):
    return _scored(spark, sf)[0].withColumn("clutch", EV.clutch_flag())


@register("score_timeline", O.with_views(TIMELINE, body="""
SELECT GAME_ID, EVENTNUM, SCORE, SCOREMARGIN, visitor_score, home_score FROM timeline"""))
def score_timeline(spark, sf):
    return _scored(spark, sf)[0].select(
        "GAME_ID", "EVENTNUM", "SCORE", "SCOREMARGIN", "visitor_score", "home_score")


@register("forward_fill", O.with_views(TIMELINE, body="""
SELECT GAME_ID, EVENTNUM, f_score AS score_filled FROM tl_fill"""))
def forward_fill(spark, sf):
    from courtstats.operators.sequence import fill

    cuts = V.pbp_cuts(spark, sf)
    return fill(V.pbp(spark, sf, cuts), "GAME_ID", "EVENTNUM", "SCORE", "down", cuts=cuts) \
        .select("GAME_ID", "EVENTNUM", F.col("SCORE").alias("score_filled"))


@register("backward_fill", O.with_views(O.PBP, body="""
SELECT GAME_ID, EVENTNUM,
  first_value(SCORE IGNORE NULLS) OVER (PARTITION BY GAME_ID ORDER BY EVENTNUM
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS score_next
FROM pbp"""))
def backward_fill(spark, sf):
    from courtstats.operators.sequence import fill

    cuts = V.pbp_cuts(spark, sf)
    return fill(V.pbp(spark, sf, cuts), "GAME_ID", "EVENTNUM", "SCORE", "up", cuts=cuts) \
        .select("GAME_ID", "EVENTNUM", F.col("SCORE").alias("score_next"))


@register("clutch_flag", O.with_views(TIMELINE, body="""
SELECT PERIOD, clutch, count(*) AS n FROM timeline_c GROUP BY PERIOD, clutch"""))
def clutch_flag(spark, sf):
    return _timeline(spark, sf).groupBy("PERIOD", "clutch").agg(F.count(F.lit(1)).alias("n"))


@register("clock_seconds", O.with_views(O.PBP, body="""
SELECT PCTIMESTRING, TRY_CAST(split_part(PCTIMESTRING, ':', 1) AS INTEGER) * 60
       + TRY_CAST(split_part(PCTIMESTRING, ':', 2) AS INTEGER) AS seconds, count(*) AS n
FROM pbp GROUP BY 1, 2"""))
def clock_seconds_q(spark, sf):
    from courtstats.functions.text import clock_seconds

    log = V.log(spark, sf)
    return log.groupBy("PCTIMESTRING", clock_seconds("PCTIMESTRING").alias("seconds")) \
              .agg(F.count(F.lit(1)).alias("n"))


_FT_DIFF_SQL = f"""
SELECT PLAYER1_NAME,
  count_if(clutch) AS clutch_fts_attempted,
  count_if(clutch AND {sql_any(_rx('MISS'))}) AS clutch_fts_missed,
  count_if(NOT clutch) AS non_clutch_fts_attempted,
  count_if(NOT clutch AND {sql_any(_rx('MISS'))}) AS non_clutch_fts_missed
FROM timeline_c WHERE {sql_any(_rx('Free Throw'))} GROUP BY PLAYER1_NAME"""


def _ft_diff_sql(min_n, extra=""):
    return O.with_views(TIMELINE, body=f"""
SELECT PLAYER1_NAME, clutch_fts_attempted, clutch_fts_missed, non_clutch_fts_attempted, non_clutch_fts_missed,
  round(1 - clutch_fts_missed / clutch_fts_attempted, 6) AS clutch_ft_percent,
  round(1 - non_clutch_fts_missed / non_clutch_fts_attempted, 6) AS non_clutch_ft_percent,
  round((1 - clutch_fts_missed / clutch_fts_attempted) - (1 - non_clutch_fts_missed / non_clutch_fts_attempted), 6) AS differential
FROM ({_FT_DIFF_SQL}) a
WHERE clutch_fts_attempted > 0 AND non_clutch_fts_attempted > 0 AND clutch_fts_attempted >= {min_n} {extra}""")


CLUTCH_MIN_FT = 2


def _ft_diff(spark, sf, min_n=CLUTCH_MIN_FT):
    tl = _timeline(spark, sf).filter(text_any(S, "Free Throw"))
    d = EV.segment_differential(tl, F.col("clutch"), text_any(S, "MISS"), "PLAYER1_NAME", min_n)
    return d.withColumns({c: r6(c) for c in ("clutch_ft_percent", "non_clutch_ft_percent", "differential")})


@register("segment_differential", _ft_diff_sql(CLUTCH_MIN_FT))
def segment_differential(spark, sf):
    return _ft_diff(spark, sf)


@register("award_clutch_decline", _ft_diff_sql(CLUTCH_MIN_FT, "QUALIFY rank() OVER (ORDER BY differential ASC) <= 10"))
def award_clutch_decline(spark, sf):
    d = _ft_diff(spark, sf)
    return top_n(d, "differential", 10, descending=False)


@register("award_clutch_improve", _ft_diff_sql(CLUTCH_MIN_FT, "QUALIFY rank() OVER (ORDER BY differential DESC) <= 10"))
def award_clutch_improve(spark, sf):
    return top_n(_ft_diff(spark, sf), "differential", 10)


# --- I4 / I5 / L45: game results and game-winning shots ----------------------

_GW_SQL = TIMELINE + """,
results AS (
  SELECT GAME_ID, max(visitor_score) AS vis_final, max(home_score) AS home_final,
         CASE WHEN max(home_score) > max(visitor_score) THEN 'home' ELSE 'visitor' END AS winner,
         CASE WHEN max(home_score) > max(visitor_score) THEN max(visitor_score) ELSE max(home_score) END AS loser_points
  FROM timeline GROUP BY GAME_ID
),
crossing AS (
  SELECT t.* FROM timeline t JOIN results r USING (GAME_ID)
  WHERE (r.winner = 'home' AND t.home_score > r.loser_points)
     OR (r.winner = 'visitor' AND t.visitor_score > r.loser_points)
  QUALIFY row_number() OVER (PARTITION BY t.GAME_ID ORDER BY t.EVENTNUM) = 1
),
gw AS (
  SELECT *, CASE WHEN coalesce(contains(HOMEDESCRIPTION, 'Free Throw'), false)
                   OR coalesce(contains(VISITORDESCRIPTION, 'Free Throw'), false) THEN 1
                 WHEN coalesce(contains(VISITORDESCRIPTION, '3PT'), false)
                   OR coalesce(contains(HOMEDESCRIPTION, '3PT'), false) THEN 3 ELSE 2 END AS shot_value
  FROM crossing
),
gw_players AS (
  SELECT PLAYER1_NAME, count_if(shot_value = 3) AS game_winning_3, count_if(shot_value = 2) AS game_winning_2,
         count_if(shot_value = 1) AS game_winning_ft, CAST(sum(shot_value) AS BIGINT) AS game_winning_points
  FROM gw GROUP BY PLAYER1_NAME
)"""


@register("game_results", O.with_views(_GW_SQL, body="SELECT * FROM results"))
def game_results(spark, sf):
    return EV.game_results(_scored(spark, sf)[0])


@register("first_crossing", O.with_views(_GW_SQL, body="""
SELECT GAME_ID, EVENTNUM, PLAYER1_NAME, home_score, visitor_score FROM crossing"""))
def first_crossing(spark, sf):
    timeline, cuts = _scored(spark, sf)
    return EV.first_crossing(timeline, cuts=cuts).select(
        "GAME_ID", "EVENTNUM", "PLAYER1_NAME", "home_score", "visitor_score")


@register("award_game_winners", O.with_views(_GW_SQL, body="""
SELECT * FROM gw_players QUALIFY rank() OVER (ORDER BY game_winning_points DESC) <= 5"""))
def award_game_winners(spark, sf):
    timeline, cuts = _scored(spark, sf)
    return top_n(EV.game_winners(timeline, cuts=cuts), "game_winning_points", 5)


# --- E12 / I6 / L46: neighbours ----------------------------------------------

_NB_SQL = O.PBP + """,
nb AS (
  SELECT *,
    lead(HOMEDESCRIPTION) OVER w AS next_home_play, lead(VISITORDESCRIPTION) OVER w AS next_visitor_play,
    lead(PLAYER1_ID) OVER w AS next_player, lag(PLAYER1_ID) OVER w AS last_player
  FROM pbp WINDOW w AS (PARTITION BY GAME_ID ORDER BY EVENTNUM)
)"""


@register("lead_lag", O.with_views(_NB_SQL, body="""
SELECT GAME_ID, EVENTNUM, next_home_play, next_player, last_player FROM nb"""))
def lead_lag(spark, sf):
    from courtstats.operators.sequence import neighbours

    n = neighbours(V.log(spark, sf), "GAME_ID", "EVENTNUM", {
        "next_home_play": ("HOMEDESCRIPTION", 1), "next_player": ("PLAYER1_ID", 1),
        "last_player": ("PLAYER1_ID", -1)})
    return n.select("GAME_ID", "EVENTNUM", "next_home_play", "next_player", "last_player")


_OWN_REB_SQL = f"""
SELECT PLAYER1_NAME, count_if(shot_value = 3) AS fix_with_3, count_if(shot_value = 2) AS fix_with_2,
       count(*) AS fixed_shots, CAST(sum(shot_value) AS BIGINT) AS fixed_points
FROM (SELECT *, CASE WHEN coalesce(contains(next_home_play, '3PT'), false)
                       OR coalesce(contains(next_visitor_play, '3PT'), false) THEN 3 ELSE 2 END AS shot_value
      FROM nb WHERE {sql_any(_rx('REBOUND'))} AND PLAYER1_ID = next_player AND PLAYER1_ID = last_player
        AND (coalesce(regexp_matches(next_home_play, 'PTS'), false)
             OR coalesce(regexp_matches(next_visitor_play, 'PTS'), false))) x
GROUP BY PLAYER1_NAME"""


@register("neighbour_pattern", O.with_views(_NB_SQL, body=_OWN_REB_SQL))
def neighbour_pattern(spark, sf):
    return EV.neighbour_pattern(V.log(spark, sf))


@register("award_own_rebound", O.with_views(_NB_SQL, body=f"""
SELECT * FROM ({_OWN_REB_SQL}) q QUALIFY rank() OVER (ORDER BY fixed_points DESC) <= 10"""))
def award_own_rebound(spark, sf):
    return top_n(EV.neighbour_pattern(V.log(spark, sf)), "fixed_points", 10)


# --- I7 / L12: block outcomes --------------------------------------------------

_BLK_SQL = _NB_SQL + f""",
blk AS (
  SELECT *, CASE WHEN coalesce(regexp_matches(HOMEDESCRIPTION, 'BLOCK'), false) THEN 'home' ELSE 'visitor' END AS hv
  FROM nb WHERE {sql_any(_rx('BLOCK'))}
),
treb AS (SELECT DISTINCT GAME_ID, PERIOD, PCTIMESTRING FROM pbp WHERE {sql_any(_ends('Rebound'))}),
kept AS (
  SELECT b.* FROM blk b ANTI JOIN treb t
  ON b.GAME_ID = t.GAME_ID AND b.PERIOD = t.PERIOD AND b.PCTIMESTRING = t.PCTIMESTRING
),
own AS (
  SELECT PLAYER3_NAME,
    count_if((hv = 'home' AND next_visitor_play IS NULL) OR (hv = 'visitor' AND next_home_play IS NULL)) AS own,
    count_if(NOT ((hv = 'home' AND next_visitor_play IS NULL) OR (hv = 'visitor' AND next_home_play IS NULL))) AS other
  FROM kept GROUP BY PLAYER3_NAME
),
rates AS (
  SELECT t.PLAYER3_NAME, t.blocks, coalesce(o.own, 0) AS own, coalesce(o.other, 0) AS other,
         round(coalesce(o.own, 0) / t.blocks, 6) AS percent_blk_recovered_by_own
  FROM (SELECT PLAYER3_NAME, count(*) AS blocks FROM blk GROUP BY PLAYER3_NAME) t
  LEFT JOIN own o ON t.PLAYER3_NAME IS NOT DISTINCT FROM o.PLAYER3_NAME
)"""


def _rates(spark, sf):
    r = EV.event_outcome_rates(V.log(spark, sf))
    return r.withColumn("percent_blk_recovered_by_own", r6("percent_blk_recovered_by_own"))


@register("event_outcome_rates", O.with_views(_BLK_SQL, body="SELECT * FROM rates"))
def event_outcome_rates(spark, sf):
    return _rates(spark, sf)


MIN_BLOCKS = 5


@register("award_outcome_rate", O.with_views(_BLK_SQL, body=f"""
SELECT * FROM rates WHERE blocks >= {MIN_BLOCKS}
QUALIFY rank() OVER (ORDER BY percent_blk_recovered_by_own DESC) <= 10"""))
def award_outcome_rate(spark, sf):
    return top_n(_rates(spark, sf).filter(F.col("blocks") >= MIN_BLOCKS), "percent_blk_recovered_by_own", 10)


# --- D4 / I9 / L17 / L18: same-moment fouls -------------------------------------

_SM_SQL = O.PBP + f""",
fouls AS (SELECT * FROM pbp WHERE {sql_any(_rx('S.FOUL'))}),
ft3 AS (SELECT * FROM pbp WHERE {sql_any(_rx('Free Throw 3 of 3'))}),
made3 AS (SELECT * FROM pbp WHERE {sql_any(_rx('3PT'))} AND {sql_none(_starts('MISS'))}),
matches AS (
  SELECT f.PLAYER1_NAME AS PLAYER1_NAME_x, s.PLAYER1_NAME AS PLAYER1_NAME_y, f.GAME_ID
  FROM fouls f JOIN ft3 s ON f.GAME_ID = s.GAME_ID AND f.PERIOD = s.PERIOD AND f.PCTIMESTRING = s.PCTIMESTRING
  UNION ALL
  SELECT f.PLAYER1_NAME, s.PLAYER1_NAME, f.GAME_ID
  FROM fouls f JOIN made3 s ON f.GAME_ID = s.GAME_ID AND f.PERIOD = s.PERIOD AND f.PCTIMESTRING = s.PCTIMESTRING
)"""


@register("same_moment_union", O.with_views(_SM_SQL, body="""
SELECT GAME_ID, PLAYER1_NAME_x, PLAYER1_NAME_y, count(*) AS n FROM matches GROUP BY 1, 2, 3"""))
def same_moment_union(spark, sf):
    m = EV.same_moment_counts(V.log(spark, sf))
    return m.groupBy("GAME_ID", "PLAYER1_NAME_x", "PLAYER1_NAME_y").agg(F.sum("n").alias("n"))


@register("award_same_moment_fouls", O.with_views(_SM_SQL, body="""
SELECT PLAYER1_NAME_x, count(*) AS count FROM matches GROUP BY 1
QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 10"""))
def award_same_moment_fouls(spark, sf):
    m = EV.same_moment_counts(V.log(spark, sf))
    return top_n(m.groupBy("PLAYER1_NAME_x").agg(F.sum("n").alias("count")), "count", 10)


@register("award_same_moment_drawn", O.with_views(_SM_SQL, body="""
SELECT PLAYER1_NAME_y, count(*) AS count FROM matches GROUP BY 1
QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 10"""))
def award_same_moment_drawn(spark, sf):
    m = EV.same_moment_counts(V.log(spark, sf))
    return top_n(m.groupBy("PLAYER1_NAME_y").agg(F.sum("n").alias("count")), "count", 10)


@register("same_moment_pairs", O.with_views(O.PBP, body=f"""
SELECT f.GAME_ID, f.PERIOD, f.PCTIMESTRING, count(*) AS n
FROM (SELECT * FROM pbp WHERE {sql_any(_rx('S.FOUL'))}) f
JOIN (SELECT * FROM pbp WHERE {sql_any(_rx('PTS'))}) s
  ON f.GAME_ID = s.GAME_ID AND f.PERIOD = s.PERIOD AND f.PCTIMESTRING = s.PCTIMESTRING
GROUP BY 1, 2, 3"""))
def same_moment_pairs(spark, sf):
    log = V.log(spark, sf)
    keys = ["GAME_ID", "PERIOD", "PCTIMESTRING"]
    f = log.filter(text_any(S, "S.FOUL")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_f"))
    s = log.filter(text_any(S, "PTS")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_s"))
    return f.join(s, keys).select(*keys, (F.col("_f") * F.col("_s")).alias("n"))


# --- D8 / F11 / L47: made dunks by row difference, games with 2+ ---------------

_DUNK_SQL = O.PBP + f""",
dunks AS (SELECT * FROM pbp WHERE {sql_any(_rx('Dunk'))}),
missed AS (SELECT * FROM dunks WHERE {sql_any(_rx('MISS'))}),
made_dunks AS (SELECT d.* FROM dunks d ANTI JOIN missed m ON m.GAME_ID = d.GAME_ID AND m.EVENTNUM = d.EVENTNUM)
"""


def _made_dunks(spark, sf):
    log = V.log(spark, sf)
    dunks = log.filter(text_any(S, "Dunk"))
    missed = dunks.filter(text_any(S, "MISS"))
    return row_difference(dunks, missed)


@register("row_difference", O.with_views(_DUNK_SQL, body="""
SELECT GAME_ID, EVENTNUM, PLAYER1_NAME FROM made_dunks"""))
def row_difference_q(spark, sf):
    return _made_dunks(spark, sf).select("GAME_ID", "EVENTNUM", "PLAYER1_NAME")


@register("count_of_counts", O.with_views(_DUNK_SQL, body="""
SELECT PLAYER1_NAME, count(*) AS games_w_2plus_dunks FROM (
  SELECT GAME_ID, PLAYER1_NAME FROM made_dunks GROUP BY 1, 2 HAVING count(*) >= 2) g
GROUP BY PLAYER1_NAME"""))
def count_of_counts_q(spark, sf):
    return count_of_counts(_made_dunks(spark, sf), ["GAME_ID", "PLAYER1_NAME"], ["PLAYER1_NAME"], 2,
                           name="games_w_2plus_dunks")


@register("award_multi_event_games", O.with_views(_DUNK_SQL, body="""
SELECT PLAYER1_NAME, count(*) AS games_w_2plus_dunks FROM (
  SELECT GAME_ID, PLAYER1_NAME FROM made_dunks GROUP BY 1, 2 HAVING count(*) >= 2) g
GROUP BY PLAYER1_NAME QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 10"""))
def award_multi_event_games(spark, sf):
    c = count_of_counts(_made_dunks(spark, sf), ["GAME_ID", "PLAYER1_NAME"], ["PLAYER1_NAME"], 2,
                        name="games_w_2plus_dunks")
    return top_n(c, "games_w_2plus_dunks", 10)


# --- F12 / I10 / L48: timeout budget --------------------------------------------

_TO_SQL = O.PBP + "," + O.TEAMS + f""",
slots AS (SELECT DISTINCT GAME_ID, PERIOD, PLAYER1_TEAM_ABBREVIATION AS team FROM pbp
          WHERE PLAYER1_TEAM_ABBREVIATION IS NOT NULL),
avail AS (
  SELECT team, count_if(PERIOD <= 4) / 4 AS games, count_if(PERIOD > 4) AS overtimes,
         7 * (count_if(PERIOD <= 4) / 4) + 2 * count_if(PERIOD > 4) AS num_timeouts
  FROM slots GROUP BY team
),
used AS (
  SELECT array_to_string(list_transform(string_split(lower(split_part(timeout, ' Timeout:', 1)), ' '),
           lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS team_name,
         count(*) AS num_timeouts_used
  FROM (SELECT unnest([HOMEDESCRIPTION, VISITORDESCRIPTION]) AS timeout FROM pbp
        WHERE {sql_any(_rx('Timeout'))}) x
  WHERE timeout IS NOT NULL AND contains(timeout, 'Timeout') AND NOT contains(timeout, 'Excess')
  GROUP BY 1
),
budget AS (
  SELECT a.team, t.team AS team_name, a.games, a.overtimes, a.num_timeouts, u.num_timeouts_used,
         round(u.num_timeouts_used / a.num_timeouts, 6) AS timeout_use_percent
  FROM avail a LEFT JOIN teams t ON t.tm = a.team LEFT JOIN used u ON u.team_name =
    CASE WHEN a.team = 'T24' THEN array_to_string(string_split(t.team, ' ')[-2:], ' ') ELSE string_split(t.team, ' ')[-1] END
)"""


def _budget(spark, sf):
    b = EV.timeout_budget(V.log(spark, sf), V.teams(spark, sf), two_words=(V.TWO_WORDS,))
    return b.select("team", "team_name", "games", "overtimes", "num_timeouts", "num_timeouts_used",
                    r6("timeout_use_percent").alias("timeout_use_percent"))


@register("budget_utilisation", O.with_views(_TO_SQL, body="SELECT * FROM budget"))
def budget_utilisation(spark, sf):
    return _budget(spark, sf)


@register("award_budget_use", O.with_views(_TO_SQL, body="""
SELECT team, num_timeouts, num_timeouts_used, timeout_use_percent FROM budget
QUALIFY rank() OVER (ORDER BY timeout_use_percent ASC NULLS LAST) <= 5 AND timeout_use_percent IS NOT NULL"""))
def award_budget_use(spark, sf):
    b = _budget(spark, sf).select("team", "num_timeouts", "num_timeouts_used", "timeout_use_percent")
    return top_n(b, "timeout_use_percent", 5, descending=False)


@register("distinct_periods", O.with_views(O.PBP, body="""
SELECT PLAYER1_TEAM_ABBREVIATION AS team, count(*) AS periods FROM (
  SELECT DISTINCT GAME_ID, PERIOD, PLAYER1_TEAM_ABBREVIATION FROM pbp WHERE PLAYER1_TEAM_ABBREVIATION IS NOT NULL) s
GROUP BY 1"""))
def distinct_periods(spark, sf):
    s = V.log(spark, sf).filter(F.col("PLAYER1_TEAM_ABBREVIATION").isNotNull()) \
        .select("GAME_ID", "PERIOD", F.col("PLAYER1_TEAM_ABBREVIATION").alias("team")).distinct()
    return s.groupBy("team").agg(F.count(F.lit(1)).alias("periods"))


@register("count_if_q", O.with_views(O.PBP, body=f"""
SELECT GAME_ID, count_if({sql_any(_rx('MISS'))}) AS misses, count_if(PERIOD <= 4) / 4 AS games,
       count_if({sql_any(_rx('3PT'))}) AS threes
FROM pbp GROUP BY GAME_ID"""))
def count_if_q(spark, sf):
    log = V.log(spark, sf)
    return log.groupBy("GAME_ID").agg(F.count_if(text_any(S, "MISS")).alias("misses"),
                                      (F.count_if(F.col("PERIOD") <= 4) / 4).alias("games"),
                                      F.count_if(text_any(S, "3PT")).alias("threes"))
