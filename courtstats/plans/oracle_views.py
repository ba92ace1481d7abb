"""DuckDB SQL for the views of ``courtstats.plans.views`` (used as CTEs by
the oracle queries).  Keep in step with the Spark definitions."""

from __future__ import annotations

TEAM_ABBREV = "('T' || lpad(CAST({k} AS VARCHAR), 2, '0'))"


def _abbr(k: str) -> str:
    return TEAM_ABBREV.format(k=k)


PBP = f"""
pbp_base AS (
  SELECT e.user_id AS GAME_ID, e.event_id AS EVENTNUM,
         CAST(2015 + e.user_id % 7 AS INTEGER) AS SEASON,
         CAST(1 + (dayofmonth(e.ts) - 1) // 5 AS INTEGER) AS PERIOD,
         CAST(11 - hour(e.ts) % 12 AS VARCHAR) || ':00' AS PCTIMESTRING,
         e.event_id % 2 = 0 AS is_home, e.event_type AS t, e.event_id AS e, n.n_name,
         CASE WHEN e.event_id % 2 = 0 THEN e.user_id % 25
              ELSE (e.user_id + 1 + e.user_id % 24) % 25 END AS team_key
  FROM events e
  LEFT JOIN nation n ON n.n_nationkey =
       CASE WHEN e.event_id % 2 = 0 THEN e.user_id % 25
            ELSE (e.user_id + 1 + e.user_id % 24) % 25 END
),
pbp_txt AS (
  SELECT *,
    CASE
      WHEN t = 'purchase' THEN CASE WHEN e % 4 = 3 THEN 'MISS Alley Oop Dunk' ELSE 'Alley Oop Dunk (2 PTS)' END
      WHEN t = 'signup' THEN CASE WHEN e % 5 = 4 THEN 'MISS 3PT Jump Shot' ELSE '3PT Jump Shot (3 PTS)' END
      WHEN t = 'click' THEN CASE WHEN e % 3 = 0 THEN 'MISS Free Throw 3 of 3'
                                 WHEN e % 3 = 1 THEN 'Free Throw 3 of 3 (1 PTS)'
                                 ELSE 'Free Throw 1 of 2 (1 PTS)' END
      WHEN t = 'view' THEN CASE WHEN e % 6 = 0 THEN 'S.FOUL' WHEN e % 6 = 1 THEN 'TEAM Rebound'
                                WHEN e % 6 = 2 THEN 'REBOUND' WHEN e % 6 = 3 THEN 'Offensive Charge Foul'
                                WHEN e % 6 = 4 THEN 'Goaltending Violation'
                                WHEN e % 12 = 5 THEN 'Kicked Ball Violation'
                                ELSE 'Defensive 3 Second Violation' END
      WHEN t = 'error' AND (e % 8 = 0 OR e % 8 = 4) THEN
           CASE WHEN team_key = 24 THEN 'TRAIL TEAM24' ELSE 'TEAM' || CAST(team_key AS VARCHAR) END || CASE WHEN e % 8 = 0 THEN ' Timeout: Regular' ELSE ' Timeout: Excess' END
      ELSE 'MISS Dunk' END AS txt,
    CASE WHEN t = 'error' AND e % 8 <> 0 AND e % 8 <> 4 THEN 'BLOCK' END AS other,
    CASE WHEN t = 'purchase' AND e % 4 <> 3 THEN 2 WHEN t = 'signup' AND e % 5 <> 4 THEN 3
         WHEN t = 'click' AND e % 3 <> 0 THEN 1 ELSE 0 END AS pts,
    (t = 'error' AND (e % 8 = 0 OR e % 8 = 4)) OR (t = 'view' AND e % 6 = 1) AS team_event,
    t = 'error' AND e % 8 <> 0 AND e % 8 <> 4 AS blocked
  FROM pbp_base
),
pbp_run AS (
  SELECT *,
    sum(CASE WHEN is_home THEN pts ELSE 0 END) OVER (PARTITION BY GAME_ID ORDER BY EVENTNUM
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h,
    sum(CASE WHEN is_home THEN 0 ELSE pts END) OVER (PARTITION BY GAME_ID ORDER BY EVENTNUM
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
  FROM pbp_txt
),
pbp AS (
  SELECT GAME_ID, EVENTNUM, SEASON, PERIOD, PCTIMESTRING,
    CASE WHEN is_home THEN txt ELSE other END AS HOMEDESCRIPTION,
    CASE WHEN is_home THEN other ELSE txt END AS VISITORDESCRIPTION,
    CASE WHEN pts > 0 THEN CAST(v AS VARCHAR) || ' - ' || CAST(h AS VARCHAR) END AS SCORE,
    CASE WHEN pts > 0 THEN CASE WHEN h = v THEN 'TIE' ELSE CAST(h - v AS VARCHAR) END END AS SCOREMARGIN,
    CASE WHEN NOT team_event THEN e % 7 + 7 * (GAME_ID % 5) END AS PLAYER1_ID,
    CASE WHEN NOT team_event THEN 'p' || CAST(e % 7 + 7 * (GAME_ID % 5) AS VARCHAR) END AS PLAYER1_NAME,
    CASE WHEN pts >= 2 AND e % 5 <> 0 THEN e % 23 END AS PLAYER2_ID,
    CASE WHEN pts >= 2 AND e % 5 <> 0 THEN 'p' || CAST(e % 23 AS VARCHAR) END AS PLAYER2_NAME,
    CASE WHEN blocked THEN e % 29 END AS PLAYER3_ID,
    CASE WHEN blocked THEN 'p' || CAST(e % 29 AS VARCHAR) END AS PLAYER3_NAME,
    {_abbr('team_key')} AS PLAYER1_TEAM_ABBREVIATION
  FROM pbp_run
)"""

BOX_BASE = f"""
box_base AS (
  SELECT o.o_custkey AS player_id, CAST(year(o.o_orderdate) AS INTEGER) AS season,
         {_abbr('o.o_orderkey % 25')} AS tm,
         l.l_orderkey, o.o_orderstatus, l.l_linenumber, l.l_quantity, l.l_discount, l.l_tax,
         l.l_returnflag, l.l_linestatus,
         CAST(round(l.l_discount * 100) AS BIGINT) AS disc,
         CAST(round(l.l_tax * 100) AS BIGINT) AS taxp
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
)"""

BOX_AGGS = """
    count(DISTINCT l_orderkey) AS g,
    count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN l_orderkey END) AS gs,
    sum(l_quantity) AS mp,
    count(*) AS fga,
    count_if(l_linestatus = 'F') AS fg,
    count_if(l_linenumber % 3 = 0) AS x3pa,
    count_if(l_linenumber % 3 = 0 AND l_linestatus = 'F') AS x3p,
    count_if(l_returnflag <> 'N') AS fta,
    count_if(l_returnflag = 'A') AS ft,
    CAST(sum(CAST(floor(l_quantity / 10) AS BIGINT)) AS BIGINT) AS trb,
    count_if(disc >= 6) AS ast,
    count_if(disc <= 1) AS stl,
    count_if(taxp <= 1) AS blk,
    count_if(taxp >= 7) AS pf,
    CAST(sum(disc) AS BIGINT) AS disc_sum, CAST(sum(taxp) AS BIGINT) AS tax_sum,
    count_if(l_linenumber = 1) AS pg_n, count_if(l_linenumber = 2) AS sg_n,
    count_if(l_linenumber = 3) AS sf_n, count_if(l_linenumber = 4) AS pf_n,
    count_if(l_linenumber >= 5) AS c_n"""

BOX_DERIVED = """
    player_id, season, tm, g, gs, mp, fg, fga, x3p, x3pa, fg - x3p AS x2p, fga - x3pa AS x2pa,
    ft, fta, trb, ast, stl, blk, pf,
    2 * (fg - x3p) + 3 * x3p + ft AS pts,
    (disc_sum - tax_sum) / 10.0::DOUBLE AS vorp,
    (disc_sum - 2 * tax_sum) / fga AS net_plus_minus_per_100_poss,
    (2 * (fg - x3p) + 3 * x3p + ft) / (2.0::DOUBLE * (fga + 0.44::DOUBLE * fta)) AS ts_percent,
    fga / g AS usg_percent,
    x3pa / fga AS x3p_ar,
    pg_n / fga AS pg_percent, sg_n / fga AS sg_percent, sf_n / fga AS sf_percent,
    pf_n / fga AS pf_percent, CASE WHEN c_n > 0 THEN c_n END / fga AS c_percent"""

PLAYER_TEAM_SEASON = BOX_BASE + f""",
pts_agg AS (
  SELECT player_id, season, tm, {BOX_AGGS}, min(tm) AS tm_min, max(tm) AS tm_max,
         grouping(player_id, season, tm) AS gid
  FROM box_base GROUP BY GROUPING SETS ((player_id, season, tm), (player_id, season))
),
player_team_season AS (
  SELECT {BOX_DERIVED.replace('player_id, season, tm,', 'player_id, season, coalesce(tm, ' + "'TOT'" + ') AS tm,', 1)}
  FROM pts_agg WHERE gid = 0 OR tm_min < tm_max
)"""

CUSTOMER_DIM = """
customer_dim AS (
  SELECT c_custkey AS player_id, c_name AS player, c_mktsegment AS pos,
         CAST(20 + c_custkey % 17 AS INTEGER) AS age, CAST(c_custkey % 15 AS INTEGER) AS experience
  FROM customer
)"""

PLAYER_SEASON = PLAYER_TEAM_SEASON + "," + CUSTOMER_DIM + """,
player_season AS (
  SELECT d.player, d.pos, d.age, d.experience, p.*
  FROM (SELECT * FROM player_team_season
        QUALIFY row_number() OVER (PARTITION BY player_id, season
                                   ORDER BY (tm <> 'TOT') ASC, tm ASC NULLS LAST) = 1) p
  LEFT JOIN customer_dim d ON d.player_id = p.player_id
),
player_team_season_named AS (
  SELECT d.player, d.pos, d.age, d.experience, p.*
  FROM player_team_season p LEFT JOIN customer_dim d ON d.player_id = p.player_id
)"""

TEAM_SEASON_ONLY = """
team_season_base AS (
  SELECT tm, season, CAST(max(g) AS DOUBLE) AS g_total, CAST(sum(gs) AS BIGINT) AS w,
         CAST(sum(g - gs) AS BIGINT) AS l,
         (sum(g)) * 0.5::DOUBLE + (sum(pts) - 2 * sum(fga)) / count(*) AS pw
  FROM player_team_season WHERE tm <> 'TOT' GROUP BY tm, season
),
team_season AS (
  SELECT tm, season, g_total, w, l, pw FROM team_season_base
  UNION ALL
  SELECT 'TOT' AS tm, season, avg(g_total) AS g_total, NULL AS w, NULL AS l, NULL AS pw
  FROM team_season_base GROUP BY season
)"""

TEAM_SEASON = PLAYER_TEAM_SEASON + "," + TEAM_SEASON_ONLY

# player_season + team_season (+ named team rows) over one box_base
BOX_ALL = PLAYER_SEASON + "," + TEAM_SEASON_ONLY

TEAMS = f"""
teams AS (
  SELECT {_abbr('n_nationkey')} AS tm,
         array_to_string(list_transform(string_split(lower(n_name), ' '),
             lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')
           || CASE WHEN n_nationkey = 24 THEN ' Trail Team' ELSE ' Team' END || CAST(n_nationkey AS VARCHAR) AS team,
         n_regionkey AS region
  FROM nation
)"""

CAP = """
cap AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS season, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS cap
  FROM orders GROUP BY 1
)"""


def with_views(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body
