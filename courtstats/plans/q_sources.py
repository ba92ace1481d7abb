"""Queries of the sources and of the operators around them: season-partitioned inputs,
headers found in the data, rename rules, boards refreshed from new games, ordered
strings in pieces, and the contract awards with carried identity.

Inputs that would be landed files are written by Spark from the driver tables to the
session's shared folder when the query is built, and read back by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtstats.functions.arith import safe_div
from courtstats.functions.columns import add_prefix, add_suffix, row_sum
from courtstats.functions.predicates import text_any
from courtstats.operators import contracts as K
from courtstats.operators import events as EV
from courtstats.operators import rules as RU
from courtstats.operators.aggregate import leave_one_out_median, ordered_pieces
from courtstats.operators.rank import leader_flag, top_n
from courtstats.plans import oracle_views as O
from courtstats.plans import views as V
from courtstats.plans.awards_box import _Q, _qualified
from courtstats.plans.q_relational import _REB_SQL, _reb
from courtstats.plans.registry import r6, register, sql_any, sql_none
from courtstats.session import checkpoint_dir, written
from courtstats.sources import headers as H
from courtstats.sources import seasons as SE
from courtstats.sources.ingest import first_link
from courtstats.sources.tables import table
from courtstats.streaming.boards import BoardState

SEASON = "season"
S = ["HOMEDESCRIPTION", "VISITORDESCRIPTION"]


def _folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- A4 / A11 / A2: season-partitioned typed inputs --------------------------------------------------

def _landed_log(spark, sf):
    """The play-by-play log, landed by season."""
    path = _folder(spark, "landed-log")
    log = V.pbp(spark, sf).withColumnRenamed("SEASON", SEASON)
    cols = {f.name: f.dataType for f in SE.INPUTS["play_by_play_log"].fields}
    SE.land(log.select(*[F.col(c).cast(t).alias(c) for c, t in cols.items()]), path)
    return path


@register("season_scan", O.with_views(O.PBP, body="""
SELECT SEASON AS season, PERIOD AS period, count(*) AS n, count(SCORE) AS scored FROM pbp WHERE SEASON IN (2016, 2018) GROUP BY 1, 2"""))
def season_scan(spark, sf):
    """Two seasons of the landed log: only their folders are read."""
    log = SE.read_seasons(spark, _landed_log(spark, sf), SE.INPUTS["play_by_play_log"], [2016, 2018])
    return log.groupBy(SEASON, F.col("PERIOD").alias("period")).agg(F.count(F.lit(1)).alias("n"), F.count("SCORE").alias("scored"))


@register("season_pruned_join", O.with_views(O.PBP, body="""
SELECT p.SEASON AS season, count(*) AS n FROM pbp p JOIN (SELECT DISTINCT 2015 + n_nationkey % 7 AS season FROM nation WHERE n_name < 'C') k
  ON k.season = p.SEASON GROUP BY 1"""))
def season_pruned_join(spark, sf):
    """The seasons come from a joined table: folders are pruned when the query runs."""
    log = SE.read_seasons(spark, _landed_log(spark, sf), SE.INPUTS["play_by_play_log"])
    some = table(spark, sf, "nation").filter(F.col("n_name") < "C").select((F.lit(2015) + F.col("n_nationkey") % 7).alias(SEASON)).distinct()
    return log.join(some, SEASON).groupBy(SEASON).agg(F.count(F.lit(1)).alias("n"))


@register("log_from_csv_files", O.with_views(O.PBP, body="""
SELECT SEASON AS season, count(*) AS n, count(DISTINCT GAME_ID) AS games, CAST(sum(PERIOD) AS BIGINT) AS periods, count(SCORE) AS scored
FROM pbp GROUP BY 1"""))
def log_from_csv_files(spark, sf):
    """CSV files by season in two layouts (other column orders, unread columns); the season is
    in the files' names only."""
    path = _folder(spark, "csv-log")
    log = V.pbp(spark, sf)
    slug = F.concat((F.col("SEASON") - 1).cast("string"), F.lit("-"), F.lpad((F.col("SEASON") % 100).cast("string"), 2, "0"), F.lit("_pbp.csv"))
    cols = [f.name for f in SE.INPUTS["play_by_play_log"].fields if f.name != SEASON]
    log = written(log.select(*cols, "SEASON", slug.alias("file"), F.lit(0).alias("VIDEO_AVAILABLE_FLAG")), "csv-log-rows")
    for odd, order in ((1, cols), (0, [*cols[::-1], "VIDEO_AVAILABLE_FLAG"])):
        log.filter(F.col("SEASON") % 2 == odd).select(*order, "file").write.mode("append").option("header", True) \
            .option("nullValue", "NA").option("escape", '"').partitionBy("file").csv(path)
    d = SE.read_landed_csv(spark, path, "play_by_play_log")
    return d.groupBy(SEASON).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("GAME_ID").alias("games"),
                                 F.sum("PERIOD").alias("periods"), F.count("SCORE").alias("scored"))


# --- A10 / A9: headers in the data, first link of a page ----------------------------------------------

@register("header_found", """
SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE c_acctbal END AS acct_bal FROM customer""")
def header_found(spark, sf):
    """Three sets of files: columns in other orders, names of several lines, a header row
    repeated among the rows, a column that one set lacks."""
    path = _folder(spark, "headed")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    names = {"c_custkey": "C Custkey\n(key)", "c_name": "C-Name", "c_nationkey": "cNationkey", "c_acctbal": "Acct Bal\nin $"}
    orders = [["c_custkey", "c_name", "c_nationkey", "c_acctbal"], ["c_acctbal", "c_nationkey", "c_name", "c_custkey"],
              ["c_name", "c_custkey", "c_nationkey"]]
    for i, order in enumerate(orders):
        part = c.filter(F.col("c_custkey") % 3 == i).select(*[F.col(x).cast("string").alias(names[x]) for x in order])
        again = spark.createDataFrame([tuple(names[x] for x in order)], part.schema)
        part.unionByName(again).repartition(*part.columns).write.mode("append").option("header", True).option("nullValue", "NA").option("escape", '"').csv(path)
    want = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
                         T.StructField("c_nationkey", T.IntegerType()), T.StructField("acct_bal", T.DoubleType())])
    return H.read_headed(spark, path, want, optional=["acct_bal"], ignore=[]).drop("source_file")


@register("first_link", """
SELECT page_id, l[1] AS link FROM (
  SELECT page_id, list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: regexp_matches(x, '^/[a-m]')) AS l FROM pages) x
WHERE len(l) > 0""")
def first_link_q(spark, sf):
    """The first link of every page to a path from a to m."""
    return first_link(table(spark, sf, "pages"), "^/[a-m]")


# --- H10 / D11: rename rules ----------------------------------------------------------------------------

NAME_RULES = [
    RU.Rule("Customer#000000007", suffix=" Jr.", kind="equals"), RU.Rule("Customer#000000013", suffix=" Jr.", kind="equals"),
    RU.Rule("00013", "Thirteen"), RU.Rule("[05]9$", suffix=" IX", kind="regex"), RU.Rule("0001", "First Thousand"),
    RU.Rule("no such name", "Nobody"),
]
_RULES_SQL = """
hit AS (SELECT c_custkey, c_name, list_filter([
  CASE WHEN c_name = 'Customer#000000007' THEN 0 END, CASE WHEN c_name = 'Customer#000000013' THEN 1 END,
  CASE WHEN contains(c_name, '00013') THEN 2 END, CASE WHEN regexp_matches(c_name, '[05]9$') THEN 3 END,
  CASE WHEN contains(c_name, '0001') THEN 4 END], lambda x: x IS NOT NULL) AS rules FROM customer)"""


@register("name_rules", "WITH " + _RULES_SQL + """
SELECT c_custkey, CASE rules[1] WHEN 0 THEN c_name || ' Jr.' WHEN 1 THEN c_name || ' Jr.' WHEN 2 THEN 'Thirteen'
  WHEN 3 THEN c_name || ' IX' WHEN 4 THEN 'First Thousand' ELSE c_name END AS name FROM hit""")
def name_rules(spark, sf):
    """The rules are read from a table; the first match wins."""
    rules = RU.rule_table(spark, NAME_RULES)
    return RU.apply_rules(table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name")), "name", rules)


@register("name_rules_report", "WITH " + _RULES_SQL + """
SELECT CASE WHEN len(rules) > 1 THEN 'several' ELSE 'none' END AS status, c_name AS name, array_to_string(rules, ',') AS rules
FROM hit WHERE len(rules) <> 1
UNION ALL SELECT 'unused', NULL, '5' UNION ALL SELECT 'unused', NULL, '0' WHERE NOT EXISTS (SELECT 1 FROM hit WHERE list_contains(rules, 0))
UNION ALL SELECT 'unused', NULL, '1' WHERE NOT EXISTS (SELECT 1 FROM hit WHERE list_contains(rules, 1))
UNION ALL SELECT 'unused', NULL, '2' WHERE NOT EXISTS (SELECT 1 FROM hit WHERE list_contains(rules, 2))
UNION ALL SELECT 'unused', NULL, '3' WHERE NOT EXISTS (SELECT 1 FROM hit WHERE list_contains(rules, 3))
UNION ALL SELECT 'unused', NULL, '4' WHERE NOT EXISTS (SELECT 1 FROM hit WHERE list_contains(rules, 4))""")
def name_rules_report(spark, sf):
    r = RU.report(table(spark, sf, "customer"), "c_name", NAME_RULES)
    return r.select("status", "name", F.array_join(F.col("rules").cast("array<string>"), ",").alias("rules"))


# --- A5 / F14: a board refreshed from new games -----------------------------------------------------------

@register("career_board_refresh", O.with_views(O.PBP, body="""
SELECT season, scope, player, points, games_scored FROM (
  SELECT SEASON AS season, 'season' AS scope, PLAYER1_NAME AS player, count_if(SCORE IS NOT NULL) AS points, count(*) AS games_scored
  FROM pbp WHERE PLAYER1_NAME IS NOT NULL GROUP BY SEASON, PLAYER1_NAME
  UNION ALL SELECT NULL, 'career', PLAYER1_NAME, count_if(SCORE IS NOT NULL), count(*) FROM pbp WHERE PLAYER1_NAME IS NOT NULL GROUP BY PLAYER1_NAME) x"""))
def career_board_refresh(spark, sf):
    """Three refreshes: some games, then all (new ones are added), then all again (nothing is)."""
    log = V.pbp(spark, sf).filter(F.col("PLAYER1_NAME").isNotNull()).select(
        F.col("SEASON").alias("season"), F.col("GAME_ID").alias("game"), F.col("PLAYER1_NAME").alias("player"), "SCORE")
    state = BoardState(spark, _folder(spark, "board-state"), "player",
                       {"points": F.count("SCORE"), "games_scored": F.count(F.lit(1))})
    state.refresh(log.filter(F.col("game") % 3 > 0))
    state.refresh(log)
    state.refresh(log)
    return state.board().select("season", "scope", "player", "points", "games_scored")


# --- F10: ordered strings in pieces -------------------------------------------------------------------------

PIECE = 1000


@register("ordered_pieces", f"""
SELECT o_orderpriority, piece, count(*) AS n, md5(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY pos)) AS digest
FROM (SELECT *, (pos - 1) // {PIECE} AS piece FROM (
  SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate NULLS FIRST, o_orderkey) AS pos
  FROM orders) x) y GROUP BY 1, 2""")
def ordered_pieces_q(spark, sf):
    """All order keys of a priority by date: a few very large groups, in bounded pieces."""
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderdate", "o_orderkey", F.col("o_orderkey").cast("string").alias("k"))
    p = ordered_pieces(o, "o_orderpriority", "k", ["o_orderdate", "o_orderkey"], ",", PIECE)
    return p.select("o_orderpriority", "piece", "n", F.md5(F.col("text").cast("binary")).alias("digest"))


# --- E1: a shared n-th value ---------------------------------------------------------------------------------

@register("top_n_shared_value", """
SELECT o_orderkey, o_orderkey % 2 AS v FROM orders QUALIFY rank() OVER (ORDER BY o_orderkey % 2 DESC) <= 5""")
def top_n_shared_value(spark, sf):
    """Half of the table shares the n-th value; all of it is the result."""
    return top_n(table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 2).alias("v")), "v", 5)


# --- L24 / L25: shares of assisted and unassisted field goals ---------------------------------------------------

_SHOTS_SQL = O.PBP + """,
shots AS (
  SELECT SEASON AS season, PLAYER1_NAME AS player, GAME_ID,
    count_if(made) AS fg, count_if(made AND PLAYER2_NAME IS NULL) AS own
  FROM (SELECT *, coalesce(contains(HOMEDESCRIPTION, 'PTS') AND NOT contains(HOMEDESCRIPTION, 'Free Throw'), false)
               OR coalesce(contains(VISITORDESCRIPTION, 'PTS') AND NOT contains(VISITORDESCRIPTION, 'Free Throw'), false) AS made
        FROM pbp WHERE PLAYER1_NAME IS NOT NULL) x GROUP BY 1, 2, 3),
shooters AS (
  SELECT season, player, count(*) AS g, CAST(sum(fg) AS BIGINT) AS fg, CAST(sum(own) AS BIGINT) AS own FROM shots GROUP BY 1, 2),
shares AS (
  SELECT s.*, own / fg AS unassisted_share, (fg - own) / fg AS assisted_share
  FROM shooters s JOIN (SELECT season, max(g) AS g_most FROM shooters GROUP BY season) m USING (season) WHERE g >= 0.5 * g_most AND fg > 0)"""


def _shares(spark, sf):
    """Made field goals by season and player, with and without an assist; players with half
    the games of the season's busiest one.  Games are counted once per player, then summed."""
    log = V.log(spark, sf).filter(F.col("PLAYER1_NAME").isNotNull())
    goal = [F.coalesce(F.col(c).contains("PTS") & ~F.col(c).contains("Free Throw"), F.lit(False)) for c in S]
    made = goal[0] | goal[1]
    per = log.groupBy(F.col("SEASON").alias(SEASON), F.col("PLAYER1_NAME").alias("player"), "GAME_ID").agg(
        F.count_if(made).alias("fg"), F.count_if(made & F.col("PLAYER2_NAME").isNull()).alias("own"))
    p = per.groupBy(SEASON, "player").agg(F.count(F.lit(1)).alias("g"), F.sum("fg").alias("fg"), F.sum("own").alias("own"))
    p = p.join(p.groupBy(F.col(SEASON).alias("_s")).agg(F.max("g").alias("g_most")), F.col(SEASON) == F.col("_s"))
    p = p.filter((F.col("g") >= 0.5 * F.col("g_most")) & (F.col("fg") > 0))
    return p.withColumns({"unassisted_share": safe_div("own", "fg"), "assisted_share": safe_div(F.col("fg") - F.col("own"), "fg")})


def _share_award(name, column):
    def build(spark, sf):
        return top_n(_shares(spark, sf), column, 5, partition=SEASON).select(SEASON, "player", "fg", r6(column).alias(column))

    register(name, O.with_views(_SHOTS_SQL, body=f"""
SELECT season, player, fg, round({column}, 6) AS {column} FROM shares
QUALIFY rank() OVER (PARTITION BY season ORDER BY {column} DESC) <= 5"""))(build)


_share_award("award_share_leaders", "unassisted_share")
_share_award("award_assisted_share", "assisted_share")


# --- L19 / L20: all heights -----------------------------------------------------------------------------------------

def _all_heights(name, best):
    order = "DESC" if best else "ASC"

    def build(spark, sf):
        return top_n(_reb(spark, sf), "c_reb_pct", 10, descending=best, partition=SEASON).select(
            SEASON, "player", r6("c_reb_pct").alias("c_reb_pct"))

    register(name, O.with_views(_REB_SQL, body=f"""
SELECT season, player, round(c_reb_pct, 6) AS c_reb_pct FROM reb QUALIFY rank() OVER (PARTITION BY season ORDER BY c_reb_pct {order}) <= 10"""))(build)


_all_heights("award_share_low_all", False)
_all_heights("award_share_high_all", True)


# --- L33 / L34: best and worst player against the median of the others ------------------------------------------------

NPM = "net_plus_minus_per_100_poss"
_MEDIAN_SQL = _Q + f""",
p AS (SELECT * FROM q WHERE tm <> 'TOT' AND g_percent >= 0.5 AND mp / g >= 10),
m AS (SELECT tm, season, median({NPM}) AS med FROM (
  SELECT *, row_number() OVER (PARTITION BY tm, season ORDER BY {NPM} DESC, player_id DESC) AS nth FROM p WHERE {NPM} IS NOT NULL) x
  WHERE nth > 1 GROUP BY tm, season)"""


def _median_gap(name, best):
    order, ext = ("DESC", "max") if best else ("ASC", "min")

    def build(spark, sf):
        p = _qualified(spark, sf, 0.5).filter((F.col("tm") != "TOT") & (F.col("mp") / F.col("g") >= 10))
        med = leave_one_out_median(p, ["tm", SEASON], NPM, NPM, "max", ["player_id"], "median")
        j = leader_flag(p, ["tm", SEASON], NPM, descending=best).filter("leader").join(med, ["tm", SEASON])
        j = j.withColumn("npm_diff", r6(F.col(NPM) - F.col("median")))
        return top_n(j, "npm_diff", 5, descending=best).select(SEASON, "tm", "player", r6(NPM).alias("npm"), r6("median").alias("median"), "npm_diff")

    register(name, O.with_views(_MEDIAN_SQL, body=f"""
SELECT p.season, p.tm, p.player, round({NPM}, 6) AS npm, round(med, 6) AS median, round({NPM} - med, 6) AS npm_diff
FROM (SELECT *, {ext}({NPM}) OVER (PARTITION BY tm, season) AS ext FROM p) p JOIN m ON m.tm = p.tm AND m.season = p.season
WHERE {NPM} = ext QUALIFY rank() OVER (ORDER BY round({NPM} - med, 6) {order}) <= 5"""))(build)


_median_gap("award_gap_median_best", True)
_median_gap("award_gap_median_worst", False)


# --- L35: contracts with carried identity, wins added and predicted salary ----------------------------------------------

_CHAIN_SQL = O.BOX_ALL + "," + O.CAP + """,
named AS (SELECT p.*, d.player, d.experience FROM player_team_season p JOIN customer_dim d ON d.player_id = p.player_id WHERE p.tm <> 'TOT'),
landed AS (
  SELECT player, tm, season, CAST(mp * 1000 + pts * 100 AS BIGINT) AS salary FROM named
  UNION ALL SELECT player, tm, season + 1, CAST(mp * 1000 + pts * 100 AS BIGINT) // 2 FROM named WHERE (player_id + season) % 5 = 0),
joined AS (
  SELECT c.*, n.player_id, n.experience, coalesce(n.vorp, 0) AS vorp FROM landed c
  LEFT JOIN named n ON n.player = c.player AND n.tm = c.tm AND n.season = c.season),
ided AS (SELECT * REPLACE (last_value(player_id IGNORE NULLS) OVER (
  PARTITION BY player ORDER BY season, tm, salary ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS player_id) FROM joined),
one AS (
  SELECT i.player_id, i.player, i.tm, i.season, CAST(sum(salary) AS BIGINT) AS salary, max(vorp) AS vorp, max(experience) AS experience, any_value(k.cap) AS cap
  FROM ided i LEFT JOIN cap k ON k.season = i.season GROUP BY 1, 2, 3, 4),
chain AS (
  SELECT *, salary / cap AS percent_of_cap, vorp * 2.7 AS wins_added, vorp * 2.7 / 41 * cap AS predicted_sal,
    salary - vorp * 2.7 / 41 * cap AS act_minus_predict, (salary - vorp * 2.7 / 41 * cap) / cap AS diff_as_percent_of_cap FROM one)"""


def _chain(spark, sf):
    pts = V.box(spark, sf).filter(F.col("tm") != "TOT")
    named = pts.join(V._customer_dim(spark, sf).select("player_id", "player", "experience"), "player_id")
    salary = (F.col("mp") * 1000 + F.col("pts") * 100).cast("long")
    paid = named.select("player", "tm", SEASON, salary.alias("salary"))
    # paid on for a season without playing: the contract knows no id
    on = named.filter((F.col("player_id") + F.col(SEASON)) % 5 == 0).select(
        "player", "tm", (F.col(SEASON) + 1).alias(SEASON), F.floor(salary / 2).cast("long").alias("salary"))
    players = named.select("player_id", "player", "tm", SEASON, "experience", "vorp")
    return K.contract_seasons(paid.unionByName(on), players, V.cap(spark, sf))


@register("carry_identity", O.with_views(_CHAIN_SQL, body="""
SELECT season, count(*) AS contracts, count(player_id) AS known, count(DISTINCT player_id) AS players, CAST(sum(salary) AS BIGINT) AS salary FROM one GROUP BY 1"""))
def carry_identity_q(spark, sf):
    return _chain(spark, sf).groupBy(SEASON).agg(
        F.count(F.lit(1)).alias("contracts"), F.count("player_id").alias("known"), F.count_distinct("player_id").alias("players"),
        F.sum("salary").alias("salary"))


@register("award_contract_predicted", O.with_views(_CHAIN_SQL, body="""
SELECT player, tm, season, salary, round(vorp, 6) AS vorp, round(wins_added, 6) AS wins_added, round(predicted_sal, 4) AS predicted_sal,
  round(diff_as_percent_of_cap, 9) AS diff_as_percent_of_cap FROM chain WHERE experience > 4 AND diff_as_percent_of_cap IS NOT NULL
QUALIFY rank() OVER (ORDER BY round(diff_as_percent_of_cap, 9)) <= 10"""))
def award_contract_predicted(spark, sf):
    """Largest gap below the salary that the wins added predict, as a share of the cap."""
    c = _chain(spark, sf).filter(F.col("experience") > 4).withColumn("diff_as_percent_of_cap", F.round("diff_as_percent_of_cap", 9))
    return top_n(c, "diff_as_percent_of_cap", 10, descending=False).select(
        "player", "tm", SEASON, "salary", r6("vorp").alias("vorp"), r6("wins_added").alias("wins_added"),
        F.round("predicted_sal", 4).alias("predicted_sal"), "diff_as_percent_of_cap")


@register("award_contract_predicted_career", O.with_views(_CHAIN_SQL, body="""
SELECT player_id, player, count(*) AS n_seasons, CAST(sum(salary) AS BIGINT) AS career_salary, round(sum(vorp), 6) AS career_vorp,
  round(sum(wins_added), 6) AS career_wins_added, round(sum(diff_as_percent_of_cap), 7) AS career_diff
FROM chain GROUP BY player_id, player HAVING max(experience) > 4 AND sum(diff_as_percent_of_cap) IS NOT NULL
QUALIFY rank() OVER (ORDER BY round(sum(diff_as_percent_of_cap), 7)) <= 10"""))
def award_contract_predicted_career(spark, sf):
    c = K.contract_careers(_chain(spark, sf)).filter(F.col("experience") > 4)
    c = c.withColumn("career_diff", F.round("career_diff_as_percent_of_cap", 7))
    return top_n(c, "career_diff", 10, descending=False).select(
        "player_id", "player", "n_seasons", "career_salary", r6("career_vorp").alias("career_vorp"),
        r6("career_wins_added").alias("career_wins_added"), "career_diff")


# --- B5 / B9 / I9: affixes, row-wise sum, matched rows of a moment ------------------------------------------------------

@register("affix_columns", """
SELECT p_partkey AS key_p_partkey, p_size AS p_size_now, p_retailprice AS p_retailprice_now,
  coalesce(p_size, 0) + coalesce(p_retailprice, 0) AS total FROM part""")
def affix_columns(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    p = add_prefix(add_suffix(p, ["p_size", "p_retailprice"], "_now"), ["p_partkey"], "key_")
    return p.withColumn("total", row_sum(["p_size_now", "p_retailprice_now"]))


_ROWS_SQL = O.PBP + f""",
f AS (SELECT * FROM pbp WHERE {sql_any("contains({c}, 'S.FOUL')")}),
s3 AS (SELECT * FROM pbp WHERE {sql_any("contains({c}, 'Free Throw 3 of 3')")}
  UNION ALL SELECT * FROM pbp WHERE {sql_any("contains({c}, '3PT')")} AND {sql_none("starts_with({c}, 'MISS')")})"""


@register("same_moment_rows", O.with_views(_ROWS_SQL, body="""
SELECT f.GAME_ID, f.EVENTNUM AS foul, s3.EVENTNUM AS shot, f.PLAYER1_NAME AS fouler, s3.PLAYER1_NAME AS shooter
FROM f JOIN s3 ON s3.GAME_ID = f.GAME_ID AND s3.PERIOD = f.PERIOD AND s3.PCTIMESTRING = f.PCTIMESTRING"""))
def same_moment_rows(spark, sf):
    """Every foul with the shots of its moment, as rows: what the award counts."""
    m = EV.same_moment_union(V.log(spark, sf))
    return m.select("GAME_ID", F.col("EVENTNUM_x").alias("foul"), F.col("EVENTNUM_y").alias("shot"),
                    F.col("PLAYER1_NAME_x").alias("fouler"), F.col("PLAYER1_NAME_y").alias("shooter"))
