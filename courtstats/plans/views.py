"""Views that present the driver tables in the shape the awards consume.

* ``pbp``                 -- play-by-play event log, from ``events`` (+ ``nation`` for team names)
* ``player_team_season``  -- box-score totals per (player, season, team) plus a
                             ``TOT`` row for multi-team seasons, from
                             ``lineitem ⋈ orders`` (team = game key mod 25)
* ``player_season``       -- one row per (player, season): the ``TOT`` row when
                             present, with name / position / age from ``customer``
* ``team_season``         -- games and record per (team, season) plus the
                             per-season mean ``TOT`` row
* ``teams``               -- team dimension (abbreviation, name) from ``nation``
* ``cap``                 -- a yearly scalar (``cap``) from ``orders``

All are plain DataFrame plans; the equivalent DuckDB SQL lives in
``courtstats.plans.oracle_views`` and must stay in step with this module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtstats.operators.rank import prefer_total_row
from courtstats.operators.sequence import Cuts, find_cuts, running_sum
from courtstats.session import written
from courtstats.sources.tables import table

# Fixed values of the synthetic event texts (the words the awards search for).
TXT_ALLEY = "Alley Oop Dunk (2 PTS)"
TXT_ALLEY_MISS = "MISS Alley Oop Dunk"
TXT_THREE = "3PT Jump Shot (3 PTS)"
TXT_THREE_MISS = "MISS 3PT Jump Shot"
TXT_FT3_MISS = "MISS Free Throw 3 of 3"
TXT_FT3 = "Free Throw 3 of 3 (1 PTS)"
TXT_FT1 = "Free Throw 1 of 2 (1 PTS)"
TXT_SFOUL = "S.FOUL"
TXT_TEAM_REB = "TEAM Rebound"
TXT_REB = "REBOUND"
TXT_CHARGE = "Offensive Charge Foul"
TXT_GOALTEND = "Goaltending Violation"
TXT_KICK = "Kicked Ball Violation"
TXT_DEF3 = "Defensive 3 Second Violation"
TXT_DUNK_MISS = "MISS Dunk"
TXT_BLOCK = "BLOCK"

N_TEAMS = 25  # one team per nation key


def team_abbrev(key: Column) -> Column:
    return F.concat(F.lit("T"), F.lpad(key.cast("string"), 2, "0"))


TWO_WORDS = "T24"  # the one team whose nickname has two words


def _nickname(key: Column) -> Column:
    return F.concat(F.when(key == 24, F.lit("Trail Team")).otherwise(F.lit("Team")), key.cast("string"))


def _home_key(game: Column) -> Column:
    return (game % N_TEAMS).cast("int")


def _visitor_key(game: Column) -> Column:
    return ((game + 1 + game % (N_TEAMS - 1)) % N_TEAMS).cast("int")


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tm (abbreviation), team (full name, title case), conference."""
    n = table(spark, sf_dir, "nation")
    return n.select(team_abbrev(F.col("n_nationkey")).alias("tm"),
                    F.concat(F.initcap("n_name"), F.lit(" "), _nickname(F.col("n_nationkey"))).alias("team"),
                    F.col("n_regionkey").alias("region"))


def pbp_cuts(spark: SparkSession, sf_dir: str) -> Cuts:
    """Where the sequences of ``pbp`` are cut (one pass over game and event number)."""
    ev = table(spark, sf_dir, "events")
    return find_cuts(ev.select(F.col("user_id").alias("GAME_ID"), F.col("event_id").alias("EVENTNUM")),
                     "GAME_ID", "EVENTNUM")


def pbp(spark: SparkSession, sf_dir: str, cuts: Cuts | None = None) -> DataFrame:
    """Play-by-play log with the running score (SCORE, SCOREMARGIN)."""
    d = running_sum(_events(spark, sf_dir), "GAME_ID", "EVENTNUM", ["_hp", "_vp"],
                    cuts=cuts or pbp_cuts(spark, sf_dir))
    h, v = F.col("_hp_run"), F.col("_vp_run")
    scoring = F.col("_pts") > 0
    return d.select(
        *LOG[:7],
        F.when(scoring, F.concat(v.cast("string"), F.lit(" - "), h.cast("string"))).alias("SCORE"),
        F.when(scoring, F.when(h == v, F.lit("TIE")).otherwise((h - v).cast("string"))).alias("SCOREMARGIN"),
        *LOG[7:])


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pbp`` without the score: a projection of the event table, for the queries
    that do not read the score."""
    return _events(spark, sf_dir).select(*LOG)


LOG = ["GAME_ID", "EVENTNUM", "SEASON", "PERIOD", "PCTIMESTRING", "HOMEDESCRIPTION", "VISITORDESCRIPTION",
       "PLAYER1_ID", "PLAYER1_NAME", "PLAYER2_ID", "PLAYER2_NAME", "PLAYER3_ID", "PLAYER3_NAME",
       "PLAYER1_TEAM_ABBREVIATION"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event, key (GAME_ID, EVENTNUM), and the points it scores."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    e, t, g = F.col("event_id"), F.col("event_type"), F.col("user_id")
    home = e % 2 == 0
    d = ev.withColumns({
        "GAME_ID": g,
        "EVENTNUM": e,
        "SEASON": (F.lit(2015) + g % 7).cast("int"),
        "PERIOD": (F.lit(1) + F.floor((F.dayofmonth("ts") - 1) / 5)).cast("int"),
        "PCTIMESTRING": F.concat((F.lit(11) - F.hour("ts") % 12).cast("string"), F.lit(":00")),
        "is_home": home,
        "team_key": F.when(home, _home_key(g)).otherwise(_visitor_key(g)),
    })
    blocked = (t == "error") & (e % 8 != 0) & (e % 8 != 4)
    timeout = (t == "error") & ((e % 8 == 0) | (e % 8 == 4))
    text = (
        F.when(t == "purchase", F.when(e % 4 == 3, TXT_ALLEY_MISS).otherwise(TXT_ALLEY))
        .when(t == "signup", F.when(e % 5 == 4, TXT_THREE_MISS).otherwise(TXT_THREE))
        .when(t == "click", F.when(e % 3 == 0, TXT_FT3_MISS).when(e % 3 == 1, TXT_FT3).otherwise(TXT_FT1))
        .when(t == "view", F.when(e % 6 == 0, TXT_SFOUL).when(e % 6 == 1, TXT_TEAM_REB)
              .when(e % 6 == 2, TXT_REB).when(e % 6 == 3, TXT_CHARGE)
              .when(e % 6 == 4, TXT_GOALTEND).when(e % 12 == 5, TXT_KICK).otherwise(TXT_DEF3))
        .when(timeout, F.concat(F.upper(_nickname(F.col("team_key"))), F.when(e % 8 == 0, F.lit(" Timeout: Regular"))
                                .otherwise(F.lit(" Timeout: Excess"))))
        .otherwise(TXT_DUNK_MISS)
    )
    other = F.when(blocked, F.lit(TXT_BLOCK))
    pts = (F.when((t == "purchase") & (e % 4 != 3), 2).when((t == "signup") & (e % 5 != 4), 3)
           .when((t == "click") & (e % 3 != 0), 1).otherwise(0))
    team_event = timeout | ((t == "view") & (e % 6 == 1))
    p1 = F.when(~team_event, e % 7 + 7 * (g % 5))  # seven players a game
    p2 = F.when((pts >= 2) & (e % 5 != 0), e % 23)
    p3 = F.when(blocked, e % 29)
    return d.select(
        "GAME_ID", "EVENTNUM", "SEASON", "PERIOD", "PCTIMESTRING",
        F.when(home, text).otherwise(other).alias("HOMEDESCRIPTION"),
        F.when(home, other).otherwise(text).alias("VISITORDESCRIPTION"),
        p1.alias("PLAYER1_ID"), F.concat(F.lit("p"), p1.cast("string")).alias("PLAYER1_NAME"),
        p2.alias("PLAYER2_ID"), F.concat(F.lit("p"), p2.cast("string")).alias("PLAYER2_NAME"),
        p3.alias("PLAYER3_ID"), F.concat(F.lit("p"), p3.cast("string")).alias("PLAYER3_NAME"),
        team_abbrev(F.col("team_key")).alias("PLAYER1_TEAM_ABBREVIATION"),
        pts.alias("_pts"),
        F.when(home, pts).otherwise(0).alias("_hp"),
        F.when(home, 0).otherwise(pts).alias("_vp"),
    )


def _order_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per game (order): the box-score counts of its lines plus the
    player, season and team of the order.

    Lines are aggregated to their order *before* the join with ``orders``
    (partial aggregation, ~4x fewer rows into the join), and the join reuses
    the aggregation's partitioning on the order key.  Because every order has
    exactly one (player, season, team), games become plain row counts
    downstream -- no distinct aggregation."""
    li = table(spark, sf_dir, "lineitem")
    ln, st, rf = F.col("l_linenumber"), F.col("l_linestatus"), F.col("l_returnflag")
    disc = F.round(F.col("l_discount") * 100).cast("long")
    taxp = F.round(F.col("l_tax") * 100).cast("long")
    per_order = li.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("mp"),
        F.count(F.lit(1)).alias("fga"),
        F.count_if(st == "F").alias("fg"),
        F.count_if(ln % 3 == 0).alias("x3pa"),
        F.count_if((ln % 3 == 0) & (st == "F")).alias("x3p"),
        F.count_if(rf != "N").alias("fta"),
        F.count_if(rf == "A").alias("ft"),
        F.sum(F.floor(F.col("l_quantity") / 10).cast("long")).alias("trb"),
        F.count_if(disc >= 6).alias("ast"),
        F.count_if(disc <= 1).alias("stl"),
        F.count_if(taxp <= 1).alias("blk"),
        F.count_if(taxp >= 7).alias("pf"),
        F.sum(disc).alias("disc_sum"),
        F.sum(taxp).alias("tax_sum"),
        F.count_if(ln == 1).alias("pg_n"),
        F.count_if(ln == 2).alias("sg_n"),
        F.count_if(ln == 3).alias("sf_n"),
        F.count_if(ln == 4).alias("pf_n"),
        F.count_if(ln >= 5).alias("c_n"),
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    # No broadcast hint: orders grows with the data; AQE broadcasts only when
    # the runtime size is under the threshold.
    j = per_order.join(o, per_order.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("o_custkey").alias("player_id"),
        F.year("o_orderdate").alias("season"),
        # a game (order) is played for one team; players move between teams
        team_abbrev((F.col("o_orderkey") % N_TEAMS).cast("int")).alias("tm"),
        (F.col("o_orderstatus") == "F").cast("long").alias("started"),
        *BOX_MEASURES,
    )


BOX_MEASURES = ["mp", "fga", "fg", "x3pa", "x3p", "fta", "ft", "trb", "ast", "stl", "blk", "pf",
                "disc_sum", "tax_sum", "pg_n", "sg_n", "sf_n", "pf_n", "c_n"]


def _box_derived(df: DataFrame) -> DataFrame:
    c = F.col
    x2pa, x2p = c("fga") - c("x3pa"), c("fg") - c("x3p")
    pts = 2 * x2p + 3 * c("x3p") + c("ft")
    return df.select(
        "player_id", "season", "tm", "g", "gs", "mp", "fg", "fga", "x3p", "x3pa",
        x2p.alias("x2p"), x2pa.alias("x2pa"), "ft", "fta", "trb", "ast", "stl", "blk", "pf",
        pts.alias("pts"),
        ((c("disc_sum") - c("tax_sum")) / F.lit(10.0)).alias("vorp"),
        ((c("disc_sum") - 2 * c("tax_sum")) / c("fga")).alias("net_plus_minus_per_100_poss"),
        (pts / (F.lit(2.0) * (c("fga") + F.lit(0.44) * c("fta")))).alias("ts_percent"),
        (c("fga") / c("g")).alias("usg_percent"),
        (c("x3pa") / c("fga")).alias("x3p_ar"),
        (c("pg_n") / c("fga")).alias("pg_percent"),
        (c("sg_n") / c("fga")).alias("sg_percent"),
        (c("sf_n") / c("fga")).alias("sf_percent"),
        (c("pf_n") / c("fga")).alias("pf_percent"),
        (F.when(c("c_n") > 0, c("c_n")) / c("fga")).alias("c_percent"),
    )


def player_team_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per (player_id, season, tm) plus tm='TOT' for multi-team seasons.

    One aggregation pass over per-game rows with GROUPING SETS
    ((player, season, tm), (player, season)): sums and counts only, so the
    partial aggregate runs map-side and a hot player sends one row per task."""
    games = _order_box(spark, sf_dir)
    agg = games.groupingSets(
        [["player_id", "season", "tm"], ["player_id", "season"]], "player_id", "season", "tm"
    ).agg(F.count(F.lit(1)).alias("g"), F.sum("started").alias("gs"),
          *[F.sum(m).alias(m) for m in BOX_MEASURES],
          F.min("tm").alias("_tm_min"), F.max("tm").alias("_tm_max"),
          F.grouping_id().alias("_gid"))
    agg = agg.filter((F.col("_gid") == 0) | (F.col("_tm_min") < F.col("_tm_max"))) \
             .withColumn("tm", F.coalesce("tm", F.lit("TOT")))
    return _box_derived(agg)


def _customer_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("player"),
                    F.col("c_mktsegment").alias("pos"),
                    (F.lit(20) + F.col("c_custkey") % 17).cast("int").alias("age"),
                    (F.col("c_custkey") % 15).cast("int").alias("experience"))


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``player_team_season`` as a written table, for queries that read it more than
    once (players and their teams, a sample and the ranks): the lines are aggregated once."""
    return written(player_team_season(spark, sf_dir), "box")


def player_season(spark: SparkSession, sf_dir: str, with_all_teams: bool = False, pts: DataFrame | None = None) -> DataFrame:
    """One row per (player, season): the TOT row if the player changed teams.

    ``with_all_teams=True`` keeps every team row as well (joined to names)."""
    pts = player_team_season(spark, sf_dir) if pts is None else pts
    if not with_all_teams:
        pts = prefer_total_row(pts, ["player_id", "season"], "tm", "TOT")
    dim = _customer_dim(spark, sf_dir)
    out = pts.join(dim, "player_id", "left")
    first = ["player_id", "player", "pos", "age", "experience", "season", "tm"]
    return out.select(*first, *[c for c in pts.columns if c not in first])


def team_season(spark: SparkSession, sf_dir: str, pts: DataFrame | None = None) -> DataFrame:
    """Per (tm, season): g_total = most games any player of the team played,
    w / l = games summed over players, pw = expected wins; plus a 'TOT' row
    per season whose g_total is the mean over teams."""
    from courtstats.operators.aggregate import with_mean_row

    pts = player_team_season(spark, sf_dir) if pts is None else pts
    c = F.col
    t = pts.filter(c("tm") != "TOT").groupBy("tm", "season").agg(
        F.max("g").cast("double").alias("g_total"), F.sum("gs").alias("w"),
        F.sum(c("g") - c("gs")).alias("l"),
        (F.sum("g") * F.lit(0.5) + (F.sum("pts") - 2 * F.sum("fga")) / F.count(F.lit(1))).alias("pw"))
    return with_mean_row(t, ["season"], "tm", "TOT", {"g_total": "avg"})


def cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly scalar: (season, cap)."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.year("o_orderdate").alias("season")).agg(
        F.sum(F.round("o_totalprice").cast("long")).alias("cap"))
