"""Play-by-play compositions (event-sequence operators).

Input: an event log with the columns of ``courtstats.plans.views.pbp``
(GAME_ID, EVENTNUM, PERIOD, PCTIMESTRING, HOMEDESCRIPTION,
VISITORDESCRIPTION, SCORE, SCOREMARGIN, PLAYERk_ID / _NAME,
PLAYER1_TEAM_ABBREVIATION).  Ordered logic goes through
``courtstats.operators.sequence`` (one exchange, hot games cut into ranges);
``cuts`` of the log (``find_cuts``) may be passed on, so that it is sampled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtstats.functions.predicates import text_any
from courtstats.functions.text import clock_seconds
from courtstats.operators.sequence import DEFAULT_CHUNK, Cuts, fill, neighbours, scan

SIDES = ["HOMEDESCRIPTION", "VISITORDESCRIPTION"]
GAME, ORDER = "GAME_ID", "EVENTNUM"


def score_timeline(log: DataFrame, chunk_size=DEFAULT_CHUNK, cuts: Cuts | None = None) -> DataFrame:
    """Score known at every event: SCORE / SCOREMARGIN filled forward per game,
    '0 - 0' / 'TIE' before the first basket, margin as int (TIE = 0), and the
    score split into ``visitor_score`` / ``home_score``."""
    f = fill(log, GAME, ORDER, ["SCORE", "SCOREMARGIN"], "down", chunk_size=chunk_size, cuts=cuts)
    f = f.na.fill({"SCORE": "0 - 0", "SCOREMARGIN": "TIE"})
    return f.withColumns({
        "SCOREMARGIN": F.when(F.col("SCOREMARGIN") == "TIE", F.lit(0))
                        .otherwise(F.col("SCOREMARGIN").try_cast("int")),
        "visitor_score": F.split_part("SCORE", F.lit(" - "), F.lit(1)).try_cast("int"),
        "home_score": F.split_part("SCORE", F.lit(" - "), F.lit(2)).try_cast("int"),
    })


def clutch_flag(period="PERIOD", margin="SCOREMARGIN", clock="PCTIMESTRING",
                max_margin: int = 5, max_seconds: int = 300) -> Column:
    """(4th period AND |margin| <= 5 AND clock <= 5:00) OR overtime."""
    p = F.col(period)
    return (((p == 4) & (F.abs(F.col(margin)) <= max_margin)
             & (clock_seconds(clock) <= max_seconds)) | (p > 4))


def segment_differential(df: DataFrame, flag: Column, fail: Column, key: str,
                         min_n: int, inside: str = "clutch", outside: str = "non_clutch",
                         noun: str = "fts") -> DataFrame:
    """Success rate inside vs outside a segment, per key, in one conditional
    aggregation (not two aggregations and a join).  Keys need attempts in both
    segments and at least ``min_n`` inside; ``differential = inside - outside``."""
    fl = F.coalesce(flag, F.lit(False))
    miss = F.coalesce(fail, F.lit(False))
    a = df.groupBy(key).agg(
        F.count_if(fl).alias(f"{inside}_{noun}_attempted"),
        F.count_if(fl & miss).alias(f"{inside}_{noun}_missed"),
        F.count_if(~fl).alias(f"{outside}_{noun}_attempted"),
        F.count_if(~fl & miss).alias(f"{outside}_{noun}_missed"))
    ia, im = F.col(f"{inside}_{noun}_attempted"), F.col(f"{inside}_{noun}_missed")
    oa, om = F.col(f"{outside}_{noun}_attempted"), F.col(f"{outside}_{noun}_missed")
    a = a.filter((ia > 0) & (oa > 0) & (ia >= min_n))
    ip, op = (1 - im / ia), (1 - om / oa)
    return a.withColumns({f"{inside}_ft_percent": ip, f"{outside}_ft_percent": op,
                          "differential": ip - op})


def _decided(finals: DataFrame) -> DataFrame:
    """Winner ('home' only if strictly ahead) and the loser's points from the final score."""
    home_won = F.col("home_final") > F.col("vis_final")
    return finals.withColumns({
        "winner": F.when(home_won, "home").otherwise("visitor"),
        "loser_points": F.when(home_won, F.col("vis_final")).otherwise(F.col("home_final")),
    })


def game_results(timeline: DataFrame) -> DataFrame:
    """Final score per game (running scores never fall, so max = final),
    winner and the loser's points."""
    return _decided(timeline.groupBy(GAME).agg(F.max("visitor_score").alias("vis_final"),
                                               F.max("home_score").alias("home_final")))


def shot_value(home: Column, visitor: Column) -> Column:
    """1 for a free throw, 3 for a three, else 2."""
    ft = F.coalesce(home.contains("Free Throw"), F.lit(False)) | \
        F.coalesce(visitor.contains("Free Throw"), F.lit(False))
    three = F.coalesce(visitor.contains("3PT"), F.lit(False)) | \
        F.coalesce(home.contains("3PT"), F.lit(False))
    return F.when(ft, 1).when(three, 3).otherwise(2)


def first_crossing(timeline: DataFrame, chunk_size=DEFAULT_CHUNK, cuts: Cuts | None = None) -> DataFrame:
    """Game-winning event per game: the first event at which the winner's score
    passes the loser's final total.  The final score comes onto the events in the
    scan of the log; the first event is a ``min_by`` aggregate."""
    finals = {"vis_final": ("max", "visitor_score"), "home_final": ("max", "home_score")}
    j = _decided(scan(timeline, GAME, ORDER, groups=finals, chunk_size=chunk_size, cuts=cuts))
    cross = ((F.col("winner") == "home") & (F.col("home_score") > F.col("loser_points"))) | \
            ((F.col("winner") == "visitor") & (F.col("visitor_score") > F.col("loser_points")))
    cols = [c for c in timeline.columns if c != GAME]
    first = j.filter(cross).groupBy(GAME).agg(
        F.min_by(F.struct(*cols), F.col(ORDER)).alias("_e"))
    return first.select(GAME, "_e.*")


def game_winners(timeline: DataFrame, chunk_size=DEFAULT_CHUNK, cuts: Cuts | None = None) -> DataFrame:
    """Per actor: game-winning threes / twos / free throws and points."""
    fc = first_crossing(timeline, chunk_size, cuts).withColumn(
        "shot_value", shot_value(F.col("HOMEDESCRIPTION"), F.col("VISITORDESCRIPTION")))
    sv = F.col("shot_value")
    return fc.groupBy("PLAYER1_NAME").agg(
        F.count_if(sv == 3).alias("game_winning_3"), F.count_if(sv == 2).alias("game_winning_2"),
        F.count_if(sv == 1).alias("game_winning_ft"), F.sum(sv).alias("game_winning_points"))


def neighbour_pattern(log: DataFrame, pattern: str = "REBOUND", next_pattern: str = "PTS",
                      chunk_size=DEFAULT_CHUNK) -> DataFrame:
    """Events matching ``pattern`` whose previous and next events have the
    same actor, and whose next event matches ``next_pattern`` (a put-back
    after an own rebound); per actor: counts by shot value."""
    n = neighbours(log, GAME, ORDER, {
        "next_home_play": ("HOMEDESCRIPTION", 1), "next_visitor_play": ("VISITORDESCRIPTION", 1),
        "next_player": ("PLAYER1_ID", 1), "last_player": ("PLAYER1_ID", -1)},
        chunk_size=chunk_size)
    nh, nv = F.col("next_home_play"), F.col("next_visitor_play")
    hit = (n.filter(text_any(SIDES, pattern))
            .filter((F.col("PLAYER1_ID") == F.col("next_player"))
                    & (F.col("PLAYER1_ID") == F.col("last_player")))
            .filter(F.coalesce(nh.rlike(next_pattern), F.lit(False))
                    | F.coalesce(nv.rlike(next_pattern), F.lit(False))))
    three = F.coalesce(nh.contains("3PT"), F.lit(False)) | F.coalesce(nv.contains("3PT"), F.lit(False))
    hit = hit.withColumn("shot_value", F.when(three, 3).otherwise(2))
    sv = F.col("shot_value")
    return hit.groupBy("PLAYER1_NAME").agg(
        F.count_if(sv == 3).alias("fix_with_3"), F.count_if(sv == 2).alias("fix_with_2"),
        F.count(F.lit(1)).alias("fixed_shots"), F.sum(sv).alias("fixed_points"))


def event_outcome_rates(log: DataFrame, event: str = "BLOCK", exclude_ends: str = "Rebound",
                        chunk_size=DEFAULT_CHUNK) -> DataFrame:
    """Share of ``event`` rows (blocks) whose next event shows nothing on the
    opponent's side (the ball stayed with the event team), excluding events
    that share (game, period, clock) with a team rebound.

    Output per actor (PLAYER3_NAME): blocks, own, other, percent_recovered_by_own."""
    n = neighbours(log, GAME, ORDER, {"next_home_play": ("HOMEDESCRIPTION", 1),
                                      "next_visitor_play": ("VISITORDESCRIPTION", 1)},
                   chunk_size=chunk_size)
    ev = n.filter(text_any(SIDES, event)).withColumn(
        "home_or_visitor", F.when(F.coalesce(F.col("HOMEDESCRIPTION").rlike(event), F.lit(False)), "home")
        .otherwise("visitor"))
    moment = [GAME, "PERIOD", "PCTIMESTRING"]
    rebs = log.filter(text_any(SIDES, exclude_ends, kind="ends")).select(
        *[F.col(c).alias("_r_" + c) for c in moment]).distinct().withColumn("_reb", F.lit(True))
    same = [ev[c].eqNullSafe(rebs["_r_" + c]) for c in moment]
    ev = ev.join(rebs, same, "left").withColumn("_kept", F.col("_reb").isNull())
    own = (((F.col("home_or_visitor") == "home") & F.col("next_visitor_play").isNull())
           | ((F.col("home_or_visitor") == "visitor") & F.col("next_home_play").isNull()))
    out = ev.groupBy("PLAYER3_NAME").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("_kept") & own).alias("own"),
        F.count_if(F.col("_kept") & ~own).alias("other"))
    return out.withColumn("percent_blk_recovered_by_own", F.col("own") / F.col("blocks"))


def pair_leaderboard(log: DataFrame, pattern: str = "Alley", miss: str = "MISS") -> DataFrame:
    """Unordered (actor, assister) pairs on made ``pattern`` events: count per
    pair, pair key = (least, greatest) so A+B and B+A are one duo."""
    made = log.filter(text_any(SIDES, pattern)).filter(
        ~text_any(SIDES, miss, kind="starts")).filter(F.col("PLAYER2_NAME").isNotNull())
    pairs = made.select(F.least("PLAYER1_NAME", "PLAYER2_NAME").alias("p1"),
                        F.greatest("PLAYER1_NAME", "PLAYER2_NAME").alias("p2"))
    return pairs.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("count"))


def same_moment_union(log: DataFrame, foul: str = "S.FOUL", last_ft: str = "Free Throw 3 of 3",
                      three: str = "3PT", miss: str = "MISS",
                      keys=("GAME_ID", "PERIOD", "PCTIMESTRING")) -> DataFrame:
    """Fouls matched to three-point attempts at the same moment: fouls with a
    third free throw (missed three) UNION ALL fouls with a made three; every
    match is kept (one foul may match several rows).  Returns the foul rows
    with ``_x`` suffixes and the matched shot rows with ``_y``."""
    keys = list(keys)
    fouls = log.filter(text_any(SIDES, foul))
    ft3 = log.filter(text_any(SIDES, last_ft))
    made3 = log.filter(text_any(SIDES, three)).filter(~text_any(SIDES, miss, kind="starts"))
    fx = fouls.select(*keys, *[F.col(c).alias(c + "_x") for c in fouls.columns if c not in keys])

    def side(d):
        return d.select(*keys, *[F.col(c).alias(c + "_y") for c in d.columns if c not in keys])

    return fx.join(side(ft3), keys).unionByName(fx.join(side(made3), keys))


def same_moment_counts(log: DataFrame, foul: str = "S.FOUL", last_ft: str = "Free Throw 3 of 3",
                       three: str = "3PT", miss: str = "MISS", extra=(),
                       keys=("GAME_ID", "PERIOD", "PCTIMESTRING")) -> DataFrame:
    """Number of rows of :func:`same_moment_union` per moment, fouler
    (``PLAYER1_NAME_x``) and shooter (``PLAYER1_NAME_y``), without making the pairs:
    both sides are counted per moment and player first and the counts multiplied.
    ``extra``: further columns of the moment (a season)."""
    keys = [*keys, *extra]
    hit = text_any(SIDES, last_ft).cast("int") + (
        text_any(SIDES, three) & ~text_any(SIDES, miss, kind="starts")).cast("int")
    fouls = log.filter(text_any(SIDES, foul)).groupBy(*keys, F.col("PLAYER1_NAME").alias("PLAYER1_NAME_x")).agg(
        F.count(F.lit(1)).alias("_f"))
    shots = log.withColumn("_hit", hit).filter(F.col("_hit") > 0).groupBy(
        *keys, F.col("PLAYER1_NAME").alias("PLAYER1_NAME_y")).agg(F.sum("_hit").alias("_s"))
    return fouls.join(shots, keys).withColumn("n", F.col("_f") * F.col("_s")).drop("_f", "_s")


def timeout_budget(log: DataFrame, teams: DataFrame, per_game: int = 7, per_ot: int = 2,
                   regulation_periods: int = 4, overrides: dict | None = None,
                   two_words: tuple[str, ...] = ("POR",)) -> DataFrame:
    """Timeout utilisation per team.

    Allotment: distinct (game, period, team) rows -> games = regular periods / 4,
    overtimes = periods > 4; ``num_timeouts = 7 * games + 2 * overtimes``.
    Used: timeout texts without 'Excess' (on the texts themselves, long form),
    nickname = title-cased text before ' Timeout:'.  ``teams`` maps the
    abbreviation ``tm`` to the full name ``team``, whose last word is the nickname
    (the last two for the abbreviations ``two_words``); ``overrides`` renames
    abbreviations first (e.g. {'BRK': 'BKN'})."""
    from courtstats.functions.text import nth_word, title_case

    slots = (log.filter(F.col("PLAYER1_TEAM_ABBREVIATION").isNotNull())
                .select(GAME, "PERIOD", F.col("PLAYER1_TEAM_ABBREVIATION").alias("team"))
                .distinct())
    avail = slots.groupBy("team").agg(
        (F.count_if(F.col("PERIOD") <= regulation_periods) / regulation_periods).alias("games"),
        F.count_if(F.col("PERIOD") > regulation_periods).alias("overtimes"))
    avail = avail.withColumn("num_timeouts", per_game * F.col("games") + per_ot * F.col("overtimes"))
    tm = F.col("tm")
    for src, dst in (overrides or {}).items():
        tm = F.when(tm == src, F.lit(dst)).otherwise(tm)
    parts = F.split("team", " ")
    last = F.when(tm.isin(*two_words), F.least(F.lit(2), F.size(parts))).otherwise(F.lit(1))
    nick = F.array_join(F.slice(parts, -last, last), " ")
    dim = teams.select(tm.alias("_abbr"), F.col("team").alias("team_name"), title_case(F.lower(nick)).alias("_nick"))
    avail = avail.join(dim, avail.team == dim._abbr, "left").drop("_abbr")
    used = (log.filter(text_any(SIDES, "Timeout"))
               .select(F.explode(F.array(*[F.col(s) for s in SIDES])).alias("timeout"))
               .filter(F.col("timeout").isNotNull())
               .filter(F.col("timeout").contains("Timeout") & ~F.col("timeout").contains("Excess"))
               .groupBy(title_case(F.lower(nth_word("timeout", 1, " Timeout:"))).alias("_nick"))
               .agg(F.count(F.lit(1)).alias("num_timeouts_used")))
    out = avail.join(used, "_nick", "left").drop("_nick")
    return out.withColumn("timeout_use_percent", F.col("num_timeouts_used") / F.col("num_timeouts"))
