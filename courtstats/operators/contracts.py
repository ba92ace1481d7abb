"""Contract performance: identity by carry, seasonal and career value against salary.

A contract names its player; the player's id, experience and value come from the
season's statistics and are missing where the player was paid but did not play.  The id
of such a row is that of the player's closest earlier season that has one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtstats.operators.sequence import DEFAULT_CHUNK, scan

WINS_PER_POINT = 2.7   # wins of one point of value over replacement
GAMES_BALANCE = 41     # wins of an even team


def wins_added(vorp: Column) -> Column:
    return vorp * WINS_PER_POINT


def predicted_salary(vorp: Column, cap: Column) -> Column:
    """The share of the cap that the wins added are worth, an even team being worth all of it."""
    return wins_added(vorp) / GAMES_BALANCE * cap


def carry_identity(df: DataFrame, name: str, order, key: str, chunk_size=DEFAULT_CHUNK) -> DataFrame:
    """Missing ``key`` values filled from the last row of the same ``name`` before it, in
    ``order`` (season first): rows of a name in descending order, filled upwards."""
    return scan(df, name, order, down={key: key}, chunk_size=chunk_size)


def contract_seasons(contracts: DataFrame, players: DataFrame, cap: DataFrame, sum_value: bool = False) -> DataFrame:
    """One row per (player_id, player, tm, season): salary (of all contracts), vorp, experience,
    cap, percent_of_cap, vorp_per_percent_of_cap, wins_added, predicted_sal,
    act_minus_predict, diff_as_percent_of_cap.

    ``contracts``: player, tm, season, salary; ``players``: player_id, player, tm, season,
    experience, vorp; ``cap``: season, cap.  Value is missing (0) where a player did not play.  Of several
    contracts of a season the salaries are added and the value is counted once;
    ``sum_value`` counts it once per contract."""
    j = contracts.join(players, ["player", "tm", "season"], "left")
    j = carry_identity(j, "player", ["season", "tm", "salary"], "player_id").na.fill({"vorp": 0.0})
    one = j.groupBy("player_id", "player", "tm", "season").agg(
        F.sum("salary").alias("salary"), (F.sum if sum_value else F.max)("vorp").alias("vorp"), F.max("experience").alias("experience"))
    c = one.join(cap, "season", "left")
    v, s, k = F.col("vorp"), F.col("salary"), F.col("cap")
    c = c.withColumns({"percent_of_cap": s / k, "wins_added": wins_added(v), "predicted_sal": predicted_salary(v, k)})
    c = c.withColumns({"vorp_per_percent_of_cap": F.try_divide(v, F.col("percent_of_cap")), "act_minus_predict": s - F.col("predicted_sal")})
    return c.withColumn("diff_as_percent_of_cap", F.col("act_minus_predict") / k)


CAREER_SUMS = ("salary", "vorp", "percent_of_cap", "wins_added", "predicted_sal", "act_minus_predict", "diff_as_percent_of_cap")


def contract_careers(seasons: DataFrame) -> DataFrame:
    """One row per (player_id, player): experience (most), career_<sum> of the seasonal
    columns and career_vorp_per_percent_of_cap."""
    g = seasons.groupBy("player_id", "player").agg(
        F.max("experience").alias("experience"), F.count(F.lit(1)).alias("n_seasons"),
        *[F.sum(c).alias("career_" + c) for c in CAREER_SUMS])
    return g.withColumn("career_vorp_per_percent_of_cap", F.try_divide("career_vorp", "career_percent_of_cap"))
