"""Typed, season-partitioned inputs.

``INPUTS`` declares the columns of every input table of the awards.  A landed table is
laid out by season (one folder per season), so that a query on some seasons reads
their files only, whether the seasons are named in the query (static pruning) or come
from a joined table (dynamic pruning).  A file with another type, or without or with
further columns, raises instead of changing the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtstats.functions._cols import as_col
from courtstats.sources.headers import read_headed

_L, _I, _D, _S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()




def _fields(*groups) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for names, t in groups for n in names.split()])


_PLAYER = (("seas_id", _L), ("season", _I), ("player_id", _L), ("player pos", _S), ("age experience", _I), ("lg tm", _S), ("g", _I))
# The input tables and their columns.
INPUTS: dict[str, T.StructType] = {
    "play_by_play_log": _fields(
        ("GAME_ID", _L), ("EVENTNUM PERIOD", _I), ("PCTIMESTRING HOMEDESCRIPTION VISITORDESCRIPTION SCORE SCOREMARGIN", _S),
        ("PLAYER1_ID", _L), ("PLAYER1_NAME", _S), ("PLAYER2_ID", _L), ("PLAYER2_NAME", _S), ("PLAYER3_ID", _L), ("PLAYER3_NAME", _S),
        ("PLAYER1_TEAM_ABBREVIATION", _S), ("season", _I)),
    "advanced": _fields(*_PLAYER, ("mp ts_percent usg_percent x3p_ar ows dws ws bpm vorp", _D)),
    "per_game": _fields(*_PLAYER, ("gs", _I), (
        "mp_per_game fg_per_game x3p_per_game x3p_percent x2p_per_game x2p_percent "
        "pts_per_game trb_per_game ast_per_game stl_per_game blk_per_game", _D)),
    "totals": _fields(*_PLAYER, ("gs mp fg fga x3p x3pa x2p x2pa ft fta orb trb ast stl blk pf pts", _I)),
    "play_by_play": _fields(*_PLAYER, ("mp pg_percent sg_percent sf_percent pf_percent c_percent net_plus_minus_per_100_poss", _D)),
    "team_summaries": _fields(("season", _I), ("lg team abbreviation", _S), ("w l", _I), ("pw", _D)),
    "standings": _fields(("TeamID", _L), ("TeamName", _S), ("WINS LOSSES", _I), ("season", _S)),
    "hustle": _fields(("PLAYER_ID", _L), ("PLAYER_NAME", _S), ("TEAM_ID", _L), ("G", _I), (
        "MIN CHARGES_DRAWN LOOSE_BALLS_RECOVERED DEF_LOOSE_BALLS_RECOVERED DEFLECTIONS SCREEN_AST_PTS "
        "CONTESTED_SHOTS CONTESTED_SHOTS_2PT CONTESTED_SHOTS_3PT DEF_BOXOUTS", _D), ("season", _I)),
    "speed_distance": _fields(("PLAYER_ID", _L), ("PLAYER_NAME", _S), ("TEAM_ID", _L), ("TEAM_ABBREVIATION", _S), ("GP", _I),
                              ("MIN DIST_MILES_DEF AVG_SPEED_DEF", _D)),
    "player_bio": _fields(("PLAYER_ID", _L), ("PLAYER_NAME", _S), ("PLAYER_HEIGHT_INCHES", _D), ("season", _I)),
    "rebounding": _fields(("PLAYER_ID", _L), ("PLAYER_NAME_LAST_FIRST", _S), ("REB C_REB UC_REB C_REB_PCT", _D), ("season", _I)),
    "late_clock_shots": _fields(("PLAYER_ID", _L), ("PLAYER_NAME", _S), ("FGA_FREQUENCY FGA EFG_PCT", _D)),
    "roster_heights": _fields(("player pos ht", _S), ("wt", _I)),
    "contracts": _fields(("player", _S), ("salary", _L), ("tm", _S), ("season", _I)),
    "salary_cap": _fields(("season", _I), ("cap", _L)),
    "preseason_odds": _fields(("team", _S), ("w_l_o_u", _D), ("result", _S)),
    "shooting_fouls_drawn": _fields(("name", _S), ("x3pt_sfd x3pt_and_1s", _I)),
    "challenges": _fields(("team_challenged challenge_outcome", _S)),
}
#: columns of landed files that the awards do not read
UNREAD = ("VIDEO_AVAILABLE_FLAG", "PLAYER1_TEAM_NICKNAME", "PLAYER1_TEAM_CITY", "PLAYER1_TEAM_ID", "PLAYER2_TEAM_NICKNAME",
          "PLAYER2_TEAM_CITY", "PLAYER2_TEAM_ID", "PLAYER3_TEAM_NICKNAME", "PLAYER3_TEAM_CITY", "PLAYER3_TEAM_ID",
          "PERSON1TYPE", "PERSON2TYPE", "PERSON3TYPE")


def season_of_file(path) -> Column:
    """Season (last year) in the name of a file or its folder: ``.../1999-00_pbp.csv`` -> 2000;
    NULL without one."""
    years = F.regexp_extract(as_col(path), r"([0-9]{4})-[0-9]{2}[^/]*(/[^/]*)?$", 1)
    return F.when(years != "", years.try_cast("int") + 1)


def land(df: DataFrame, path: str, season: str = "season", files: int = 8, mode: str = "errorifexists") -> None:
    """Write a table by season, every season in about ``files`` files: rows are dealt by
    season and row hash, so a season that holds most rows is not one task."""
    plain = [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    d = df.withColumn("_file", F.pmod(F.xxhash64(*plain), F.lit(files))).repartition(season, "_file").drop("_file")
    d.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(season).parquet(path)


def check_columns(found: T.StructType, declared: T.StructType, what: str) -> None:
    """Raise where names or types are not those declared."""
    have, want = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (found, declared))
    wrong = [f"{n}: {have.get(n, 'missing')} for {want.get(n, 'no column')}" for n in sorted({*have, *want}) if have.get(n) != want.get(n)]
    if wrong:
        raise ValueError(f"{what} has drifted: " + "; ".join(wrong))


def read_seasons(spark: SparkSession, path: str, declared: T.StructType, seasons=None, season: str = "season",
                 check: bool = True) -> DataFrame:
    """A landed table with its declared columns; ``seasons`` are the only folders read.
    ``check`` compares the footers of all files with the declaration first."""
    if check:
        found = spark.read.option("mergeSchema", True).option("basePath", path).parquet(path).schema
        check_columns(found, declared, path)
    df = spark.read.schema(declared).parquet(path)
    return df if seasons is None else df.filter(F.col(season).isin([int(s) for s in seasons]))


def read_landed_csv(spark: SparkSession, paths, name: str, season_from_file: bool = True, multi_line: bool = False) -> DataFrame:
    """CSV files of the input ``name``, columns by the names in their headers, whatever their
    order; the season comes from the file's name where the table has none in the file."""
    declared = INPUTS[name]
    lower = T.StructType([T.StructField(f.name.lower(), f.dataType) for f in declared.fields if not (season_from_file and f.name == "season")])
    ignore = [c.lower() for c in UNREAD] + ["x", "unnamed_0", "season"]
    d = read_headed(spark, paths, lower, ignore=ignore, multi_line=multi_line)
    cols = [season_of_file("source_file").alias("season") if season_from_file and f.name == "season" else F.col(f.name.lower()).alias(f.name)
            for f in declared.fields]
    return d.select(*cols, "source_file")
