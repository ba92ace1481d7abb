"""Landed inputs by season, headers in the data, rename rules, refreshed boards, strings in
pieces, carried identity."""

import hashlib
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtstats.operators import contracts as K
from courtstats.operators import rules as RU
from courtstats.operators.aggregate import ordered_pieces
from courtstats.plans import q_sources as QS
from courtstats.sources import headers as H
from courtstats.sources import seasons as SE
from courtstats.sources.ingest import first_link
from courtstats.streaming.boards import BoardState

SF = "/root/testdata/sf0.001"


def rows(df, cols=None):
    df = df.select(*(cols or df.columns))
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


# --- rules --------------------------------------------------------------------------------------

def test_rules_of_contracts_and_rosters(spark):
    before = ["Tim Hardaway", "Tim Hardaway Sr.", "Gary Payton", "Gary Payton II", "Robert Woodard II", "Mo Bamba", "Mohamed Bamba",
              "Nic Claxton", "Otto Porter Jr.", "Otto Porter", "Lonnie Walker IV", "Juancho Hernangómez", "Luka Dončić", None]
    after = ["Tim Hardaway Jr.", "Tim Hardaway Sr.", "Gary Payton II", "Gary Payton II", "Robert Woodard", "Mo Bamba", "Mo Bamba",
             "Nicolas Claxton", "Otto Porter", "Otto Porter", "Lonnie Walker", "Juan Hernangómez", "Luka Dončić", None]
    d = spark.createDataFrame(list(enumerate(before)), "i int, player string")
    assert [r.player for r in RU.apply_rules(d, "player", RU.CONTRACT_RULES).orderBy("i").collect()] == after
    got = {r.player: r.name for r in RU.apply_rules(d, "player", RU.ROSTER_RULES, "name").collect()}
    assert got["Otto Porter Jr."] == "Otto Porter" and got["Nic Claxton"] == "Nic Claxton" and got["Tim Hardaway"] == "Tim Hardaway"
    stats = spark.createDataFrame([("Tim Hardaway Jr.", 1), ("Lonnie Walker", 2), ("Luka Dončić", 3)], "player string, id int")
    joined = RU.join_by_rules(d, stats, "player", RU.rule_table(spark, RU.CONTRACT_RULES))
    assert {(r.i, r.id) for r in joined.collect() if r.id} == {(0, 1), (10, 2), (12, 3)}


def test_first_rule_wins_and_the_report(spark):
    rules = [RU.Rule("b", "first"), RU.Rule("^ab", suffix="!", kind="regex"), RU.Rule("c", kind="equals", suffix=" Jr."), RU.Rule("zz")]
    d = spark.createDataFrame([("ab",), ("ab",), ("c",), ("d",), ("abc",), (None,), ("xzzab",)], "n string")
    assert rows(RU.apply_rules(d, "n", rules, "m")) == [
        ("ab", "first"), ("ab", "first"), ("abc", "first"), ("c", "c Jr."), ("d", "d"), ("xzzab", "first"), (None, None)]
    shuffled = RU.rule_table(spark, rules).orderBy(F.col("rule").desc())
    assert rows(RU.apply_rules(d, "n", shuffled, "m")) == rows(RU.apply_rules(d, "n", rules, "m"))
    assert rows(RU.report(d, "n", [*rules, RU.Rule("never")])) == [
        ("none", "d", []), ("several", "ab", [0, 1]), ("several", "abc", [0, 1]), ("several", "xzzab", [0, 3]), ("unused", None, [4])]
    assert rows(RU.apply_rules(d, "n", []))[0] == ("ab",)
    with pytest.raises(ValueError):
        RU.Rule("x", kind="like")
    with pytest.raises(ValueError):
        RU.apply_rules(d, "n", [RU.Rule("x")] * (RU.MAX_RULES + 1))


# --- ordered strings in pieces ---------------------------------------------------------------------

def test_a_million_members_in_pieces(spark):
    d = spark.range(0, 1_000_000, 1, 8).select(F.lit("hot").alias("g"), F.col("id").cast("string").alias("k"), (-F.col("id")).alias("o"))
    d = d.unionByName(spark.createDataFrame([("s", "b", 2), ("s", "a", 1), ("s", None, 0), ("n", None, 1)], "g string, k string, o long"))
    got = ordered_pieces(d, "g", "k", "o", ",", 100_000, chunk_size=1 << 17).collect()
    hot = sorted((r.piece, r.n, r.text) for r in got if r.g == "hot")
    assert [n for _, n, _ in hot] == [100_000] * 10
    text = ",".join(t for _, _, t in hot)
    assert hashlib.md5(text.encode()).hexdigest() == hashlib.md5(",".join(map(str, range(999_999, -1, -1))).encode()).hexdigest()
    assert [(r.g, r.piece, r.n, r.text) for r in got if r.g != "hot"] == [("s", 0, 2, "a,b")]


# --- headers ---------------------------------------------------------------------------------------

WANT = T.StructType([T.StructField("name", T.StringType()), T.StructField("x3pt_sfd", T.IntegerType()), T.StructField("pct_percent", T.DoubleType())])


def put(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_headers_are_found_per_file(spark, tmp_path):
    path = put(tmp_path, a='Name,"X3PT SFD\nshooting fouls",Pct%\nAnn,3,0.5\nName,"X3PT SFD\nshooting fouls",Pct%\n"Bo, Jr.",NA,\n',
               b='Pct%,Name,x3pt sfd\n0.25,Cy,7\n', c='X3PT SFD,Name\n9,Di\n', d='')
    d = H.read_headed(spark, path, WANT, optional=["pct_percent"], ignore=[])
    got = {tuple(r)[:3] for r in d.collect()}
    assert got == {("Ann", 3, 0.5), ("Bo, Jr.", None, None), ("Cy", 7, 0.25), ("Di", 9, None)}
    assert {os.path.basename(r.source_file) for r in d.collect()} == {"a.csv", "b.csv", "c.csv"}


@pytest.mark.parametrize("text", ["Name,x3pt_sfd\nA,1\n", "Name,x3pt_sfd,Pct%,New\nA,1,2,3\n", "Name,x3pt_sfd,Pct%\nA,one,2\n",
                                  ",".join(f"c{i}" for i in range(12)) + "\n"])
def test_drifting_files_raise(spark, tmp_path, text):
    path = put(tmp_path, good="Name,x3pt_sfd,Pct%\nB,1,0.5\n", bad=text)
    with pytest.raises(PySparkException):
        H.read_headed(spark, path, WANT, ignore=[], max_columns=8).select("name", "x3pt_sfd").collect()


def test_repeated_and_empty_names(spark, tmp_path):
    path = put(tmp_path, a="A,A,,9 lives\n1,2,3,4\n")
    want = T.StructType([T.StructField(n, T.IntegerType()) for n in ("a", "a_2", "x9_lives")])
    assert [tuple(r)[:3] for r in H.read_headed(spark, path, want).collect()] == [(1, 2, 4)]


def test_only_first_records_are_kept_for_headers(spark, tmp_path):
    want = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
    path = put(tmp_path, x="A,B\n" + "".join(f"{i},{-i}\n" for i in range(2000)), y='B,"A\nfirst"\n' + "".join(f"{i},{-i}\n" for i in range(2000)))
    d = H.read_headed(spark, path, want, ignore=[])
    assert sorted((r.a, r.b) for r in d.collect()) == sorted([(i, -i) for i in range(2000)] + [(-i, i) for i in range(2000)])
    heads = plan(H.headers(H.read_cells(spark, path)))
    assert "min_by(_at" in heads and "min_by(_cells" not in heads  # cells in a running minimum sort all records


# --- seasons ----------------------------------------------------------------------------------------

def test_seasons_are_pruned(spark, tmp_path):
    path = str(tmp_path / "log")
    declared = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType()), T.StructField("season", T.IntegerType())])
    d = spark.range(1000).select("id", F.lit("x").alias("v"), (F.lit(2000) + F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 4)).cast("int").alias("season"))
    SE.land(d, path, files=4)
    some = SE.read_seasons(spark, path, declared, [2001, 2003])
    text = plan(some)
    assert "PartitionFilters" in text and "season#" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert some.count() == d.filter("season in (2001, 2003)").count()
    os.makedirs(f"{path}/season=1999")
    with open(f"{path}/season=1999/part-0.parquet", "w") as f:
        f.write("not a parquet file")
    assert SE.read_seasons(spark, path, declared, [2001, 2003], check=False).count() == some.count()  # its folder is not read
    with pytest.raises(Exception, match="parquet"):
        SE.read_seasons(spark, path, declared, check=False).select("id").collect()
    os.remove(f"{path}/season=1999/part-0.parquet")
    dim = spark.createDataFrame([(2002, "a"), (2001, "b")], "season int, k string").filter("k = 'a'")
    joined = SE.read_seasons(spark, path, declared).join(F.broadcast(dim), "season")
    assert "dynamicpruning" in plan(joined).lower()
    SE.land(spark.createDataFrame([(1, "new", 2002)], declared), path, mode="overwrite")  # only that season is replaced
    again = SE.read_seasons(spark, path, declared)
    assert again.filter("season = 2002").count() == 1 and again.filter("season = 2001").count() == d.filter("season = 2001").count()


def test_drift_of_landed_columns_raises(spark, tmp_path):
    declared = T.StructType([T.StructField("id", T.LongType()), T.StructField("season", T.IntegerType())])
    for i, bad in enumerate([spark.range(3).select(F.col("id").cast("string").alias("id"), F.lit(2000).alias("season")),
                             spark.range(3).select("id", F.lit(1).alias("more"), F.lit(2000).alias("season")),
                             spark.range(3).select(F.col("id").alias("other"), F.lit(2000).alias("season"))]):
        path = str(tmp_path / str(i))
        SE.land(bad, path)
        with pytest.raises(ValueError, match="drifted"):
            SE.read_seasons(spark, path, declared)
    assert set(SE.INPUTS) >= {"play_by_play_log", "advanced", "contracts", "salary_cap"}
    with pytest.raises(ValueError):
        SE.check_columns(SE.INPUTS["contracts"], SE.INPUTS["salary_cap"], "x")


def test_season_of_a_file(spark):
    d = spark.createDataFrame([("s3://b/1996-97_pbp.csv",), ("/d/1999-00_pbp.csv/part-00000-8c.csv",), ("/2001-02/x/part-1.csv",), (None,)], "p string")
    assert [r[0] for r in d.select(SE.season_of_file("p")).collect()] == [1997, 2000, None, None]


# --- boards ------------------------------------------------------------------------------------------

def test_refreshed_board_equals_recomputation(spark, tmp_path):
    log = spark.range(3000).select((F.lit(2000) + F.col("id") % 3).cast("int").alias("season"), (F.col("id") % 40).alias("game"),
                                   F.concat(F.lit("p"), (F.col("id") % 7).cast("string")).alias("player"), (F.col("id") % 5).alias("pts"))
    log = log.withColumn("season", (F.lit(2000) + F.col("game") % 3).cast("int"))
    measures = {"points": F.sum("pts"), "events": F.count(F.lit(1))}
    path = str(tmp_path / "board")

    def files(season):
        d = f"{path}/season={season}"
        return {(f, os.path.getmtime(f"{d}/{f}")) for f in os.listdir(d)} if os.path.isdir(d) else set()

    first = BoardState(spark, path, "player", measures)
    assert first.refresh(log.filter("game < 9")) == [2000, 2001, 2002]
    assert first.refresh(log.filter("game < 9")) == []
    kept = files(2002)
    later = spark.newSession()
    second = BoardState(later, path, "player", measures)
    assert second.refresh(log.filter("game < 9 or game in (9, 10)")) == [2000, 2001]
    assert files(2002) == kept
    assert second.refresh(log) == [2000, 2001, 2002] and second.refresh(log) == []
    want = rows(log.groupBy("season", "player").agg(*[m.alias(n) for n, m in measures.items()]))
    board = second.board()
    assert rows(board.filter("scope = 'season'"), ["season", "player", "points", "events"]) == want
    career = rows(log.groupBy("player").agg(*[m.alias(n) for n, m in measures.items()]))
    assert rows(board.filter("scope = 'career'"), ["player", "points", "events"]) == career


# --- contracts, links ------------------------------------------------------------------------------------

def test_identity_is_carried_and_value_counted_once(spark):
    contracts = spark.createDataFrame([
        ("A", "X", 2019, 100), ("A", "X", 2019, 50), ("A", "X", 2020, 60), ("B", "Y", 2018, 10), ("B", "Y", 2019, 20), ("C", "Z", 2019, 5)],
        "player string, tm string, season int, salary long")
    players = spark.createDataFrame([(1, "A", "X", 2019, 6, 2.0), (2, "B", "Y", 2019, 5, 1.0)],
                                    "player_id long, player string, tm string, season int, experience int, vorp double")
    cap = spark.createDataFrame([(2018, 1000), (2019, 1000), (2020, 2000)], "season int, cap long")
    s = K.contract_seasons(contracts, players, cap)
    got = {(r.player, r.season): (r.player_id, r.salary, r.vorp, r.percent_of_cap) for r in s.collect()}
    assert got == {("A", 2019): (1, 150, 2.0, 0.15), ("A", 2020): (1, 60, 0.0, 0.03), ("B", 2018): (None, 10, 0.0, 0.01),
                   ("B", 2019): (2, 20, 1.0, 0.02), ("C", 2019): (None, 5, 0.0, 0.005)}
    a = s.filter("player = 'A' and season = 2019").first()
    assert a.wins_added == pytest.approx(5.4) and a.predicted_sal == pytest.approx(5.4 / 41 * 1000)
    assert a.diff_as_percent_of_cap == pytest.approx((150 - 5.4 / 41 * 1000) / 1000)
    twice = K.contract_seasons(contracts, players, cap, sum_value=True)
    assert twice.filter("player = 'A' and season = 2019").first().vorp == 4.0
    c = {r.player: r for r in K.contract_careers(s).filter("player_id is not null").collect()}
    assert (c["A"].career_salary, c["A"].experience, c["A"].n_seasons) == (210, 6, 2)
    assert c["A"].career_vorp_per_percent_of_cap == pytest.approx(2.0 / 0.18)


def test_first_link(spark):
    d = spark.createDataFrame([(1, '<a href="/b"><a href="/a2"><a href="/a1">'), (2, "<p>"), (3, None)], "page_id int, html string")
    assert rows(first_link(d, "^/a")) == [(1, "/a2")]


def test_shares_lie_between_zero_and_one(spark):
    s = QS._shares(spark, SF).collect()
    assert s and all(0 <= r.unassisted_share <= 1 and r.assisted_share == pytest.approx(1 - r.unassisted_share) for r in s)
