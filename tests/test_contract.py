"""Contracts that the driver data never exercises: missing keys, NaN, ties, cuts
inside a sequence, odd numbers in texts."""

import random

import pytest
from pyspark.sql import functions as F

from courtstats.functions.text import (
    game_season, height_inches, name_override, parse_number, split_typed,
)
from courtstats.operators import events as EV
from courtstats.operators import joins as J
from courtstats.operators import rank as R
from courtstats.operators import sequence as Q
from courtstats.operators.filters import group_size_filter, qualify_share
from courtstats.session import checkpoint_dir
from courtstats.sources.ingest import missing_ids, read_many
from courtstats.sources.tables import TABLE_SCHEMAS
from courtstats.streaming import ingest_new_files


def rows(df, cols=None):
    df = df.select(*(cols or df.columns))
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def log(spark):
    random.seed(1)
    data = [(random.choice(["a", "b", None, "c", "a", "a"]), 3 * i + random.randint(0, 2), random.choice([None, 1, 2, 5]),
             random.choice([None, "x", "y"])) for i in range(90)] + [("z", None, 4, None), ("z", 2, None, "q")]
    return spark.createDataFrame(data, "g string, o long, v long, s string").cache()


NEIGHBOURS = {"n1": ("v", 1), "p1": ("s", -1), "n3": ("s", 3), "p2": ("v", -2), "p4": ("v", -4)}


@pytest.mark.parametrize("run", [
    lambda d, c: Q.running_sum(d, "g", "o", "v", chunk_size=c),
    lambda d, c: Q.fill(d, "g", "o", ["v", "s"], "down", c),
    lambda d, c: Q.fill(d, "g", "o", ["v", "s"], "up", c),
    lambda d, c: Q.neighbours(d, "g", "o", NEIGHBOURS, c),
], ids=["running_sum", "fill_down", "fill_up", "neighbours"])
def test_sequences_do_not_depend_on_chunks(log, run):
    plain = run(log, None)
    for size in (1, 3, 64, Q.DEFAULT_CHUNK):
        assert rows(run(log, size), plain.columns) == rows(plain), size


def test_missing_keys_match(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, x string")
    right = spark.createDataFrame([(1, "p"), (None, "q"), (4, "r")], "k int, x string")
    assert rows(J.join_suffix(left, right, "k")) == [(1, "a", "p"), (None, "b", "q")]
    assert rows(J.join_suffix(left, right, "k", null_safe=False)) == [(1, "a", "p")]
    got = {(r.k, r._merge) for r in J.merge_indicator(left, right.drop("x"), "k").collect()}
    assert got == {(1, "both"), (None, "both"), (3, "left_only"), (4, "right_only")}
    assert rows(J.anti_join(left, right, "k")) == [(3, "c")]
    assert rows(J.semi_join(left, right, "k")) == [(1, "a"), (None, "b")]
    assert rows(J.role_join(left, right, {"k": "r_"}, "k"), ["k", "r_x"]) == [(1, "p"), (None, "q")]
    many = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k int, v int")
    assert rows(group_size_filter(many, "k", 1)) == [(None, 1), (None, 2)]
    q = qualify_share(spark.createDataFrame([(None, 3.0)], "k int, g double"),
                      spark.createDataFrame([(None, 4.0)], "k int, g_total double"), "k", "g", "g_total", 0.5)
    assert [r.g_percent for r in q.collect()] == [0.75]


def test_nan_is_missing_and_ties_are_total(spark):
    nan = float("nan")
    d = spark.createDataFrame([("a", 1, 2.0), ("a", 2, nan), ("a", 3, 5.0), ("a", 4, 5.0), (None, 5, nan), (None, 6, 1.0)],
                              "g string, i int, v double")
    assert rows(R.slice_range(d, "g", "v", 1, 1), ["i"]) == [(3,), (6,)]
    assert rows(R.drop_leader(d, "g", "v"), ["i"]) == [(1,), (2,), (4,), (5,)]
    assert rows(R.group_argmax(d, "g", "v"), ["i"]) == [(3,), (6,)]
    assert {(r.i, r.leader) for r in R.leader_flag(d, "g", "v").collect() if r.leader} == {(3, True), (4, True), (6, True)}
    assert rows(R.top_n(d, F.col("v"), 1, partition="g"), ["i"]) == [(3,), (4,), (6,)]
    assert rows(R.top_n(d, "v", 1, partition="g"), ["i"]) == [(3,), (4,), (6,)]
    pct = {r.i: r.v_pct_rank for r in R.pct_rank(d, "v", partition="g").collect()}
    assert pct == {1: pytest.approx(1 / 3), 2: None, 3: pytest.approx(2.5 / 3), 4: pytest.approx(2.5 / 3), 5: None, 6: 1.0}
    twice = spark.createDataFrame([("a", 1, 9.0), ("a", 1, 9.0), ("a", 2, 3.0)], "g string, i int, v double")
    assert rows(R.drop_leader(twice, "g", "v")) == [("a", 1, 9.0), ("a", 2, 3.0)]


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_over_ranges(spark, descending):
    random.seed(3)
    data = [(random.choice(["a", "b", None]), i, float(random.randint(0, 60))) for i in range(300)] + [("a", 999, None)]
    d = spark.createDataFrame(data, "g string, i int, v double")
    got = {r.i: r for r in R.percent_rank_ignore_null(
        R.pct_rank(d, "v", method="min", partition="g", descending=descending), "v", "pr", "g", descending).collect()}
    for g, i, v in data:
        if v is None:
            assert got[i].v_pct_rank is None and got[i].pr is None
            continue
        own = [x for h, _, x in data if h == g and x is not None]
        low = 1 + sum((x > v) if descending else (x < v) for x in own)
        assert got[i].v_pct_rank == pytest.approx(low / len(own))
        assert got[i].pr == pytest.approx((low - 1) / (len(own) - 1))
    both = R.pct_rank(d.withColumn("w", F.col("i").cast("long") * 0 + F.lit(2 ** 53) + F.col("i") % 3)
                      .withColumn("j", F.col("i")), ["i", "w"], descending=descending)
    assert both.filter("i_pct_rank is null").count() == 0
    assert both.select("w_pct_rank").distinct().count() == 3  # longs beyond 2**53 stay apart


def test_numbers_names_and_heights(spark):
    d = spark.createDataFrame([(".405",), ("-.5",), ("$1,234",), ("30-52, under",), ("TIE",), ("7.",)], "t string")
    assert [r[0] for r in d.select(parse_number("t")).collect()] == [0.405, -0.5, 1234.0, 30.0, None, 7.0]
    n = spark.createDataFrame([("A",), ("B",), (None,)], "t string")
    assert [r[0] for r in n.select(name_override("t", [("A", "X"), ("A", "Y")])).collect()] == ["X", "B", None]
    h = spark.createDataFrame([("6-7",), ("six",), (None,)], "t string")
    assert [r[0] for r in h.select(height_inches("t")).collect()] == [79, None, None]
    assert [tuple(r) for r in split_typed(h, "t", "-", {"f": "int", "i": "int"}).select("f", "i").collect()] == [
        (6, 7), (None, None), (None, None)]
    s = spark.createDataFrame([("0029600001",), ("0022300001",), ("22300001",)], "t string")
    assert [r[0] for r in s.select(game_season("t")).collect()] == [1996, 2023, 2023]


def test_timeouts_by_nickname(spark):
    log = spark.createDataFrame(
        [(1, 1, "CELTICS Timeout: Regular", None, "BOS"), (1, 1, "TRAIL BLAZERS Timeout: Regular", None, "POR"),
         (1, 1, None, "CELTICS Timeout: Excess", "BOS"), (1, 5, None, "CELTICS Timeout: Regular", "BOS")],
        "GAME_ID int, PERIOD int, HOMEDESCRIPTION string, VISITORDESCRIPTION string, PLAYER1_TEAM_ABBREVIATION string")
    teams = spark.createDataFrame([("BOS", "Boston Celtics"), ("POR", "Portland Trail Blazers")], "tm string, team string")
    got = {r.team: r.num_timeouts_used for r in EV.timeout_budget(log, teams).collect()}
    assert got == {"BOS": 2, "POR": 1}


def test_same_moment_counts_equal_the_pairs(spark):
    random.seed(5)
    text = ["S.FOUL", "Free Throw 3 of 3", "3PT Jump Shot", "MISS 3PT Jump Shot", None]
    log = spark.createDataFrame([(1, 1, str(random.randint(0, 2)), random.choice(text), random.choice(text),
                                  random.choice(["a", "b", "c"])) for _ in range(60)],
                                "GAME_ID int, PERIOD int, PCTIMESTRING string, HOMEDESCRIPTION string, "
                                "VISITORDESCRIPTION string, PLAYER1_NAME string")
    pairs = EV.same_moment_union(log).groupBy("PLAYER1_NAME_x", "PLAYER1_NAME_y").agg(F.count("*").alias("n"))
    counts = EV.same_moment_counts(log).groupBy("PLAYER1_NAME_x", "PLAYER1_NAME_y").agg(F.sum("n").alias("n"))
    assert rows(pairs) == rows(counts)


def test_sources_and_folders(spark, tmp_path):
    a = spark.createDataFrame([(1,), (2,), (5,)], "k long")
    b = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    assert rows(missing_ids(a, b, "k")) == [(3, "missing"), (5, "unexpected")]
    many = read_many(spark, ["/root/testdata/sf0.001/events.parquet", "/root/testdata/sf0.01/events.parquet"],
                     TABLE_SCHEMAS["events"])
    assert many.select("source_file").distinct().count() == 2
    assert checkpoint_dir(spark) == checkpoint_dir(spark)
    with pytest.raises(TypeError):  # a stream has to name its checkpoint
        ingest_new_files(spark, "x", TABLE_SCHEMAS["events"], str(tmp_path), "no_checkpoint")
