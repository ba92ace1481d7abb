"""Sequence scans: any atomic order type, several order columns, cuts of hot keys, plans."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from courtstats.operators import events as EV
from courtstats.operators import sequence as Q
from courtstats.plans import views as V

SF = "/root/testdata/sf0.001"


def rows(df, cols=None):
    df = df.select(*(cols or df.columns))
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


ORDERS = {
    "long": ("long", lambda i: i * 7),
    "double": ("double", lambda i: i / 3),
    "text": ("string", lambda i: f"é{i:05d}"),
    "timestamp": ("timestamp", lambda i: dt.datetime(2024, 3, 9) + dt.timedelta(minutes=i, microseconds=i)),
    "local_time": ("timestamp_ntz", lambda i: dt.datetime(2024, 3, 9) + dt.timedelta(minutes=i, microseconds=i)),
    "date": ("date", lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)),
    "decimal": ("decimal(20,3)", lambda i: Decimal(i) / 8),
    "binary": ("binary", lambda i: bytes([i // 250, i % 250])),
}


@pytest.mark.parametrize("kind", ORDERS)
def test_any_order_type_with_a_hot_key(spark, kind):
    """Two thirds of the rows share a key; cut or not, the result is the same."""
    random.seed(5)
    type_, value = ORDERS[kind]
    data = [(random.choice(["hot", "hot", "x", None]), value(i) if i else None, random.choice([None, 1, 2, 5]),
             random.choice([None, "p", "q"])) for i in range(150)]
    random.shuffle(data)
    d = spark.createDataFrame(data, f"g string, o {type_}, v long, s string").repartition(5).cache()
    asked = dict(sums={"run": "v"}, down={"s": "s"}, up={"next_v": "v"}, number="at",
                 near={"n1": ("v", 1), "n7": ("s", 7), "p2": ("v", -2)},
                 groups={"top": ("max", "v"), "all": ("sum", "v"), "n": ("count", "s"), "low": ("min", "s")})
    plain = Q.scan(d, "g", "o", chunk_size=None, **asked)
    for size in (1, 4, 20, 1000):
        assert rows(Q.scan(d, "g", "o", chunk_size=size, **asked), plain.columns) == rows(plain), size
    assert Q.find_cuts(d, "g", "o", 20).hot and not Q.find_cuts(d, "g", "o", 1000).bounds


def test_two_order_columns_part_what_one_cannot(spark):
    """Half of the rows share key and time; the second column orders them and is cut."""
    t = dt.datetime(2024, 1, 1)
    data = [("hot", t if i % 2 else t + dt.timedelta(seconds=i), i, i % 3) for i in range(200)] + [("hot", None, 999, 1)]
    d = spark.createDataFrame(data, "g string, ts timestamp, id long, v long")
    plain = Q.scan(d, "g", ["ts", "id"], sums={"run": "v"}, near={"prev": ("id", -1)}, chunk_size=None)
    cut = Q.scan(d, "g", ["ts", "id"], sums={"run": "v"}, near={"prev": ("id", -1)}, chunk_size=10)
    assert rows(cut, plain.columns) == rows(plain)
    cuts = Q.find_cuts(d, "g", ["ts", "id"], 10)
    parts = d.groupBy(Q._range_of(d, cuts)).count().agg(F.max("count")).first()[0]
    assert parts <= 20
    with pytest.raises(ValueError):
        Q.scan(d, "g", "ts", sums={"run": "v"}, cuts=cuts)


def test_a_sample_decides_cuts_only(spark):
    """A log beyond the sample: its hot key is cut into even ranges, whatever its values."""
    d = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 500).alias("g"),
        F.pow(F.lit(1.0004), F.col("id")).alias("o"), (F.col("id") % 11).alias("v"))
    cuts = Q.find_cuts(d, "g", "o", 1000, sample=2000)
    assert cuts.hot == ((-1,),)
    sizes = [r["count"] for r in d.filter("g = -1").groupBy(Q._range_of(d, cuts)).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 3000
    plain = Q.running_sum(d, "g", "o", "v", chunk_size=None)
    got = Q.running_sum(d, "g", "o", "v", cuts=cuts)
    assert plain.select(*got.columns).exceptAll(got).count() == 0
    capped = Q.find_cuts(d, "g", "o", 10, sample=2000, max_cuts=8)
    assert len(capped.bounds) <= 8 + len(capped.hot)


def test_empty_log(spark):
    d = spark.createDataFrame([], "g string, o timestamp, v long")
    assert Q.scan(d, "g", "o", sums={"r": "v"}, near={"n": ("v", 1)}, chunk_size=1).count() == 0


def test_one_exchange_of_the_log(spark):
    """Score, fill, final score and first crossing: one scan and one exchange of the log."""
    cuts = V.pbp_cuts(spark, SF)
    assert not cuts.bounds
    plan = executed(EV.game_winners(EV.score_timeline(V.pbp(spark, SF, cuts), cuts=cuts), cuts=cuts))
    final = plan[:plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert final.count("Scan parquet") == 1
    assert final.count("Exchange ") <= 2  # by game, by player
    final = executed(EV.neighbour_pattern(V.log(spark, SF))).split("== Initial Plan ==")[0]
    assert final.count("Scan parquet") == 1


def test_game_winners_of_a_hot_game(spark):
    """Cuts inside every game change neither the first crossing nor the final score."""
    log = V.pbp(spark, SF)
    plain = EV.first_crossing(EV.score_timeline(log, None), None)
    for size in (2, 9):
        cut = EV.first_crossing(EV.score_timeline(log, size), size)
        assert rows(cut) == rows(plain)
