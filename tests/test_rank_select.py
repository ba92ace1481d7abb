"""Top-n by threshold, percentile ranks over cut partitions and exact selection."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from courtstats.operators import rank as R
from courtstats.operators.aggregate import exact_median, leave_one_out_median, order_statistics

SF = "/root/testdata/sf0.001"


def rows(df, cols=None):
    df = df.select(*(cols or df.columns))
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_top_n_whose_nth_value_half_the_rows_share(spark):
    d = spark.range(0, 20000, 1, 8).select("id", (F.col("id") % 2).alias("v"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("w"))
    top = R.top_n(d, "v", 3)
    assert top.count() == 10000 and top.columns == d.columns
    plan = executed(top)
    assert "BroadcastHashJoin" in plan and "SinglePartition" not in plan.replace("TakeOrderedAndProject", "")
    got = R.top_n(d, ["v", "w"], 4, descending=[False, True], rank_col="place")
    want = d.filter("v = 0 and w = 2").count()
    assert got.count() == want and {r.place for r in got.collect()} == {1}
    mixed = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 4.0), (4, 4.0), (5, 3.0), (6, None), (7, float("nan"))], "i int, x double")
    assert rows(R.top_n(mixed, "x", 3, rank_col="r"), ["i", "r"]) == [(1, 1), (2, 1), (3, 3), (4, 3)]
    assert rows(R.top_n(mixed, F.col("x") * 2, 1, descending=False), ["i"]) == [(5,)]
    assert R.top_n(mixed.limit(0), "x", 3).count() == 0


def test_top_n_reads_an_aggregate_once(spark):
    """Both readers share the exchange of the aggregate below."""
    from courtstats.sources.tables import table

    g = table(spark, SF, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.sum("o_totalprice").alias("s"), F.max("o_orderdate").alias("last"))
    plan = executed(R.top_n(g, "n", 5))
    assert plan.count("Scan parquet") == 1 or "ReusedExchange" in plan or "QueryStage" in plan and plan.count("FileScan parquet") <= 1


def brute_ranks(data, g, v):
    own = [x for h, _, x in data if h == g and x is not None]
    return 1 + sum(x < v for x in own), own.count(v), len(own)


@pytest.mark.parametrize("partition", ["g", None])
def test_ranks_of_cut_partitions_and_heavy_values(spark, partition):
    """A hot partition, a value that half of its rows share, missing values, repeated rows."""
    random.seed(8)
    data = [(random.choice(["hot", "hot", "hot", "b", None]), i // 2, random.choice([0.0, 0.0, None, float(random.randint(-9, 9)), random.random()]))
            for i in range(700)]
    d = spark.createDataFrame(data, "g string, i int, x double").withColumn("y", -F.col("x")).repartition(4).cache()
    plain = R.pct_rank(R.pct_rank(d, ["x", "y"], partition=partition, chunk_size=None), "x", "min", partition, True, "_m", None)
    for size in (1, 20, 150):
        cuts = R.rank_cuts(d, ["x"], partition, size)["x"]
        assert cuts.cuts.bounds and cuts.heavy
        got = R.pct_rank(R.pct_rank(d, ["x", "y"], partition=partition, chunk_size=size), "x", "min", partition, True, "_m", size)
        assert got.columns == plain.columns and rows(got) == rows(plain), size
    for r in plain.distinct().collect():
        if r.x is None:
            assert r.x_pct_rank is None and r.x_m is None
        else:
            lo, same, n = brute_ranks([(g if partition else 1, i, x) for g, i, x in data], r.g if partition else 1, r.x)
            assert r.x_pct_rank == pytest.approx((lo + (same - 1) / 2) / n)
            assert r.x_m == pytest.approx((n - lo - same + 2) / n)


def test_percent_rank_of_cut_partitions(spark):
    d = spark.range(500).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 7 > 0, F.col("id") % 50).alias("x"))
    d = d.unionByName(spark.createDataFrame([(9, 5), (8, None)], "g long, x long"))
    plain = rows(R.percent_rank_ignore_null(d, "x", "p", "g", chunk_size=None))
    assert rows(R.percent_rank_ignore_null(d, "x", "p", "g", chunk_size=30)) == plain
    assert (9, 5, 0.0) in plain and (8, None, None) in plain


def test_composite_is_one_exchange_by_partition(spark):
    d = spark.range(300).select((F.col("id") % 3).alias("g"), *[(F.col("id") * k % 17).cast("double").alias(f"c{k}") for k in (1, 2, 3, 5)])
    plan = executed(R.pct_rank(d, ["c1", "c2", "c3", "c5"], partition="g"))
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("size", [None, 1, 25])
def test_exact_selection(spark, size):
    random.seed(3)
    data = [(random.choice(["hot", "hot", "a", None]), random.choice([1.0, 2.0, 2.0, random.random(), None, float("nan")]), random.randint(0, 4), i)
            for i in range(400)] + [("one", 4.0, 1, 900), ("two", 4.0, 1, 901), ("two", 9.0, 3, 902), ("none", None, 1, 903)]
    d = spark.createDataFrame(data, "g string, x double, b int, i int")
    groups = {}
    for g, x, b, i in data:
        groups.setdefault(g, []).append((x if x == x else None, b, i))
    got = {r.g: r.median for r in exact_median(d, "g", "x", chunk_size=size).collect()}
    want = {g: statistics.median([x for x, _, _ in v if x is not None]) for g, v in groups.items() if any(x is not None for x, _, _ in v)}
    assert got == pytest.approx(want)
    third = {r.g: (r.a, r.b) for r in order_statistics(d, "g", "x", {"a": F.lit(3), "b": F.col("_n")}, size).collect()}
    for g, v in groups.items():
        x = sorted(x for x, _, _ in v if x is not None)
        if x:
            assert third[g] == (x[2] if len(x) > 2 else None, x[-1])
    for extreme, pick in (("max", max), ("min", min)):
        got = {r.g: r.median_wo for r in leave_one_out_median(d, "g", "b", "x", extreme, ["i"], chunk_size=size).collect()}
        for g, v in groups.items():
            out = pick(v, key=lambda r: (r[1], r[2]))
            rest = [x for x, b, i in v if x is not None and i != out[2]]
            if g in got:
                assert got[g] == (pytest.approx(statistics.median(rest)) if rest else None), (g, extreme)
