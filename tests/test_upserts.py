"""The last row of a key wins, without a sort where all columns have a fixed width."""
from decimal import Decimal

from pyspark.sql import functions as F

from barloom.operators import quality as Q
from barloom.operators.upserts import keep_last
from barloom.sources.bindings import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_both_ways_agree(spark):
    rows = [(k % 5, Decimal(k * 7 % 31) if k % 6 else None, float(k), k % 3 == 0) for k in range(60)] + [(9, None, 1.0, None)]
    fixed = spark.createDataFrame(rows, "k int, o decimal(20,0), x double, b boolean")
    other = fixed.withColumn("text", F.lit("t"))
    a, b = keep_last(fixed, ["k"], ["o"]), keep_last(other, ["k"], ["o"]).drop("text")
    assert "SortAggregate" not in plan(a) and "SortAggregate" in plan(b)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert a.columns == ["k", "o", "x", "b"] and a.where("k = 9").first()["x"] == 1.0


def test_raw_bars_are_cleaned_without_a_sort(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    for frame in (Q.clean_bars(t.bars_raw), Q.canonicalize(t.bars_raw, "1997-09-05")):
        assert "SortAggregate" not in plan(frame)


def test_selection_without_a_cap(spark):
    from barloom.operators.ranking import select_top
    rows = [(f"S{i}", "0-100" if i % 4 else "100-500", 89.0 - i, 70.0, 70.0, 80.0, "UP", 5.0, 5.0, 1.0, 70.0) for i in range(20)]
    scored = spark.createDataFrame(rows, "symbol string, price_bucket string, score double, confidence double, trade_confidence double, direction_return_alignment double, "
                                         "direction string, expected_return double, multi_horizon_expected_return double, prediction_uncertainty_pct double, direction_confidence double")
    everything = select_top(scored, n=None, per_bucket=None)
    assert everything.count() == 20 and everything.groupBy("price_bucket").agg(F.max("bucket_rank")).count() == 2
    assert [r.symbol for r in select_top(scored, n=3, per_bucket=None).collect()] == [r.symbol for r in everything.limit(3).collect()]
    assert select_top(scored, n=None, per_bucket=2).count() == 4
