import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.sources import barstore as B, ledgers as L
from barloom.streaming import bars as ST


def test_scan_symbol_files(spark, scratch):
    open(f"{scratch}/aaa.NS.csv", "w").write("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,1,1.5,10\n")
    open(f"{scratch}/BBB.csv", "w").write("Date,Open,High,Low,Close,Volume\n2024-01-03,1,2,1,2.5,10\n")
    got = {(r["symbol"], r["close"]) for r in B.scan_symbol_files(spark, scratch).collect()}
    assert got == {("AAA", 1.5), ("BBB", 2.5)}


def test_store_upsert_and_pruning(spark, scratch, make_bars):
    path = f"{scratch}/bars"
    B.upsert_bars(spark, path, make_bars([10.0] * 40))
    B.upsert_bars(spark, path, make_bars([20.0] * 5, first="2024-01-29"))        # meets stored dates: replaced
    B.upsert_bars(spark, path, make_bars([30.0] * 3, first="2024-06-03"))        # later month: appended
    B.upsert_bars(spark, path, make_bars([7.0] * 2, symbol="BBB", first="2024-01-02"))
    store = spark.read.parquet(path)
    assert store.count() == 45 and store.dropDuplicates(["symbol", "date"]).count() == 45
    assert store.where("close = 20").count() == 5 and store.where("close = 30").count() == 3
    scan = B.range_scan(store, "2024-01-10", "2024-01-31")
    plan = scan._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(ym" in plan and "PushedFilters: [IsNotNull(date)" in plan
    assert scan.where("symbol = 'AAA'").count() == 16


def test_periods(spark):
    day = lambda p: str(spark.range(1).select(B.lookback_start("2024-03-31", p)).first()[0])
    assert (day("1y"), day("1mo"), day("10d"), day("odd")) == ("2023-03-31", "2024-02-29", "2024-03-21", "2019-03-31")


def ledger(spark, n=3, high=12.0, suffix=""):
    rows = [(f"S{i}", f"id{i}{suffix}", "B1", 10.0, high, 9.0, 11.0) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, prediction_id string, price_bucket string, pred_open double, pred_high double, pred_low double, pred_close double")


def test_ledger_is_write_once(spark, scratch):
    assert L.write_ledger_once(spark, scratch + "/l", ledger(spark), "2024-01-02") == "WRITTEN"
    assert L.write_ledger_once(spark, scratch + "/l", ledger(spark), "2024-01-02") == "UNCHANGED"
    with pytest.raises(ValueError, match="immutable"):
        L.write_ledger_once(spark, scratch + "/l", ledger(spark, suffix="x"), "2024-01-02")
    with pytest.raises(ValueError, match="checks"):
        L.write_ledger_once(spark, scratch + "/l", ledger(spark, high=10.5), "2024-01-03")
    with pytest.raises(ValueError, match="checks"):
        L.write_ledger_once(spark, scratch + "/l", ledger(spark, n=7), "2024-01-03")


def test_evaluation_is_bound_to_the_ledger(spark, scratch):
    day = dt.date(2024, 1, 2)
    led = ledger(spark).withColumn("run_date", F.lit(day))
    ev = spark.createDataFrame([(f"S{i}", day, day, 1.0) for i in range(3)], "symbol string, prediction_date date, market_date date, ape_close double")
    with pytest.raises(ValueError, match="does not match"):
        L.write_evaluation_once(spark, scratch + "/e", ev.where("symbol <> 'S1'"), led, "2024-01-02")
    with pytest.raises(ValueError, match="after the market date"):
        L.write_evaluation_once(spark, scratch + "/e", ev, led, "2024-01-01")
    assert L.write_evaluation_once(spark, scratch + "/e", ev, led, "2024-01-02") == "WRITTEN"
    assert L.write_evaluation_once(spark, scratch + "/e", ev, led, "2024-01-02") == "UNCHANGED"
    assert spark.read.parquet(scratch + "/e").where("prediction_id = 'id2'").count() == 1


EV = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def feed(spark, path, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EV).coalesce(1).write.mode("append").parquet(path)
    return spark.createDataFrame([], EV).schema


def at(h, m):
    return dt.datetime(2024, 1, 1, h, m)


def test_stream_upsert_replaces_repeats(spark, scratch):
    schema = feed(spark, scratch + "/in", [(1, at(9, 0), 1, "a", 1.0), (2, at(9, 1), 1, "b", 5.0)], [(3, at(9, 2), 1, "a", 2.0)], [(4, at(9, 3), 1, "a", 9.0)])
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(scratch + "/in").select("event_type", "event_id", "value")
    path = ST.upsert_stream(rows, ["event_type"], scratch + "/out", scratch + "/cp")
    assert {r["event_type"]: r["value"] for r in spark.read.parquet(path).collect()} == {"a": 9.0, "b": 5.0}


def test_stream_writes_a_date_once(spark, scratch):
    schema = feed(spark, scratch + "/in", [(1, at(9, 0), 1, "a", 1.0)])
    def run():
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(scratch + "/in").select(F.to_date("ts").alias("d"), "value")
        ST.write_dates_once(rows, "d", scratch + "/out", scratch + "/cp")
        return spark.read.parquet(scratch + "/out/batch=*").count()
    assert run() == 1
    feed(spark, scratch + "/in", [(2, at(10, 0), 1, "a", 2.0)])
    assert run() == 1


def test_stream_upsert_keeps_the_largest_order_over_batches(spark, scratch):
    schema = feed(spark, scratch + "/in", [(7, at(9, 0), 1, "a", 7.0), (1, at(9, 1), 1, "b", 1.0)], [(3, at(9, 2), 1, "a", 3.0)], [(9, at(9, 3), 1, "b", 9.0)], [(5, at(9, 3), 1, "b", 5.0)])
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(scratch + "/in").select("event_type", "event_id", "value")
    path = ST.upsert_stream(rows, ["event_type"], scratch + "/out", scratch + "/cp")
    assert {r["event_type"]: (r["event_id"], r["value"]) for r in spark.read.parquet(path).collect()} == {"a": (7, 7.0), "b": (9, 9.0)}


@pytest.mark.parametrize("late_days", [None, 0])
def test_stream_writes_a_split_date_whole(spark, scratch, late_days):
    schema = feed(spark, scratch + "/in", [(1, at(9, 0), 1, "a", 1.0)], [(2, at(10, 0), 1, "a", 2.0)])
    def run():
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(scratch + "/in").select(F.to_date("ts").alias("d"), "value")
        ST.write_dates_once(rows, "d", scratch + "/out", scratch + "/cp", late_days)
        n = ST._written(spark, scratch + "/out")
        return sorted(r["value"] for i in n for r in spark.read.parquet(f"{scratch}/out/batch={i}").collect())
    assert run() == ([1.0, 2.0] if late_days is None else [])
    feed(spark, scratch + "/in", [(3, at(11, 0), 1, "a", 3.0)], [(4, at(9, 0) + dt.timedelta(1), 1, "a", 4.0)])
    assert run() == ([1.0, 2.0, 4.0] if late_days is None else [1.0, 2.0, 3.0])
    assert run() == ([1.0, 2.0, 4.0] if late_days is None else [1.0, 2.0, 3.0])
    feed(spark, scratch + "/in", [(5, at(12, 0), 1, "a", 5.0), (6, at(9, 0) + dt.timedelta(2), 1, "a", 6.0)])
    assert run() == ([1.0, 2.0, 4.0, 6.0] if late_days is None else [1.0, 2.0, 3.0, 4.0])


def test_stream_bars_close_with_the_watermark(spark, scratch):
    schema = feed(spark, scratch + "/in", [(1, at(9, 0), 1, "a", 1.0), (2, at(9, 10), 1, "a", 5.0), (3, at(9, 50), 1, "a", 2.0)])
    ST.stream_bars(ST.event_stream(spark, scratch + "/in", "*.parquet", schema), scratch + "/out", scratch + "/cp")
    got = [(r["open"], r["close"], r["volume"]) for r in spark.read.parquet(scratch + "/out").collect()]
    assert got == [(2.0, 6.0, 2.0)]
