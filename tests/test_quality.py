import datetime as dt

from pyspark.sql import functions as F

from barloom.functions import scalars as S
from barloom.operators import quality as Q, upserts as U
from tests.conftest import SCHEMA, sessions


def bars(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def good(n=35, symbol="AAA"):
    return [(symbol, d, 100.0, 102.0, 98.0, 101.0, 1000.0) for d in sessions(n, "2026-07-01")]


def errors(spark, rows, cutoff, symbols=("AAA",)):
    uni = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    return {r["symbol"]: r["errors"] for r in Q.validate_bars(bars(spark, rows), uni, cutoff).collect()}


def test_validation_codes(spark):
    rows = good()
    last = rows[-1][1]
    assert errors(spark, rows, str(last)) == {"AAA": []}
    assert "FUTURE_DATA" in errors(spark, rows, str(rows[-2][1]))["AAA"]
    assert errors(spark, rows + rows[:1], str(last))["AAA"] == ["DUPLICATE_DATE_INDEX"]
    broken = rows[:-1] + [("AAA", last, 100.0, 99.0, 98.0, 101.0, -1.0)]
    assert errors(spark, broken, str(last))["AAA"] == ["NEGATIVE_VOLUME", "HIGH_LT_OPEN_CLOSE"]
    assert errors(spark, rows, str(last), ("AAA", "ZZZ"))["ZZZ"] == ["EMPTY_DATA"]
    assert errors(spark, rows[:5], str(rows[4][1]))["AAA"] == ["TOO_FEW_ROWS:5"]
    assert "NON_TRADING_DAY_CUTOFF" in errors(spark, rows, "2026-12-26")["AAA"]


def test_bucket_edges(spark):
    edges = [9.99, 10.0, 49.99, 50.0, 100.0, 250.0, 500.0, 1000.0, 2499.99, 2500.0, None, float("nan")]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(edges)], "i int, p double")
    got = [tuple(r) for r in df.orderBy("i").select(S.price_bucket("p"), S.price_bucket_code("p")).collect()]
    assert got == [("<10", "B0"), ("10-49", "B7"), ("10-49", "B7"), ("50-99", "B6"), ("100-249", "B5"), ("250-499", "B4"),
                   ("500-999", "B3"), ("1000-2499", "B2"), ("1000-2499", "B2"), (">2500", "B1"), ("-", "OUT"), ("-", "OUT")]


def test_clean_keeps_last_and_drops_broken(spark):
    raw = spark.createDataFrame([
        ("A", dt.datetime(2026, 9, 3, 10), "1", "2", "1", "1", "5", 1), ("A", dt.datetime(2026, 9, 3, 12), "1", "3", "1", "2", "5", 2),
        ("A", dt.datetime(2026, 9, 4), "x", "2", "1", "1", "5", 3), ("A", dt.datetime(2026, 9, 7), "1", "Infinity", "1", "1", "5", 4)],
        "symbol string, ts timestamp, open string, high string, low string, close string, volume string, seq int")
    out = Q.clean_bars(raw).collect()
    assert len(out) == 1 and out[0]["close"] == 2.0
    assert Q.canonicalize(raw, "2026-09-04").count() == 2


def test_next_session_skips_weekend_and_holiday(spark):
    cal = Q.trading_calendar(spark, "2026-09-01", "2026-09-30", ("2026-09-14",))
    df = spark.createDataFrame([("2026-09-11",), ("2026-09-12",)], "d string").select(F.to_date("d").alias("d"))
    got = {str(r["d"]): str(r["target_date"]) for r in Q.next_sessions(df, "d", F.lit(1), cal).collect()}
    assert got == {"2026-09-11": "2026-09-15", "2026-09-12": "2026-09-15"}


def test_weekday_arithmetic(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-01-07", 5), ("2024-01-06", "2024-01-07", 0), ("2024-01-05", "2024-01-08", 2),
                                ("1969-12-29", "1970-01-02", 5)], "a string, b string, n int")
    rows = df.select(S.weekdays_between(F.to_date("a"), F.to_date("b")).alias("got"), "n").collect()
    assert all(r["got"] == r["n"] for r in rows)


def test_upsert_never_reopens_a_closed_outcome(spark):
    old = spark.createDataFrame([("p1", "WIN"), ("p2", "OPEN")], "id string, outcome string")
    new = spark.createDataFrame([("p1", "OPEN"), ("p2", "LOSS"), ("p3", "OPEN")], "id string, outcome string")
    got = dict(U.upsert(old, new, ["id"], protect=F.col("outcome") != "OPEN").collect())
    assert got == {"p1": "WIN", "p2": "LOSS", "p3": "OPEN"}


def test_frame_errors(spark):
    df = spark.createDataFrame([("a", 10.0, 9.0, 8.0, 11.0), ("A ", 1.0, 2.0, 1.0, None)],
                               "symbol string, pred_open double, pred_high double, pred_low double, pred_close double")
    got = Q.validate_predictions(df, 1).first()["errors"]
    assert got == ["DUPLICATE_SYMBOLS", "INVALID:pred_close", "PRED_HIGH_INVALID", "TOP_N_EXCEEDED:2>1"]
    assert Q.validate_predictions(df.limit(0)).first()["errors"] == ["EMPTY_PREDICTIONS"]
