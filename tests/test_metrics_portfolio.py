import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.functions import scalars as S
from barloom.operators import joins as J, market as M, metrics as A, models as MD, portfolio as P, quality as Q
from tests.conftest import sessions


def evaluation(spark, apes, confidence=90.0):
    rows = [(f"p{i}", d, "AAA", float(a), confidence, True) for i, (d, a) in enumerate(zip(sessions(len(apes)), apes))]
    return spark.createDataFrame(rows, "prediction_id string, market_date date, symbol string, ape_close double, prediction_confidence double, direction_correct boolean")


def test_calibration_and_drift(spark):
    c = A.calibration(evaluation(spark, [25.0] * 4)).first()
    assert c["calibration"] == "LOW EVIDENCE" and abs(c["ece"] - 15) < 1e-9
    d = A.error_drift(evaluation(spark, [1.0] * 5 + [2.0] * 5)).first()
    assert d["drift"] == "HIGH" and d["drift_ratio"] == pytest.approx(1.0)
    assert A.error_drift(evaluation(spark, [1.0, 2.0])).first()["drift"] == "UNKNOWN"


def test_horizon_accuracy(spark):
    df = spark.createDataFrame([(365, 5.0, True), (365, -10.0, False)], "horizon_days bigint, ape double, direction_correct boolean")
    r = A.accuracy_by(df, ["horizon_days"]).first()
    assert r["mape_accuracy"] == 92.5 and r["samples"] == 2 and r["direction_accuracy"] == 50.0


def test_permutation_is_stable_and_bounded(spark):
    rows = [(i, 3.0 + (i % 5) / 10, 2.0 + (i % 3) / 10) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    p = [MD.paired_permutation(x, "k", "a", "b").first()["p_value"] for x in (df, df.repartition(7))]
    assert p[0] == p[1] and 0 < p[0] <= 0.1
    assert MD.paired_permutation(df.limit(3), "k", "a", "b").first()["p_value"] is None
    assert MD.paired_permutation(df, "k", "b", "a").first()["p_value"] == 1.0


def plan_row(spark, conf, **h):
    base = {f"horizon_{k}d": None for k in (1, 3, 5, 7, 10, 20, 60, 90, 180, 365)}
    base.update(h)
    cols = ", ".join(f"{k} double" for k in base)
    return spark.createDataFrame([(500.0, conf, dt.date(2026, 9, 11), *base.values())], f"average_price double, ai_confidence double, prediction_date date, {cols}")


def test_sell_plan(spark):
    cal = Q.trading_calendar(spark, "2026-01-01", "2027-12-31", ("2026-09-14",))
    plan = lambda conf, **h: P.with_sell_plan(plan_row(spark, conf, **h), cal).first()
    r = plan(80.0, horizon_1d=18.0)
    assert r["sell_target_price"] == pytest.approx(590) and str(r["sell_date"]) == "2026-09-15" and r["sell_status"] == "TARGET_DATE"
    assert plan(40.0, horizon_1d=18.0)["sell_target_price"] == pytest.approx(550)
    w = plan(80.0, horizon_1d=3.0)
    assert w["sell_status"] == "WAIT" and w["sell_date"] is None


def test_position_decisions(spark):
    df = plan_row(spark, 80.0, horizon_60d=12.0, horizon_90d=15.0)
    from barloom.functions.scoring import horizon_values
    ask = lambda price, target, strict=False: df.select(P.position_decision(F.lit(price), "average_price", F.lit(target).cast("double"), "ai_confidence", horizon_values(), strict).alias("d")).first()["d"]["decision"]
    assert ask(550.0, 500.0) == "SELL" and ask(480.0, 560.0) == "HOLD" and ask(480.0, 400.0) == "REDUCE" and ask(480.0, None) == "HOLD"


def test_target_confirmation(spark):
    conf = lambda **h: P.confirm_target(plan_row(spark, 80.0, **h)).first()
    r = conf(horizon_60d=18.0, horizon_90d=21.0, horizon_180d=19.0, horizon_365d=20.0)
    assert r["target_status"] == "MULTI_HORIZON_CONFIRMED" and r["target_pct"] >= 18
    r = conf(horizon_60d=21.0, horizon_90d=7.0, horizon_180d=4.0, horizon_365d=3.0)
    assert r["target_status"] == "SINGLE_HORIZON_OR_INCONSISTENT" and r["target_pct"] == 10.0
    assert conf()["target_status"] == "NO_LONG_HORIZON_EVIDENCE"


def test_regime_of_trends(make_bars):
    up = [100 + 80 * i / 259 for i in range(260)]
    name = lambda closes: M.market_regime(make_bars(closes)).first()["regime"]
    assert name(up) == "BULL" and name(up[::-1]) == "BEAR" and name(up[:40]) == "SIDEWAYS"


def test_asof_join_strict_and_not(spark, make_bars):
    bars = make_bars([10.0, 11.0, 12.0], first="2024-01-01")
    left = spark.createDataFrame([("AAA", "2024-01-02"), ("AAA", "2024-01-06"), ("AAA", "2023-12-01"), ("BBB", "2024-01-02")], "symbol string, t string")
    left = left.select("symbol", F.to_date("t").alias("t"))
    got = lambda strict: {(r["symbol"], str(r["t"])): r["asof_close"] for r in J.asof_join(left, bars, "symbol", "t", "date", ["close"], strict).collect()}
    assert got(False) == {("AAA", "2024-01-02"): 11.0, ("AAA", "2024-01-06"): 12.0, ("AAA", "2023-12-01"): None, ("BBB", "2024-01-02"): None}
    assert got(True)[("AAA", "2024-01-02")] == 10.0


def test_jump_hit(spark, make_bars):
    bars = make_bars([100.0, 101.0, 99.0, 108.0, 90.0])
    t = spark.createDataFrame([("AAA", dt.date(2024, 1, 1), 100.0, 105.0)], "symbol string, prediction_date date, current_price double, target_level double")
    r = J.evaluate_jumps(t, bars).first()
    assert r["hit"] and r["days_to_hit"] == 3 and r["observation_days"] == 4


def test_ids_and_downside(spark):
    r = spark.range(1).select(S.prediction_id(F.lit("2026-09-09"), F.lit("PFC"), F.lit("2026-09-08"), F.lit("v1")).alias("a"),
                              S.downside_probability(F.lit(0.8528), F.lit(1.7103), raw=True).alias("raw"), S.downside_probability(F.lit(0.8528), F.lit(1.7103)).alias("d")).first()
    assert len(r["a"]) == 17 and r["a"].startswith("P")
    assert r["raw"] == pytest.approx(84.13, abs=0.01) and r["d"] == pytest.approx(100 - r["raw"])
