"""Features on large prices and gaps, against pandas; forecasts keep their labels."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.rolling import positioned, with_rolling
from barloom.operators import features as W
from barloom.operators import forecasts as Y


def walk(n, level, seed=1, step=0.01):
    rng = np.random.default_rng(seed)
    return list(level + np.cumsum(rng.normal(0, step, n)))


@pytest.mark.parametrize("level", [1e2, 1e5, 1e6])
def test_deviation_of_large_prices(make_bars, level):
    got = W.with_bollinger(make_bars(walk(700, level))).orderBy("date").toPandas()
    sd = np.lib.stride_tricks.sliding_window_view(got["close"].to_numpy(), 20).std(axis=1, ddof=1)
    np.testing.assert_allclose(((got["bb_upper"] - got["bb_mid"]) / 2)[19:], sd, rtol=1e-6, atol=level * 1e-14)
    assert got["bb_position"][19:].notna().all()


def test_gaps_give_no_value(make_bars):
    bars = make_bars(walk(120, 100, step=1.0))
    day = [r[0] for r in bars.select("date").orderBy("date").collect()]
    bars = bars.withColumns({"volume": F.when(F.col("date") != day[50], F.col("volume")),
                             "close": F.when(F.col("date") == day[40], 0.0).otherwise(F.col("close"))})
    got = W.feature_frame(bars).orderBy("date").toPandas()
    mean = got["volume"].rolling(20).mean()
    want = (got["volume"] / mean).where(mean.notna())
    pd.testing.assert_series_equal(got["volume_ratio"], want, check_names=False)
    change = got["close"].pct_change(fill_method=None).replace([np.inf, -np.inf], np.nan)
    for n in (10, 20):
        pd.testing.assert_series_equal(got[f"volatility{n}"], change.rolling(n).std(), check_names=False, rtol=1e-9)


def test_long_windows_and_spans(make_bars):
    bars = positioned(make_bars(walk(600, 100)))
    got = with_rolling(bars, {"m": ("avg", "close", 512)}).orderBy("date").toPandas()
    np.testing.assert_allclose(got["m"][511:], got["close"].rolling(512).mean()[511:])
    with pytest.raises(ValueError, match="600"):
        with_rolling(bars, {"m": ("avg", "close", 600)})
    with pytest.raises(ValueError, match="200"):
        with_rolling(bars, emas={"e": ("close", 200)})


def panel(spark, sessions, symbols=3):
    """Closes whose next change follows the volume ratio, and volumes that often fall by more than nine tenths."""
    rng = np.random.default_rng(2)
    rows = []
    for s in range(symbols):
        close, days = 100.0, pd.bdate_range("2023-01-02", periods=sessions)
        volume = np.where(rng.random(sessions) < 0.3, 50.0, 1000.0)
        for d, v in zip(days, volume):
            rows.append((f"S{s}", d.date(), close * 0.999, close * 1.01, close * 0.99, close, float(v)))
            close *= 1.02 if v < 100 else 0.995
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_volume_labels_are_whole_and_fits_beat_the_mean(spark):
    frame = Y.design(Y.with_price_targets(W.feature_frame(panel(spark, 190)))).cache()
    assert frame.agg(F.min("t_volume")).first()[0] < -2.5
    fit = Y.fit_ensemble(frame, "t_close", sizes=Y.QUICK)
    assert abs(sum(fit.weights.values()) - 1) < 1e-9
    mean = frame.agg(F.avg("t_close")).first()[0]
    got = fit.predict(frame, "p").agg(F.avg(F.abs(F.col("p") - F.col("t_close"))), F.avg(F.abs(F.col("t_close") - F.lit(mean)))).first()
    assert got[0] < 0.6 * got[1]
    error = spark.range(1).select(Y.implied_error(F.lit(100.0), F.log1p(F.lit(9.0)) - F.log1p(F.lit(100.0)), F.lit(0.0), True)).first()[0]
    assert abs(error - 100 * 91 / 9) < 1e-9


def test_next_session_status(spark):
    short = Y.next_session_forecast(W.feature_frame(panel(spark, 120)), "2030-01-01", sizes=Y.QUICK).collect()
    assert len(short) == 3 and all(r.status == "INSUFFICIENT_DATA" and r.pred_close is None for r in short)
    full = Y.next_session_forecast(W.feature_frame(panel(spark, 230)), "2030-01-01", sizes=Y.QUICK).collect()
    assert all(r.status == "VALID" and r.pred_low <= min(r.pred_open, r.pred_close) and r.pred_high >= max(r.pred_open, r.pred_close) for r in full)
    assert short[0].__fields__ == full[0].__fields__


def test_audit_sees_labels_beyond_the_cutoff(make_bars):
    features = W.feature_frame(make_bars(walk(200, 100, step=1.0)))
    cutoff = features.orderBy(F.desc("date")).select("date").collect()[20][0]
    frame = W.supervised_frame(features, cutoff)
    assert W.leakage_audit(frame, cutoff, 5, panel=features).first().asDict()["target_leak_rows"] == 5
    assert W.leakage_audit(W.purged(frame, cutoff, 5, features), cutoff, 5, panel=features).first()["status"] == "PASS"


def test_registered_forecasts_use_full_sizes(monkeypatch):
    from types import SimpleNamespace
    from barloom.plans import model_queries as Q
    seen = []

    class Stop(Exception):
        pass

    def stop(*args, sizes=Y.VARIANTS, **kwargs):
        seen.append(sizes)
        raise Stop

    for name in ("fit_ensemble", "direction_forecast", "next_session_forecast", "multi_horizon_forecast"):
        monkeypatch.setattr(Y, name, stop)
    monkeypatch.setattr(Y, "latest_rows", lambda frame: frame)
    frame = SimpleNamespace(select=lambda *c: None)
    monkeypatch.setattr(Q, "_frame", lambda t: frame)
    monkeypatch.setattr("barloom.plans.registry.Tables", lambda *a: SimpleNamespace(features=None))
    from barloom.plans.catalog import QUERIES
    for name in ("ensemble", "direction", "volume", "next_session", "multi_horizon"):
        with pytest.raises(Stop):
            QUERIES[f"{name}_forecast"](None, None)
    assert seen == [Y.VARIANTS] * 5
    assert Y.VARIANTS == {"A": (250, 5, 220, 12, 14), "B": (350, 4, 300, 15, 18)}


def test_errors_are_pooled_over_the_walk_forward_folds(spark):
    frame = Y.design(Y.with_price_targets(W.feature_frame(panel(spark, 190)))).cache()
    data = frame.where("t_close is not null")
    days = [r[0] for r in data.select("date").distinct().orderBy("date").collect()]
    folds = Y.fold_dates(data)
    step = (len(days) - 46) // 3
    assert folds == [(days[43 + k * step], days[45 + k * step], days[44 + (k + 1) * step]) for k in (1, 2)]  # the embargo leaves the first fold too few dates
    assert Y.fit_ensemble(frame, "t_close", sizes=Y.QUICK).samples == 3 * step * 2
    held = Y.fit_ensemble(frame, "t_close", sizes=Y.QUICK, purged=True)
    assert held.samples == 3 * (len(days) - int(len(days) * 0.8))
