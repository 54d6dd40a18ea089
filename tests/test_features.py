import math

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from barloom import constants as K
from barloom.functions import rolling as RL
from barloom.operators import features as W


def walk(n, seed=1):
    rng = np.random.default_rng(seed)
    return list(100 * np.exp(np.cumsum(rng.normal(0, 0.02, n))))


def to_pandas(df):
    return df.orderBy("date").toPandas()


def test_rolling_and_exponential_match_pandas(make_bars):
    """Longer than two blocks, so that totals are carried over block borders."""
    bars = make_bars(walk(1300))
    got = to_pandas(W.feature_frame(bars))
    c = got["close"]
    for n in (10, 20, 50):
        pd.testing.assert_series_equal(got[f"sma{n}"], c.rolling(n).mean(), check_names=False, rtol=1e-10)
    for n in (9, 20):
        pd.testing.assert_series_equal(got[f"ema{n}"], c.ewm(span=n, adjust=False).mean(), check_names=False, rtol=1e-11)
    line = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    np.testing.assert_allclose(got["macd"], line, atol=1e-9)
    np.testing.assert_allclose(got["macd_signal"], line.ewm(span=9, adjust=False).mean(), atol=1e-9)
    np.testing.assert_allclose(got["volatility20"][20:], c.pct_change().rolling(20).std()[20:], rtol=1e-8)
    np.testing.assert_allclose(got["bb_upper"][19:], (c.rolling(20).mean() + 2 * c.rolling(20).std())[19:], rtol=1e-8)
    obv = (np.sign(c.diff()).fillna(0) * got["volume"]).cumsum()
    np.testing.assert_allclose(got["obv"], obv)


def test_flat_and_rising_series(make_bars):
    flat = to_pandas(W.feature_frame(make_bars([50.0] * 60)))
    assert flat["rsi14"].iloc[-1] == 50.0 and flat["bb_position"].isna().all()
    assert (flat["volatility20"].dropna() == 0).all()
    up = to_pandas(W.feature_frame(make_bars([50.0 + i for i in range(60)])))
    assert up["rsi14"].iloc[-1] == 100.0 and up["rsi14"].iloc[:14].isna().all()


def test_zero_run_after_large_values_is_exactly_zero(spark, make_bars):
    bars = make_bars([1.0] * 700).withColumn("x", F.when(F.col("date") < "2025-01-01", F.lit(1e9) / 7).otherwise(0.0))
    out = RL.with_rolling(RL.positioned(bars), {"s": ("sum", "x", 14)}).orderBy("date").toPandas()
    assert (out["s"].iloc[-50:] == 0).all()


def test_supervised_rows_end_before_cutoff(make_bars):
    bars = make_bars(walk(220))
    cutoff = str(bars.orderBy(F.desc("date")).limit(30).agg(F.min("date")).first()[0])
    sup = W.supervised_frame(W.feature_frame(bars), cutoff)
    assert sup.count() > 0 and sup.where(F.col("date") >= cutoff).count() == 0
    assert W.leakage_audit(sup, cutoff, 1).first()["status"] == "PASS"
    assert W.leakage_audit(W.feature_frame(bars), cutoff, 1).first()["status"] == "FAIL"


def test_bars_after_the_cutoff_change_nothing(make_bars):
    closes = walk(200)
    cutoff = "2024-07-01"
    key = lambda df: [tuple(r) for r in df.orderBy("date").collect()]
    short = W.horizon_targets(make_bars(closes[:180]), cutoff, (1, 5))
    long = W.horizon_targets(make_bars(closes), cutoff, (1, 5))
    assert key(short) == key(long)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(1, 1000), min_size=60, max_size=90))
def test_scores_stay_in_range(make_bars, closes):
    out = W.technical_score(W.feature_frame(make_bars(closes))).collect()
    assert all(0 <= r["technical_score"] <= 100 for r in out)
    assert len(K.FEATURES) == 46 and not any(math.isnan(r["technical_score"]) for r in out)
