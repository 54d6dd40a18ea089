"""Rolling features take few window operators, and gaps, runs of zeros and block borders do not change them."""
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.functions import rolling as RL
from barloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_features_take_five_window_operators(spark):
    plan = QUERIES["feature_frame"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\+- Window \[", plan)) == 5


def test_gaps_zeros_and_blocks_match_pandas(make_bars):
    day = make_bars([1.0] * 1300)
    n = F.datediff("date", F.lit("2024-01-01").cast("date"))
    x = F.when(n % 97 == 0, None).when(n.between(700, 760), 0.0).otherwise(1 / (1 + n % 13))
    bars = RL.positioned(day.withColumn("x", F.when(~n.between(1000, 1100), x)))
    lag = F.lag("x", 3).over(RL.in_order())
    got = RL.with_rolling(bars, {"s": ("sum", "x", 14), "a": ("avg", "x", 30), "d": ("std", "x", 20)}, also={"l": lag}).orderBy("date").toPandas()
    assert got["x"].isna().sum() > 80 and [c for c in got.columns if c.startswith("_")] == list(RL.MARKS)
    for name, want in {"s": got["x"].rolling(14).sum(), "a": got["x"].rolling(30).mean(), "d": got["x"].rolling(20).std(), "l": got["x"].shift(3)}.items():
        pd.testing.assert_series_equal(got[name].isna(), want.isna(), check_names=False)
        np.testing.assert_allclose(got[name], want, rtol=1e-9, atol=1e-12)
    zeros = (got["x"] == 0).rolling(14).sum() == 14
    assert zeros.any() and (got["s"][zeros] == 0).all()
