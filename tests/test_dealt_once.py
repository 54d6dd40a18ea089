"""Bars of the scores are dealt out by symbol once; the latest predictions go through the ledger's windows alone."""
import re

import pytest
from pyspark.sql import Window, functions as F

from barloom import constants as K
from barloom.functions.rolling import series
from barloom.operators import features as W, joins as J, market as M
from barloom.sources.bindings import Tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    t = Tables(spark, SF)
    t.keep_bars()
    return t


def test_stored_bars_are_all_bars(spark, tables):
    rows = lambda df: sorted(map(str, df.select("symbol", "date", "close", "volume").collect()))
    assert rows(tables.bars) == rows(Tables(spark, SF).bars)


def test_parts_of_the_scores_take_no_exchange(tables):
    parts = [tables.latest_predictions, W.technical_score(tables.features), tables.reliability,
             M.trailing_volatility(tables.bars), M.data_gaps(tables.bars, "2001-12-31")]
    assert not [p for p in map(plan, parts) if "Exchange" in p]


def test_latest_predictions_are_the_last_of_the_ledger(spark):
    t = Tables(spark, SF)
    # histories of none, one, five to seven and many bars past the first five
    n = F.row_number().over(series())
    k = F.expr("cast(substring(symbol, 2) as int) % 9")
    t.bars = t.bars.withColumn("n", n).where((F.col("n") <= k + 3) | (k == 8)).drop("n")
    newest = F.max("run_date").over(Window.partitionBy("symbol"))
    want = t.ledger.withColumn("_newest", newest).where("run_date = _newest").drop("_newest")
    assert t.latest_predictions.columns == want.columns
    got = sorted(map(str, t.latest_predictions.collect()))
    assert got and got == sorted(map(str, want.collect()))
    # six bars a symbol are all that the wide windows see
    assert len(re.findall(r"\+- Window \[", plan(t.latest_predictions))) == len(re.findall(r"\+- Window \[", plan(want))) + 2


def test_recent_index_bars_are_the_last_index_bars(spark, tables):
    want = tables.index_bars.orderBy(F.desc("date")).limit(6).collect()
    assert len(want) == 6 and sorted(map(str, tables.recent_index_bars(6).collect())) == sorted(map(str, want))
    assert M.recent_return(tables.recent_index_bars(6)).collect() == M.recent_return(tables.index_bars).collect()


def test_a_single_horizon_is_not_unfolded(tables):
    first = tables.followed.withColumn("ahead", F.array(F.col("ahead")[K.HORIZONS.index(1)]))
    one = J.horizon_errors(first, (1,))
    assert "Generate" not in plan(one) and "Generate" in plan(tables.horizon_evaluation)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(one) == rows(tables.horizon_evaluation.where("horizon_days = 1")) != []
