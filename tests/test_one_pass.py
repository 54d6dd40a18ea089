"""Results that follow a prediction through its own series take one pass over it: no join, no copies per horizon."""
import re

import pytest

from barloom.functions import scalars as S
from barloom.operators import joins as J
from barloom.plans.catalog import QUERIES
from barloom.sources.bindings import Tables

SF = "/root/testdata/sf0.001"


def operators(df):
    return re.findall(r"\b(\w+Join|Exchange|Generate|Scan parquet)\b", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture(scope="module")
def tables(spark):
    t = Tables(spark, SF)
    t.keep_bars()
    return t


def rows(df):
    names = sorted(df.columns)
    return sorted(map(str, S.rounded(df.select(*names)).collect()))


def test_what_follows_a_prediction_equals_the_joins(tables):
    assert rows(tables.evaluation) == rows(J.evaluate_predictions(tables.ledger, tables.bars))
    whole = rows(J.evaluate_horizons(tables.ledger, tables.bars, base="cutoff_date"))
    assert whole and rows(tables.horizon_evaluation) == whole


@pytest.mark.parametrize("name", ["horizon_offset_join", "horizon_reliability"])
def test_bars_are_folded_and_dealt_once(spark, name):
    plan = operators(QUERIES[name](spark, SF))
    assert plan.count("Exchange") == 2 and not [p for p in plan if p.endswith("Join")]


def test_scores_fold_the_raw_rows_once(spark):
    t = Tables(spark, SF)
    t.decided
    assert "lineitem" not in " ".join(t.bars.inputFiles()) and "lineitem" not in " ".join(t.candidates.inputFiles())
