"""The roll-up of horizons inside a row: same values as by groups, nothing dealt out again."""
from pyspark.sql import functions as F

from barloom import constants as K
from barloom.functions import scalars as S, scoring as D
from barloom.plans.catalog import QUERIES


def rows(df):
    return sorted(map(str, S.rounded(df).collect()))


def test_rollup_takes_the_exchanges_of_the_ledger_only(spark):
    plan = QUERIES["horizon_rollup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_rollup_of_a_row_equals_that_of_a_group(spark):
    rows_ = [("a", *range(1, 11)), ("b", None, -2, 3, None, 5, -6, None, 8, None, None), ("c", *[None] * 10), ("d", None, *[None] * 8, -4),
             ("e", 0, -1, 1, 2, None, 3, 4, None, None, 7)]
    rows_ = [(r[0], *[None if v is None else float(v) for v in r[1:]]) for r in rows_]
    wide = spark.createDataFrame(rows_, "id string, " + ", ".join(f"horizon_{h}d double" for h in K.HORIZONS))
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon_days"), F.col(f"horizon_{h}d").alias("expected_return")) for h in K.HORIZONS])
    names = ["id", "short_median", "medium_median", "long_median", "primary_return", "agreement_pct"]
    want = D.horizon_rollup(wide.select("id", F.inline(pairs)), "id").select(*names)
    assert rows(D.horizon_rollup_row(wide).select(*names)) == rows(want)
