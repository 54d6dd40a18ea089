"""Windows over bars are dealt out in proportion to the source; labels take no further sort, scan or join."""
import re

import pytest
from pyspark.sql import functions as F

from barloom.operators import features as W
from barloom.plans.catalog import QUERIES
from barloom.sources import bindings as B

SF = "/root/testdata/sf0.001"


def operators(df):
    return re.findall(r"\b(\w+Join|Exchange|Sort|FileScan parquet)\b", df._jdf.queryExecution().executedPlan().toString())


def test_partitions_grow_with_the_source(spark, monkeypatch):
    whole = B.Tables(spark, SF)
    rows = whole.raw("lineitem").count()
    monkeypatch.setattr(B, "TASK_ROWS", rows // 40)
    assert B.Tables(spark, SF).features.rdd.getNumPartitions() >= 40
    assert sorted(map(str, whole.features.collect())) == sorted(map(str, B.Tables(spark, SF).features.collect()))


@pytest.mark.parametrize("name", ["leakage_audit", "leakage_audit_unpurged", "supervised_frame"])
def test_labels_come_with_the_features(spark, name):
    plan = operators(QUERIES[name](spark, SF))
    assert plan.count("FileScan parquet") == 1 and plan.count("Sort") == 2 and not [p for p in plan if p.endswith("Join")]


def test_labels_made_before_equal_those_of_the_features(spark):
    t = B.Tables(spark, SF)
    names = W.supervised_frame(t.features, "1999-06-01").columns
    rows = lambda df: sorted(map(str, df.select(*names).collect()))
    carried = t.labelled((5,))
    one, other = W.supervised_frame(t.features, "1999-06-01"), W.supervised_frame(carried, "1999-06-01")
    assert rows(one) == rows(other) and one.count() > 0
    for frame, plain in ((other, one), (W.purged(other, "1999-06-01", 5, carried), W.purged(one, "1999-06-01", 5, t.features))):
        assert W.leakage_audit(frame, "1999-06-01", 5).first() == W.leakage_audit(plain, "1999-06-01", 5, panel=t.features).first()
    assert W.purged(other, "1999-06-01", 5, carried).where(F.col("label_date_5") >= "1999-06-01").count() == 0
