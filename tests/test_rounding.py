"""Rounding to cents as the SQL does it: values that decide ranks may lie on a half."""
import datetime as dt

import duckdb
import pyarrow as pa

from barloom.functions import scalars as S
from barloom.plans import registry
from barloom.plans.catalog import QUERIES


def test_half_cents_round_as_in_sql(spark):
    v = [sign * round(k / 1000, 6) for k in range(5, 20_000, 10) for sign in (1, -1)]
    t = pa.table({"v": pa.array(v)})
    want = dict(duckdb.sql("SELECT v, round(v, 2) FROM t").fetchall())
    got = spark.createDataFrame([(x,) for x in v], "v double").select("v", S.half_away("v", 2).alias("r")).collect()
    assert {r.v: r.r for r in got} == want


def test_ranks_of_half_cents(spark, monkeypatch):
    rows = [(f"S{i}", dt.date(2020, 1, 1), "B1", c) for i, c in enumerate((1.005, 1.0, 1.01, 0.285, 0.28, None))]

    class Stub:
        def __init__(self, *_):
            self.evaluation = spark.createDataFrame(rows, "symbol string, market_date date, price_bucket string, prediction_confidence double")

    monkeypatch.setattr(registry, "Tables", Stub)
    got = {r.symbol: r["rank"] for r in QUERIES["cross_section_rank"](spark, "").collect()}
    t = pa.table({"symbol": [r[0] for r in rows[:5]], "c": [r[3] for r in rows[:5]]})
    want = duckdb.sql("SELECT symbol, rank() OVER (ORDER BY round(c, 2) DESC) FROM t").fetchall()
    assert {s: got[s] for s, _ in want} == dict(want)
