"""The batch jobs over the smallest data set, run twice."""
from barloom.operators import quality as Q
from barloom.plans import jobs
from barloom.sources.bindings import Tables

SF = "/root/testdata/sf0.001"


def test_evening_job_is_repeatable(spark, scratch):
    t = Tables(spark, SF)
    run = lambda: jobs.evening_job(spark, t.ledger, t.bars, t.decisions, scratch, "1998-05-14")
    assert run() == "WRITTEN"
    count = lambda name: spark.read.parquet(f"{scratch}/{name}").count()
    names = ("evaluation", "daily_metrics", "stock_reliability", "horizon_evaluation", "decisions")
    first = [count(n) for n in names]
    assert min(first) > 0 and first[0] == first[2] == first[4] and first[1] == 1
    assert run() == "UNCHANGED" and [count(n) for n in names] == first


def test_portfolio_job(spark, scratch):
    t = Tables(spark, SF)
    jobs.portfolio_job(t.holdings, t.latest_predictions, Q.trading_calendar(spark, "1995-01-01", "2004-12-31"), scratch)
    row = spark.read.parquet(f"{scratch}/portfolio_rollup").first()
    assert row["positions"] == t.holdings.count() == sum(row["action_counts"].values())
