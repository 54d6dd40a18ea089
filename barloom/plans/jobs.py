"""Batch jobs that compose the operators and write their tables."""
from pyspark.sql import functions as F

from barloom.operators import joins as J, metrics as A, portfolio as P
from barloom.sources.ledgers import write_evaluation_once


def evening_job(spark, ledger, bars, decisions, out, market_date):
    """Evaluate the predictions of a session and refresh what depends on them.

    The evaluation is write-once; the other tables are functions of stored data and
    one partition each, so running the job again gives the same result. Returns
    WRITTEN or UNCHANGED.
    """
    day = F.lit(market_date).cast("date")
    mine = ledger.where(F.col("run_date") == day)
    evaluation = J.evaluate_predictions(mine, bars.where(F.col("date") == day))
    status = write_evaluation_once(spark, f"{out}/evaluation", evaluation, mine, market_date)
    stored = spark.read.parquet(f"{out}/evaluation")
    A.daily_metrics(stored).write.mode("overwrite").parquet(f"{out}/daily_metrics")
    A.stock_reliability(stored).write.mode("overwrite").parquet(f"{out}/stock_reliability")
    horizons = J.evaluate_horizons(ledger, bars, market_date=market_date).drop("evaluated_date")
    horizons.write.mode("overwrite").parquet(f"{out}/horizon_evaluation/evaluated_date={market_date}")
    closed = J.close_decisions(decisions.where(F.col("prediction_date") == day), bars).drop("prediction_date")
    closed.write.mode("overwrite").parquet(f"{out}/decisions/prediction_date={market_date}")
    return status


def portfolio_job(holdings, predictions, calendar, out):
    """Write the plan of every holding and its roll-up."""
    plan = P.portfolio_plan(holdings, predictions, calendar)
    plan.write.mode("overwrite").parquet(f"{out}/portfolio_plan")
    stored = plan.sparkSession.read.parquet(f"{out}/portfolio_plan")
    P.portfolio_rollup(stored).write.mode("overwrite").parquet(f"{out}/portfolio_rollup")
