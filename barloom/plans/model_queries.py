"""Validation splits, model comparison, pooled forecasts and streams."""
from pyspark.sql import Window, functions as F

from barloom.functions import scalars as S
from barloom.operators import forecasts as Y, metrics as A, models as M
from barloom.plans.ctes import H, R, clamp, cols
from barloom.plans.data_queries import DAILY
from barloom.plans.registry import query
from barloom.session import shared_dir, stored
from barloom.streaming import bars as ST

r4 = lambda df: S.rounded(df, 4)
CUTOFF = "2000-12-29"


def _counts(t):
    return t.bars.groupBy("symbol").agg(F.count("*").alias("n"))


@query("walk_forward_splits", """SELECT symbol, n, CAST(k AS BIGINT) AS fold, 45+k*step-1 AS train_end, 45+k*step AS val_start, least(n, 45+k*step+step) AS val_end FROM
  (SELECT symbol, n, greatest(1, (n-46)//3) AS step FROM (SELECT symbol, count(*) AS n FROM bars GROUP BY 1)) , (VALUES (0),(1),(2)) v(k)
  WHERE n>47 AND least(n,45+k*step+step)>45+k*step AND 45+k*step-1>=45""")
def _(t):
    return M.walk_forward_splits(_counts(t)).select("symbol", "n", F.col("fold").cast("bigint").alias("fold"), "train_end", "val_start", "val_end")


@query("purged_split", """SELECT * FROM (SELECT symbol, n, CAST(h AS BIGINT) AS horizon_days, s-h AS train_end, s AS val_start, n AS val_end FROM
  (SELECT symbol, n, CAST(least(greatest(60,floor(n*0.8)),n-10) AS BIGINT) AS s FROM (SELECT symbol, count(*) AS n FROM bars GROUP BY 1)), (VALUES (1),(3),(5),(7),(10),(20),(60),(90),(180),(365)) v(h))
  WHERE n>=100 AND train_end>=30 AND n-val_start>=10""")
def _(t):
    return M.purged_split(_counts(t))


_E = "(0.5*pred_close+0.3*pred_open+0.2*current_price)"
_SP = "sqrt((pow(pred_close-m,2)+pow(pred_open-m,2)+pow(current_price-m,2))/3)"


@query("ensemble_combine", f"""SELECT prediction_id, {R('e', 4)} AS ensemble, {R(clamp('100*(1-' + clamp('sp/greatest(abs(e),1e-8)', 0, 1) + ')'), 4)} AS agreement, {R('sp/greatest(abs(e),1e-8)*100', 4)} AS dispersion_pct
  FROM (SELECT prediction_id, {_E} AS e, {_SP} AS sp FROM (SELECT *, (pred_close+pred_open+current_price)/3 AS m FROM ledger))""")
def _(t):
    x = M.combine(t.ledger, ["pred_close", "pred_open", "current_price"], [0.5, 0.3, 0.2])
    return r4(x.select("prediction_id", "ensemble", "agreement", "dispersion_pct"))


ERR = """(SELECT symbol, avg(abs(actual_close-previous_close))/greatest(avg(abs(actual_close)),1e-8) AS champion, avg(abs(actual_close-pred_close))/greatest(avg(abs(actual_close)),1e-8) AS challenger FROM evaluation GROUP BY symbol)"""
PERM = f"""p0 AS (SELECT symbol, champion-challenger AS d FROM {ERR}), p1 AS (SELECT count(*) AS samples, avg(d) AS observed FROM p0),
  p2 AS (SELECT i, avg(d*(('0x'||substr(md5(symbol||'|'||i),1,1))::INT%2*2-1)) AS m FROM p0, range(500) r(i) GROUP BY i),
  p3 AS (SELECT samples, observed, CASE WHEN samples<30 THEN NULL WHEN observed>0 THEN ((SELECT count(*) FROM p2 WHERE m>=observed)+1)/501.0::DOUBLE ELSE 1.0 END AS p_value FROM p1)"""


def _errors(t):
    a = A.error_metrics(t.evaluation, "actual_close", "previous_close", ["symbol"]).select("symbol", F.col("normalized_mae").alias("champion"))
    b = A.error_metrics(t.evaluation, "actual_close", "pred_close", ["symbol"]).select("symbol", F.col("normalized_mae").alias("challenger"))
    return a.join(b, "symbol")


@query("paired_permutation", f"WITH {PERM} SELECT samples, {R('observed')} AS observed, {R('p_value')} AS p_value FROM p3")
def _(t):
    return S.rounded(M.paired_permutation(_errors(t), "symbol", "champion", "challenger"))


@query("promotion_gates", f"""WITH {PERM}, g AS (SELECT count(*) AS processed, avg(champion) AS a, avg(challenger) AS b FROM {ERR}), l AS (SELECT max_by(close_mape,market_date) AS live FROM ({DAILY})),
  x AS (SELECT *, (a-b)/greatest(abs(a),1e-8) AS improvement FROM g, p3, l)
  SELECT processed, {R('a')} AS champion_error, {R('b')} AS challenger_error, {R('improvement')} AS improvement, {R('p_value')} AS p_value, b<a AS error_better, improvement>=0.02 AS relative_improvement,
  coalesce(p_value<=0.1,false) AS paired_significance, coalesce(live<=5,true) AS live_guard,
  CASE WHEN b<a AND improvement>=0.02 AND processed>=30 AND coalesce(p_value<=0.1,false) AND coalesce(live<=5,true) THEN 'PROMOTED' ELSE 'REJECTED' END AS decision FROM x""")
def _(t):
    live = A.daily_metrics(t.evaluation).agg(F.max_by("close_mape", "market_date")).scalar()
    x = M.promotion_gates(_errors(t), "symbol", "champion", "challenger", live)
    g = lambda k: F.col("gates")[k].alias(k)
    return S.rounded(x.select("processed", "champion_error", "challenger_error", "improvement", "p_value", g("error_better"), g("relative_improvement"),
                              g("paired_significance"), g("live_guard"), "decision"))


@query("rollback_rule", f"""SELECT market_date, {R('live', 4)} AS live_mape, {R('base', 4)} AS baseline_mape, CASE WHEN base IS NULL THEN 'NO ROLLBACK DATA' WHEN live>5 AND live>base*1.25 THEN 'AUTOMATIC LIVE ROLLBACK' ELSE 'LIVE MODEL STABLE' END AS rollback
  FROM (SELECT market_date, close_mape AS live, lag(close_mape) OVER (ORDER BY market_date) AS base FROM ({DAILY}))""")
def _(t):
    d = A.daily_metrics(t.evaluation).select("market_date", F.col("close_mape").alias("live_mape"))
    d = d.withColumn("baseline_mape", F.lag("live_mape").over(Window.orderBy("market_date")))  # one row per session
    return r4(M.rollback_rule(d))


# -- pooled forecasts (checked by invariants, not by SQL) --
def _frame(t):
    """The panel of the forecasts, stored: cuts, folds and fits read it several times."""
    frame = Y.design(Y.with_price_targets(t.features.where(F.col("date") <= F.lit(CUTOFF).cast("date"))))
    return stored(frame.select("symbol", "date", "close", "volume", "x", "label", "t_close", "t_volume"), "frame")


@query("ensemble_forecast")
def _(t):
    frame = _frame(t)
    fit = Y.fit_ensemble(frame, "t_close")
    if fit is None:
        raise ValueError("too few sessions to hold some out")
    out = fit.predict(Y.latest_rows(frame.select("symbol", "date", "close", "x")), "expected")
    return out.select("symbol", "date", (F.col("close") * (1 + F.col("expected"))).alias("pred_close"), F.col("expected_agreement").alias("agreement"),
                      F.col("expected_dispersion").alias("dispersion_pct"), F.lit(fit.mape).alias("validation_mape"))


@query("direction_forecast")
def _(t):
    frame = _frame(t)
    return Y.direction_forecast(frame, Y.latest_rows(frame.select("symbol", "date", "x"))).drop("x")


@query("volume_forecast")
def _(t):
    frame = _frame(t)
    fit = Y.fit_ensemble(frame, "t_volume", price="volume", log=True)
    if fit is None:
        raise ValueError("too few sessions to hold some out")
    out = fit.predict(Y.latest_rows(frame.select("symbol", "date", "volume", "x")), "r")
    return out.select("symbol", "date", F.greatest(F.expm1(F.log1p("volume") + F.col("r")), F.lit(0.0)).alias("pred_volume"))


@query("next_session_forecast")
def _(t):
    return Y.next_session_forecast(t.features, CUTOFF)


@query("multi_horizon_forecast")
def _(t):
    return Y.multi_horizon_forecast(t.features, CUTOFF)


@query("trained_hit_prob")
def _(t):
    x = t.latest_predictions.withColumn("technical_score", F.lit(50.0))
    out = Y.trained_hit_probability(t.closed_decisions, x)
    return out.select("symbol", "hit_prob_1", "hit_prob_2", "hit_prob_3", "hit_prob_5", "downside_prob", "probability_model", "probability_samples")


# -- streams ------------------------------------------------------------------
BARS = "symbol, ts, " + cols("open high low close volume", 4)


def _ntz(df):
    return r4(df).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _events(t):
    return ST.event_stream(t.spark, t.dir, "events.parquet", t.raw("events").schema)


@query("stream_bars", f"SELECT {BARS} FROM intraday WHERE ts+INTERVAL 15 MINUTE<=(SELECT max(ts)-INTERVAL 10 MINUTE FROM events)")
def _(t):
    sink = shared_dir(t.spark, "stream-bars")
    ST.stream_bars(_events(t), f"{sink}/out", f"{sink}/checkpoint")
    return _ntz(t.spark.read.parquet(f"{sink}/out"))


@query("stream_upsert", "SELECT user_id, event_type, max(event_id) AS event_id, max_by(value,event_id) AS value FROM events GROUP BY 1,2")
def _(t):
    sink = shared_dir(t.spark, "stream-upsert")
    rows = t.spark.readStream.schema(t.raw("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    path = ST.upsert_stream(rows.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], f"{sink}/table", f"{sink}/checkpoint")
    return t.spark.read.parquet(path)
