"""Accuracy, calibration, drift, economics and reports over evaluations."""
from pyspark.sql import functions as F

from barloom.functions import scalars as S
from barloom.operators import metrics as A
from barloom.plans.ctes import FEATURES, OHLC, OHLCV, R, clamp, cols
from barloom.plans.data_queries import DAILY
from barloom.plans.registry import query
from barloom.plans.window_queries import NET

r4 = lambda df: S.rounded(df, 4)
HIT = "avg(CASE WHEN direction_correct THEN 1.0 ELSE 0.0 END)*100"
PT = "least(greatest(1-abs({})/100,0),1)*100"

EVN = [f"{p}_{c}" for p in ("pred", "actual", "diff", "ape") for c in OHLCV] + ["previous_close", "prediction_confidence"]


@query("prediction_errors", f"SELECT prediction_id, market_date, symbol, price_bucket, pred_direction, actual_direction, direction_correct, {cols(EVN, 4)} FROM evaluation")
def _(t):
    return r4(t.evaluation.drop("prediction_date", "prediction_uncertainty_pct"))


@query("error_metrics", f"""SELECT price_bucket, count(*) AS samples, {R('avg(abs((actual_close-pred_close)/greatest(abs(actual_close),1e-8)))*100', 4)} AS mape,
  {R('avg(abs(actual_close-pred_close))/greatest(avg(abs(actual_close)),1e-8)', 4)} AS normalized_mae FROM evaluation GROUP BY 1""")
def _(t):
    return r4(A.error_metrics(t.evaluation, "actual_close", "pred_close", ["price_bucket"]))


SUM = " ".join(f"{c}_mape" for c in OHLCV) + " overall_mape direction_accuracy"


@query("cumulative_metrics", f"""SELECT samples, {cols(SUM, 4)}, {R(clamp('100-close_mape'), 4)} AS model_accuracy FROM
  (SELECT count(*) AS samples, {', '.join(f'avg(abs(ape_{c})) AS {c}_mape' for c in OHLCV)}, (avg(abs(ape_open))+avg(abs(ape_high))+avg(abs(ape_low))+avg(abs(ape_close)))/4 AS overall_mape, {HIT} AS direction_accuracy FROM evaluation)""")
def _(t):
    return r4(A.cumulative_metrics(t.evaluation))


@query("daily_metrics", f"SELECT market_date, samples, {cols(SUM, 4)} FROM ({DAILY})")
def _(t):
    return r4(A.daily_metrics(t.evaluation))


def _acc(ape, keys, src, where=""):
    return (f"SELECT {keys}, count({ape}) AS samples, {R(f'avg(abs({ape}))', 4)} AS mape, {R(f'avg({PT.format(ape)})', 4)} AS accuracy, "
            f"{R(clamp(f'100-avg(abs({ape}))'), 4)} AS mape_accuracy, {R(HIT, 4)} AS direction_accuracy FROM {src} {where} GROUP BY {keys}")


@query("bucket_accuracy", _acc("ape_close", "price_bucket", "evaluation"))
def _(t):
    return r4(A.accuracy_by(t.evaluation, ["price_bucket"], "ape_close"))


@query("horizon_accuracy", _acc("ape", "horizon_days", "horizon_evaluation"))
def _(t):
    return r4(A.accuracy_by(t.horizon_evaluation, ["horizon_days"]))


@query("stock_reliability", f"SELECT symbol, samples, {cols('mape_open mape_high mape_low mape_close mape direction_accuracy', 4)} FROM reliability")
def _(t):
    return r4(t.reliability)


@query("worst_symbol", f"SELECT symbol, {R('avg(abs(ape_close))', 4)} AS mape FROM evaluation GROUP BY 1 ORDER BY avg(abs(ape_close)) DESC, symbol LIMIT 1")
def _(t):
    return r4(A.worst_symbol(t.evaluation))


@query("bucket_summary", f"""SELECT price_bucket, samples, {cols('mape direction_accuracy', 4)}, row_number() OVER (ORDER BY mape, price_bucket) AS place FROM
  (SELECT price_bucket, count(*) AS samples, avg(abs(ape_close)) AS mape, {HIT} AS direction_accuracy FROM evaluation GROUP BY 1)""")
def _(t):
    return r4(A.bucket_summary(t.evaluation))


@query("horizon_summary", f"""SELECT price_bucket, horizon_days, count(*) AS samples, {R('avg(abs(ape))', 4)} AS mape, {R(f'avg({PT.format("ape")})', 4)} AS accuracy, {R(HIT, 4)} AS direction_accuracy
  FROM horizon_evaluation WHERE evaluated_date>=(SELECT max(evaluated_date) FROM horizon_evaluation)-14 GROUP BY GROUPING SETS ((horizon_days),(price_bucket,horizon_days))""")
def _(t):
    return r4(A.horizon_summary(t.horizon_evaluation))


@query("confidence_bands", f"""SELECT CASE WHEN prediction_confidence>=80 THEN 'High' WHEN prediction_confidence>=60 THEN 'Medium' ELSE 'Low' END AS band,
  count(*) AS samples, {R('avg(abs(ape_close))', 4)} AS mape, {R(HIT, 4)} AS direction_accuracy FROM evaluation GROUP BY 1""")
def _(t):
    return r4(A.confidence_bands(t.evaluation))


@query("error_distribution", """SELECT CAST(k AS BIGINT) AS limit_pct, (SELECT CAST(round_even(avg(CASE WHEN abs(ape_close)<=k THEN 1.0 ELSE 0.0 END)*100,0) AS BIGINT) FROM evaluation) AS within_pct
  FROM (VALUES (1),(2),(3),(5)) v(k)""")
def _(t):
    return A.error_distribution(t.evaluation)


_WN = "sqrt((p*(1-p)+3.8416/(4*n))/n)*1.96"


@query("wilson_interval", f"""SELECT price_bucket, n AS samples, {R(f'greatest(((p+3.8416/(2*n))-{_WN})/(1+3.8416/n)*100,0)', 4)} AS low, {R(f'least(((p+3.8416/(2*n))+{_WN})/(1+3.8416/n)*100,100)', 4)} AS high
  FROM (SELECT price_bucket, count(*) AS n, avg(CASE WHEN direction_correct THEN 1.0 ELSE 0.0 END) AS p FROM evaluation GROUP BY 1)""")
def _(t):
    x = t.evaluation.groupBy("price_bucket").agg(F.count("*").alias("samples"), F.count_if(F.col("direction_correct")).alias("s"))
    low, high = A.wilson_interval("s", "samples")
    return r4(x.select("price_bucket", "samples", low.alias("low"), high.alias("high")))


CAL = f"""(SELECT sum(n)::BIGINT AS samples, sum(abs(c-o))/sum(n) AS ece, sum(c-o)/sum(n) AS bias FROM (SELECT count(*) AS n, sum(c) AS c, sum(o) AS o FROM
  (SELECT least(greatest(prediction_confidence,0),100) AS c, {PT.format('ape_close')} AS o FROM evaluation)
  GROUP BY CASE WHEN c<=50 THEN 0 WHEN c<=60 THEN 1 WHEN c<=70 THEN 2 WHEN c<=80 THEN 3 WHEN c<=90 THEN 4 ELSE 5 END))"""
CALS = "CASE WHEN samples<50 THEN 'LOW EVIDENCE' WHEN ece<=5 THEN 'CALIBRATED' WHEN ece<=10 THEN 'WATCH' ELSE 'MIS-CALIBRATED' END"


@query("calibration_ece", f"SELECT samples, {cols('ece bias', 4)}, {CALS} AS calibration FROM {CAL}")
def _(t):
    return r4(A.calibration(t.evaluation))


DRI = """(SELECT avg(CASE WHEN k<=5 THEN e END) AS recent_mape, avg(CASE WHEN k>5 THEN e END) AS baseline_mape FROM
  (SELECT abs(ape_close) AS e, row_number() OVER (ORDER BY market_date DESC, symbol DESC) AS k FROM evaluation) WHERE k<=25)"""
DRR = "(recent_mape-baseline_mape)/greatest(baseline_mape,1e-9)"
DRS = f"CASE WHEN {DRR}>=0.2 THEN 'HIGH' WHEN {DRR}>=0.1 THEN 'MEDIUM' WHEN {DRR}<=-0.1 THEN 'IMPROVING' ELSE 'LOW' END"


@query("error_drift", f"SELECT {DRS} AS drift, {R(DRR, 4)} AS drift_ratio, {cols('recent_mape baseline_mape', 4)} FROM {DRI}")
def _(t):
    return r4(A.error_drift(t.evaluation))


_FD = " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CASE WHEN date<DATE '1998-01-01' THEN {c} END) AS a, avg(CASE WHEN date>=DATE '1998-01-01' THEN {c} END) AS b FROM features" for c in FEATURES)


@query("feature_drift", f"SELECT feature, {R('abs(b-a)/greatest(abs(a),1e-6)', 4)} AS shift, abs(b-a)/greatest(abs(a),1e-6)>0.2 AS drift FROM ({_FD})")
def _(t):
    return r4(A.feature_drift(t.features, F.col("date") >= F.lit("1998-01-01").cast("date"), FEATURES))


@query("model_report", f"""WITH d AS (SELECT market_date, {clamp('100-avg(abs(ape_close))')} AS a, row_number() OVER (ORDER BY market_date DESC) AS k FROM evaluation GROUP BY 1),
  b AS (SELECT count(*) AS samples, {clamp('100-avg(abs(ape_close))')} AS current_accuracy, {clamp('100-avg(CASE WHEN market_date<(SELECT max(market_date) FROM evaluation) THEN abs(ape_close) END)')} AS previous_accuracy, {HIT} AS direction_accuracy FROM evaluation),
  c AS (SELECT * FROM {CAL}), r AS (SELECT * FROM {DRI}),
  x AS (SELECT b.*, (SELECT avg(a) FROM d WHERE k<=7) AS trend_7, (SELECT avg(a) FROM d WHERE k<=30) AS trend_30, {DRS} AS drift, {DRR} AS drift_ratio, recent_mape, baseline_mape, ece, bias,
    (SELECT {CALS} FROM c) AS calibration, (SELECT symbol FROM evaluation GROUP BY 1 ORDER BY avg(abs(ape_close)) DESC, symbol LIMIT 1) AS worst_symbol,
    (SELECT max(m) FROM (SELECT avg(abs(ape_close)) AS m FROM evaluation GROUP BY symbol)) AS worst_mape FROM b, c, r)
  SELECT samples, drift, calibration, worst_symbol, {cols('current_accuracy previous_accuracy direction_accuracy trend_7 trend_30 drift_ratio recent_mape baseline_mape ece bias worst_mape', 4)},
  CASE WHEN current_accuracy>=75 AND drift NOT IN ('HIGH','MEDIUM') AND calibration<>'MIS-CALIBRATED' THEN 'HEALTHY' WHEN current_accuracy>=65 THEN 'WATCH' ELSE 'NEEDS REVIEW' END AS health FROM x""".replace("b.*,", "b.samples, b.current_accuracy, b.previous_accuracy, b.direction_accuracy,").replace("SELECT b.samples, b.current", "SELECT b.samples, b.current"))
def _(t):
    return r4(A.model_report(t.evaluation))


DS = """(SELECT count(*) AS samples, avg(CASE WHEN outcome='WIN' THEN 1.0 ELSE 0.0 END)*100 AS win_rate, avg(return_pct) AS avg_return, count(CASE WHEN action='BUY' THEN 1 END) AS buy,
  count(CASE WHEN action='NO TRADE' THEN 1 END) AS no_trade FROM (SELECT * FROM closed ORDER BY evaluation_date DESC, prediction_id DESC LIMIT 750))"""


@query("decision_summary", f"SELECT samples, {cols('win_rate avg_return', 4)}, buy, no_trade FROM {DS}")
def _(t):
    return r4(A.decision_summary(t.closed_decisions))


@query("weekly_performance", f"""WITH k AS (SELECT *, row_number() OVER (ORDER BY market_date DESC) AS k FROM ({DAILY})),
  x AS (SELECT count(*) AS days, max(market_date) AS latest_day, CAST(sum(samples) AS BIGINT) AS samples, avg(open_mape) AS open_mape, avg(high_mape) AS high_mape, avg(low_mape) AS low_mape, avg(close_mape) AS close_mape,
  avg(overall_mape) AS overall_mape, avg(direction_accuracy) AS direction_accuracy, max(CASE WHEN k=1 THEN close_mape END)-max(CASE WHEN k=2 THEN close_mape END) AS close_mape_change,
  max(CASE WHEN k=1 THEN direction_accuracy END)-max(CASE WHEN k=2 THEN direction_accuracy END) AS direction_change FROM k WHERE k<=5)
  SELECT days, latest_day, samples, {cols('open_mape high_mape low_mape close_mape overall_mape direction_accuracy close_mape_change direction_change', 4)},
  {R(f"0.35*greatest(100-least(close_mape*10,100),0)+0.35*direction_accuracy+0.15*least(days*20,100)+0.15*(SELECT win_rate FROM {DS})", 4)} AS health_score FROM x""")
def _(t):
    return r4(A.weekly_performance(A.daily_metrics(t.evaluation), A.decision_summary(t.closed_decisions)))


@query("economic_performance", f"""WITH n AS (SELECT symbol, market_date, {NET} AS r, (actual_close/previous_close-1)*100-0.3 AS b FROM evaluation),
  q AS (SELECT *, product(1+r/100) OVER w AS eq FROM n WINDOW w AS (PARTITION BY symbol ORDER BY market_date ROWS UNBOUNDED PRECEDING)),
  d AS (SELECT *, (eq/nullif(max(eq) OVER w,0)-1)*100 AS dd FROM q WINDOW w AS (PARTITION BY symbol ORDER BY market_date ROWS UNBOUNDED PRECEDING))
  SELECT symbol, count(r) AS samples, printf('%.6e',(max_by(eq,market_date)-1)*100) AS net_return_pct, {R('avg(CASE WHEN r>0 THEN 1.0 ELSE 0.0 END)*100', 4)} AS win_rate_pct,
  {R('coalesce(sum(CASE WHEN r>0 THEN r END)/nullif(abs(sum(CASE WHEN r<0 THEN r END)),0),0)', 4)} AS profit_factor, printf('%.6e',min(dd)) AS max_drawdown_pct,
  {R('avg(r)', 4)} AS mean_net_return_pct, {R('avg(b)', 4)} AS baseline_mean_net_return_pct, {R('avg(CASE WHEN r>b THEN 1.0 ELSE 0.0 END)*100', 4)} AS baseline_win_rate_pct FROM d GROUP BY symbol""")
def _(t):
    x = A.economic_performance(t.evaluation)
    sci = lambda c: F.format_string("%.6e", c).alias(c)
    keep = [c for c in x.columns if c not in ("net_return_pct", "max_drawdown_pct")]
    return r4(x.select(*keep, sci("net_return_pct"), sci("max_drawdown_pct")))


@query("baseline_comparison", f"""SELECT prediction_id, market_date, prediction_date, symbol, {R('a', 4)} AS ai_ape, {R('b', 4)} AS baseline_ape, 0.3::DOUBLE AS cost_pct, a+0.3<b AS ai_better FROM
  (SELECT *, abs(ape_close) AS a, abs(actual_close-previous_close)/greatest(abs(actual_close),1e-8)*100 AS b FROM evaluation)""")
def _(t):
    return r4(A.baseline_comparison(t.evaluation, _baselines(t)))


def _baselines(t):
    return t.ledger.select("prediction_id", F.col("current_price").alias("baseline_close"), F.lit(0.3).alias("baseline_cost_pct"))


_AC = "50+(0.25*" + clamp("100-10*m") + "+0.15*d+0.15*bw+0.15*u+0.15*h+0.15*50-50)*least(samples/30.0,1)"


@query("adaptive_confidence", f"""WITH r AS (SELECT * FROM evaluation QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY market_date DESC, prediction_id DESC)<=50),
  hz AS (SELECT ({clamp('100-10*avg(abs(ape))')}+{clamp(HIT)})/2 AS h FROM horizon_evaluation WHERE horizon_days=1),
  p AS (SELECT symbol, count(*) AS samples, avg(abs(ape_close)) AS m, {HIT} AS d, avg(CASE WHEN abs(ape_close)+0.3<abs(actual_close-previous_close)/greatest(abs(actual_close),1e-8)*100 THEN 1.0 ELSE 0.0 END)*100 AS bw,
   {clamp('100-avg(prediction_uncertainty_pct)')} AS u, (SELECT h FROM hz) AS h FROM r GROUP BY symbol)
  SELECT symbol, samples, 1::BIGINT AS horizon_days, {R('m', 4)} AS recent_mape, {R('d', 4)} AS direction_accuracy, {R('bw', 4)} AS baseline_win_rate, {R('u', 4)} AS uncertainty_score, {R('h', 4)} AS historical_score, {R(clamp(_AC), 4)} AS confidence FROM p""")
def _(t):
    return r4(A.adaptive_confidence(t.evaluation, A.accuracy_by(t.horizon_evaluation, ["horizon_days"])))


@query("horizon_reliability", f"""SELECT symbol, horizon_days, n AS samples, {R(clamp('0.6*(100-least(12.5*m,100))+0.4*a'), 4)} AS horizon_reliability FROM
  (SELECT symbol, horizon_days, count(*) AS n, avg(abs(ape)) AS m, {HIT} AS a FROM (SELECT * FROM horizon_evaluation QUALIFY row_number() OVER (PARTITION BY symbol, horizon_days ORDER BY evaluated_date DESC, prediction_date DESC)<=60) GROUP BY 1,2)""")
def _(t):
    return r4(A.horizon_reliability(t.horizon_evaluation))


@query("quality_summary")
def _(t):
    return A.quality_summary(t.evaluation, _baselines(t), t.horizon_evaluation)
