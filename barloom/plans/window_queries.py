"""Window operators over the daily and the intraday panel."""
from pyspark.sql import functions as F

from barloom.functions import scalars as S
from barloom.operators import features as W, intraday as I, market as M, metrics as A
from barloom.operators.joins import evaluate_jumps
from barloom.plans.ctes import FEATURES, H, OHLCV, R, bucket, clamp, cols, div, label, lag, lead
from barloom.plans.registry import query

r4 = lambda df: S.rounded(df, 4)


def _panel(name, fn, names):
    @query(name, f"SELECT symbol, date, {cols(names, 4)} FROM features")
    def run(t):
        return r4(fn(t.bars).select("symbol", "date", *names.split()))


_panel("sma", W.with_sma, "sma10 sma20 sma50")
_panel("ema", W.with_ema, "ema9 ema20")
_panel("macd", W.with_macd, "macd macd_signal macd_hist")
_panel("rsi", W.with_rsi, "rsi14")
_panel("atr", W.with_atr, "atr14 atr_pct")
_panel("adx", W.with_adx, "adx14")
_panel("bollinger", W.with_bollinger, "bb_mid bb_upper bb_lower bb_position")
_panel("returns_lags", W.with_returns, "return1 return3 return5 return10 return20 close_lag1 close_lag2 close_lag3 close_lag5 return_lag1 return_lag2 return_lag3 return_lag5")
_panel("volatility", W.with_volatility, "volatility10 volatility20")
_panel("volume_features", W.with_volume_features, "volume_ratio obv obv_change")
_panel("candle_features", W.with_candle_shape, "high_low_range body_pct upper_wick lower_wick")


@query("feature_frame", f"SELECT symbol, date, {cols(FEATURES, 4)} FROM features")
def _(t):
    return r4(t.features)


_ALL = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)
SUP = f"""SELECT *, CAST(CASE WHEN target_return>0.002 THEN 2 WHEN target_return<-0.002 THEN 0 ELSE 1 END AS BIGINT) AS direction_class FROM
  (SELECT *, {', '.join(lead(c) + f' AS target_{c}' for c in OHLCV)}, {lead('close')}/nullif(close,0)-1 AS target_return FROM features)
  WHERE date<DATE '1999-06-01' AND {_ALL} AND target_close IS NOT NULL"""
SUPC = list(FEATURES) + [f"target_{c}" for c in OHLCV] + ["target_return"]


@query("supervised_frame", f"SELECT symbol, date, direction_class, {cols(SUPC, 4)} FROM ({SUP})")
def _(t):
    return r4(W.supervised_frame(t.labelled(), "1999-06-01"))


def _audit(where):
    """Audit of labels five sessions ahead by the dates of the full panel."""
    leak = "CAST(coalesce(sum(CASE WHEN tgt>=DATE '1999-06-01' THEN 1 ELSE 0 END), 0) AS BIGINT)"
    future = "CAST(coalesce(sum(CASE WHEN date>=DATE '1999-06-01' THEN 1 ELSE 0 END), 0) AS BIGINT)"
    return f"""WITH s AS ({SUP}), p AS (SELECT symbol, date, {lead('date', 5)} AS tgt FROM features)
  SELECT CASE WHEN count(*)>0 AND {leak}=0 AND {future}=0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS rows, 46::BIGINT AS features,
  {future} AS future_rows, {leak} AS target_leak_rows, 5::BIGINT AS horizon FROM s JOIN p USING (symbol, date) {where}"""


@query("leakage_audit", _audit("WHERE tgt<DATE '1999-06-01'"))
def _(t):
    labelled = t.labelled((5,))
    frame = W.purged(W.supervised_frame(labelled, "1999-06-01"), "1999-06-01", 5, labelled)
    return W.leakage_audit(frame, "1999-06-01", 5, panel=labelled)


@query("leakage_audit_unpurged", _audit(""))
def _(t):
    labelled = t.labelled((5,))
    return W.leakage_audit(W.supervised_frame(labelled, "1999-06-01"), "1999-06-01", 5, panel=labelled)


_HT = ", ".join(f"{R(lead('close', h), 4)} AS target_close_{h}d, {R(f'({lead(chr(99) + chr(108) + chr(111) + chr(115) + chr(101), h)}/nullif(close,0)-1)*100', 4)} AS target_return_{h}d" for h in H)


@query("horizon_targets", f"SELECT symbol, date, {R('close', 4)} AS close, {_HT} FROM bars WHERE date<=DATE '2000-06-30'")
def _(t):
    return r4(W.horizon_targets(t.bars, "2000-06-30"))


@query("technical_score", f"SELECT symbol, date, {R('technical_score', 4)} AS technical_score FROM technical")
def _(t):
    return r4(W.technical_score(t.features))


@query("prescreen", "SELECT symbol, date, technical_score FROM technical ORDER BY technical_score DESC, symbol LIMIT 50")
def _(t):
    return W.prescreen(W.technical_score(t.features), 50)


@query("ranked_screen", f"""SELECT * FROM (SELECT t.symbol, {bucket('b.close')} AS price_bucket, technical_score, {R('b.close', 4)} AS close,
  row_number() OVER (PARTITION BY {bucket('b.close')} ORDER BY technical_score DESC, t.symbol) AS bucket_rank
  FROM technical t JOIN (SELECT symbol, max_by(close,date) AS close FROM bars GROUP BY 1) b ON t.symbol=b.symbol) WHERE bucket_rank<=10""")
def _(t):
    from barloom.operators.joins import latest_at
    from barloom.operators.ranking import top_per_bucket
    scored = W.technical_score(t.features).select("symbol", "technical_score").join(latest_at(t.bars, columns=["close"]), "symbol")
    scored = scored.withColumn("price_bucket", S.price_bucket_code("close"))
    out = top_per_bucket(scored, 10, [F.desc("technical_score"), F.asc("symbol")])
    return r4(out.select("symbol", "price_bucket", "technical_score", "close", F.col("bucket_rank").cast("bigint").alias("bucket_rank")))


NET = "CAST(sign((pred_close/previous_close-1)*100) AS DOUBLE)*((actual_close/previous_close-1)*100)-0.3"


@query("equity_curve", f"""SELECT symbol, market_date, {R('net', 4)} AS net_return_pct, printf('%.6e', product(1+net/100) OVER (PARTITION BY symbol ORDER BY market_date ROWS UNBOUNDED PRECEDING)) AS equity
  FROM (SELECT symbol, market_date, {NET} AS net FROM evaluation)""")
def _(t):
    x = A.with_net_returns(t.evaluation).select("symbol", "market_date", F.col("ai_net_return_pct").alias("net_return_pct"))
    return A.with_equity(x, "net_return_pct").select("symbol", "market_date", S.steady("net_return_pct", 4).alias("net_return_pct"),
                                                     F.format_string("%.6e", "equity").alias("equity"))


@query("drawdown", f"""SELECT symbol, market_date, {R('max(equity) OVER w', 3)} AS peak, {R('(equity/max(equity) OVER w-1)*100', 3)} AS drawdown_pct FROM
  (SELECT symbol, market_date, exp(sum(ln(1+f)) OVER (PARTITION BY symbol ORDER BY market_date ROWS UNBOUNDED PRECEDING)) AS equity FROM
   (SELECT symbol, market_date, least(greatest(({NET})/100/50,-0.5),0.5) AS f FROM evaluation))
  WINDOW w AS (PARTITION BY symbol ORDER BY market_date ROWS UNBOUNDED PRECEDING)""")
def _(t):
    x = A.with_net_returns(t.evaluation)
    x = x.withColumn("r", S.clamp(F.col("ai_net_return_pct") / 50, -50, 50))
    return A.with_equity(x, "r").select("symbol", "market_date", S.steady("peak", 3).alias("peak"), S.steady("drawdown_pct", 3).alias("drawdown_pct"))


RET20 = """(SELECT symbol, (max(CASE WHEN k=1 THEN close END)/nullif(max(CASE WHEN k=21 THEN close END),0)-1)*100 AS r FROM
  (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars WHERE date<=DATE '2000-12-29') GROUP BY symbol)"""


@query("n_session_return", f"""SELECT symbol, {R('r', 4)} AS session_return, {R("(SELECT (max(CASE WHEN k=1 THEN close END)/max(CASE WHEN k=6 THEN close END)-1)*100 FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS k FROM index_bars WHERE date<=DATE '2000-12-29'))", 4)} AS benchmark_recent_return_5d FROM {RET20}""")
def _(t):
    x = M.n_session_return(t.bars, 20, "2000-12-29")
    ctx = M.recent_return(t.index_bars, "2000-12-29")
    from barloom.operators.joins import with_context
    return r4(with_context(x, ctx.drop("symbol")))


TV = """(SELECT symbol, count(r) AS returns, CASE WHEN count(r)>=5 THEN stddev_samp(r) END AS v FROM
  (SELECT symbol, k, (close/lag(close) OVER (PARTITION BY symbol ORDER BY date)-1)*100 AS r FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars) WHERE k<=21) GROUP BY symbol)"""


@query("trailing_volatility", f"SELECT symbol, returns, {R('v', 4)} AS volatility_pct, CASE WHEN v IS NULL THEN 'UNKNOWN' WHEN v<1 THEN 'LOW' WHEN v>=3 THEN 'HIGH' ELSE 'MEDIUM' END AS volatility_bucket FROM {TV}")
def _(t):
    return r4(M.trailing_volatility(t.bars))


@query("cross_section_rank", f"""SELECT symbol, market_date, price_bucket, rank() OVER (PARTITION BY price_bucket ORDER BY c DESC) AS rank,
  count(*) OVER (PARTITION BY price_bucket) AS group_count, {R('(1-(rank() OVER (PARTITION BY price_bucket ORDER BY c DESC)-1)/CAST(count(*) OVER (PARTITION BY price_bucket) AS DOUBLE))*100', 4)} AS percentile
  FROM (SELECT *, round(prediction_confidence,2) AS c FROM evaluation)""")
def _(t):
    x = t.evaluation.select("symbol", "market_date", "price_bucket", S.half_away("prediction_confidence", 2).alias("c"))
    return r4(M.cross_section_rank(x, "c").drop("c"))


SECT = f"(SELECT r.symbol, u.sector, r.r FROM {RET20} r JOIN universe u ON r.symbol=u.symbol)"


@query("sector_relative", f"SELECT symbol, sector, {R('r', 4)} AS session_return, {R('r-median(r) OVER (PARTITION BY sector)', 4)} AS sector_relative FROM {SECT}")
def _(t):
    x = M.n_session_return(t.bars, 20, "2000-12-29").join(t.universe.select("symbol", "sector"), "symbol")
    return r4(M.sector_strength(x).select("symbol", "sector", "session_return", "sector_relative"))


_ST = clamp("50+(sm-om)*8+least(greatest(n-1,0),5)*1.5")


@query("sector_strength", f"""SELECT symbol, sector, {R('sm', 4)} AS sector_median, {R(f'CASE WHEN r IS NULL THEN 50.0 ELSE {_ST} END', 4)} AS sector_strength,
  {R(clamp(f'(CASE WHEN r IS NULL THEN 50.0 ELSE {_ST} END)-3'), 4)} AS sector_score FROM
  (SELECT *, median(r) OVER (PARTITION BY sector) AS sm, median(r) OVER () AS om, count(r) OVER (PARTITION BY sector) AS n FROM {SECT})""")
def _(t):
    x = M.n_session_return(t.bars, 20, "2000-12-29").join(t.universe.select("symbol", "sector"), "symbol")
    return r4(M.sector_strength(x, regime="BEAR").select("symbol", "sector", "sector_median", "sector_strength", "sector_score"))


@query("session_vwap", f"""SELECT symbol, ts, {R('sum((high+low+close)/3*volume) OVER w/nullif(sum(volume) OVER w,0)', 4)} AS vwap FROM intraday
  WINDOW w AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def _(t):
    return r4(I.with_session_vwap(t.intraday).select("symbol", "ts", "vwap"))


INTRA = """WITH i0 AS (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM intraday),
  ie AS (SELECT symbol, rn, close AS e9, close AS e20 FROM i0 WHERE rn=1 UNION ALL
    SELECT b.symbol, b.rn, e9+(b.close-e9)*0.2, e20+(b.close-e20)*2/21.0 FROM ie e JOIN i0 b ON b.symbol=e.symbol AND b.rn=e.rn+1),
  iv AS (SELECT i0.symbol, ts, day, i0.rn, open, high, low, close, volume, e9 AS ema9, e20 AS ema20,
    sum((high+low+close)/3*volume) OVER d/nullif(sum(volume) OVER d,0) AS vwap,
    CASE WHEN i0.rn>=20 THEN avg(volume) OVER (PARTITION BY i0.symbol ORDER BY ts ROWS 19 PRECEDING) END AS volume_ma20,
    close/nullif(lag(close) OVER s,0)-1 AS return1, close/nullif(lag(close,4) OVER s,0)-1 AS return4, close/nullif(lag(close,8) OVER s,0)-1 AS momentum,
    (high-low)/nullif(close,0) AS range_pct, max(high) OVER (PARTITION BY i0.symbol, day) AS day_high, min(low) OVER (PARTITION BY i0.symbol, day) AS day_low
    FROM i0 JOIN ie ON i0.symbol=ie.symbol AND i0.rn=ie.rn
    WINDOW d AS (PARTITION BY i0.symbol, day ORDER BY ts ROWS UNBOUNDED PRECEDING), s AS (PARTITION BY i0.symbol ORDER BY ts)),
  ifeat AS (SELECT *, volume/nullif(volume_ma20,0) AS relative_volume FROM iv)"""
IF = "ema9 ema20 vwap volume_ma20 relative_volume return1 return4 momentum range_pct day_high day_low"


@query("intraday_features", f"{INTRA} SELECT symbol, ts, {cols(IF, 4)} FROM ifeat")
def _(t):
    return r4(I.intraday_features(t.intraday).select("symbol", "ts", *IF.split()))


SETUP = f"""{INTRA}, il AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS rows FROM ifeat WHERE volume_ma20 IS NOT NULL AND momentum IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC)=1),
  is0 AS (SELECT *, {clamp('''50.0::DOUBLE+CASE WHEN close>vwap THEN 12 ELSE -12 END+CASE WHEN ema9>ema20 THEN 10 ELSE -8 END+CASE WHEN relative_volume>1.5 THEN 12 WHEN relative_volume>1.1 THEN 5 ELSE 0 END
    +CASE WHEN momentum>0.01 THEN 10 WHEN momentum<-0.01 THEN -10 ELSE 0 END+CASE WHEN range_pct>0.015 THEN 6 ELSE 0 END''')} AS score,
    greatest(abs(momentum),range_pct*1.5,0.012) AS mv FROM il),
  is1 AS (SELECT *, CASE WHEN score>=60 THEN 'UP' WHEN score<=40 THEN 'DOWN' ELSE 'NEUTRAL' END AS bias,
    least(95.0,50+abs(score-50)*0.7+least(relative_volume,3)*5) AS sc, least(80.0,45+abs(score-50)*0.6+least(relative_volume,2)*4) AS lc FROM is0),
  is2 AS (SELECT *, CASE WHEN rows<20 THEN 'INSUFFICIENT_DATA' WHEN bias='NEUTRAL' THEN 'NEUTRAL' WHEN score>=65 AND relative_volume>=1 AND sc>=60 THEN 'QUALIFIED'
    WHEN score>=55 AND relative_volume>=0.8 THEN 'WATCH' ELSE 'LOW_SCORE' END AS status, CASE WHEN bias='UP' THEN 1 ELSE -1 END AS sd FROM is1),
  setups AS (SELECT symbol, status, rows, bias, score, close AS current, relative_volume, vwap, ema9, ema20,
    CASE WHEN status IN ('QUALIFIED','WATCH') THEN close*(1+sd*mv) END AS target, CASE WHEN status IN ('QUALIFIED','WATCH') THEN close*(1-sd*mv*0.55) END AS stop_loss,
    CASE WHEN status IN ('QUALIFIED','WATCH') THEN mv*100 END AS expected_move, CASE status WHEN 'QUALIFIED' THEN sc WHEN 'WATCH' THEN lc END AS confidence FROM is2)"""
SC = "score current relative_volume vwap ema9 ema20 target stop_loss expected_move confidence"


@query("intraday_setup", f"{SETUP} SELECT symbol, status, rows, bias, {cols(SC, 4)} FROM setups")
def _(t):
    return r4(I.intraday_setups(I.intraday_features(t.intraday)))


@query("intraday_watchlist", f"{SETUP} SELECT symbol, status, {cols('score confidence relative_volume', 4)} FROM setups WHERE status IN ('QUALIFIED','WATCH') ORDER BY score DESC, confidence DESC, relative_volume DESC, symbol LIMIT 5")
def _(t):
    w = I.intraday_watchlist(I.intraday_setups(I.intraday_features(t.intraday)))
    return r4(w.select("symbol", "status", "score", "confidence", "relative_volume"))


@query("intraday_scan_stats", f"{SETUP} SELECT coalesce(status,'NO_DATA') AS status, count(*) AS symbols FROM (SELECT DISTINCT event_type AS symbol FROM events UNION SELECT symbol FROM universe) u LEFT JOIN setups s ON u.symbol=s.symbol GROUP BY 1")
def _(t):
    names = t.raw("events").select(F.col("event_type").alias("symbol")).union(t.universe.select("symbol"))
    return I.scan_statistics(I.intraday_setups(I.intraday_features(t.intraday)), names)


SNAP = """SELECT 'MAIN' AS index_key, 'INDEX' AS source, max(CASE WHEN k=1 THEN date END) AS data_date, {} FROM
  (SELECT *, row_number() OVER (ORDER BY date DESC) AS k FROM index_bars WHERE date<=DATE '2000-12-30') WHERE k<=252"""
_SN = ", ".join(f"{R(f'max(CASE WHEN k=1 THEN {c} END)', 4)} AS {c}" for c in ("open", "high", "low", "close"))


@query("index_snapshot", SNAP.format(_SN + f", {R('max(high)', 4)} AS high_52w, {R('min(low)', 4)} AS low_52w, {R('(max(CASE WHEN k=1 THEN close END)/max(CASE WHEN k=2 THEN close END)-1)*100', 4)} AS change_1d")
       + " UNION ALL SELECT 'NONE','unavailable',NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL")
def _(t):
    snap = M.index_snapshot(t.index_bars, "2000-12-30")
    wanted = t.spark.createDataFrame([("MAIN", "ABSENT", 0), ("MAIN", "INDEX", 1), ("NONE", "ABSENT", 0)], "index_key string, symbol string, priority int")
    return r4(M.first_available(snap, wanted))


@query("market_regime", f"""WITH x AS (SELECT *, row_number() OVER (ORDER BY date) AS rn FROM (SELECT * FROM index_bars WHERE date<=DATE '2000-12-29' ORDER BY date DESC LIMIT 252)),
  y AS (SELECT *, avg(close) OVER (ORDER BY date ROWS 19 PRECEDING) AS sma20, avg(close) OVER (ORDER BY date ROWS 49 PRECEDING) AS sma50, avg(close) OVER (ORDER BY date ROWS 199 PRECEDING) AS sma200,
    close/lag(close) OVER (ORDER BY date)-1 AS r, (close/lag(close,20) OVER (ORDER BY date)-1)*100 AS return_20d, (close/lag(close,60) OVER (ORDER BY date)-1)*100 AS return_60d FROM x),
  z AS (SELECT *, stddev_samp(r) OVER (ORDER BY date ROWS 19 PRECEDING)*100 AS volatility_20d FROM y QUALIFY row_number() OVER (ORDER BY date DESC)=1),
  s AS (SELECT *, {clamp('''50.0::DOUBLE+CASE WHEN close>sma20 THEN 10 ELSE -10 END+CASE WHEN close>sma50 THEN 10 ELSE -10 END+CASE WHEN close>sma200 THEN 10 ELSE -10 END
    +CASE WHEN return_20d>2 THEN 8 WHEN return_20d<-2 THEN -8 ELSE 0 END+CASE WHEN return_60d>5 THEN 7 WHEN return_60d<-5 THEN -7 ELSE 0 END-CASE WHEN volatility_20d>2.5 THEN 8 ELSE 0 END''')} AS score FROM z)
  SELECT symbol, CASE WHEN score>=65 THEN 'BULL' WHEN score<=40 THEN 'BEAR' ELSE 'SIDEWAYS' END AS regime, {R(clamp('50+abs(score-50)*1.2', 35, 95), 4)} AS confidence,
  {cols('score sma20 sma50 sma200 return_20d return_60d volatility_20d', 4)} FROM s""")
def _(t):
    return r4(M.market_regime(t.index_bars, "2000-12-29"))


@query("market_breadth", f"""SELECT up AS advancers, dn AS decliners, eq AS unchanged, {R('up/CAST(greatest(dn,1) AS DOUBLE)', 4)} AS ratio, {R('CASE WHEN up+dn>0 THEN 100.0*up/(up+dn) ELSE 50 END', 4)} AS score FROM
  (SELECT count(CASE WHEN a>b THEN 1 END) AS up, count(CASE WHEN a<b THEN 1 END) AS dn, count(CASE WHEN a=b THEN 1 END) AS eq FROM
   (SELECT symbol, max(CASE WHEN k=1 THEN close END) AS a, max(CASE WHEN k=2 THEN close END) AS b FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars WHERE date<=DATE '2000-12-29') GROUP BY symbol))""")
def _(t):
    return r4(M.market_breadth(t.bars, "2000-12-29"))


@query("broadcast_context", f"""SELECT p.symbol, p.price_bucket, (SELECT count(CASE WHEN a>b THEN 1 END) FROM (SELECT symbol, max(CASE WHEN k=1 THEN close END) AS a, max(CASE WHEN k=2 THEN close END) AS b FROM
   (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars) GROUP BY symbol)) AS advancers, {R('(SELECT max_by(close,date) FROM index_bars)', 4)} AS index_close FROM latest_predictions p""")
def _(t):
    from barloom.operators.joins import with_context
    x = with_context(t.latest_predictions.select("symbol", "price_bucket"), M.market_breadth(t.bars).select("advancers"))
    return r4(with_context(x, t.index_bars.agg(F.max_by("close", "date").alias("index_close"))))


@query("data_gaps", f"""SELECT symbol, history_rows, {R('CASE WHEN history_rows>1 THEN greatest(expected-history_rows,0)/CAST(greatest(expected,1) AS DOUBLE)*100 ELSE 100 END', 4)} AS missing_rate_pct, stale_days, {R('anomaly', 4)} AS anomaly_rate,
  {R(clamp('100-greatest(180-history_rows,0)*0.25-least(greatest(expected-history_rows,0)/CAST(greatest(expected,1) AS DOUBLE)*400,30)-least(stale_days*10,30)-least(anomaly*100,30)'), 4)} AS data_quality_score FROM
  (SELECT symbol, count(*) AS history_rows, CAST(greatest(date_diff('day',max(date),DATE '2000-12-31'),0) AS DOUBLE) AS stale_days, avg(CASE WHEN high<low*1.05 THEN 1.0 ELSE 0.0 END) AS anomaly,
   len(list_filter(generate_series(min(date)::TIMESTAMP,max(date)::TIMESTAMP,INTERVAL 1 DAY), lambda d: isodow(d)<6)) AS expected FROM bars WHERE date<=DATE '2000-12-31' GROUP BY symbol)""")
def _(t):
    x = M.data_gaps(t.bars.withColumn("low", F.col("low") * 1.05), "2000-12-31")
    return r4(x.withColumn("data_quality_score", M.data_quality_score("history_rows", "missing_rate_pct", "stale_days", "anomaly_rate")))


@query("jump_evaluation", f"""SELECT symbol, prediction_date, coalesce(min(CASE WHEN high>=target THEN step END),0)>0 AS hit, min(CASE WHEN high>=target THEN step END) AS days_to_hit,
  {R('(max(high)/any_value(cp)-1)*100', 4)} AS max_upside, count(high) AS observation_days FROM
  (SELECT l.symbol, l.run_date AS prediction_date, current_price AS cp, current_price*1.05 AS target, n.high, n.rn-m.rn AS step FROM ledger l JOIN nb m ON m.symbol=l.symbol AND m.date=l.run_date
   LEFT JOIN nb n ON n.symbol=l.symbol AND n.rn BETWEEN m.rn+1 AND m.rn+7) GROUP BY 1,2""")
def _(t):
    x = t.ledger.select("symbol", F.col("run_date").alias("prediction_date"), "current_price", (F.col("current_price") * 1.05).alias("target_level"))
    return r4(evaluate_jumps(x, t.bars))
