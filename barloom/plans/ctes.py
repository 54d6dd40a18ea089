"""Shared SQL tables for the check queries, one text per table."""
import re

H = (1, 3, 5, 7, 10, 20, 60, 90, 180, 365)
OHLC = ("open", "high", "low", "close")
OHLCV = OHLC + ("volume",)


def R(expr, n=6):
    """Rounded value; see functions.scalars.steady for the shift."""
    return f"(round(CAST({expr} AS DOUBLE)+3.1e-{n + 4},{n})+0.0)"


def cols(names, n=6, src=""):
    """Select list of rounded columns."""
    return ", ".join(f"{R(src + c, n)} AS {c}" for c in (names.split() if isinstance(names, str) else names))


def clamp(e, lo=0, hi=100):
    return f"(CASE WHEN ({e}) IS NULL THEN NULL ELSE least(greatest(({e}),{lo}.0),{hi}.0) END)"


def div(a, b):
    return f"(({a})/nullif(({b}),0))"


def bucket(p, what="code"):
    codes = [(2500, "B1", ">2500"), (1000, "B2", "1000-2499"), (500, "B3", "500-999"), (250, "B4", "250-499"),
             (100, "B5", "100-249"), (50, "B6", "50-99"), (10, "B7", "10-49")]
    i = 1 if what == "code" else 2
    whens = " ".join(f"WHEN {p}>={c[0]} THEN '{c[i]}'" for c in codes)
    none, low = ("OUT", "B0") if what == "code" else ("-", "<10")
    return f"(CASE WHEN {p} IS NULL THEN '{none}' {whens} ELSE '{low}' END)"


def label(r, t=0.002):
    return f"(CASE WHEN {r}>{t} THEN 'UP' WHEN {r}<-{t} THEN 'DOWN' ELSE 'NEUTRAL' END)"


def roll(fn, c, n, guard, prev=None):
    """Rolling aggregate, null until row number ``guard``."""
    return (f"CASE WHEN rn>={guard} THEN {fn}({c}) OVER (PARTITION BY symbol ORDER BY date "
            f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END")


def lag(c, n=1):
    return f"lag({c},{n}) OVER (PARTITION BY symbol ORDER BY date)"


def lead(c, n=1):
    return f"lead({c},{n}) OVER (PARTITION BY symbol ORDER BY date)"


TICK = ("(SELECT *, printf('S%06d',l_suppkey) AS symbol, CAST(l_shipdate AS DATE) AS date, "
        "l_extendedprice/nullif(l_quantity,0) AS price FROM lineitem)")
SEQ = "l_orderkey,l_linenumber,l_partkey,l_extendedprice,l_quantity"
FOLD = ("first(price ORDER BY l_orderkey,l_linenumber,price) AS open, max(price) AS high, min(price) AS low, "
        "last(price ORDER BY l_orderkey,l_linenumber,price) AS close, sum(l_quantity) AS volume")

CTES = {}
CTES["bars"] = f"SELECT symbol, date, {FOLD} FROM {TICK} WHERE isodow(date)<6 GROUP BY symbol, date"
CTES["index_bars"] = (f"SELECT 'INDEX' AS symbol, date, {FOLD} FROM {TICK} WHERE isodow(date)<6 GROUP BY date")
CTES["nb"] = "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM bars"
CTES["ixn"] = "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM index_bars"
CTES["bars_raw"] = """SELECT printf('S%06d',l_suppkey) AS symbol, l_shipdate AS ts,
  CASE WHEN l_linenumber=7 AND l_tax=0 THEN NULL ELSE p END AS open, p*(1+l_discount) AS high,
  CASE WHEN l_linenumber=6 AND l_tax>0.07 THEN p*2 ELSE p*(1-l_tax) END AS low, p AS close,
  CASE WHEN l_linenumber=5 AND l_discount=0 THEN NULL WHEN l_linenumber=4 AND l_discount>0.09 THEN -1.0
       ELSE l_quantity END AS volume,
  (l_linenumber=7 AND l_tax=0) AS nan_row,
  (l_linenumber=5 AND l_discount=0) AS inf_row,
  l_orderkey,l_linenumber,l_partkey,l_extendedprice,l_quantity,l_discount,l_tax
  FROM (SELECT *, l_extendedprice/nullif(l_quantity,0) AS p FROM lineitem)"""
SEQ7 = SEQ + ",l_discount,l_tax"
CTES["raw_last"] = (f"SELECT * FROM (SELECT *, CAST(ts AS DATE) AS date, row_number() OVER (PARTITION BY symbol, "
                    f"CAST(ts AS DATE) ORDER BY {','.join(c + ' DESC' for c in SEQ7.split(','))}) AS k FROM bars_raw) WHERE k=1")
CTES["universe"] = """SELECT printf('S%06d',s_suppkey) AS symbol, s_name AS name, coalesce(n_name,'UNKNOWN') AS sector,
  CASE WHEN s_suppkey%7<>0 THEN s_acctbal/40000 END AS roe, s_acctbal/20000-0.1 AS revenue_growth,
  CASE WHEN s_suppkey%5<>0 THEN (s_suppkey%40)/100.0-0.2 END AS earnings_growth,
  abs(s_acctbal)/100 AS debt_to_equity, CAST((s_suppkey%60)-5 AS DOUBLE) AS pe
  FROM supplier LEFT JOIN nation ON s_nationkey=n_nationkey"""
CTES["intraday"] = """SELECT symbol, ts, first(price ORDER BY t0,event_id) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY t0,event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM (SELECT event_type AS symbol, time_bucket(INTERVAL '15 minutes', ts) AS ts, value+1 AS price, ts AS t0, event_id FROM events)
  GROUP BY symbol, ts"""

_PAST = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
CTES["led0"] = f"""SELECT symbol, date AS run_date, {lag('date')} AS cutoff_date, rn-1 AS history_rows,
  {R(lag('close'))} AS current_price, avg(open) {_PAST} AS o, avg(high) {_PAST} AS h, avg(low) {_PAST} AS l,
  avg(close) {_PAST} AS c, avg(volume) {_PAST} AS v, stddev_samp(close) {_PAST} AS s FROM nb"""
CTES["led1"] = f"""SELECT symbol, run_date, cutoff_date, history_rows, current_price, {R('o')} AS pred_open,
  {R('greatest(h,o,c)')} AS pred_high, {R('least(l,o,c)')} AS pred_low, {R('c')} AS pred_close, {R('v')} AS pred_volume,
  {R(clamp('100-100*s/c'))} AS confidence, {R('20*s/c')} AS prediction_uncertainty_pct,
  {R(f"({R('c')}/current_price-1)*100")} AS expected_return FROM led0 WHERE history_rows>=5"""
_HZ = ", ".join(f"CASE WHEN history_rows>={2 * h} THEN " + R(
    f"expected_return*sqrt({h}/10.0)*CASE WHEN (history_rows+{h})%4=0 THEN -1.0 ELSE 1.0 END") + f" END AS horizon_{h}d" for h in H)
CTES["ledger"] = f"""SELECT *, {label('expected_return/100')} AS direction,
  {clamp('50+abs(expected_return)')} AS direction_confidence, {bucket('current_price')} AS price_bucket,
  'P'||substr(sha256(run_date||'|'||symbol||'|'||cutoff_date||'|v1'),1,16) AS prediction_id,
  {R('pred_close*1.001')} AS horizon_1d_pred_close,
  CASE WHEN history_rows%2=0 THEN {R('pred_close*1.003')} END AS horizon_3d_pred_close, {_HZ} FROM led1"""
_PAIR = ", ".join(f"actual_{c}-pred_{c} AS diff_{c}, (actual_{c}-pred_{c})/greatest(abs(actual_{c}),1e-8)*100 AS ape_{c}"
                  for c in OHLCV)
CTES["evaluation"] = f"""SELECT *, pred_direction=actual_direction AS direction_correct, {_PAIR} FROM (
  SELECT prediction_id, run_date AS market_date, run_date AS prediction_date, l.symbol, price_bucket,
  {', '.join(f'pred_{c}' for c in OHLCV)}, {', '.join(f'b.{c} AS actual_{c}' for c in OHLCV)},
  current_price AS previous_close, direction AS pred_direction,
  {label('(b.close/nullif(current_price,0)-1)')} AS actual_direction, confidence AS prediction_confidence,
  prediction_uncertainty_pct FROM ledger l JOIN bars b ON l.symbol=b.symbol AND l.run_date=b.date)"""
_HU = " UNION ALL ".join(
    f"SELECT l.symbol, run_date, {h} AS h, n.rn+{h} AS trn, horizon_{h}d AS ret, "
    + (f"horizon_{h}d_pred_close" if h in (1, 3) else "CAST(NULL AS DOUBLE)")
    + " AS pc, current_price, confidence, price_bucket FROM ledger l JOIN nb n ON l.symbol=n.symbol AND l.cutoff_date=n.date"
    for h in H)
CTES["horizon_evaluation"] = f"""SELECT *, sign(expected_return)=sign(actual_return) AS direction_correct FROM (
  SELECT evaluated_date, symbol, prediction_date, horizon_days, pred_close, actual_close,
  prediction_confidence, price_bucket, actual_close-pred_close AS diff,
  (actual_close-pred_close)/greatest(abs(actual_close),1e-8)*100 AS ape,
  coalesce((pred_close/nullif(current_price,0)-1)*100,0) AS expected_return,
  coalesce((actual_close/nullif(current_price,0)-1)*100,0) AS actual_return
  FROM (SELECT n.date AS evaluated_date, u.symbol, u.run_date AS prediction_date, CAST(h AS BIGINT) AS horizon_days,
    coalesce(pc, current_price*(1+coalesce(ret,0)/100)) AS pred_close, n.close AS actual_close,
    confidence AS prediction_confidence, price_bucket, current_price
    FROM ({_HU}) u JOIN nb n ON u.symbol=n.symbol AND u.trn=n.rn))"""
CTES["decisions"] = """SELECT prediction_id, run_date AS prediction_date, symbol, price_bucket,
  CASE WHEN prediction_uncertainty_pct>15 THEN 'NO TRADE' WHEN expected_return>=10 THEN 'BUY' WHEN expected_return<=-10 THEN 'AVOID'
  WHEN expected_return>=5 THEN 'WATCH' ELSE 'HOLD' END AS action, confidence AS decision_score, confidence, expected_return,
  prediction_uncertainty_pct AS prediction_uncertainty, 50.0::DOUBLE AS technical_score, current_price AS entry_price,
  pred_close AS predicted_close, 'OPEN' AS outcome FROM ledger"""
CTES["closed"] = f"""SELECT * EXCLUDE (side), CASE WHEN side*return_pct>0 THEN 'WIN' WHEN side*return_pct<0 THEN 'LOSS' ELSE 'NEUTRAL' END AS outcome,
  CAST(sign(return_pct)=sign(predicted_close-entry_price) AS DOUBLE) AS direction_correct
  FROM (SELECT d.* EXCLUDE (outcome), d.prediction_date AS evaluation_date, {', '.join(f'b.{c} AS actual_{c}' for c in OHLC)},
  (b.close/entry_price-1)*100 AS return_pct, (b.high/entry_price-1)*100 AS mfe_pct, (b.low/entry_price-1)*100 AS mae_pct,
  CASE action WHEN 'BUY' THEN 1 WHEN 'AVOID' THEN -1 ELSE 0 END AS side
  FROM decisions d JOIN bars b ON d.symbol=b.symbol AND d.prediction_date=b.date WHERE entry_price>0)"""
CTES["latest_predictions"] = "SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY run_date DESC)=1"
CTES["reliability"] = f"""SELECT symbol, count(*) AS samples, avg(abs(ape_open)) AS mape_open, avg(abs(ape_high)) AS mape_high,
  avg(abs(ape_low)) AS mape_low, avg(abs(ape_close)) AS mape_close,
  (avg(abs(ape_open))+avg(abs(ape_high))+avg(abs(ape_low))+avg(abs(ape_close)))/4 AS mape,
  avg(CASE WHEN direction_correct THEN 1.0 ELSE 0.0 END)*100 AS direction_accuracy FROM evaluation GROUP BY symbol"""
CTES["ema"] = """SELECT symbol, rn, close AS e9, close AS e12, close AS e20, close AS e26, 0.0::DOUBLE AS sig FROM nb WHERE rn=1
  UNION ALL SELECT b.symbol, b.rn, e9+(b.close-e9)*0.2, e12+(b.close-e12)*2/13.0, e20+(b.close-e20)*2/21.0, e26+(b.close-e26)*2/27.0,
  sig+((e12+(b.close-e12)*2/13.0)-(e26+(b.close-e26)*2/27.0)-sig)*0.2
  FROM ema e JOIN nb b ON b.symbol=e.symbol AND b.rn=e.rn+1"""
CTES["f1"] = f"""SELECT *, close-{lag('close')} AS chg, greatest(high-low, abs(high-{lag('close')}), abs(low-{lag('close')})) AS tr,
  high-{lag('high')} AS um, {lag('low')}-low AS dm,
  {', '.join(div('close', lag('close', n)) + f'-1 AS return{n}' for n in (1, 3, 5, 10, 20))},
  {', '.join(lag('close', n) + f' AS close_lag{n}' for n in (1, 2, 3, 5))},
  {', '.join(roll('avg', 'close', n, n) + f' AS sma{n}' for n in (10, 20, 50))},
  {roll('stddev_samp', 'close', 20, 20)} AS sd20, {roll('avg', 'volume', 20, 20)} AS vma20 FROM nb"""
CTES["f2"] = f"""SELECT *, {roll('avg', 'greatest(chg,0)', 14, 15)} AS gain, {roll('avg', 'greatest(-chg,0)', 14, 15)} AS loss,
  {roll('avg', 'tr', 14, 14)} AS atr14, {roll('sum', 'tr', 14, 14)} AS trs,
  {roll('sum', 'CASE WHEN um>dm AND um>0 THEN um ELSE 0 END', 14, 14)} AS pds,
  {roll('sum', 'CASE WHEN dm>um AND dm>0 THEN dm ELSE 0 END', 14, 14)} AS mds,
  {roll('stddev_samp', 'return1', 10, 11)} AS volatility10, {roll('stddev_samp', 'return1', 20, 21)} AS volatility20,
  {', '.join(lag('return1', n) + f' AS return_lag{n}' for n in (1, 2, 3, 5))},
  sum(coalesce(sign(chg),0)*volume) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS obv FROM f1"""
_PI, _MI = "100*pds/nullif(trs,0)", "100*mds/nullif(trs,0)"
CTES["f3"] = f"SELECT *, 100*abs({_PI}-{_MI})/nullif({_PI}+{_MI},0) AS dx, {div('obv', lag('obv', 10))}-1 AS obv_change FROM f2"
CTES["features"] = f"""SELECT f.symbol, f.date, f.rn, open, high, low, close, volume, sma10, sma20, sma50, e9 AS ema9, e20 AS ema20,
  CASE WHEN loss>0 THEN 100-100/(1+gain/loss) WHEN loss=0 AND gain=0 THEN 50.0 WHEN loss=0 THEN 100.0 END AS rsi14,
  e12-e26 AS macd, sig AS macd_signal, e12-e26-sig AS macd_hist, sma20 AS bb_mid, sma20+2*sd20 AS bb_upper, sma20-2*sd20 AS bb_lower,
  (close-(sma20-2*sd20))/nullif((sma20+2*sd20)-(sma20-2*sd20),0) AS bb_position, atr14, {div('atr14', 'close')} AS atr_pct,
  CASE WHEN f.rn>=27 AND count(dx) OVER w14=14 THEN avg(dx) OVER w14 END AS adx14,
  return1, return3, return5, return10, return20, volatility10, volatility20, volume/nullif(vma20,0) AS volume_ratio, obv, obv_change,
  close/nullif(sma20,0)-1 AS close_vs_sma20, close/nullif(sma50,0)-1 AS close_vs_sma50, e9/nullif(e20,0)-1 AS ema9_vs_ema20,
  (high-low)/nullif(close,0) AS high_low_range, close_lag1, close_lag2, close_lag3, close_lag5,
  return_lag1, return_lag2, return_lag3, return_lag5, (close-open)/nullif(open,0) AS body_pct,
  (high-greatest(open,close))/nullif(close,0) AS upper_wick, (least(open,close)-low)/nullif(close,0) AS lower_wick
  FROM f3 f JOIN ema e ON f.symbol=e.symbol AND f.rn=e.rn
  WINDOW w14 AS (PARTITION BY f.symbol ORDER BY f.date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"""
FEATURES = ("open high low close volume sma10 sma20 sma50 ema9 ema20 rsi14 macd macd_signal macd_hist bb_mid bb_upper bb_lower "
            "bb_position atr14 atr_pct adx14 return1 return3 return5 return10 return20 volatility10 volatility20 volume_ratio obv "
            "obv_change close_vs_sma20 close_vs_sma50 ema9_vs_ema20 high_low_range close_lag1 close_lag2 close_lag3 close_lag5 "
            "return_lag1 return_lag2 return_lag3 return_lag5 body_pct upper_wick lower_wick").split()
CTES["technical"] = f"""SELECT symbol, date, {clamp('''50.0::DOUBLE + CASE WHEN rsi14 BETWEEN 50 AND 70 THEN 10 WHEN rsi14>=45 AND rsi14<50 THEN 4
  WHEN rsi14>75 THEN -8 WHEN rsi14<30 THEN -5 ELSE 0 END + CASE WHEN macd_hist>0 THEN 10 ELSE 0 END + CASE WHEN close_vs_sma20>0 THEN 8 ELSE 0 END
  + CASE WHEN close_vs_sma50>0 THEN 8 ELSE 0 END + CASE WHEN ema9_vs_ema20>0 THEN 6 ELSE 0 END
  + CASE WHEN volume_ratio>1.2 THEN 8 WHEN volume_ratio>1 THEN 3 ELSE 0 END + CASE WHEN adx14>25 THEN 5 ELSE 0 END''')} AS technical_score
  FROM (SELECT * FROM features WHERE {' AND '.join(c + ' IS NOT NULL' for c in FEATURES)}
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC)=1)"""
CTES["candidates"] = f"""SELECT p.*, coalesce(u.sector,'UNKNOWN') AS sector, coalesce(technical_score,50.0) AS technical_score,
  coalesce(r.samples,0) AS reliability_samples, coalesce({R('50+least(r.samples/20.0,1.0)*(0.55*' + clamp('100-20*r.mape') + '+0.45*r.direction_accuracy-50)')},50.0) AS reliability_score,
  50.0::DOUBLE AS sector_score, {R(clamp('100-4*' + clamp('prediction_uncertainty_pct', 0, 25)))} AS uncertainty_score,
  coalesce(horizon_1d, expected_return) AS multi_horizon_expected_return
  FROM latest_predictions p LEFT JOIN universe u ON p.symbol=u.symbol LEFT JOIN technical t ON p.symbol=t.symbol
  LEFT JOIN reliability r ON p.symbol=r.symbol"""
_N = "CAST(substr(symbol,2) AS BIGINT)"
CTES["holdings"] = f"""SELECT symbol||'.NS' AS ticker, CAST((n+1)*10 AS DOUBLE) AS quantity,
  CASE WHEN n%5<>0 AND n%7<>0 THEN {R('cost')} END AS average_price,
  CASE WHEN n%5=0 THEN {R('(last_close-cost)*((n+1)*10)')} END AS reported_pnl,
  CASE WHEN n%7=0 AND n%5<>0 THEN {R('(last_close/cost-1)*100')} END AS reported_return
  FROM (SELECT symbol, {_N} AS n, max(CASE WHEN k=1 THEN close END) AS last_close, max(CASE WHEN k=61 THEN close END) AS cost
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars) GROUP BY symbol)"""
CTES["ipo"] = """SELECT '  '||p_name||'   '||p_brand||' '||p_partkey||' ' AS name_text,
  '₹'||CAST(floor(p_retailprice*0.9) AS BIGINT)||' - ₹'||CAST(floor(p_retailprice) AS BIGINT) AS price_text,
  'Rs.'||(p_size*4-50)||' (est)' AS gmp_text,
  CASE WHEN k%9<>0 THEN DATE '2024-01-01'+CAST(k%40 AS INTEGER) END AS open_date,
  CASE WHEN k%11<>0 THEN DATE '2024-01-01'+CAST(k%40 AS INTEGER)+3 END AS close_date,
  CASE WHEN k%13=0 THEN 'Listed' WHEN k%17=0 THEN 'subscription closed' WHEN k%3=0 THEN 'Open' ELSE '' END AS status,
  CAST(k%70-20 AS DOUBLE) AS revenue_growth, CAST(k%90-35 AS DOUBLE) AS profit_growth, CAST(k%33 AS DOUBLE) AS roe,
  (k%60)/10.0::DOUBLE AS debt_to_equity, CAST(k%45 AS DOUBLE) AS pe, CAST(k%37 AS DOUBLE) AS industry_pe,
  (k%400)/10.0::DOUBLE AS qib, (k%250)/10.0::DOUBLE AS nii, (k%90)/10.0::DOUBLE AS retail,
  CAST(p_size*4-50 AS DOUBLE) AS gmp, CAST(floor(p_retailprice) AS DOUBLE) AS price_high
  FROM (SELECT *, p_partkey AS k FROM part)"""


_NN = "(" + "+".join(f"(CASE WHEN horizon_{h}d IS NOT NULL THEN 1 ELSE 0 END)" for h in H) + ")"
_POS = "(" + "+".join(f"(CASE WHEN horizon_{h}d>0 THEN 1 ELSE 0 END)" for h in H) + ")"
_NEG = "(" + "+".join(f"(CASE WHEN horizon_{h}d<0 THEN 1 ELSE 0 END)" for h in H) + ")"
_FLAT = "(" + "+".join(f"(CASE WHEN abs(horizon_{h}d)<=1.5 THEN 1 ELSE 0 END)" for h in H) + ")"
ALIGN = (f"CASE direction WHEN 'UP' THEN {clamp('50+25*expected_return')} WHEN 'DOWN' THEN {clamp('50-25*expected_return')} "
         f"ELSE {clamp('100-20*abs(expected_return)')} END")
CTES["scored0"] = f"""SELECT *, {ALIGN} AS direction_return_alignment,
  CASE WHEN {_NN}=0 THEN 50.0::DOUBLE ELSE 100.0::DOUBLE*(CASE direction WHEN 'UP' THEN {_POS} WHEN 'DOWN' THEN {_NEG} ELSE {_FLAT} END)/{_NN} END AS horizon_alignment FROM candidates"""
CTES["scored"] = f"""SELECT *, CASE WHEN trade_confidence>=75 THEN 'HIGH' WHEN trade_confidence>=60 THEN 'MEDIUM' ELSE 'LOW' END AS trade_quality FROM (SELECT *,
  {clamp('0.25*confidence+0.15*direction_confidence+0.20*reliability_score+0.20*horizon_alignment+0.10*uncertainty_score+0.10*direction_return_alignment')} AS trade_confidence,
  {clamp("0.20*technical_score+0.10*" + clamp('50+5*expected_return') + "+0.15*confidence+0.10*direction_confidence+0.10*reliability_score+0.10*(CASE direction WHEN 'UP' THEN 90.0 WHEN 'NEUTRAL' THEN 55.0 ELSE 35.0 END)+0.10*sector_score+0.10*" + clamp('50+4*multi_horizon_expected_return') + "+0.05*uncertainty_score")} AS score FROM scored0)"""
CTES["vol20"] = """SELECT symbol, CASE WHEN count(r)>=5 THEN stddev_samp(r) END AS volatility_pct FROM
  (SELECT symbol, (close/lag(close) OVER (PARTITION BY symbol ORDER BY date)-1)*100 AS r FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars) WHERE k<=21) GROUP BY symbol"""
CTES["gaps"] = f"""SELECT symbol, {clamp('100-greatest(180-n,0)*0.25-least(greatest(expected-n,0)/CAST(greatest(expected,1) AS DOUBLE)*400,30)-least(stale*10,30)')} AS data_quality_score FROM
  (SELECT symbol, count(*) AS n, date_diff('day',max(date),DATE '2001-12-31') AS stale, len(list_filter(generate_series(min(date)::TIMESTAMP,max(date)::TIMESTAMP,INTERVAL 1 DAY), lambda d: isodow(d)<6)) AS expected
   FROM bars WHERE date<=DATE '2001-12-31' GROUP BY symbol)"""
CTES["hrel"] = f"""SELECT symbol, {clamp('0.6*(100-least(12.5*m,100))+0.4*a')} AS horizon_reliability FROM
  (SELECT symbol, avg(abs(ape)) AS m, avg(CASE WHEN direction_correct THEN 1.0 ELSE 0.0 END)*100 AS a FROM (SELECT * FROM horizon_evaluation WHERE horizon_days=1
   QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY evaluated_date DESC, prediction_date DESC)<=60) GROUP BY 1)"""
CTES["risky"] = f"""SELECT s.*, {clamp('0.75*score+0.10*85+0.15*uncertainty_score')} AS risk_adjusted_score, v.volatility_pct,
  CASE WHEN v.volatility_pct IS NULL THEN 'UNKNOWN' WHEN v.volatility_pct<1 THEN 'LOW' WHEN v.volatility_pct>=3 THEN 'HIGH' ELSE 'MEDIUM' END AS volatility_bucket,
  (SELECT (max(CASE WHEN k=1 THEN close END)/max(CASE WHEN k=6 THEN close END)-1)*100 FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS k FROM index_bars)) AS benchmark_return,
  coalesce(g.data_quality_score,0.0) AS data_quality_score, coalesce({clamp('0.55*(100-least(15*r.mape,100))+0.45*r.direction_accuracy')},50.0) AS stock_reliability,
  coalesce(h.horizon_reliability,50.0) AS horizon_reliability
  FROM scored s LEFT JOIN vol20 v ON s.symbol=v.symbol LEFT JOIN gaps g ON s.symbol=g.symbol LEFT JOIN reliability r ON s.symbol=r.symbol LEFT JOIN hrel h ON s.symbol=h.symbol"""
_HP = "100/(1+exp(least(greatest(({0}-expected_return)/greatest(abs(prediction_uncertainty_pct),0.5),-20),20)))"
CTES["dec0"] = f"""SELECT *, (1-least(reliability_samples/50.0,1))*{clamp('confidence')}+least(reliability_samples/50.0,1)*{clamp('reliability_score')} AS calibrated_confidence,
  expected_return/greatest(abs(coalesce(volatility_pct,3)),0.25) AS risk_adjusted_return, expected_return-0.6 AS net_expected_return, expected_return-benchmark_return AS benchmark_edge_pct,
  {clamp('risk_adjusted_score*1.05')} AS regime_adjusted_score, {', '.join(_HP.format(k) + f' AS hit_prob_{k}' for k in (1, 2, 3, 5))}, 100-{_HP.format(-2)} AS downside_prob FROM risky"""
CTES["dec1"] = f"""SELECT *, {clamp('0.19*regime_adjusted_score+0.14*calibrated_confidence+0.11*technical_score+0.10*' + clamp('50+5*net_expected_return') + '+0.10*' + clamp('50+4*multi_horizon_expected_return') + '+0.09*hit_prob_3+0.08*60+0.05*50+0.05*' + clamp('50+5*benchmark_edge_pct') + '+0.04*' + clamp('50+10*risk_adjusted_return') + '+0.03*stock_reliability+0.02*data_quality_score')} AS final_decision_score,
  75.0+CASE volatility_bucket WHEN 'HIGH' THEN 4 WHEN 'LOW' THEN -2 ELSE 0 END+CASE WHEN stock_reliability<55 THEN 4 ELSE 0 END+CASE WHEN horizon_reliability<55 THEN 3 ELSE 0 END AS buy_level,
  68.0+CASE volatility_bucket WHEN 'HIGH' THEN 3 WHEN 'LOW' THEN -1 ELSE 0 END+CASE WHEN stock_reliability<55 THEN 3 ELSE 0 END+CASE WHEN horizon_reliability<55 THEN 2 ELSE 0 END AS watch_level,
  0.5+CASE WHEN volatility_bucket='HIGH' THEN 0.25 ELSE 0 END AS least_net FROM dec0"""
CTES["final"] = """SELECT *, CASE WHEN prediction_uncertainty_pct>15 OR calibrated_confidence<45 OR data_quality_score<60 OR stock_reliability<30 OR horizon_reliability<30 OR final_decision_score<55
   OR net_expected_return<least_net OR downside_prob>=75 THEN 'NO TRADE' WHEN final_decision_score>=buy_level AND direction='UP' AND benchmark_edge_pct>=-0.1 AND hit_prob_3>=50 THEN 'BUY'
   WHEN final_decision_score>=watch_level AND direction='UP' AND hit_prob_3>=45 AND downside_prob<80 THEN 'WATCH' WHEN final_decision_score<=35 OR (direction='DOWN' AND final_decision_score<55) THEN 'AVOID' ELSE 'HOLD' END AS action,
  prediction_uncertainty_pct>15 AS uncertainty_flag, CASE WHEN final_decision_score>=75 THEN 'LOW' WHEN final_decision_score>=55 THEN 'MEDIUM' ELSE 'HIGH' END AS final_risk FROM dec1"""


def _needs(text, seen):
    for name in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)", text):
        if name in CTES and name not in seen:
            seen.add(name)
            _needs(CTES[name], seen)
    return seen


def with_ctes(text):
    """Prefix a SELECT with every shared table it reads, in dependency order."""
    used = _needs(text, set())
    if not used:
        return text
    order = {n: i for i, n in enumerate(CTES)}
    body = ",\n".join(f"{n} AS ({CTES[n]})" for n in sorted(used, key=order.get))
    extra = re.match(r"\s*WITH\s+", text)
    if extra:
        return f"WITH RECURSIVE {body},\n{text[extra.end():]}"
    return f"WITH RECURSIVE {body}\n{text}"
