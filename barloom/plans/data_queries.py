"""Sources, cleaning, validation, joins and set operations."""
from pyspark.sql import functions as F

from barloom import constants as K
from barloom.functions import scalars as S
from barloom.operators import joins as J, ordering as O, quality as Q, upserts as U
from barloom.plans.ctes import OHLC, OHLCV, R, bucket, cols, div, label, lead
from barloom.plans.registry import query
from barloom.sources import barstore as B, tables as X
from barloom.sources.bindings import HOLIDAYS, symbol_of

BAR = "symbol, date, " + cols("open high low close volume", 4)
HOL = "(" + ",".join(f"'{h}'" for h in HOLIDAYS) + ")"
r4 = lambda df: S.rounded(df, 4)


# -- sources ------------------------------------------------------------------
@query("bars", f"SELECT {BAR} FROM bars")
def _(t):
    return r4(t.bars)


@query("bars_range_scan", f"SELECT {BAR} FROM bars WHERE date BETWEEN DATE '1996-03-15' AND DATE '1997-02-10'")
def _(t):
    return r4(B.range_scan(B.with_month(t.bars), "1996-03-15", "1997-02-10"))


@query("lookback_filter", f"""SELECT '2y' AS period, {BAR} FROM bars WHERE date BETWEEN DATE '1998-12-31'-INTERVAL 2 YEAR AND DATE '1998-12-31'
  UNION ALL SELECT '3mo', {BAR} FROM bars WHERE date BETWEEN DATE '1998-12-31'-INTERVAL 3 MONTH AND DATE '1998-12-31'
  UNION ALL SELECT '45d', {BAR} FROM bars WHERE date BETWEEN DATE '1998-12-31'-45 AND DATE '1998-12-31'""")
def _(t):
    parts = [B.lookback(t.bars, "1998-12-31", p).withColumn("period", F.lit(p)) for p in ("2y", "3mo", "45d")]
    return r4(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _solvent(t):
    s = t.raw("supplier").where("s_acctbal >= 0")
    return s.select(symbol_of(F.col("s_suppkey")).alias("symbol"))


@query("bars_read_with_fallback", f"""WITH p AS (SELECT * FROM bars WHERE date>=DATE '1996-01-01' AND symbol IN
  (SELECT printf('S%06d',s_suppkey) FROM supplier WHERE s_acctbal>=0))
  SELECT 'STORE' AS source, {BAR} FROM p UNION ALL
  SELECT 'LEGACY', {BAR} FROM bars WHERE symbol NOT IN (SELECT symbol FROM p)""")
def _(t):
    store = t.bars.where("date >= '1996-01-01'").join(_solvent(t), "symbol", "left_semi").withColumn("source", F.lit("STORE"))
    return r4(U.read_with_fallback(store, t.bars.withColumn("source", F.lit("LEGACY"))))


@query("missing_ranges", """WITH h AS (SELECT u.symbol, min(date) AS a, max(date) AS b FROM universe u LEFT JOIN
    (SELECT * FROM bars WHERE volume>40) b ON u.symbol=b.symbol GROUP BY 1)
  SELECT symbol, 'ALL' AS kind, DATE '1995-01-10' AS range_start, DATE '2001-06-30' AS range_end FROM h WHERE a IS NULL
  UNION ALL SELECT symbol, 'BEFORE', DATE '1995-01-10', a FROM h WHERE a>DATE '1995-01-10'
  UNION ALL SELECT symbol, 'AFTER', b+1, DATE '2001-06-30' FROM h WHERE b<DATE '2001-06-30'""")
def _(t):
    return B.missing_ranges(t.bars.where("volume > 40"), t.universe, "1995-01-10", "2001-06-30")


@query("bars_merge", f"""SELECT symbol, date, {cols('open high low', 4)}, {R('CASE WHEN fresh THEN close*1.01 ELSE close END', 4)} AS close, {R('volume', 4)} AS volume
  FROM (SELECT *, date>=DATE '1997-06-01' AS fresh FROM bars) WHERE fresh OR date<DATE '1998-01-01'""")
def _(t):
    cached = t.bars.where("date < '1998-01-01'")
    fresh = t.bars.where("date >= '1997-06-01'").withColumn("close", F.col("close") * 1.01)
    return r4(U.merge_sources([cached, fresh], ["symbol", "date"]))


@query("universe_scan", "SELECT DISTINCT printf('S%06d',l_suppkey) AS symbol FROM lineitem")
def _(t):
    listed = t.ticks.select(F.concat(F.lit(" "), F.lower(symbol_of(F.col("l_suppkey"))), F.lit(".ns ")).alias("Ticker"))
    return X.symbol_list(listed.unionByName(t.spark.range(1).select(F.lit("Symbol").alias("Ticker"))))


@query("latest_ledger_date", "SELECT max(run_date) AS latest, max(CASE WHEN run_date=DATE '1997-05-14' THEN run_date END) AS exact_date FROM ledger")
def _(t):
    from barloom.sources.ledgers import latest_date
    return latest_date(t.ledger, "1997-05-14")


EVK = "prediction_id, market_date, symbol, price_bucket, direction_correct, " + cols("ape_close prediction_confidence", 4)
EVC = ["prediction_id", "market_date", "symbol", "price_bucket", "direction_correct", "ape_close", "prediction_confidence"]


@query("evaluations_scan", f"SELECT {EVK} FROM evaluation WHERE market_date<>DATE '1997-05-14'")
def _(t):
    from barloom.sources.ledgers import scan_evaluations
    return r4(scan_evaluations(t.evaluation, exclude="1997-05-14").select(*EVC))


@query("recent_sessions", f"SELECT {EVK} FROM evaluation WHERE market_date IN (SELECT DISTINCT market_date FROM evaluation ORDER BY 1 DESC LIMIT 5)")
def _(t):
    from barloom.sources.ledgers import recent_sessions
    return r4(recent_sessions(t.evaluation, 5).select(*EVC))


@query("holdings_load", """SELECT replace(h.ticker,'.NS','') AS stock, h.ticker, quantity, average_price, reported_pnl, reported_return FROM holdings h""")
def _(t):
    names = t.universe.select("name", F.concat("symbol", F.lit(".NS")).alias("ticker"))
    known = names.join(_solvent(t).withColumn("ticker", F.concat("symbol", F.lit(".NS"))), "ticker", "left_semi")
    source = t.holdings.join(known, "ticker", "left").select(
        F.coalesce(F.concat(F.lit(" "), F.lower("name")), F.lower(F.regexp_replace("ticker", r"\.NS", " "))).alias("Stock"),
        F.concat("quantity", F.lit("")).alias("Qty"),
        F.concat(F.lit("₹"), F.col("average_price").cast("decimal(18,6)").cast("string")).alias("Avg. Price"),
        F.col("reported_pnl").alias("Profit / Loss"), F.col("reported_return").alias("Return %"))
    return X.load_holdings(source.withColumnRenamed("Return %", "Return Percent"), known)


@query("number_extract", "SELECT trim(regexp_replace(name_text,'\\s+',' ','g')) AS ipo_name, price_high, gmp, open_date, close_date FROM ipo")
def _(t):
    return X.normalize_offers(t.ipo).select("ipo_name", "price_high", "gmp", "open_date", "close_date")


@query("evaluation_bind", """WITH e AS (SELECT symbol, market_date FROM evaluation WHERE actual_direction<>'NEUTRAL' AND ape_volume>-900)
  SELECT run_date AS prediction_date, count(*) AS ledger_rows, count(e.symbol) AS bound_rows,
  count(*)-count(e.symbol) AS missing, 0::BIGINT AS extra, 0::BIGINT AS duplicates, count(*)=count(e.symbol) AS valid
  FROM ledger l LEFT JOIN e ON l.symbol=e.symbol AND l.run_date=e.market_date GROUP BY 1""")
def _(t):
    from barloom.sources.ledgers import binding_report
    ev = t.evaluation.where("actual_direction <> 'NEUTRAL' and ape_volume > -900").drop("prediction_id")
    return binding_report(ev, t.ledger)


@query("upsert_keep_last", f"""SELECT coalesce(c.prediction_id,d.prediction_id) AS prediction_id,
  coalesce(c.symbol,d.symbol) AS symbol, CASE WHEN c.prediction_id IS NOT NULL THEN c.outcome ELSE 'OPEN' END AS outcome,
  {R('c.return_pct', 4)} AS return_pct, {R('coalesce(c.confidence,d.confidence)', 4)} AS confidence
  FROM (SELECT * FROM closed WHERE prediction_date<DATE '1998-06-01') c
  FULL JOIN (SELECT * FROM decisions WHERE prediction_date>=DATE '1998-01-01') d ON c.prediction_id=d.prediction_id""")
def _(t):
    c = ["prediction_id", "symbol", "outcome", "confidence"]
    old = t.closed_decisions.where("prediction_date < '1998-06-01'").select(*c, "return_pct")
    new = t.decisions.where("prediction_date >= '1998-01-01'").select(*c)
    return r4(U.upsert(old, new, ["prediction_id"], protect=F.col("outcome") != "OPEN"))


DAILY = f"""SELECT market_date, count(*) AS samples, {', '.join(f'avg(abs(ape_{c})) AS {c}_mape' for c in OHLCV)},
  (avg(abs(ape_open))+avg(abs(ape_high))+avg(abs(ape_low))+avg(abs(ape_close)))/4 AS overall_mape,
  avg(CASE WHEN direction_correct THEN 1.0 ELSE 0.0 END)*100 AS direction_accuracy FROM evaluation GROUP BY market_date"""


@query("bounded_log", f"SELECT market_date, samples, {cols('close_mape direction_accuracy', 4)} FROM ({DAILY}) ORDER BY market_date DESC LIMIT 250")
def _(t):
    from barloom.operators.metrics import daily_metrics
    d = daily_metrics(t.evaluation).select("market_date", "samples", "close_mape", "direction_accuracy")
    return r4(U.bounded_log(d, ["market_date"], 250))


@query("json_rows", f"""SELECT prediction_id, CAST(to_json(struct_pack(symbol:=symbol, run_date:=run_date, rows:=history_rows, h60:=CASE WHEN horizon_60d IS NULL THEN NULL ELSE history_rows END,
  band:=price_bucket)) AS VARCHAR) AS doc FROM ledger""")
def _(t):
    from barloom.sources.ledgers import json_rows
    x = t.ledger.select("prediction_id", "symbol", "run_date", F.col("history_rows").alias("rows"),
                        F.when(F.col("horizon_60d").isNotNull(), F.col("history_rows")).alias("h60"), F.col("price_bucket").alias("band"))
    return json_rows(x, ["prediction_id"])


@query("json_round_trip", f"""SELECT prediction_id, CASE WHEN history_rows%3=0 OR history_rows%5=0 THEN NULL ELSE {R('current_price', 4)} END AS v, price_bucket AS band FROM ledger""")
def _(t):
    from barloom.sources.ledgers import json_rows, read_json_rows
    n = F.col("history_rows")
    v = F.when(n % 3 == 0, float("nan")).when(n % 5 == 0, float("inf")).otherwise(F.col("current_price"))
    x = t.ledger.select("prediction_id", v.alias("v"), F.col("price_bucket").alias("band"))
    return r4(read_json_rows(json_rows(x, ["prediction_id"]), "v double, band string"))


@query("ledger_read", f"""SELECT symbol, run_date, 'P'||substr(sha256('1997-05-14|'||symbol||'|1997-05-14|v1'),1,16) AS prediction_id,
  {cols('pred_close baseline_close', 4)}, 0.3::DOUBLE AS baseline_cost_pct FROM (SELECT *, current_price AS baseline_close FROM ledger) WHERE run_date=DATE '1997-05-14'""")
def _(t):
    from barloom.sources.ledgers import read_ledger
    got = read_ledger(t.ledger.drop("prediction_id", "cutoff_date"), "1997-05-14", version="v1")
    return r4(got.select("symbol", "run_date", "prediction_id", "pred_close", "baseline_close", "baseline_cost_pct"))


@query("fallback_source", "SELECT trim(regexp_replace(name_text,'\\s+',' ','g')) AS ipo_name, price_high FROM ipo WHERE gmp>=20")
def _(t):
    x = X.normalize_offers(t.ipo).select("ipo_name", "price_high", "gmp")
    return U.first_non_empty([x.where("gmp > 100000"), x.where("gmp >= 20"), x]).select("ipo_name", "price_high")


# -- cleaning and validation --------------------------------------------------
RAWC = "symbol, date, " + cols(OHLCV, 4)
FULL = " AND ".join(f"{c} IS NOT NULL" for c in OHLCV)


@query("clean_bars", f"SELECT {RAWC} FROM raw_last WHERE {FULL}")
def _(t):
    return r4(Q.clean_bars(t.bars_raw))


@query("canonicalize", f"SELECT symbol, date, {cols('open high low close', 4)} FROM raw_last WHERE date<=DATE '1997-09-05'")
def _(t):
    return r4(Q.canonicalize(t.bars_raw, "1997-09-05").drop("volume"))


def _flags(src, cutoff, min_rows):
    """Per-symbol error list in SQL over a table of raw rows."""
    return f"""SELECT symbol, n AS rows, data_date, concat_ws('|', CASE WHEN n<{min_rows} THEN 'TOO_FEW_ROWS:'||n END,
    CASE WHEN nan THEN 'NAN_OHLCV' END, CASE WHEN nan OR inf THEN 'NONFINITE_OHLCV' END, CASE WHEN neg THEN 'NEGATIVE_VOLUME' END,
    CASE WHEN hi THEN 'HIGH_LT_OPEN_CLOSE' END, CASE WHEN lo THEN 'LOW_GT_OPEN_CLOSE' END, CASE WHEN pos THEN 'NONPOSITIVE_PRICE' END,
    CASE WHEN n>days THEN 'DUPLICATE_DATE_INDEX' END, CASE WHEN data_date>DATE '{cutoff}' THEN 'FUTURE_DATA' END,
    CASE WHEN isodow(DATE '{cutoff}')>5 OR '{cutoff}' IN {HOL} THEN 'NON_TRADING_DAY_CUTOFF' END) AS errors
    FROM (SELECT symbol, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, max(CAST(ts AS DATE)) AS data_date, bool_or(nan_row) AS nan, bool_or(inf_row) AS inf,
      coalesce(bool_or(volume<0),false) AS neg, coalesce(bool_or(high<greatest(open,close)),false) AS hi,
      coalesce(bool_or(low>least(open,close)),false) AS lo, coalesce(bool_or(least(open,high,low,close)<=0),false) AS pos FROM {src} GROUP BY symbol)"""


def _joined():
    return F.concat_ws("|", "errors").alias("errors")


@query("validate_bars", _flags("bars_raw", "1998-01-03", 500))
def _(t):
    v = Q.validate_bars(Q.coerce_bars(t.bars_raw), t.universe, "1998-01-03", 500, HOLIDAYS)
    return v.select("symbol", "rows", "data_date", _joined())


@query("validate_universe", f"""SELECT CASE WHEN errors='' THEN 'PASSED' ELSE 'FAILED' END AS verdict, symbol, errors FROM ({_flags("(SELECT * FROM raw_last WHERE date<=DATE '1998-01-02')", '1998-01-02', 150)})""")
def _(t):
    v = Q.validate_bars(Q.canonicalize(t.bars_raw, "1998-01-02"), t.universe, "1998-01-02", 150, HOLIDAYS)
    return v.select(F.when(F.size("errors") == 0, "PASSED").otherwise("FAILED").alias("verdict"), "symbol", _joined())


@query("snapshot_status", f"""SELECT symbol, DATE '1996-07-05' AS requested_cutoff, data_date, rows, CASE WHEN errors='' THEN 'OK' ELSE 'INVALID' END AS status, errors
  FROM ({_flags("(SELECT * FROM raw_last WHERE date<=DATE '1996-07-05')", '1996-07-05', 60)})""")
def _(t):
    return Q.snapshot_status(t.bars_raw, t.universe, "1996-07-05", 60, HOLIDAYS).withColumn("errors", F.concat_ws("|", "errors"))


@query("quality_gate", """SELECT mode, sampled, covered, validated, sampled-validated AS failed,
  CASE WHEN mode='EVENING' THEN CASE WHEN sampled>validated THEN 'FAIL' ELSE 'PASS' END
   WHEN covered<least(50,sampled) OR validated<least(50,sampled) THEN 'FAIL' WHEN validated<sampled THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status
  FROM (SELECT count(*) AS sampled, count(n) AS covered, count(CASE WHEN n>=360 THEN 1 END) AS validated FROM
    (SELECT u.symbol, n FROM universe u LEFT JOIN (SELECT symbol, count(*) AS n FROM bars GROUP BY 1) b ON u.symbol=b.symbol)), (VALUES ('MORNING'),('EVENING')) m(mode)""")
def _(t):
    v = Q.validate_bars(t.bars, t.universe, min_rows=360)
    m = Q.quality_gate(v).withColumn("mode", F.lit("MORNING"))
    return m.unionByName(Q.quality_gate(v, strict=True).withColumn("mode", F.lit("EVENING")))


@query("clip_cutoff", f"SELECT {BAR} FROM bars WHERE date<=DATE '1996-12-31'")
def _(t):
    return r4(t.bars.where(F.col("date") <= F.lit("1996-12-31").cast("date")))


@query("normalize_symbol", """SELECT s_suppkey, printf('S%06d',s_suppkey) AS symbol, 'SUPPLIER'||substr(s_name,10)||'.NS' AS ticker FROM supplier""")
def _(t):
    return t.raw("supplier").select(
        "s_suppkey", S.normalize_symbol(F.concat(F.lit("  s"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit(".ns "))).alias("symbol"),
        S.fallback_ticker("s_name").alias("ticker"))


_P = "close/CASE WHEN volume<10 THEN 1 WHEN volume<30 THEN 20 ELSE 300 END"


@query("price_bucket", f"SELECT symbol, date, {bucket(_P, 'label')} AS label, {bucket(_P)} AS code FROM bars")
def _(t):
    p = F.col("close") / F.when(F.col("volume") < 10, 1).when(F.col("volume") < 30, 20).otherwise(300)
    return t.bars.select("symbol", "date", S.price_bucket(p).alias("label"), S.price_bucket_code(p).alias("code"))


@query("bucket_backfill", """SELECT prediction_id, CASE WHEN volatile THEN CASE WHEN p>=1000 THEN '>1000' WHEN p>=500 THEN '500-999' WHEN p>=100 THEN '100-499'
  WHEN p>=50 THEN '50-99' WHEN p>=10 THEN '10-49' ELSE '<10' END ELSE price_bucket END AS price_bucket
  FROM (SELECT prediction_id, price_bucket, current_price/10 AS p, confidence<60 AS volatile FROM ledger)""")
def _(t):
    x = t.ledger.select("prediction_id", (F.col("current_price") / 10).alias("current_price"), "pred_close",
                        F.when(F.col("confidence") >= 60, F.col("price_bucket")).otherwise(" ").alias("price_bucket"))
    return Q.backfill_bucket(x).select("prediction_id", "price_bucket")


@query("even_sample", """SELECT symbol FROM (SELECT symbol, row_number() OVER (ORDER BY symbol)-1 AS k, count(*) OVER () AS n FROM universe)
  WHERE n<=37 OR k IN (SELECT CAST(round_even(i*(n-1)/36.0,0) AS BIGINT) FROM range(37) r(i))""")
def _(t):
    return O.even_sample(t.universe.select("symbol").distinct(), "symbol", 37)


LIQ = """SELECT symbol, avg_value, last_price, CASE WHEN n<20 OR avg_value<60000 OR last_price<1 THEN 0.0::DOUBLE ELSE least(log10(greatest(avg_value,1))*8,100) END AS liquidity_score
  FROM (SELECT symbol, count(*) AS n, avg(close*volume) AS avg_value, max_by(close,date) AS last_price FROM
  (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars) WHERE k<=60 GROUP BY 1)"""


@query("liquidity_score", f"SELECT symbol, {cols('avg_value last_price liquidity_score', 4)} FROM ({LIQ})")
def _(t):
    return r4(Q.liquidity_score(t.bars, min_value=60000.0))


@query("liquid_universe", f"SELECT symbol, {cols('liquidity_score', 4)} FROM ({LIQ}) WHERE liquidity_score>0 ORDER BY liquidity_score DESC, symbol LIMIT 40")
def _(t):
    return r4(Q.liquid_universe(Q.liquidity_score(t.bars, min_value=60000.0), 40).select("symbol", "liquidity_score"))


@query("data_cutoff", """SELECT max(date) AS data_cutoff FROM (SELECT date, count(*) AS c FROM bars WHERE date<DATE '1998-03-01' GROUP BY 1)
  WHERE c>=greatest(5, ceil((SELECT count(DISTINCT symbol) FROM bars)*0.2))""")
def _(t):
    return Q.data_cutoff(t.bars, "1998-03-01", min_fraction=0.2)


@query("session_date", "SELECT max(CASE WHEN date<DATE '1997-05-14' THEN date END) AS morning_session, max(CASE WHEN date<=DATE '1997-05-14' THEN date END) AS evening_session FROM index_bars")
def _(t):
    return Q.session_dates(t.index_bars, "1997-05-14")


def _span(t):
    row = t.bars.agg(F.min("date"), F.max("date")).first()
    return str(row[0]), str(row[1])


CAL = f"""(SELECT d AS date, row_number() OVER (ORDER BY d) AS session FROM (SELECT CAST(unnest(generate_series((SELECT min(date) FROM bars)::TIMESTAMP,
  (SELECT max(date) FROM bars)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS d) WHERE isodow(d)<6 AND CAST(d AS VARCHAR) NOT IN {HOL})"""


@query("trading_calendar", f"SELECT date, session FROM {CAL}")
def _(t):
    return Q.trading_calendar(t.spark, *_span(t), HOLIDAYS)


@query("next_trading_day", f"""WITH c AS {CAL}, p AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
  SELECT d, (SELECT max(date) FROM c WHERE date<d) AS previous_day, (SELECT min(date) FROM c WHERE date>d) AS next_day,
  (SELECT date FROM c WHERE session=coalesce((SELECT max(session) FROM c WHERE date<=d))+5) AS plus_five FROM p
  WHERE d BETWEEN (SELECT min(date) FROM bars) AND (SELECT max(date) FROM bars)""")
def _(t):
    first, last = _span(t)
    cal = Q.trading_calendar(t.spark, first, last, HOLIDAYS)
    days = t.raw("orders").select(F.to_date("o_orderdate").alias("d")).distinct().where(F.col("d").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    back = F.when(S.is_session("d", HOLIDAYS), -1).otherwise(0)
    x = Q.next_sessions(days, "d", back, cal, "previous_day")
    x = Q.next_sessions(x, "d", F.lit(1), cal, "next_day")
    return Q.next_sessions(x, "d", F.lit(5), cal, "plus_five")


@query("validate_predictions", """SELECT count(*) AS rows, concat_ws('|', CASE WHEN count(*)>count(DISTINCT upper(trim(symbol))) THEN 'DUPLICATE_SYMBOLS' END,
  CASE WHEN bool_or(pc IS NULL) THEN 'INVALID:pred_close' END, CASE WHEN bool_or(ph<greatest(pred_open,pc)) THEN 'PRED_HIGH_INVALID' END,
  CASE WHEN bool_or(pred_low>least(pred_open,pc)) THEN 'PRED_LOW_INVALID' END, 'TOP_N_EXCEEDED:'||count(*)||'>10') AS errors
  FROM (SELECT symbol, pred_open, pred_high*0.9 AS ph, pred_low, CASE WHEN confidence>=1 THEN pred_close END AS pc FROM ledger)""")
def _(t):
    x = t.ledger.withColumns({"pred_high": F.col("pred_high") * 0.9, "pred_close": F.when(F.col("confidence") >= 1, F.col("pred_close"))})
    return Q.validate_predictions(x, 10).withColumn("errors", F.concat_ws("|", "errors"))


@query("validate_portfolio", """SELECT count(*) AS rows, concat_ws('|','MISSING:decision', CASE WHEN count(*)>count(DISTINCT ticker) THEN 'DUPLICATE_TICKER' END,
  CASE WHEN bool_or(q<0) THEN 'NEGATIVE_QUANTITY' END) AS errors FROM (SELECT ticker, quantity-50 AS q FROM holdings)""")
def _(t):
    x = t.holdings.withColumns({"quantity": F.col("quantity") - 50, "current_price": F.lit(1.0)})
    return Q.validate_portfolio(x).withColumn("errors", F.concat_ws("|", "errors"))


@query("validate_ledger", """SELECT run_date, rows, symbols, ids, largest_bucket, NOT bad AND rows<=10 AND symbols=rows AND ids=rows AND largest_bucket<=6 AS valid FROM
  (SELECT run_date, sum(n) AS rows, max(n) AS largest_bucket, bool_or(bad) AS bad, any_value(symbols) AS symbols, any_value(ids) AS ids FROM
   (SELECT run_date, price_bucket, CAST(count(*) AS BIGINT) AS n, bool_or(NOT (pred_low<=least(pred_open,pred_close) AND pred_high>=greatest(pred_open,pred_close))) AS bad FROM ledger GROUP BY 1,2)
   JOIN (SELECT run_date, count(DISTINCT symbol) AS symbols, count(DISTINCT prediction_id) AS ids FROM ledger GROUP BY 1) USING (run_date) GROUP BY 1)""".replace("sum(n) AS rows", "CAST(sum(n) AS BIGINT) AS rows"))
def _(t):
    return Q.validate_ledger(t.ledger, by=["run_date"])


@query("ledger_backfill", f"""SELECT CASE WHEN action='HOLD' THEN 'LEGACY-'||substr(sha256(prediction_date||'|'||symbol),1,16) ELSE prediction_id END AS prediction_id,
  CAST(prediction_date AS VARCHAR) AS prediction_date, symbol, action, {R('confidence', 4)} AS confidence, '' AS evaluation_date, CAST(NULL AS DOUBLE) AS return_pct FROM decisions""")
def _(t):
    old = t.decisions.withColumn("prediction_id", F.when(F.col("action") == "HOLD", "nan").otherwise(F.col("prediction_id")))
    old = old.withColumn("confidence", F.concat("confidence", F.lit(" %")))
    return r4(Q.backfill_decisions(old).select("prediction_id", "prediction_date", "symbol", "action", "confidence", "evaluation_date", "return_pct"))


@query("ohlc_repair", f"""SELECT prediction_id, {R('pred_open', 4)} AS pred_open, {R('greatest(pred_high*0.95,pred_open,pred_close)', 4)} AS pred_high,
  {R('least(pred_low*1.05,pred_open,pred_close)', 4)} AS pred_low, {R('pred_close', 4)} AS pred_close FROM ledger""")
def _(t):
    x = t.ledger.select("prediction_id", "pred_open", (F.col("pred_high") * 0.95).alias("pred_high"),
                        (F.col("pred_low") * 1.05).alias("pred_low"), "pred_close")
    return r4(Q.repair_ohlc(x))


# -- joins --------------------------------------------------------------------
@query("join_baseline", f"""SELECT e.prediction_id, e.symbol, e.market_date, {R('l.current_price', 4)} AS baseline_close, {R('actual_close', 4)} AS actual_close
  FROM evaluation e LEFT JOIN (SELECT * FROM ledger WHERE expected_return>0) l ON e.prediction_id=l.prediction_id""")
def _(t):
    base = t.ledger.where("expected_return > 0").select("prediction_id", F.col("current_price").alias("baseline_close"))
    ev = t.evaluation.select("prediction_id", "symbol", "market_date", "actual_close")
    return r4(J.lookup(ev, base, "prediction_id", {"baseline_close": None}))


@query("join_holdings_predictions", f"""SELECT h.ticker, h.quantity, p.symbol, p.run_date, {R('p.pred_close', 4)} AS pred_close, p.direction
  FROM holdings h LEFT JOIN (SELECT * FROM latest_predictions WHERE confidence>=50) p ON replace(h.ticker,'.NS','')=p.symbol""")
def _(t):
    p = t.latest_predictions.where("confidence >= 50")
    return r4(J.attach_latest_predictions(t.holdings, p).select("ticker", "quantity", "symbol", "run_date", "pred_close", "direction"))


@query("join_lookup_default", f"""SELECT l.prediction_id, l.symbol, coalesce(u.sector,'UNKNOWN') AS sector, {R('coalesce(r.direction_accuracy,50)', 4)} AS direction_accuracy
  FROM ledger l LEFT JOIN (SELECT * FROM universe WHERE debt_to_equity<60) u ON l.symbol=u.symbol LEFT JOIN (SELECT * FROM reliability WHERE mape<400) r ON l.symbol=r.symbol""")
def _(t):
    x = J.lookup(t.ledger.select("prediction_id", "symbol"), t.universe.where("debt_to_equity < 60"), "symbol", {"sector": "UNKNOWN"})
    return r4(J.lookup(x, t.reliability.where("mape < 400"), "symbol", {"direction_accuracy": 50.0}))


@query("join_actuals", f"""SELECT l.prediction_id, b.symbol, b.date, {cols(OHLC, 4, 'b.')} FROM ledger l JOIN bars b ON l.symbol=b.symbol AND l.run_date=b.date""")
def _(t):
    x = t.ledger.select("prediction_id", "symbol", F.col("run_date").alias("date"))
    return r4(x.join(t.bars.drop("volume"), ["symbol", "date"]))


PROBE = "(SELECT o_orderkey, printf('S%06d', o_custkey%(SELECT count(*) FROM supplier)) AS symbol, CAST(o_orderdate AS DATE) AS d FROM orders)"


def _probe(t):
    n = t.raw("supplier").agg(F.count("*")).scalar()
    return t.raw("orders").select("o_orderkey", symbol_of(F.col("o_custkey") % n).alias("symbol"),
                                  F.to_date("o_orderdate").alias("d"))


@query("asof_previous", f"""SELECT o_orderkey, p.symbol, p.d, b.date AS asof_date, {R('b.close', 4)} AS asof_close FROM {PROBE} p
  ASOF LEFT JOIN bars b ON p.symbol=b.symbol AND p.d>b.date""")
def _(t):
    return r4(J.asof_join(_probe(t), t.bars, "symbol", "d", "date", ["close"], strict=True))


@query("asof_latest", f"""SELECT o_orderkey, p.symbol, p.d, b.date AS asof_date, {R('b.close', 4)} AS asof_close, {R('b.volume', 4)} AS asof_volume FROM {PROBE} p
  ASOF LEFT JOIN bars b ON p.symbol=b.symbol AND p.d>=b.date""")
def _(t):
    return r4(J.asof_join(_probe(t), t.bars, "symbol", "d", "date", ["close", "volume"]))


HE = "pred_close actual_close prediction_confidence diff ape expected_return actual_return"


@query("horizon_offset_join", f"SELECT evaluated_date,symbol,prediction_date,horizon_days,price_bucket,direction_correct,{cols(HE, 4)} FROM horizon_evaluation")
def _(t):
    return r4(t.horizon_evaluation)


@query("forward_k_join", f"""SELECT l.prediction_id, n.rn-m.rn AS step, n.date AS bar_date, {R('n.high', 4)} AS high, {R('n.close', 4)} AS close FROM ledger l
  JOIN nb m ON m.symbol=l.symbol AND m.date=l.run_date JOIN nb n ON n.symbol=l.symbol AND n.rn BETWEEN m.rn+1 AND m.rn+7""")
def _(t):
    x = t.ledger.select("prediction_id", "symbol", F.col("run_date").alias("prediction_date"))
    out = J.forward_window(x, t.bars, 7)
    return r4(out.select("prediction_id", F.col("step").cast("bigint").alias("step"), "bar_date", "high", "close"))


@query("decision_outcomes", f"SELECT prediction_id, symbol, evaluation_date, action, outcome, {cols('entry_price actual_close return_pct mfe_pct mae_pct direction_correct', 4)} FROM closed")
def _(t):
    return r4(t.closed_decisions.select("prediction_id", "symbol", "evaluation_date", "action", "outcome", "entry_price", "actual_close",
                                        "return_pct", "mfe_pct", "mae_pct", "direction_correct"))


@query("semi_join", f"SELECT prediction_id, symbol, outcome, {R('return_pct', 4)} AS return_pct FROM closed WHERE prediction_id IN (SELECT prediction_id FROM ledger WHERE confidence>=70)")
def _(t):
    ids = t.ledger.where("confidence >= 70")
    return r4(J.close_decisions(t.decisions, t.bars, ids).select("prediction_id", "symbol", "outcome", "return_pct"))


@query("anti_join", "SELECT ticker, quantity FROM holdings WHERE replace(ticker,'.NS','') NOT IN (SELECT symbol FROM latest_predictions WHERE confidence>=60)")
def _(t):
    p = t.latest_predictions.where("confidence >= 60").select(F.concat("symbol", F.lit(".NS")).alias("ticker"))
    return t.holdings.join(p, "ticker", "left_anti").select("ticker", "quantity")


@query("cross_horizons", "SELECT prediction_id, CAST(h AS BIGINT) AS horizon_days FROM ledger, (VALUES (1),(3),(5),(7),(10),(20),(60),(90),(180),(365)) v(h)")
def _(t):
    return J.cross_horizons(t.ledger.select("prediction_id"))


@query("prefer_canonical", f"""SELECT h.ticker, {R('coalesce(c.pred_close,f.close)', 4)} AS pred_close, CASE WHEN c.symbol IS NOT NULL THEN 'CANONICAL' WHEN f.symbol IS NOT NULL THEN 'FALLBACK' END AS prediction_source
  FROM holdings h LEFT JOIN (SELECT * FROM latest_predictions WHERE confidence>=60) c ON h.ticker=c.symbol||'.NS'
  LEFT JOIN (SELECT symbol, max_by(close,date) AS close FROM bars GROUP BY 1 HAVING count(*)>=370) f ON h.ticker=f.symbol||'.NS'""")
def _(t):
    keys = t.holdings.select("ticker", F.regexp_replace("ticker", r"\.NS$", "").alias("symbol"))
    long = t.bars.groupBy("symbol").agg(F.count("*").alias("n"), F.max_by("close", "date").alias("pred_close")).where("n >= 370")
    out = J.prefer_canonical(keys, t.latest_predictions.where("confidence >= 60"), long, ["pred_close"])
    return r4(out.select("ticker", "pred_close", "prediction_source"))


# -- set operations -----------------------------------------------------------
@query("union_by_name", f"""SELECT symbol, date, {R('close', 4)} AS close, {R('volume', 4)} AS volume, CAST(NULL AS VARCHAR) AS sector FROM bars
  UNION ALL SELECT symbol, NULL, NULL, NULL, sector FROM universe""")
def _(t):
    return r4(t.bars.select("symbol", "date", "close", "volume").unionByName(t.universe.select("sector", "symbol"), allowMissingColumns=True))


_A = "SELECT symbol FROM bars WHERE date<DATE '1995-02-01'"
_B = "SELECT symbol FROM bars WHERE date>DATE '2001-10-01'"


@query("set_difference", f"SELECT symbol, 'MISSING' AS side FROM ({_A} EXCEPT {_B}) UNION ALL SELECT symbol, 'EXTRA' FROM ({_B} EXCEPT {_A})")
def _(t):
    return U.set_difference(t.bars.where("date < '1995-02-01'"), t.bars.where("date > '2001-10-01'"), "symbol")


@query("set_intersect", f"{_A} INTERSECT {_B}")
def _(t):
    return t.bars.where("date < '1995-02-01'").select("symbol").intersect(t.bars.where("date > '2001-10-01'").select("symbol"))


@query("ordered_distinct", "SELECT printf('S%06d',l_suppkey) AS symbol, min(l_orderkey) AS first_position FROM lineitem GROUP BY 1 ORDER BY 2, 1 LIMIT 60")
def _(t):
    x = t.ticks.select(symbol_of(F.col("l_suppkey")).alias("symbol"), F.col("l_orderkey").alias("p"))
    return U.ordered_distinct(x, "symbol", "p").orderBy("first_position", "symbol").limit(60)
