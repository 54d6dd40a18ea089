"""Cleaning, validation and calendar operators."""
from pyspark.sql import Window, functions as F

from barloom import constants as K
from barloom.functions import scalars as S
from barloom.operators.joins import FIELDS, PRICES
from barloom.operators.upserts import keep_last


def coerce_bars(raw, time="ts"):
    """Text fields to doubles (unreadable becomes null) and the date without time."""
    return raw.select("symbol", F.to_date(time).alias("date"),
                      *[F.trim(c).try_cast("double").alias(c) for c in FIELDS],
                      *[c for c in raw.columns if c not in ("symbol", time, *FIELDS)])


def clean_bars(raw, order="seq"):
    """Typed, finite, complete bars, one per symbol and date (last row wins)."""
    df = keep_last(coerce_bars(raw), ["symbol", "date"], [order]).drop(order)
    df = df.withColumns({c: S.finite(c) for c in FIELDS})
    return df.where("date is not null").dropna(subset=list(FIELDS))


def canonicalize(raw, cutoff, order="seq"):
    """Dated rows up to the cutoff, one per symbol and date (last row wins)."""
    df = coerce_bars(raw).where(F.col("date") <= F.lit(cutoff).cast("date"))
    return keep_last(df, ["symbol", "date"], [order]).drop(order)


def validate_bars(bars, universe, cutoff=None, min_rows=30, holidays=()):
    """Error codes of every symbol of the universe, as an array.

    Rows are folded per (symbol, date) and then per symbol, both map-side
    combined, so a symbol with very many rows costs no more than its dates.
    """
    v = {c: F.col(c) for c in FIELDS}
    missing = [v[c].isNull() | F.isnan(v[c]) for c in FIELDS]
    infinite = [F.abs(v[c]) == float("inf") for c in FIELDS]
    any_of = lambda conds: F.coalesce(F.greatest(*[F.coalesce(c, F.lit(False)) for c in conds]), F.lit(False))
    flags = {
        "nan": any_of(missing), "inf": any_of(missing + infinite), "neg": F.coalesce(v["volume"] < 0, F.lit(False)),
        "hi": F.coalesce(v["high"] < F.greatest(v["open"], v["close"]), F.lit(False)),
        "lo": F.coalesce(v["low"] > F.least(v["open"], v["close"]), F.lit(False)),
        "pos": any_of([v[c] <= 0 for c in PRICES]), "nodate": F.col("date").isNull()}
    day = bars.groupBy("symbol", "date").agg(
        F.count("*").alias("n"), *[F.max(f).alias(k) for k, f in flags.items()])
    per = day.groupBy("symbol").agg(
        F.sum("n").alias("n"), F.max("date").alias("data_date"), F.max(F.col("n") > 1).alias("dup"),
        *[F.max(k).alias(k) for k in flags])
    cut = F.lit(cutoff).cast("date")
    df = universe.select("symbol").distinct().join(per, "symbol", "left")
    dated = ~F.col("nodate")
    codes = [
        (F.col("n") < min_rows, F.concat(F.lit("TOO_FEW_ROWS:"), F.col("n").cast("string"))),
        (F.col("nan"), F.lit("NAN_OHLCV")), (F.col("inf"), F.lit("NONFINITE_OHLCV")),
        (F.col("neg"), F.lit("NEGATIVE_VOLUME")), (F.col("hi"), F.lit("HIGH_LT_OPEN_CLOSE")),
        (F.col("lo"), F.lit("LOW_GT_OPEN_CLOSE")), (F.col("pos"), F.lit("NONPOSITIVE_PRICE")),
        (F.col("nodate"), F.lit("INVALID_DATE_INDEX")), (dated & F.col("dup"), F.lit("DUPLICATE_DATE_INDEX"))]
    if cutoff is not None:
        codes += [(dated & (F.col("data_date") > cut), F.lit("FUTURE_DATA")),
                  (dated & ~S.is_session(cut, holidays), F.lit("NON_TRADING_DAY_CUTOFF"))]
    found = F.array_compact(F.array(*[F.when(c, e) for c, e in codes]))
    errors = F.when(F.col("n").isNull(), F.array(F.lit("EMPTY_DATA"))).otherwise(found)
    return df.select("symbol", F.coalesce("n", F.lit(0)).alias("rows"), "data_date", errors.alias("errors"))


def snapshot_status(raw, universe, cutoff, min_rows=60, holidays=()):
    """Usability of each symbol's data at the cutoff."""
    checked = validate_bars(canonicalize(raw, cutoff), universe, cutoff, min_rows, holidays)
    session = S.is_session(F.lit(cutoff).cast("date"), holidays)
    return checked.select(
        "symbol", F.lit(cutoff).cast("date").alias("requested_cutoff"),
        F.when(session, F.col("data_date")).alias("data_date"),
        F.when(session, F.col("rows")).otherwise(F.lit(0)).alias("rows"),
        F.when(~session, "INVALID_CUTOFF")
        .when((F.size("errors") == 0) & F.col("data_date").isNotNull(), "OK").otherwise("INVALID").alias("status"),
        F.when(session, F.col("errors")).otherwise(F.array(F.lit("NON_TRADING_DAY_CUTOFF"))).alias("errors"))


def quality_gate(validation, minimum=50, strict=False):
    """One status row: enough symbols with data, enough of them valid.

    In strict mode any failed or missing symbol fails the gate.
    """
    has = F.col("rows") > 0
    ok = F.size("errors") == 0
    df = validation.agg(F.count("*").alias("sampled"), F.count_if(has).alias("covered"),
                        F.count_if(ok).alias("validated"), F.count_if(~ok).alias("failed"))
    need = F.least(F.lit(minimum), F.col("sampled"))
    if strict:
        status = F.when(F.col("failed") > 0, "FAIL").otherwise("PASS")
    else:
        status = (F.when((F.col("covered") < need) | (F.col("validated") < need), "FAIL")
                  .when(F.col("failed") > 0, "PASS_WITH_WARNINGS").otherwise("PASS"))
    return df.withColumn("status", status)


def liquidity_score(bars, window=60, min_rows=20, min_value=K.MIN_TRADED_VALUE, min_price=K.MIN_PRICE):
    """Score from the traded value of the last bars of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    recent = bars.select("symbol", "date", "close", (F.col("close") * F.col("volume")).alias("_v"),
                         F.row_number().over(w).alias("_k")).where(F.col("_k") <= window)
    per = recent.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("_v").alias("avg_value"),
                                       F.max_by("close", "date").alias("last_price"))
    poor = (F.col("n") < min_rows) | (F.col("avg_value") < min_value) | (F.col("last_price") < min_price)
    score = F.least(F.log10(F.greatest("avg_value", F.lit(1.0))) * 8, F.lit(100.0))
    return per.select("symbol", "avg_value", "last_price",
                      F.when(poor, 0.0).otherwise(score).alias("liquidity_score"))


def liquid_universe(scores, cap=K.MAX_UNIVERSE):
    """Symbols with a positive score, the best ``cap`` of them."""
    return scores.where("liquidity_score > 0").orderBy(F.desc("liquidity_score"), "symbol").limit(cap)


def data_cutoff(bars, reference, min_fraction=0.5, min_symbols=5, fallback=None):
    """Latest date before the reference that enough symbols cover."""
    ref = F.lit(reference).cast("date")
    total = F.greatest(bars.select("symbol").distinct().agg(F.count("*")).scalar(), F.lit(1))
    need = F.greatest(F.lit(min_symbols), F.ceil(total * min_fraction))
    days = bars.where(F.col("date") < ref).groupBy("date").agg(F.count_distinct("symbol").alias("symbols"))
    fb = F.lit(fallback).cast("date")
    return days.where(F.col("symbols") >= need).agg(
        F.coalesce(F.max("date"), F.when(fb < ref, fb)).alias("data_cutoff"))


def session_dates(index_bars, reference):
    """Last completed session: before the day (morning), up to it (evening)."""
    ref = F.lit(reference).cast("date")
    return index_bars.agg(
        F.max(F.when(F.col("date") < ref, F.col("date"))).alias("morning_session"),
        F.max(F.when(F.col("date") <= ref, F.col("date"))).alias("evening_session"))


def trading_calendar(spark, first, last, holidays=()):
    """Numbered sessions of a date range (one row per day of the calendar)."""
    days = spark.range(1).select(F.explode(F.sequence(
        F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    return (days.where(S.is_session("date", holidays))
            .withColumn("session", F.row_number().over(Window.orderBy("date")).cast("bigint")))


def next_sessions(df, date, steps, calendar, name="target_date"):
    """The n-th session after each row's date (which need not be a session)."""
    first = calendar.agg(F.min("date").alias("d")).first()["d"]
    last = calendar.agg(F.max("date").alias("d")).first()["d"]
    days = calendar.sparkSession.range(1).select(F.explode(F.sequence(
        F.lit(first), F.lit(last))).alias("_cal_day"))
    upto = days.join(calendar, days["_cal_day"] == calendar["date"], "left").select(
        "_cal_day", F.last("session", ignorenulls=True).over(
            Window.orderBy("_cal_day").rowsBetween(Window.unboundedPreceding, 0)).alias("_s"))
    target = calendar.select((F.col("session")).alias("_t"), F.col("date").alias(name))
    return (df.join(upto, df[date] == upto["_cal_day"], "left").withColumn("_t", F.col("_s") + steps)
            .join(target, "_t", "left").drop("_cal_day", "_s", "_t"))


def _frame_errors(df, checks):
    """One row: flag and the codes whose aggregate condition holds."""
    agg = df.agg(F.count("*").alias("rows"), *[c.alias(f"_e{i}") for i, (c, _) in enumerate(checks)])
    codes = F.array_compact(F.array(*[F.when(F.col(f"_e{i}"), F.lit(e) if isinstance(e, str) else e)
                                      for i, (_, e) in enumerate(checks)]))
    return agg, codes


def _repeats(df, key, normal):
    """Number of key values that occur more than once (two partial aggregates)."""
    return df.groupBy(normal(F.col(key)).alias("_k")).count().where("count > 1").agg(F.count("*")).scalar()


def validate_predictions(df, expected_n=None):
    """Integrity of a prediction frame, one row with error codes."""
    need = ["symbol", "pred_open", "pred_high", "pred_low", "pred_close"]
    absent = [c for c in need if c not in df.columns]
    bad = lambda c: F.coalesce(F.max(S.finite(c).isNull()), F.lit(False))
    checks = [(F.lit(c in absent), f"MISSING:{c}") for c in absent]
    if "symbol" not in absent:
        checks.append((F.lit(0) < _repeats(df, "symbol", lambda c: F.upper(F.trim(c))), "DUPLICATE_SYMBOLS"))
    checks += [(bad(c), f"INVALID:{c}") for c in need[1:] if c not in absent]
    if not set(need[1:]) & set(absent):
        checks += [(F.coalesce(F.max(F.col("pred_high") < F.greatest("pred_open", "pred_close")), F.lit(False)), "PRED_HIGH_INVALID"),
                   (F.coalesce(F.max(F.col("pred_low") > F.least("pred_open", "pred_close")), F.lit(False)), "PRED_LOW_INVALID")]
    if expected_n is not None:
        checks.append((F.count("*") > expected_n, F.concat(
            F.lit("TOP_N_EXCEEDED:"), F.col("rows").cast("string"), F.lit(f">{int(expected_n)}"))))
    agg, codes = _frame_errors(df, checks)
    return agg.select("rows", F.when(F.col("rows") == 0, F.array(F.lit("EMPTY_PREDICTIONS"))).otherwise(codes).alias("errors"))


def validate_portfolio(df):
    """Integrity of a portfolio frame, one row with error codes."""
    need = ["ticker", "quantity", "average_price", "current_price", "decision"]
    checks = [(F.lit(True), f"MISSING:{c}") for c in need if c not in df.columns]
    if "ticker" in df.columns:
        checks.append((F.lit(0) < _repeats(df, "ticker", lambda c: c), "DUPLICATE_TICKER"))
    if "quantity" in df.columns:
        checks.append((F.coalesce(F.max(F.col("quantity") < 0), F.lit(False)), "NEGATIVE_QUANTITY"))
    agg, codes = _frame_errors(df, checks)
    return agg.select("rows", F.when(F.col("rows") == 0, F.array(F.lit("EMPTY_PORTFOLIO"))).otherwise(codes).alias("errors"))


def validate_ledger(df, by=(), top_n=K.TOP_N, per_bucket=K.MAX_PER_BUCKET):
    """True where a prediction ledger may be stored, per value of ``by``."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    odd = blank("prediction_id") | F.lower("prediction_id").isin("nan", "none") | (F.length("prediction_id") < 2)
    prices = [F.col(f"pred_{c}") for c in PRICES]
    holes = F.greatest(*[S.finite(p).isNull() for p in prices])
    o, h, l, c = prices
    shape = ~((l <= F.least(o, c)) & (h >= F.greatest(o, c)))
    per = df.groupBy(*by, "price_bucket").agg(
        F.count("*").alias("n"), F.max(blank("symbol") | odd | holes | F.coalesce(shape, F.lit(True))).alias("bad"))
    counts = df.groupBy(*by).agg(F.count_distinct("symbol").alias("symbols"),
                                 F.count_distinct("prediction_id").alias("ids"))
    whole = per.groupBy(*by).agg(F.sum("n").alias("rows"), F.max("n").alias("largest_bucket"), F.max("bad").alias("bad"))
    joined = whole.join(counts, list(by)) if by else whole.withColumns(
        {c: counts.select(c).scalar() for c in ("symbols", "ids")})
    ok = (~F.col("bad") & (F.col("rows") <= top_n) & (F.col("symbols") == F.col("rows"))
          & (F.col("ids") == F.col("rows")) & (F.col("largest_bucket") <= per_bucket))
    return joined.select(*by, "rows", "symbols", "ids", "largest_bucket", ok.alias("valid"))


DECISION_TEXT = ("prediction_id", "prediction_date", "evaluation_date", "symbol", "price_bucket", "action", "outcome")
DECISION_NUMBERS = ("decision_score", "confidence", "expected_return", "prediction_uncertainty", "technical_score",
                    "entry_price", "predicted_close", "actual_open", "actual_high", "actual_low", "actual_close",
                    "return_pct", "mfe_pct", "mae_pct", "direction_correct")


def backfill_decisions(df):
    """Decision ledger with every expected column, typed, and ids for old rows."""
    have = set(df.columns)
    text = {c: (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")) for c in DECISION_TEXT}
    nums = {c: (S.text_number(F.col(c).cast("string")) if c in have else F.lit(None).cast("double")) for c in DECISION_NUMBERS}
    out = df.select(*[e.alias(c) for c, e in {**text, **nums}.items()])
    blank = F.trim("prediction_id").isin("", "nan", "None")
    return out.withColumn("prediction_id", F.when(blank, S.legacy_id("prediction_date", "symbol"))
                          .otherwise(F.col("prediction_id")))


def backfill_bucket(df, label=S.legacy_price_bucket):
    """Fill missing price buckets from the first price column the frame has."""
    have = F.col("price_bucket") if "price_bucket" in df.columns else F.lit(None).cast("string")
    missing = have.isNull() | F.trim(have).isin("", "nan", "None", "-")
    source = next((c for c in ("current_price", "pred_close", "current_close") if c in df.columns), None)
    value = F.when(missing, label(F.col(source))) if source else F.lit(None)
    return df.withColumn("price_bucket", F.coalesce(value, have, F.lit("-")))


def repair_ohlc(df, prefix="pred_"):
    """Widen high and low so that they bracket open and close."""
    o, h, l, c = (F.col(f"{prefix}{x}") for x in PRICES)
    return df.withColumns({f"{prefix}high": F.greatest(h, o, c), f"{prefix}low": F.least(l, o, c)})
