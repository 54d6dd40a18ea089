"""Joins of predictions, bars, holdings and lookups.

No side is force-broadcast: Spark broadcasts a side when its measured size is
under spark.sql.autoBroadcastJoinThreshold and sort-merges (with AQE skew
splitting) otherwise.
"""
from pyspark.sql import Window, functions as F

from barloom import constants as K
from barloom.functions import scalars as S
from barloom.functions.rolling import series

PRICES = ("open", "high", "low", "close")
FIELDS = PRICES + ("volume",)


def lookup(df, table, key, columns):
    """Left lookup on ``key``; ``columns`` maps a column to its default."""
    side = table.select(key, *columns).dropDuplicates([key])
    joined = df.drop(*[c for c in columns if c in df.columns]).join(side, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in columns.items() if d is not None})


def latest_at(bars, cutoff=None, columns=FIELDS):
    """Latest bar of each symbol dated at or before the cutoff."""
    if cutoff is not None:
        bars = bars.where(F.col("date") <= F.lit(cutoff).cast("date"))
    return (bars.groupBy("symbol")
            .agg(F.max("date").alias("date"), *[F.max_by(c, "date").alias(c) for c in columns]))


def asof_join(left, right, on, left_time, right_time, columns, strict=False):
    """For each left row the latest right row at (or, strict, before) its time.

    The distinct (key, time) pairs of the left and the right rows are put in one
    time-ordered window per key, so there is no range join and no pair is ever
    formed; both sides hold a key at most once per time step, which bounds the
    window by the calendar even when one key carries most left rows. The result
    goes back to the left rows by an equi-join.
    """
    times = left.select(on, F.col(left_time).alias("_t")).distinct()
    points = right.groupBy(on, F.col(right_time).alias("_t")).agg(
        F.max(F.struct(right_time, *columns)).alias("_r"))
    # at equal times a strict join must see the left row first
    probe = times.select(on, "_t", F.lit(0 if strict else 1).alias("_k"), F.lit(None).cast(
        points.schema["_r"].dataType).alias("_r"))
    both = probe.unionByName(points.select(on, "_t", F.lit(1 if strict else 0).alias("_k"), "_r"))
    w = Window.partitionBy(on).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    found = (both.withColumn("_m", F.last("_r", ignorenulls=True).over(w))
             .where(F.col("_k") == (0 if strict else 1))
             .select(on, F.col("_t").alias(left_time), F.col(f"_m.{right_time}").alias(f"asof_{right_time}"),
                     *[F.col(f"_m.{c}").alias(f"asof_{c}") for c in columns]))
    return left.join(found, [on, left_time], "left")


def evaluate_predictions(ledger, bars):
    """Ledger rows joined to the bar of their session, with signed errors."""
    actual = bars.select("symbol", F.col("date").alias("run_date"),
                         *[F.col(c).alias(f"actual_{c}") for c in FIELDS])
    return signed_errors(ledger.join(actual, ["symbol", "run_date"]))


def signed_errors(df):
    """Errors of ledger rows that hold the bar of their session as actual_<field>."""
    df = df.select(
        "prediction_id", F.col("run_date").alias("market_date"), F.col("run_date").alias("prediction_date"),
        "symbol", "price_bucket", *[f"pred_{c}" for c in FIELDS],
        *[f"actual_{c}" for c in FIELDS],
        F.col("current_price").alias("previous_close"), F.col("direction").alias("pred_direction"),
        S.direction_of_prices("current_price", "actual_close").alias("actual_direction"),
        F.col("confidence").alias("prediction_confidence"), "prediction_uncertainty_pct")
    return df.withColumns({
        "direction_correct": F.col("pred_direction") == F.col("actual_direction"),
        **{f"diff_{c}": F.col(f"actual_{c}") - F.col(f"pred_{c}") for c in FIELDS},
        **{f"ape_{c}": S.relative_error(f"actual_{c}", f"pred_{c}") for c in FIELDS}})


def forward_bars(bars, horizons):
    """Each bar with the date and close of the bars h sessions later, as an array."""
    steps = [F.struct(F.lit(h).alias("horizon_days"), F.lead("date", h).over(series()).alias("date"),
                      F.lead("close", h).over(series()).alias("close")) for h in horizons]
    return bars.select("symbol", "date", F.array(*steps).alias("ahead"))


def evaluate_horizons(ledger, bars, base="cutoff_date", horizons=K.HORIZONS, market_date=None):
    """Forecasts of every horizon against the bar h sessions after the base date.

    Sessions are counted in the symbol's own calendar. ``base`` is the date the
    sessions are counted from: the cutoff the forecast was made at (default) or
    the run date. One window numbers the future of every bar, one equi-join
    attaches it to the ledger, and horizons are unfolded after the join, so the
    shuffle carries each prediction once and not once per horizon.
    """
    ahead = forward_bars(bars, horizons).withColumnRenamed("date", base)
    return horizon_errors(ledger.join(ahead, ["symbol", base]), horizons, market_date)


def horizon_errors(df, horizons=K.HORIZONS, market_date=None):
    """Forecasts of every horizon of ledger rows that hold their later bars as ``ahead``."""
    stated = [F.struct(F.lit(h).alias("h"), F.col(f"horizon_{h}d").alias("ret"),
                       (F.col(f"horizon_{h}d_pred_close") if f"horizon_{h}d_pred_close" in df.columns
                        else F.lit(None).cast("double")).alias("close")) for h in horizons]
    # a single horizon is taken as it lies in the row, nothing is unfolded
    pairs = ([F.get("ahead", F.lit(0)).alias("a"), stated[0].alias("s")] if len(horizons) == 1 else
             [F.inline(F.arrays_zip(F.col("ahead").alias("a"), F.array(*stated).alias("s")))])
    df = df.select("symbol", F.col("run_date").alias("prediction_date"), "current_price", "confidence", "price_bucket", *pairs)
    cur = F.col("current_price")
    predicted = F.coalesce(F.col("s.close"), F.when(cur != 0, cur * (1 + F.coalesce(
        F.col("s.ret"), F.lit(0.0)) / 100)))
    df = df.where(F.col("a.close").isNotNull()).select(
        F.col("a.date").alias("evaluated_date"), "symbol", "prediction_date",
        F.col("s.h").cast("bigint").alias("horizon_days"), predicted.alias("pred_close"),
        F.col("a.close").alias("actual_close"), F.col("confidence").alias("prediction_confidence"),
        "price_bucket", "current_price")
    if market_date is not None:
        df = df.where(F.col("evaluated_date") == F.lit(market_date).cast("date"))
    df = df.where(F.col("pred_close").isNotNull()).withColumns({
        "diff": F.col("actual_close") - F.col("pred_close"),
        "ape": S.relative_error("actual_close", "pred_close"),
        "expected_return": F.coalesce((S.ratio("pred_close", "current_price") - 1) * 100, F.lit(0.0)),
        "actual_return": F.coalesce((S.ratio("actual_close", "current_price") - 1) * 100, F.lit(0.0))})
    same = F.signum("expected_return") == F.signum("actual_return")
    return df.withColumn("direction_correct", same).drop("current_price")


def close_decisions(decisions, bars, prediction_ids=None):
    """Outcome of open decisions from the bar of their prediction date."""
    if prediction_ids is not None:
        decisions = decisions.join(prediction_ids.select("prediction_id"), "prediction_id", "left_semi")
    actual = bars.select("symbol", F.col("date").alias("prediction_date"),
                         *[F.col(c).alias(f"actual_{c}") for c in PRICES])
    df = decisions.where((F.col("outcome") == "OPEN") & (F.col("entry_price") > 0)).join(
        actual, ["symbol", "prediction_date"])
    gain = {n: (F.col(f"actual_{c}") / F.col("entry_price") - 1) * 100
            for n, c in (("return_pct", "close"), ("mfe_pct", "high"), ("mae_pct", "low"))}
    df = df.withColumns({"evaluation_date": F.col("prediction_date"), **gain})
    r, act = F.col("return_pct"), F.upper("action")
    side = F.when(act == "BUY", 1).when(act == "AVOID", -1).otherwise(0)
    return df.withColumns({
        "outcome": F.when(side * r > 0, "WIN").when(side * r < 0, "LOSS").otherwise("NEUTRAL"),
        "direction_correct": F.when(F.col("predicted_close").isNotNull(), (
            F.signum(r) == F.signum(F.col("predicted_close") - F.col("entry_price"))).cast("double"))})


def evaluate_jumps(targets, bars, sessions=K.JUMP_SESSIONS):
    """First session in which a forward window of bars reaches the target."""
    w = series()
    highs = F.array(*[F.lead("high", k).over(w) for k in range(1, sessions + 1)])
    ahead = bars.select("symbol", F.col("date").alias("prediction_date"),
                        F.filter(highs, lambda h: h.isNotNull()).alias("highs"))
    df = targets.join(ahead, ["symbol", "prediction_date"])
    marks = F.transform("highs", lambda h: h >= F.col("target_level"))
    first = F.array_position(marks, True)
    seen = F.size("highs")
    return df.select(
        "symbol", "prediction_date", (first > 0).alias("hit"),
        F.when(first > 0, first).cast("bigint").alias("days_to_hit"),
        F.when(seen > 0, (F.array_max("highs") / F.col("current_price") - 1) * 100).alias("max_upside"),
        seen.cast("bigint").alias("observation_days"))


def forward_window(left, bars, sessions, base="prediction_date"):
    """The first ``sessions`` bars after each left row's date, one row each."""
    w = series()
    steps = F.array(*[F.struct(F.lit(k).alias("step"), F.lead("date", k).over(w).alias("bar_date"),
                               F.lead("high", k).over(w).alias("high"), F.lead("close", k).over(w).alias("close"))
                      for k in range(1, sessions + 1)])
    ahead = bars.select("symbol", F.col("date").alias(base), steps.alias("_s"))
    return (left.join(ahead, ["symbol", base]).select(*left.columns, F.inline("_s"))
            .where(F.col("bar_date").isNotNull()))


def attach_latest_predictions(holdings, predictions):
    """Left join holdings to predictions on the normalized symbol."""
    side = predictions.select(S.normalize_symbol("symbol").alias("_s"),
                              *[F.col(c).alias(f"{c}_prediction" if c in holdings.columns else c)
                                for c in predictions.columns]).dropDuplicates(["_s"])
    return (holdings.withColumn("_s", S.normalize_symbol("ticker"))
            .join(side, "_s", "left").drop("_s"))


def prefer_canonical(keys, canonical, fallback, columns, key="symbol"):
    """Values of the canonical row where one exists, else of the fallback row."""
    first = canonical.select(key, *[F.col(c).alias(f"_c_{c}") for c in columns], F.lit(True).alias("_c"))
    second = fallback.select(key, *[F.col(c).alias(f"_f_{c}") for c in columns], F.lit(True).alias("_f"))
    df = keys.join(first, key, "left").join(second, key, "left")
    return df.select(
        *keys.columns,
        *[F.when(F.col("_c"), F.col(f"_c_{c}")).otherwise(F.col(f"_f_{c}")).alias(c) for c in columns],
        F.when(F.col("_c"), "CANONICAL").when(F.col("_f"), "FALLBACK").alias("prediction_source"))


def with_context(df, context):
    """Attach the columns of a one-row frame by scalar subqueries (no cross join)."""
    return df.withColumns({c: context.select(c).scalar() for c in context.columns})


def cross_horizons(df, horizons=K.HORIZONS):
    """One row per input row and horizon, unfolded in place (no join, no shuffle)."""
    return df.withColumn("horizon_days", F.explode(F.array(*[F.lit(int(h)).cast("bigint") for h in horizons])))
