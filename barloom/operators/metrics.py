"""Accuracy, calibration, drift and economic metrics of evaluated predictions."""
from pyspark.sql import Window, functions as F

from barloom import constants as K
from barloom.functions import scalars as S
from barloom.operators.joins import PRICES


def hits(c="direction_correct"):
    """Share of true values in percent."""
    return F.avg(F.col(c).cast("double")) * 100


def mape(c):
    return F.avg(F.abs(F.col(c)))


def stock_reliability(evaluation):
    """Error and direction accuracy of each symbol."""
    df = evaluation.groupBy("symbol").agg(
        F.count("*").alias("samples"), *[mape(f"ape_{c}").alias(f"mape_{c}") for c in PRICES],
        hits().alias("direction_accuracy"))
    total = sum((F.col(f"mape_{c}") for c in PRICES), F.lit(0.0))
    return df.withColumn("mape", total / len(PRICES))


def error_summary(df, groups=()):
    """Sample count, MAPE of every field, mean of the four prices, direction accuracy."""
    out = df.groupBy(*groups).agg(
        F.count("*").alias("samples"), *[mape(f"ape_{c}").alias(f"{c}_mape") for c in PRICES + ("volume",)],
        hits().alias("direction_accuracy"))
    total = sum((F.col(f"{c}_mape") for c in PRICES), F.lit(0.0))
    return out.withColumn("overall_mape", total / len(PRICES))


def daily_metrics(evaluation):
    return error_summary(evaluation, ["market_date"])


def with_net_returns(evaluation, cost=K.COST_PCT):
    """Cost-adjusted return of following the predicted direction, and of holding."""
    priced = evaluation.where((F.col("actual_close") > 0) & (F.col("previous_close") > 0) & F.col("pred_close").isNotNull())
    gross = (F.col("pred_close") / F.col("previous_close") - 1) * 100
    realized = (F.col("actual_close") / F.col("previous_close") - 1) * 100
    df = priced.withColumns({"ai_gross_return_pct": gross, "realized_return_pct": realized})
    df = df.withColumns({
        "ai_net_return_pct": F.signum("ai_gross_return_pct") * F.col("realized_return_pct") - cost,
        "baseline_net_return_pct": F.col("realized_return_pct") - cost})
    return df.withColumn("ai_outperforms", F.col("ai_net_return_pct") > F.col("baseline_net_return_pct"))


def with_equity(df, returns, leverage=1.0, key="symbol", order="market_date"):
    """Compounded equity, its running peak and the drawdown in percent."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("equity", F.product(1 + F.col(returns) * leverage / 100).over(w))
    df = df.withColumn("peak", F.max("equity").over(w))
    return df.withColumn("drawdown_pct", (S.ratio("equity", "peak") - 1) * 100)


def error_metrics(df, actual, predicted, groups=()):
    """MAPE and normalized mean absolute error over finite pairs."""
    a, p = S.finite(actual), S.finite(predicted)
    ok = a.isNotNull() & p.isNotNull()
    gap = F.when(ok, F.abs(a - p))
    size = F.when(ok, F.abs(a))
    return df.groupBy(*groups).agg(
        F.count(gap).alias("samples"), (F.avg(gap / F.greatest(size, F.lit(1e-8))) * 100).alias("mape"),
        (F.avg(gap) / F.greatest(F.avg(size), F.lit(1e-8))).alias("normalized_mae"))


def cumulative_metrics(evaluation):
    out = error_summary(evaluation)
    return out.withColumn("model_accuracy", S.accuracy_from_mape("close_mape"))


def accuracy_by(df, keys, ape="ape"):
    """Samples, MAPE, mean point accuracy and direction accuracy per group."""
    return df.groupBy(*keys).agg(
        F.count(ape).alias("samples"), mape(ape).alias("mape"), F.avg(S.point_accuracy(ape)).alias("accuracy"),
        S.accuracy_from_mape(mape(ape)).alias("mape_accuracy"), hits().alias("direction_accuracy"))


def worst_symbol(evaluation):
    """Symbol with the largest mean error (first by name among equals)."""
    per = evaluation.groupBy("symbol").agg(mape("ape_close").alias("mape")).where("mape is not null")
    return per.orderBy(F.desc("mape"), "symbol").limit(1)


def bucket_summary(evaluation):
    """Buckets in order of error; the first is the best, the last the worst."""
    per = accuracy_by(evaluation, ["price_bucket"], "ape_close").select("price_bucket", "samples", "mape", "direction_accuracy")
    w = Window.orderBy("mape", "price_bucket")  # a handful of buckets
    return per.withColumn("place", F.row_number().over(w).cast("bigint"))


def horizon_summary(horizon_evaluation, days=14):
    """Per horizon and per bucket and horizon, over the last days, in one pass."""
    last = horizon_evaluation.agg(F.date_sub(F.max("evaluated_date"), days)).scalar()
    recent = horizon_evaluation.where(F.col("evaluated_date") >= last)
    h, b = F.col("horizon_days"), F.col("price_bucket")
    return recent.groupingSets([[h], [b, h]], b, h).agg(
        F.count("*").alias("samples"), mape("ape").alias("mape"), F.avg(S.point_accuracy("ape")).alias("accuracy"),
        hits().alias("direction_accuracy"))


def confidence_bands(evaluation):
    c = F.col("prediction_confidence")
    band = F.when(c >= 101, None).when(c >= 80, "High").when(c >= 60, "Medium").when(c >= -1, "Low")
    return (evaluation.withColumn("band", band).where("band is not null").groupBy("band")
            .agg(F.count("*").alias("samples"), mape("ape_close").alias("mape"), hits().alias("direction_accuracy")))


def error_distribution(evaluation, limits=(1, 2, 3, 5)):
    """Whole percent of rows whose error is within each limit."""
    e = F.abs("ape_close")
    out = evaluation.where("ape_close is not null").agg(
        *[F.bround(F.avg((e <= k).cast("double")) * 100).cast("bigint").alias(f"_w{k}") for k in limits])
    return out.select(F.inline(F.array(*[F.struct(F.lit(k).cast("bigint").alias("limit_pct"), F.col(f"_w{k}").alias("within_pct"))
                                         for k in limits])))


def wilson_interval(successes, total, z=1.96):
    """Bounds of the Wilson score interval, in percent."""
    n = F.nullif(S.col(total).cast("double"), F.lit(0.0))
    p = S.col(successes) / n
    den = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / den
    half = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / den
    return (F.when(n.isNotNull(), F.greatest((mid - half) * 100, F.lit(0.0))),
            F.when(n.isNotNull(), F.least((mid + half) * 100, F.lit(100.0))))


CALIBRATION_EDGES = (50, 60, 70, 80, 90)


def calibration(evaluation):
    """Expected calibration error over right-closed confidence bins, bias and status."""
    df = evaluation.select(S.clamp("prediction_confidence").alias("c"), S.point_accuracy("ape_close").alias("o")).dropna()
    b = F.lit(len(CALIBRATION_EDGES))
    for i, e in reversed(list(enumerate(CALIBRATION_EDGES))):
        b = F.when(F.col("c") <= e, i).otherwise(b)
    bins = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.sum("o").alias("o"))
    out = bins.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("samples"), F.sum(F.abs(F.col("c") - F.col("o"))).alias("_e"),
                   F.sum(F.col("c") - F.col("o")).alias("_b"))
    ece = F.col("_e") / F.nullif("samples", F.lit(0))
    return out.select("samples", ece.alias("ece"), (F.col("_b") / F.nullif("samples", F.lit(0))).alias("bias"),
                      F.when(F.col("samples") == 0, "UNKNOWN").when(F.col("samples") < K.EVIDENCE_SAMPLES, "LOW EVIDENCE")
                      .when(ece <= 5, "CALIBRATED").when(ece <= 10, "WATCH").otherwise("MIS-CALIBRATED").alias("calibration"))


def error_drift(evaluation, recent=5, before=20):
    """Error of the latest rows against the rows before them.

    Only the last recent + before rows are ordered (a distributed top-k).
    """
    rows = evaluation.where("ape_close is not null").select("market_date", "symbol", F.abs("ape_close").alias("e"))
    tail = rows.orderBy(F.desc("market_date"), F.desc("symbol")).limit(recent + before)
    k = F.row_number().over(Window.orderBy(F.desc("market_date"), F.desc("symbol")))
    out = tail.withColumn("_k", k).agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("_k") <= recent, F.col("e"))).alias("recent_mape"),
        F.avg(F.when(F.col("_k") > recent, F.col("e"))).alias("baseline_mape"))
    few = F.col("n") < 3
    r = (F.col("recent_mape") - F.col("baseline_mape")) / F.greatest(F.col("baseline_mape"), F.lit(1e-9))
    d = K.DRIFT_THRESHOLD
    return out.select(
        F.when(few | F.col("baseline_mape").isNull(), "UNKNOWN").when(r >= d, "HIGH").when(r >= d / 2, "MEDIUM")
        .when(r <= -d / 2, "IMPROVING").otherwise("LOW").alias("drift"),
        F.when(~few, r).alias("drift_ratio"), F.when(~few, F.col("recent_mape")).alias("recent_mape"),
        F.when(~few, F.col("baseline_mape")).alias("baseline_mape"))


def feature_drift(df, is_current, columns, threshold=K.DRIFT_THRESHOLD):
    """Relative shift of the mean of each column between two parts of a frame, in one pass."""
    out = df.agg(*[F.avg(F.when(~is_current, F.col(c))).alias(f"_a_{c}") for c in columns],
                 *[F.avg(F.when(is_current, F.col(c))).alias(f"_b_{c}") for c in columns])
    shift = lambda c: F.abs(F.col(f"_b_{c}") - F.col(f"_a_{c}")) / F.greatest(F.abs(F.col(f"_a_{c}")), F.lit(1e-6))
    return out.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), shift(c).alias("shift"),
                                                  (shift(c) > threshold).alias("drift")) for c in columns])))


def model_report(evaluation):
    """Accuracy now and before the last session, trends, drift, calibration, health."""
    last = evaluation.agg(F.max("market_date")).scalar()
    e = F.abs("ape_close")
    base = evaluation.agg(
        F.count("*").alias("samples"), S.accuracy_from_mape(F.avg(e)).alias("current_accuracy"),
        S.accuracy_from_mape(F.avg(F.when(F.col("market_date") < last, e))).alias("previous_accuracy"),
        hits().alias("direction_accuracy"))
    daily = evaluation.groupBy("market_date").agg(S.accuracy_from_mape(mape("ape_close")).alias("a")).where("a is not null")
    tail = daily.orderBy(F.desc("market_date")).limit(30).withColumn("_k", F.row_number().over(Window.orderBy(F.desc("market_date"))))
    trend = tail.agg(F.avg(F.when(F.col("_k") <= 7, F.col("a"))).alias("trend_7"), F.avg("a").alias("trend_30"))
    from barloom.operators.joins import with_context
    for part in (trend, error_drift(evaluation), calibration(evaluation).drop("samples"),
                 worst_symbol(evaluation).select(F.col("symbol").alias("worst_symbol"), F.col("mape").alias("worst_mape"))):
        base = with_context(base, part)
    acc = F.col("current_accuracy")
    health = (F.when(acc.isNull(), "NO VALIDATION")
              .when((acc >= 75) & ~F.col("drift").isin("HIGH", "MEDIUM") & (F.col("calibration") != "MIS-CALIBRATED"), "HEALTHY")
              .when(acc >= 65, "WATCH").otherwise("NEEDS REVIEW"))
    return base.withColumn("health", health)


def weekly_performance(daily, decisions, sessions=5):
    """Means of the last sessions, change of the last two, health score."""
    tail = daily.orderBy(F.desc("market_date")).limit(sessions).withColumn("_k", F.row_number().over(Window.orderBy(F.desc("market_date"))))
    at = lambda c, k: F.max(F.when(F.col("_k") == k, F.col(c)))
    out = tail.agg(
        F.count("*").alias("days"), F.max("market_date").alias("latest_day"), F.sum("samples").alias("samples"),
        *[F.avg(c).alias(c) for c in ("open_mape", "high_mape", "low_mape", "close_mape", "overall_mape", "direction_accuracy")],
        (at("close_mape", 1) - at("close_mape", 2)).alias("close_mape_change"),
        (at("direction_accuracy", 1) - at("direction_accuracy", 2)).alias("direction_change"))
    win = F.coalesce(decisions.select("win_rate").scalar(), F.lit(50.0))
    return out.withColumn("health_score", S.weighted([
        (0.35, F.greatest(100 - F.least(F.col("close_mape") * 10, F.lit(100.0)), F.lit(0.0))), (0.35, F.col("direction_accuracy")),
        (0.15, F.least(F.col("days") * 20.0, F.lit(100.0))), (0.15, win)]))


def decision_summary(closed, days=30):
    """Win rate and mean return of the latest closed decisions."""
    tail = closed.where("outcome <> 'OPEN'").orderBy(F.desc("evaluation_date"), F.desc("prediction_id")).limit(max(days * 25, days))
    return tail.agg(
        F.count("*").alias("samples"), (F.avg((F.col("outcome") == "WIN").cast("double")) * 100).alias("win_rate"),
        F.avg("return_pct").alias("avg_return"), F.count_if(F.col("action") == "BUY").alias("buy"),
        F.count_if(F.col("action") == "NO TRADE").alias("no_trade"))


def economic_performance(evaluation):
    """Compounded result of following the predictions, per symbol."""
    df = with_equity(with_net_returns(evaluation), "ai_net_return_pct")
    r = F.col("ai_net_return_pct")
    loss = F.sum(F.when(r < 0, r))
    return df.groupBy("symbol").agg(
        F.count(r).alias("samples"), ((F.max_by("equity", "market_date") - 1) * 100).alias("net_return_pct"),
        (F.avg((r > 0).cast("double")) * 100).alias("win_rate_pct"),
        F.coalesce(F.sum(F.when(r > 0, r)) / F.nullif(F.abs(loss), F.lit(0.0)), F.lit(0.0)).alias("profit_factor"),
        F.min("drawdown_pct").alias("max_drawdown_pct"), F.avg(r).alias("mean_net_return_pct"),
        F.avg("baseline_net_return_pct").alias("baseline_mean_net_return_pct"),
        (F.avg(F.col("ai_outperforms").cast("double")) * 100).alias("baseline_win_rate_pct"))


def baseline_comparison(evaluation, baselines, cost=K.COST_PCT):
    """Prediction error plus cost against the error of the no-change baseline."""
    from barloom.operators.joins import lookup
    df = lookup(evaluation, baselines, "prediction_id", {"baseline_close": None, "baseline_cost_pct": cost})
    ai, base = F.abs("ape_close"), F.abs(S.relative_error("actual_close", "baseline_close"))
    return df.select("prediction_id", "market_date", "prediction_date", "symbol", ai.alias("ai_ape"), base.alias("baseline_ape"),
                     F.col("baseline_cost_pct").alias("cost_pct"),
                     F.coalesce(ai + F.col("baseline_cost_pct") < base, F.lit(False)).alias("ai_better"))


def adaptive_confidence(evaluation, horizon_accuracy, horizon=1, rows=50, regime_score=50.0):
    """Confidence per symbol from its last evaluated rows, shrunk to 50 while rows are few."""
    w = Window.partitionBy("symbol").orderBy(F.desc("market_date"), F.desc("prediction_id"))
    recent = evaluation.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= rows)
    better = F.abs("ape_close") + K.COST_PCT < F.abs(S.relative_error("actual_close", "previous_close"))
    per = recent.groupBy("symbol").agg(
        F.count("*").alias("samples"), F.coalesce(mape("ape_close"), F.lit(10.0)).alias("recent_mape"),
        F.coalesce(hits(), F.lit(50.0)).alias("direction_accuracy"),
        F.coalesce(F.avg(better.cast("double")) * 100, F.lit(50.0)).alias("baseline_win_rate"),
        S.clamp(100 - F.coalesce(F.avg("prediction_uncertainty_pct"), F.lit(50.0))).alias("uncertainty_score"))
    past = horizon_accuracy.where(F.col("horizon_days") == horizon).agg(
        ((S.clamp(100 - F.max("mape") * 10) + S.clamp(F.max("direction_accuracy"))) / 2).alias("h")).select("h").scalar()
    raw = S.weighted([(0.25, S.clamp(100 - F.col("recent_mape") * 10)), (0.15, "direction_accuracy"), (0.15, "baseline_win_rate"),
                      (0.15, "uncertainty_score"), (0.15, F.coalesce(past, F.lit(50.0))), (0.15, F.lit(float(regime_score)))])
    grown = 50 + (raw - 50) * F.least(F.col("samples") / 30.0, F.lit(1.0))
    return per.withColumns({"historical_score": F.coalesce(past, F.lit(50.0)), "confidence": S.clamp(grown),
                            "horizon_days": F.lit(horizon).cast("bigint")})


def horizon_reliability(horizon_evaluation, rows=60):
    """Score of each symbol and horizon from its last evaluated rows."""
    w = Window.partitionBy("symbol", "horizon_days").orderBy(F.desc("evaluated_date"), F.desc("prediction_date"))
    recent = horizon_evaluation.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= rows)
    per = recent.groupBy("symbol", "horizon_days").agg(
        F.count("*").alias("samples"), F.coalesce(mape("ape"), F.lit(10.0)).alias("_m"), F.coalesce(hits(), F.lit(50.0)).alias("_a"))
    score = S.clamp(0.6 * (100 - F.least(F.col("_m") * 12.5, F.lit(100.0))) + 0.4 * F.col("_a"))
    return per.select("symbol", "horizon_days", "samples", score.alias("horizon_reliability"))


def quality_summary(evaluation, baselines, horizon_evaluation):
    """All quality controls as one row of nested records.

    Per-symbol economics are summed up, so the row does not grow with the universe.
    """
    hz = accuracy_by(horizon_evaluation, ["horizon_days"])
    base = baseline_comparison(evaluation, baselines).agg(
        F.count("*").alias("baseline_samples"), (F.avg(F.col("ai_better").cast("double")) * 100).alias("baseline_win_rate"))
    eco = economic_performance(evaluation).agg(
        F.count("*").alias("symbols"), F.avg("win_rate_pct").alias("mean_win_rate_pct"),
        F.avg("mean_net_return_pct").alias("mean_net_return_pct"), F.min("max_drawdown_pct").alias("worst_drawdown_pct"))
    conf = adaptive_confidence(evaluation, hz).agg(F.avg("confidence").alias("mean_confidence"))
    row = hz.agg(F.sort_array(F.collect_list(F.struct("horizon_days", "samples", "mape", "accuracy", "direction_accuracy"))).alias("horizons"))
    from barloom.operators.joins import with_context
    for part in (base, eco, conf):
        row = with_context(row, part)
    return row.select("horizons", F.struct("baseline_samples", "baseline_win_rate").alias("baseline"),
                      F.struct("symbols", "mean_win_rate_pct", "mean_net_return_pct", "worst_drawdown_pct").alias("economics"),
                      F.struct("mean_confidence").alias("confidence"))
