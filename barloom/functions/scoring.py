"""Row scores: reliability, trade confidence, composite and final decision."""
from pyspark.sql import functions as F

from barloom import constants as K
from barloom.functions import scalars as S


def reliability_score(mape, direction_accuracy, samples):
    """Evidence-weighted reliability around the neutral value 50."""
    w = F.least(S.col(samples) / 20.0, F.lit(1.0))
    skill = 0.55 * S.clamp(100 - 20 * S.col(mape)) + 0.45 * S.col(direction_accuracy)
    return 50 + w * (skill - 50)


def stock_reliability_score(mape, direction_accuracy):
    """Reliability used by the final decision (a second, steeper scheme)."""
    return S.clamp(0.55 * (100 - F.least(S.col(mape) * 15, F.lit(100.0))) + 0.45 * S.col(direction_accuracy))


def expected_return_score(r):
    return S.clamp_or(50 + S.col(r) * 5, 50)


def multi_horizon_score(r):
    return S.clamp_or(50 + S.col(r) * 4, 50)


def regime_direction_score(direction, regime):
    """Fit of a direction to a market regime; ``regime`` is a name or a column."""
    regime = F.lit(regime) if isinstance(regime, str) else regime
    out = F.when(regime == "HIGH VOL", 45.0)
    for name in ("BULL", "BEAR"):
        up, flat, down = K.REGIME_DIRECTION[name]
        d = S.col(direction)
        out = out.when(regime == name, F.when(d == "UP", up).when(d == "NEUTRAL", flat).when(d == "DOWN", down).otherwise(50.0))
    up, flat, down = K.REGIME_DIRECTION["SIDEWAYS"]
    d = S.col(direction)
    return out.otherwise(F.when(d == "UP", up).when(d == "NEUTRAL", flat).when(d == "DOWN", down).otherwise(50.0))


def return_alignment(direction, r):
    """Agreement of the stated direction with the expected return."""
    d, r = F.upper(S.col(direction)), S.col(r)
    return F.coalesce(F.when(d == "UP", S.clamp(50 + r * 25)).when(d == "DOWN", S.clamp(50 - r * 25))
                      .otherwise(S.clamp(100 - F.abs(r) * 20)), F.lit(50.0))


def horizon_values(prefix="horizon_", suffix="d", horizons=K.HORIZONS):
    """Known horizon forecasts of a row, as an array of (horizon, value)."""
    pairs = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"{prefix}{h}{suffix}").alias("v")) for h in horizons])
    return F.filter(pairs, lambda p: p["v"].isNotNull())


def horizon_alignment(direction, values):
    """Percent of horizon forecasts that agree with the direction."""
    d = F.upper(S.col(direction))
    agree = F.filter(values, lambda p: F.when(d == "UP", p["v"] > 0).when(d == "DOWN", p["v"] < 0)
                     .otherwise(F.abs(p["v"]) <= 1.5))
    return F.when(F.size(values) > 0, 100.0 * F.size(agree) / F.size(values)).otherwise(50.0)


def horizon_status(values):
    """Outlook over the report horizons: share of positive forecasts."""
    up = F.size(F.filter(values, lambda p: p["v"] > 0)) * 3
    n = F.size(values)
    return F.when(n < 3, "N/A").when(up >= 2 * n, "BULLISH").when(up >= n, "MIXED").otherwise("WEAK")


def trade_quality(c):
    return F.when(S.col(c) >= 75, "HIGH").when(S.col(c) >= 60, "MEDIUM").otherwise("LOW")


def score_candidates(df, regime="SIDEWAYS"):
    """Alignment, trade confidence and composite score of every candidate."""
    df = df.withColumns({
        "direction_return_alignment": return_alignment("direction", "expected_return"),
        "horizon_alignment": horizon_alignment("direction", horizon_values())})
    trade = S.clamp(S.weighted([(0.25, "confidence"), (0.15, "direction_confidence"), (0.20, "reliability_score"),
                                (0.20, "horizon_alignment"), (0.10, "uncertainty_score"), (0.10, "direction_return_alignment")]))
    score = S.clamp(S.weighted([
        (0.20, "technical_score"), (0.10, expected_return_score("expected_return")), (0.15, "confidence"),
        (0.10, "direction_confidence"), (0.10, "reliability_score"), (0.10, regime_direction_score("direction", regime)),
        (0.10, "sector_score"), (0.10, multi_horizon_score("multi_horizon_expected_return")), (0.05, "uncertainty_score")]))
    df = df.withColumns({"trade_confidence": trade, "score": score})
    return df.withColumn("trade_quality", trade_quality("trade_confidence"))


def with_uncertainty(df, volatility="volatility_pct", dispersion="ensemble_dispersion_pct"):
    """Prediction uncertainty from model spread, else from volatility, with its scores."""
    v = F.coalesce(S.finite(volatility), F.lit(3.0))
    spread = S.finite(dispersion) if dispersion in df.columns else F.lit(None).cast("double")
    df = df.withColumn("prediction_uncertainty_pct", F.coalesce(spread, F.least(F.greatest(v, F.lit(1.0)), F.lit(12.0))))
    u = F.col("prediction_uncertainty_pct")
    df = df.withColumn("uncertainty_score", S.clamp(100 - 4 * S.clamp(u, 0, 25)))
    return df.withColumns({
        "calibrated_confidence": S.clamp(0.70 * F.coalesce(F.col("confidence"), F.lit(50.0)) + 0.30 * F.col("uncertainty_score")),
        "risk_flag": F.when(u <= 4, "LOW").when(u <= 8, "MEDIUM").otherwise("HIGH")})


def with_market_risk(df, regime):
    base = K.REGIME_BASE_RISK.get(regime.upper(), 60.0)
    return df.withColumns({"market_risk_score": F.lit(base), "risk_adjusted_score": S.clamp(
        S.weighted([(0.75, "score"), (0.10, F.lit(base)), (0.15, "uncertainty_score")]))})


def adaptive_thresholds(regime, volatility_bucket, stock_rel, horizon_rel):
    """Buy and watch score levels and the least net return."""
    regime = F.upper(F.lit(regime) if isinstance(regime, str) else regime)
    vol = F.upper(S.col(volatility_bucket))
    def shift(hard, high, low, weak_stock, weak_horizon):
        return (F.when(regime.isin("BEAR", "HIGH VOL"), hard).otherwise(0.0)
                + F.when(vol == "HIGH", high).when(vol == "LOW", low).otherwise(0.0)
                + F.when(S.col(stock_rel) < 55, weak_stock).otherwise(0.0)
                + F.when(S.col(horizon_rel) < 55, weak_horizon).otherwise(0.0))
    return (75.0 + shift(5.0, 4.0, -2.0, 4.0, 3.0), 68.0 + shift(4.0, 3.0, -1.0, 3.0, 2.0),
            K.MIN_NET_RETURN + F.when(vol == "HIGH", 0.25).otherwise(0.0))


def decide(df, regime="SIDEWAYS", breadth=50.0, news=50.0, raw_downside=False):
    """Final score, action and risk of scored candidates."""
    m = K.REGIME_MULTIPLIER.get(regime.upper(), 1.0)
    e, u = F.col("expected_return"), F.col("prediction_uncertainty_pct")
    df = df.withColumns({
        "calibrated_confidence": S.blend_confidence("confidence", "reliability_score", "reliability_samples"),
        "risk_adjusted_return": S.volatility_adjusted(e, "volatility_pct"),
        "net_expected_return": S.net_return(e), "benchmark_edge_pct": F.coalesce(e, F.lit(0.0)) - F.col("benchmark_return"),
        "regime_adjusted_score": S.clamp(F.col("risk_adjusted_score") * m),
        **{f"hit_prob_{int(k)}": S.hit_probability(k, e, u) for k in K.HIT_LEVELS},
        "downside_prob": S.downside_probability(e, u, raw_downside)})
    part = lambda c, k: S.clamp_or(50 + F.col(c) * k, 50)
    df = df.withColumn("final_decision_score", S.clamp(S.weighted([
        (0.19, "regime_adjusted_score"), (0.14, "calibrated_confidence"), (0.11, "technical_score"), (0.10, part("net_expected_return", 5)),
        (0.10, part("multi_horizon_expected_return", 4)), (0.09, "hit_prob_3"), (0.08, F.lit(float(breadth))), (0.05, F.lit(float(news))),
        (0.05, part("benchmark_edge_pct", 5)), (0.04, part("risk_adjusted_return", 10)), (0.03, "stock_reliability"),
        (0.02, "data_quality_score")])))
    buy, watch, least = adaptive_thresholds(regime, "volatility_bucket", "stock_reliability", "horizon_reliability")
    s, up, hit, down = F.col("final_decision_score"), F.col("direction") == "UP", F.col("hit_prob_3"), F.col("downside_prob")
    stop = ((u > 15) | (F.col("calibrated_confidence") < 45) | (F.col("data_quality_score") < 60) | (F.col("stock_reliability") < 30)
            | (F.col("horizon_reliability") < 30) | (s < 55) | (F.col("net_expected_return") < least) | (down >= 75))
    action = (F.when(stop, "NO TRADE")
              .when((s >= buy) & up & (F.col("benchmark_edge_pct") >= -K.BENCHMARK_TOLERANCE) & (hit >= 50), "BUY")
              .when((s >= watch) & up & (hit >= 45) & (down < 80), "WATCH")
              .when((s <= 35) | ((F.col("direction") == "DOWN") & (s < 55)), "AVOID").otherwise("HOLD"))
    return df.withColumns({"action": action, "uncertainty_flag": u > 15,
                           "final_risk": F.when(s >= 75, "LOW").when(s >= 55, "MEDIUM").otherwise("HIGH")})


def jump_score(price, pred_close, pred_high, confidence, technical, upside_7d):
    """Signal of a fast rise, from one-day and seven-session forecasts."""
    pct = lambda x: S.clamp(x / K.JUMP_THRESHOLD * 100)
    return S.clamp(S.weighted([
        (0.25, pct(S.col(pred_high) / S.col(price) - 1)), (0.15, pct(S.col(pred_close) / S.col(price) - 1)),
        (0.20, pct(F.coalesce(S.col(upside_7d), F.lit(0.0)) / 100)), (0.20, confidence), (0.20, technical)]))


def jump_watchlist(df, pool=K.JUMP_POOL, n=K.JUMP_TOP_N):
    """Best jump candidates of a bounded, ranked pool."""
    up7 = F.coalesce(F.col("horizon_7d"), F.lit(0.0))
    p = df.orderBy(F.desc("score"), "symbol").limit(pool).withColumns({
        "jump_score": jump_score("current_price", "pred_close", "pred_high", "confidence", "technical_score", "horizon_7d"),
        "estimated_7d_upside": up7, "expected_1d_return": (F.col("pred_close") / F.col("current_price") - 1) * 100,
        "target_level": F.col("current_price") * (1 + K.JUMP_THRESHOLD), "status": F.lit("OPEN"),
        "remaining_days": F.lit(K.JUMP_SESSIONS).cast("bigint")})
    high = (F.col("pred_high") / F.col("current_price") - 1) * 100
    live = p.where((F.col("jump_score") >= K.JUMP_MIN_SCORE) & (F.greatest(high, up7) >= K.JUMP_MIN_UPSIDE))
    return live.orderBy(F.desc("jump_score"), F.desc("estimated_7d_upside"), "symbol").limit(n)


def fundamental_score(f):
    """Ranking score from point-in-time fundamentals; a missing term is skipped."""
    term = lambda value, low, high: F.coalesce(S.clamp(value, low, high), F.lit(0.0))
    c = {k: F.col(k) for k in ("roe", "revenue_growth", "earnings_growth", "debt_to_equity", "pe")}
    pe = F.when(c["pe"] > 0, S.clamp(25 - c["pe"], -6, 6) * 0.2)
    return f.withColumn("fundamental_score", S.clamp(
        50 + term(c["roe"] * 25, -10, 15) + term(c["revenue_growth"] * 30, -8, 10) + term(c["earnings_growth"] * 25, -8, 10)
        - term(c["debt_to_equity"] / 50, 0, 8) + F.coalesce(pe, F.lit(0.0))))


def analyze_offers(df):
    """Premium, score, action and warning of public offers."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    df = df.withColumns({"gmp_value": z("gmp"), "gmp_pct": z("gmp") / F.greatest("price_high", F.lit(1.0)) * 100,
                         "implied_listing_price": F.greatest("price_high", F.lit(1.0)) + z("gmp")})
    debt = F.coalesce(F.nullif("debt_to_equity", F.lit(0.0)), F.lit(1.0))
    value = F.when((z("pe") > 0) & (z("industry_pe") > 0),
                   S.clamp((F.col("industry_pe") - F.col("pe")) / F.nullif("industry_pe", F.lit(0.0)) * 20, -20, 20)).otherwise(0.0)
    asked = S.clamp(F.log1p(z("qib")) * 2 + F.log1p(z("nii")) * 1.5 + F.log1p(z("retail")), -10, 15)
    score = S.clamp(50 + S.clamp("gmp_pct", -30, 50) * 0.45 + S.clamp(z("revenue_growth"), -30, 50) * 0.20
                    + S.clamp(z("profit_growth"), -30, 50) * 0.20 + S.clamp(z("roe"), 0, 30) * 0.25
                    - S.clamp(debt - 1, 0, 4) * 5 + value + asked)
    df = df.withColumn("ipo_score", score)
    return df.withColumns({
        "ipo_action": F.when((F.col("ipo_score") >= 75) & (F.col("gmp_pct") >= 8), "BUY").when(F.col("ipo_score") >= 65, "CONSIDER")
        .when(F.col("ipo_score") >= 50, "WATCH").otherwise("AVOID"),
        "gmp_warning": F.when(F.col("gmp_pct") < 0, "NEGATIVE GMP").when(F.col("gmp_pct") < 5, "LOW GMP").otherwise("POSITIVE GMP")})


def active_offers(df, today):
    """Offers that are open or still to come on the given day."""
    day = F.lit(today).cast("date")
    o, c = F.col("open_date"), F.col("close_date")
    over = F.upper(F.coalesce("status", F.lit(""))).rlike("LISTED|CLOSED|COMPLETED|ENDED")
    window = (F.when(o.isNotNull() & c.isNotNull(), ((o <= day) & (day <= c)) | (o > day))
              .when(o.isNotNull(), o >= F.date_sub(day, 1)).when(c.isNotNull(), c >= day).otherwise(True))
    return df.where(~over & window)


def horizon_rollup(forecasts, key="symbol"):
    """Short, medium and long medians, primary return and agreement per symbol.

    A symbol has at most one row per horizon, so its medians are over ten values.
    """
    h, r = F.col("horizon_days"), F.col("expected_return")
    per = forecasts.groupBy(key).agg(
        F.median(F.when(h.between(1, 10), r)).alias("short_median"), F.median(F.when(h.between(20, 90), r)).alias("medium_median"),
        F.median(F.when(h >= 180, r)).alias("long_median"), F.max(F.when(h == 1, r)).alias("_p"),
        F.collect_list(r).alias("_all"), *[F.max(F.when(h == k, r)).alias(f"horizon_{k}d") for k in K.HORIZONS])
    per = per.withColumn("primary_return", F.coalesce("_p", "short_median"))
    same = F.size(F.filter("_all", lambda x: F.signum(x) == F.signum(F.col("primary_return"))))
    return per.withColumn("agreement_pct", F.when(F.col("primary_return").isNotNull() & (F.size("_all") > 0),
                                                  100.0 * same / F.size("_all"))).drop("_p", "_all")


def horizon_rollup_row(df):
    """``horizon_rollup`` of forecasts that lie side by side in a row as horizon_<h>d: nothing is grouped."""
    known = lambda hs: F.array_compact(F.array(*[F.col(f"horizon_{h}d") for h in hs]))

    def median(hs):
        v = F.array_sort(known(hs))
        at = lambda k: F.get(v, F.floor(k / 2).cast("int"))
        return at(F.size(v) - 1) * 0.5 + at(F.size(v)) * 0.5  # null if there are none

    df = df.withColumns({"short_median": median([h for h in K.HORIZONS if h <= 10]), "medium_median": median([h for h in K.HORIZONS if 20 <= h <= 90]),
                         "long_median": median([h for h in K.HORIZONS if h >= 180]), "_all": known(K.HORIZONS)})
    df = df.withColumn("primary_return", F.coalesce("horizon_1d", "short_median"))
    same = F.size(F.filter("_all", lambda x: F.signum(x) == F.signum(F.col("primary_return"))))
    return df.withColumn("agreement_pct", F.when(F.col("primary_return").isNotNull() & (F.size("_all") > 0),
                                                 100.0 * same / F.size("_all"))).drop("_all")
