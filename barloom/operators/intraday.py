"""Intraday features and setups over 15-minute bars."""
from pyspark.sql import Window, functions as F

from barloom import constants as K
from barloom.functions import scalars as S
from barloom.functions.rolling import change_over, in_order, positioned, with_rolling


def with_session_vwap(bars):
    """Volume-weighted price accumulated inside each symbol's day."""
    day = Window.partitionBy("symbol", "day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = bars.withColumn("day", F.to_date("ts"))
    return df.withColumn("vwap", S.ratio(F.sum(typical * F.col("volume")).over(day), F.sum("volume").over(day)))


def intraday_features(bars):
    w, whole_day = in_order(), Window.partitionBy("symbol", "day")
    df = positioned(with_session_vwap(bars), order="ts")
    df = df.withColumns({
        "return1": change_over("close", 1, w), "return4": change_over("close", 4, w), "momentum": change_over("close", 8, w),
        "range_pct": S.ratio(F.col("high") - F.col("low"), "close")})
    df = with_rolling(df, {"volume_ma20": ("avg", "volume", 20)}, {"ema9": ("close", 9), "ema20": ("close", 20)})
    return df.withColumns({"relative_volume": S.ratio("volume", "volume_ma20"), "day_high": F.max("high").over(whole_day),
                           "day_low": F.min("low").over(whole_day)}).drop("_pos", "_blk", "_off")


def intraday_setups(features, min_rows=K.INTRADAY_MIN_ROWS):
    """Setup of each symbol from its latest complete bar, with a status."""
    used = ["close", "vwap", "ema9", "ema20", "relative_volume", "momentum", "range_pct"]
    full = features.dropna()
    last = full.groupBy("symbol").agg(F.count("*").alias("rows"), *[F.max_by(c, "ts").alias(c) for c in used])
    rv, mo, rg, cl = (F.col(c) for c in ("relative_volume", "momentum", "range_pct", "close"))
    score = S.clamp(50.0 + F.when(cl > F.col("vwap"), 12).otherwise(-12) + F.when(F.col("ema9") > F.col("ema20"), 10).otherwise(-8)
                    + F.when(rv > 1.5, 12).when(rv > 1.1, 5).otherwise(0)
                    + F.when(mo > 0.01, 10).when(mo < -0.01, -10).otherwise(0) + F.when(rg > 0.015, 6).otherwise(0))
    df = last.withColumns({"score": score, "_move": F.greatest(F.abs(mo), rg * 1.5, F.lit(K.INTRADAY_MIN_MOVE))})
    df = df.withColumn("bias", F.when(F.col("score") >= 60, "UP").when(F.col("score") <= 40, "DOWN").otherwise("NEUTRAL"))
    away = F.abs(F.col("score") - 50)
    strict = F.least(F.lit(95.0), 50 + away * 0.7 + F.least(rv, F.lit(3.0)) * 5)
    loose = F.least(F.lit(80.0), 45 + away * 0.6 + F.least(rv, F.lit(2.0)) * 4)
    status = (F.when(F.col("rows") < min_rows, "INSUFFICIENT_DATA").when(F.col("bias") == "NEUTRAL", "NEUTRAL")
              .when((F.col("score") >= 65) & (rv >= 1.0) & (strict >= 60), "QUALIFIED")
              .when((F.col("score") >= 55) & (rv >= 0.8), "WATCH").otherwise("LOW_SCORE"))
    df = df.withColumn("status", status)
    side = F.when(F.col("bias") == "UP", 1).otherwise(-1)
    live = F.col("status").isin("QUALIFIED", "WATCH")
    return df.select(
        "symbol", "status", "rows", "bias", "score", cl.alias("current"), "relative_volume", "vwap", "ema9", "ema20",
        F.when(live, cl * (1 + side * F.col("_move"))).alias("target"),
        F.when(live, cl * (1 - side * F.col("_move") * 0.55)).alias("stop_loss"),
        F.when(live, F.col("_move") * 100).alias("expected_move"),
        F.when(F.col("status") == "QUALIFIED", strict).when(F.col("status") == "WATCH", loose).alias("confidence"))


def intraday_watchlist(setups, n=K.INTRADAY_TOP_N):
    live = setups.where(F.col("status").isin("QUALIFIED", "WATCH"))
    return live.orderBy(F.desc("score"), F.desc("confidence"), F.desc("relative_volume"), "symbol").limit(n)


def scan_statistics(setups, universe):
    """Scan counts by status; symbols of the universe without bars are NO_DATA."""
    per = universe.select("symbol").distinct().join(setups.select("symbol", "status"), "symbol", "left")
    return per.groupBy(F.coalesce("status", F.lit("NO_DATA")).alias("status")).agg(F.count("*").alias("symbols"))
