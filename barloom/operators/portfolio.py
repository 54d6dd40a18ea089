"""Position plans: cost, decision, sell plan and roll-up."""
from pyspark.sql import functions as F

from barloom import constants as K
from barloom.functions import scalars as S
from barloom.functions.scoring import horizon_values
from barloom.operators.quality import next_sessions


def infer_average_price(price, average, pnl, ret, quantity):
    """Cost of a position from its reported profit or return where it is not stated."""
    price = S.col(price)
    from_pnl = F.when(S.col(quantity) > 0, price - S.col(pnl) / F.nullif(S.col(quantity), F.lit(0.0)))
    from_ret = F.when(S.col(ret) != -100, price / F.nullif(1 + S.col(ret) / 100, F.lit(0.0)))
    return F.coalesce(S.col(average), from_pnl, from_ret)


def position_decision(price, cost, target, confidence, values, strict=False):
    """(decision, reason) of a position. ``strict`` asks that the price is below cost for a recovery hold."""
    price, cost, target = S.finite(price), S.finite(cost), S.finite(target)
    goal = cost * (1 + K.TARGET_PROFIT_PCT / 100)
    slack = F.greatest(F.lit(1e-9), F.abs(goal) * 1e-10) if strict else F.lit(1e-9)
    many = F.size(F.filter(values, lambda p: p["v"] >= K.TARGET_PROFIT_PCT)) >= 2
    recovery = (target >= goal) & (price < cost) if strict else target >= goal
    out = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))
    return (F.when(price.isNull() | cost.isNull() | (cost <= 0), out("WAIT", "NO PRICE / COST DATA"))
            .when(target.isNull(), out("HOLD", "AI PREDICTION UNAVAILABLE"))
            .when(price >= goal - slack, out("SELL", "10% profit target reached"))
            .when(recovery & many & (S.col(confidence) >= K.MIN_PLAN_CONFIDENCE), out("HOLD", "MULTI_HORIZON_CONFIRMED recovery"))
            .when(recovery, out("HOLD", "AI recovery target remains above cost"))
            .when(target < price * (1 - K.REDUCE_GAP_PCT / 100), out("REDUCE", "AI target materially below current price"))
            .otherwise(out("HOLD", "AI recovery not yet confirmed")))


def with_sell_plan(df, calendar, cost="average_price", confidence="ai_confidence", date="prediction_date"):
    """First horizon with a forecast at the profit target, its price and session date."""
    good = F.filter(horizon_values(), lambda p: p["v"] >= K.TARGET_PROFIT_PCT)
    df = df.withColumn("_first", F.try_element_at(good, F.lit(1)))
    known = F.coalesce(F.col(cost) > 0, F.lit(False))
    live = known & F.col("_first").isNotNull()
    planned = F.when(live & (F.coalesce(F.col(confidence), F.lit(0.0)) >= K.MIN_PLAN_CONFIDENCE),
                     F.greatest(F.col("_first.v"), F.lit(K.TARGET_PROFIT_PCT))).otherwise(K.TARGET_PROFIT_PCT)
    df = df.withColumns({"planned_profit_pct": planned, "sell_horizon_days": F.when(live, F.col("_first.h")).cast("bigint"),
                         "sell_status": F.when(live, "TARGET_DATE").otherwise("WAIT")})
    df = df.withColumn("sell_target_price", F.when(known, F.col(cost) * (1 + F.col("planned_profit_pct") / 100)))
    return next_sessions(df, date, F.col("sell_horizon_days"), calendar, "sell_date").drop("_first")


def portfolio_plan(holdings, predictions, calendar):
    """Full plan row of every holding, from its latest prediction."""
    from barloom.operators.joins import attach_latest_predictions
    df = attach_latest_predictions(holdings, predictions)
    df = df.withColumns({"prediction_date": F.col("run_date"), "ai_confidence": F.coalesce("confidence", F.lit(0.0)),
                         "ai_target": F.col("pred_close"), "average_price": infer_average_price(
                             "current_price", "average_price", "reported_pnl", "reported_return", "quantity")})
    price, cost = F.col("current_price"), F.col("average_price")
    df = df.withColumns({"_values": horizon_values(), "invested_value": F.coalesce(F.col("quantity") * cost, F.lit(0.0)),
                         "current_value": F.coalesce(F.col("quantity") * price, F.lit(0.0))})
    df = df.withColumn("_d", position_decision(price, cost, "ai_target", "ai_confidence", F.col("_values")))
    df = with_sell_plan(df, calendar)
    best = F.array_max(F.transform("_values", lambda p: p["v"]))
    need = (S.ratio(cost, price) - 1) * 100
    goal = cost * (1 + K.TARGET_PROFIT_PCT / 100)
    need_goal = (S.ratio(goal, price) - 1) * 100
    chance = lambda n, reached: F.when((n > 0) & best.isNotNull(), S.clamp(50 + 50 * (best / F.nullif(n, F.lit(0.0))), 0, 95)).otherwise(
        F.when(reached, 95.0).otherwise(0.0))
    hits = F.filter("_values", lambda p: p["v"] >= need)
    window = (F.when(F.col("sell_status") == "TARGET_DATE", F.concat(F.col("sell_horizon_days").cast("string"), F.lit("D")))
              .when(F.col("_d.decision").isin("SELL", "REDUCE"), "NOW").when(F.col("ai_target").isNotNull(), "WATCH").otherwise("NO AI DATA"))
    pnl = F.col("current_value") - F.col("invested_value")
    return df.select(
        S.normalize_symbol("ticker").alias("stock"), "ticker", "quantity", "average_price", "current_price", "invested_value", "current_value",
        pnl.alias("pnl"), (pnl / F.nullif("invested_value", F.lit(0.0)) * 100).alias("return_pct"), "ai_target", "ai_confidence",
        F.col("direction").alias("ai_direction"), F.col("_d.decision").alias("decision"), window.alias("sell_window"),
        goal.alias("profit_target_price"), F.coalesce("sell_target_price", "ai_target").alias("sell_target_price"), "sell_date",
        ((S.ratio("ai_target", cost) - 1) * 100).alias("projected_return"), ((cost - price) / F.nullif(cost, F.lit(0.0)) * 100).alias("recovery_gap_pct"),
        chance(need, price >= cost).alias("recovery_probability"), F.array_min(F.transform(hits, lambda p: p["h"])).cast("bigint").alias("recovery_horizon_days"),
        chance(need_goal, price >= goal).alias("profit_target_probability"),
        F.concat(F.col("_d.reason"), F.lit("; sell "), F.col("sell_status")).alias("sell_reason"), "prediction_date",
        *[F.col(f"horizon_{h}d") for h in K.HORIZONS])


def portfolio_rollup(plan):
    """Totals and action counts, one row. The number of actions is fixed."""
    totals = plan.agg(F.count("*").alias("positions"), F.sum("current_value").alias("value"), F.sum("invested_value").alias("_i"))
    counts = plan.groupBy("decision").agg(F.count("*").alias("n")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("decision", "n")))).alias("action_counts"))
    pnl = F.col("value") - F.col("_i")
    return totals.select("positions", "value", pnl.alias("pnl"), F.coalesce(pnl / F.nullif("_i", F.lit(0.0)) * 100, F.lit(0.0)).alias("return_pct"),
                         counts.scalar().alias("action_counts"))


def confirm_target(df, minimum=K.TARGET_PROFIT_PCT):
    """Profit target supported by at least two long horizons of a row."""
    long = horizon_values(horizons=K.LONG_HORIZONS)
    backs = lambda p: F.size(F.filter(F.col("_l"), lambda q: (q["h"] >= p["h"]) & (q["v"] >= p["v"] * 0.8) & (q["v"] >= minimum))) >= 2
    df = df.withColumn("_l", long)
    df = df.withColumn("_ok", F.filter("_l", lambda p: (p["v"] >= minimum) & backs(p)))
    top = F.array_max(F.transform("_l", lambda p: p["v"]))
    low = F.array_min(F.transform("_ok", lambda p: p["v"]))
    yes = F.size("_ok") > 0
    return df.withColumns({
        "target_pct": F.when(F.size("_l") == 0, minimum).when(yes, S.half_away(F.greatest(low, F.lit(minimum)), 2))
        .otherwise(S.half_away(F.when(top >= minimum, minimum).otherwise(F.greatest(top, F.lit(0.0))), 2)),
        "target_status": F.when(F.size("_l") == 0, "NO_LONG_HORIZON_EVIDENCE").when(yes, "MULTI_HORIZON_CONFIRMED")
        .otherwise("SINGLE_HORIZON_OR_INCONSISTENT"),
        "confirmed_horizons": F.transform("_ok", lambda p: p["h"])}).drop("_l", "_ok")
