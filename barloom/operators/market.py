"""Market context: index snapshot, regime, breadth, sectors, trailing statistics."""
from pyspark.sql import Window, functions as F

from barloom import constants as K
from barloom.functions import scalars as S
from barloom.functions.rolling import change_over, rolling, series
from barloom.operators.ordering import group_median, with_group_rank

def at_cutoff(bars, cutoff):
    return bars if cutoff is None else bars.where(F.col("date") <= F.lit(cutoff).cast("date"))


def last_rows(bars, n, cutoff=None):
    """The last n bars of each symbol, numbered from the latest (1)."""
    return at_cutoff(bars, cutoff).withColumn("_k", F.row_number().over(
        Window.partitionBy("symbol").orderBy(F.desc("date")))).where(F.col("_k") <= n)


def n_session_return(bars, n=20, cutoff=None, name="session_return"):
    """Percent return over the last n sessions, null for shorter histories."""
    two = last_rows(bars.select("symbol", "date", "close"), n + 1, cutoff).groupBy("symbol").agg(
        F.max(F.when(F.col("_k") == 1, F.col("close"))).alias("_a"),
        F.max(F.when(F.col("_k") == n + 1, F.col("close"))).alias("_b"))
    return two.select("symbol", ((S.ratio("_a", "_b") - 1) * 100).alias(name))


def recent_return(index_bars, cutoff=None):
    """Benchmark return over five sessions, else one, else zero."""
    two = last_rows(index_bars.select("symbol", "date", "close"), 6, cutoff).groupBy("symbol").agg(
        *[F.max(F.when(F.col("_k") == k, F.col("close"))).alias(f"_c{k}") for k in (1, 2, 6)])
    return two.select("symbol", F.coalesce((S.ratio("_c1", F.coalesce("_c6", "_c2")) - 1) * 100, F.lit(0.0))
                      .alias("benchmark_recent_return_5d"))


def trailing_volatility(bars, n=20, min_rows=5, cutoff=None):
    """Sample deviation of the last n one-session returns in percent, and its class."""
    recent = last_rows(bars.select("symbol", "date", "close"), n + 1, cutoff)
    recent = recent.withColumn("_r", change_over("close", 1) * 100)
    per = recent.groupBy("symbol").agg(F.count("_r").alias("returns"), F.stddev_samp("_r").alias("_s"))
    v = F.when(F.col("returns") >= min_rows, F.col("_s"))
    return per.select("symbol", "returns", v.alias("volatility_pct"), volatility_bucket(v).alias("volatility_bucket"))


def volatility_bucket(v):
    return (F.when(S.finite(v).isNull(), "UNKNOWN").when(v < K.VOLATILITY_LOW, "LOW")
            .when(v >= K.VOLATILITY_HIGH, "HIGH").otherwise("MEDIUM"))


def index_snapshot(index_bars, cutoff=None, year=252, fresh_only=False):
    """Latest index bar with one-session change and yearly range."""
    recent = last_rows(index_bars, year, cutoff)
    first = lambda c: F.max(F.when(F.col("_k") == 1, F.col(c)))
    per = recent.groupBy("symbol").agg(
        *[first(c).alias(c) for c in ("close", "open", "high", "low")], first("date").alias("data_date"),
        F.max(F.when(F.col("_k") == 2, F.col("close"))).alias("_p"),
        F.max("high").alias("high_52w"), F.min("low").alias("low_52w"))
    out = per.withColumn("change_1d", F.coalesce((S.ratio("close", F.coalesce("_p", "close")) - 1) * 100, F.lit(0.0))).drop("_p")
    if fresh_only and cutoff is not None:
        out = out.where(F.col("data_date") == F.lit(cutoff).cast("date"))
    return out


def first_available(snapshots, priorities):
    """Per index key, the snapshot of the first candidate symbol that has data.

    ``priorities(index_key, symbol, priority)`` lists the candidates.
    """
    got = priorities.join(snapshots, "symbol", "left").where("close is not null")
    cols = [c for c in got.columns if c not in ("index_key", "priority")]
    best = got.groupBy("index_key").agg(F.min_by(F.struct(*cols), "priority").alias("_s"))
    keys = priorities.select("index_key").distinct()
    return keys.join(best, "index_key", "left").select(
        "index_key", F.coalesce("_s.symbol", F.lit("unavailable")).alias("source"),
        *[F.col(f"_s.{c}").alias(c) for c in cols if c != "symbol"])


def market_regime(index_bars, cutoff=None, sessions=252):
    """Trend regime of an index from moving averages, returns and volatility."""
    recent = last_rows(index_bars.select("symbol", "date", "close"), sessions, cutoff).drop("_k")
    df = recent.withColumns({
        "_n": F.row_number().over(series()), "sma20": rolling(F.avg, "close", 20), "sma50": rolling(F.avg, "close", 50),
        "sma200": rolling(F.avg, "close", 200), "_r": change_over("close", 1),
        "return_20d": F.coalesce(change_over("close", 20) * 100, F.lit(0.0)),
        "return_60d": F.coalesce(change_over("close", 60) * 100, F.lit(0.0))})
    df = df.withColumn("volatility_20d", rolling(F.stddev_samp, "_r", 20) * 100)
    cols = ["close", "_n", "sma20", "sma50", "sma200", "return_20d", "return_60d", "volatility_20d"]
    row = df.groupBy("symbol").agg(F.max_by(F.struct(*cols), "date").alias("_l")).select("symbol", "_l.*")
    row = row.withColumn("sma200", F.coalesce("sma200", "sma50"))
    sign = lambda c, size: F.when(F.col("close") > F.col(c), size).otherwise(-size)
    swing = lambda c, edge, size: F.when(F.col(c) > edge, size).when(F.col(c) < -edge, -size).otherwise(0)
    points = (50.0 + sign("sma20", 10) + sign("sma50", 10) + sign("sma200", 10) + swing("return_20d", 2, 8)
              + swing("return_60d", 5, 7) - F.when(F.col("volatility_20d") > 2.5, 8).otherwise(0))
    short = F.col("_n") < 60
    score = F.when(short, 50.0).otherwise(S.clamp(points))
    name = F.when(short, "SIDEWAYS").when(score >= 65, "BULL").when(score <= 40, "BEAR").otherwise("SIDEWAYS")
    conf = F.when(short, 35.0).otherwise(S.clamp(50 + F.abs(score - 50) * 1.2, 35, 95))
    return row.select("symbol", name.alias("regime"), score.alias("score"), conf.alias("confidence"),
                      "sma20", "sma50", "sma200", "return_20d", "return_60d", "volatility_20d")


def market_breadth(bars, cutoff=None):
    """Symbols up, down and unchanged in their last session."""
    two = last_rows(bars.select("symbol", "date", "close"), 2, cutoff).groupBy("symbol").agg(
        F.max(F.when(F.col("_k") == 1, F.col("close"))).alias("a"), F.max(F.when(F.col("_k") == 2, F.col("close"))).alias("b"))
    out = two.agg(F.count_if(F.col("a") > F.col("b")).alias("advancers"), F.count_if(F.col("a") < F.col("b")).alias("decliners"),
                  F.count_if(F.col("a") == F.col("b")).alias("unchanged"))
    up, down = F.col("advancers"), F.col("decliners")
    return out.withColumns({"ratio": up / F.greatest(down, F.lit(1)),
                            "score": F.when(up + down > 0, 100 * up / (up + down)).otherwise(50.0)})


def sector_strength(df, returns="session_return", regime="SIDEWAYS"):
    """Sector median return against the market, as a score per row.

    Medians are exact and computed from value counts, so a sector (or the
    market) with very many rows is never sorted in one task.
    """
    base = df.withColumn("_all", F.lit(1))
    sectors = group_median(base, ["sector"], returns, "sector_median")
    market = group_median(base, ["_all"], returns, "m").select("m").scalar()
    out = df.join(sectors, "sector", "left")
    peers = F.least(F.greatest(F.col("sector_median_count") - 1, F.lit(0)), F.lit(5)) * 1.5
    strength = F.when(F.col(returns).isNotNull(), S.clamp(
        50 + (F.col("sector_median") - F.coalesce(market, F.lit(0.0))) * 8 + peers)).otherwise(50.0)
    out = out.withColumn("sector_strength", strength)
    return out.withColumns({
        "sector_score": S.clamp(F.col("sector_strength") + K.REGIME_SECTOR_SHIFT.get(regime, 0.0)),
        "sector_relative": F.coalesce(F.col(returns) - F.col("sector_median"), F.lit(None))}).drop("sector_median_count")


def cross_section_rank(df, value, group="price_bucket"):
    return with_group_rank(df, [group], value)


def data_gaps(bars, cutoff):
    """History length, missing weekdays, staleness and anomaly share per symbol."""
    per = at_cutoff(bars, cutoff).groupBy("symbol").agg(
        F.count("*").alias("history_rows"), F.min("date").alias("_a"), F.max("date").alias("_b"),
        F.avg((F.col("high") < F.col("low")).cast("double")).alias("_x"),
        F.avg(F.greatest((F.col("high") < F.col("low")), F.col("volume") < 0).cast("double")).alias("anomaly_rate"))
    expected = S.weekdays_between("_a", "_b")
    missing = F.when(F.col("history_rows") > 1, F.greatest(expected - F.col("history_rows"), F.lit(0))
                     / F.greatest(expected, F.lit(1)) * 100).otherwise(100.0)
    stale = F.greatest(F.datediff(F.lit(cutoff).cast("date"), "_b"), F.lit(0)).cast("double")
    return per.select("symbol", "history_rows", missing.alias("missing_rate_pct"), stale.alias("stale_days"), "anomaly_rate")


def data_quality_score(history, missing, stale, anomaly):
    return S.clamp(100 - F.greatest(180 - F.col(history), F.lit(0)) * 0.25 - F.least(F.col(missing) * 4, F.lit(30.0))
                   - F.least(F.col(stale) * 10, F.lit(30.0)) - F.least(F.col(anomaly) * 100, F.lit(30.0)))
