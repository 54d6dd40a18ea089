"""Ranked selections. Top-k per bucket uses row_number() <= k, which Spark limits
inside every map task before the shuffle, so a huge bucket sends k rows per task."""
from pyspark.sql import Window, functions as F

from barloom import constants as K
from barloom.functions import scalars as S

RANK_KEYS = ("trade_confidence", "score", "confidence", "direction_confidence")


def rank_order():
    return [*[F.desc(c) for c in RANK_KEYS], F.asc("symbol")]


def top_per_bucket(df, n, order=None, bucket="price_bucket"):
    w = Window.partitionBy(bucket).orderBy(*(order or rank_order()))
    return df.withColumn("bucket_rank", F.row_number().over(w)).where(F.col("bucket_rank") <= n)


def rank_candidates(df, n=None):
    out = df.orderBy(*rank_order())
    return out if n is None else out.limit(n)


def within_uncertainty(cap=K.MAX_UNCERTAINTY):
    return F.coalesce(F.col("prediction_uncertainty_pct") <= cap, F.lit(False))


def strictly_eligible():
    m = F.coalesce(F.col("multi_horizon_expected_return"), F.lit(-999.0))
    return ((F.upper("direction") == "UP") & (F.coalesce("expected_return", F.lit(-999.0)) >= K.MIN_NET_RETURN)
            & (m > 0) & (F.coalesce("direction_return_alignment", F.lit(0.0)) >= 60))


def top_of_first_tier(df, tier, n, bucket="price_bucket"):
    """The n best of each bucket, or all, among the rows of the least tier that has any.

    Ranks are taken inside (bucket, tier), so the input is worked out once and the tier
    is chosen on the n rows per bucket and tier that are left.
    """
    w = Window.partitionBy(bucket, "_tier").orderBy(*rank_order())
    ranked = df.withColumn("_tier", tier).where("_tier is not null")
    short = ranked.withColumn("bucket_rank", F.row_number().over(w))
    if n is None:  # nothing bounds what is left, so the tier comes in as a scalar
        return short.where(F.col("_tier") == ranked.agg(F.min("_tier")).scalar())
    short = short.where(F.col("bucket_rank") <= n)
    least = F.min("_tier").over(Window.partitionBy())  # over n rows per bucket and tier
    return short.withColumn("_least", least).where("_tier = _least").drop("_least")


def selection_tier():
    """Strict, then UP within the cap, then UP."""
    up = F.upper("direction") == "UP"
    return (F.when(strictly_eligible() & within_uncertainty(), 1)
            .when(up & within_uncertainty(), 2).when(up, 3))


def cascade(df):
    """Rows of the first tier that has any."""
    tier = selection_tier()
    tiered = df.withColumn("selection_tier", tier.cast("bigint"))
    best = tiered.agg(F.min("selection_tier")).scalar()
    # a later tier includes the rows of the earlier ones, which are then empty
    return tiered.where(F.col("selection_tier") == best)


def diversified_top(df, n=K.TOP_N, per_bucket=K.MAX_PER_BUCKET):
    """Best candidate of each bucket first, then the global ranking.

    At most ``per_bucket`` of a bucket are chosen; None leaves it to the ranking, where
    no more than n of a bucket can be among the first n. So the buckets are cut first and
    the final ordering works on a handful of rows.
    """
    prices = ["pred_open", "pred_high", "pred_low", "pred_close", "current_price"]
    pool = df.where(F.col("price_bucket") != "OUT").dropna(subset=[c for c in prices if c in df.columns])
    short = top_of_first_tier(pool, F.when(within_uncertainty(), 1).otherwise(2), per_bucket or n).drop("_tier")
    first = (F.col("bucket_rank") > 1).cast("int")
    lead = F.when(first == 0, F.col("price_bucket"))
    return short.orderBy(first, lead, *rank_order()).limit(n)


def select_top(scored, n=K.TOP_N, min_score=65.0, min_confidence=60.0, min_trade_confidence=60.0, per_bucket=K.MAX_PER_BUCKET):
    """Qualified candidates: thresholds, cascade, cap per bucket, n rows; None leaves out the cap or the limit."""
    base = scored.where((F.col("score") >= min_score) & (F.col("confidence") >= min_confidence)
                        & (F.col("trade_confidence") >= min_trade_confidence) & (F.col("direction_return_alignment") >= 60))
    out = top_of_first_tier(base, selection_tier(), per_bucket or n).withColumn("selection_tier", F.col("_tier").cast("bigint")).drop("_tier")
    return out.orderBy("price_bucket", "bucket_rank").limit(n) if n else out


def best_pick(df, keys=("final_decision_score", "trade_confidence", "score")):
    """One row per bucket in price order."""
    key = next((k for k in keys if k in df.columns), "symbol")
    out = top_per_bucket(df, 1, [F.desc(key), F.asc("symbol")])
    return out.withColumn("bucket_ordinal", S.bucket_ordinal("price_bucket")).orderBy("bucket_ordinal")


def latest_per_symbol(predictions):
    """Latest run date only, the last id per normalized symbol."""
    latest = predictions.agg(F.max("run_date")).scalar()
    day = predictions.where(F.col("run_date") == latest).withColumn("symbol", S.normalize_symbol("symbol"))
    cols = [c for c in day.columns if c != "symbol"]
    return day.groupBy("symbol").agg(F.max_by(F.struct(*cols), "prediction_id").alias("_p")).select("symbol", "_p.*")
