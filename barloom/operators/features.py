"""Technical features of daily bars: one shuffle by symbol, native windows only."""
from pyspark.sql import Window, functions as F

from barloom import constants as K
from barloom.functions import scalars as S
from barloom.functions.rolling import (change_over, in_order, positioned, series, to_date_so_far, with_rolling)


# name: (kind, source column, rows); sources with an underscore are made by _moves
SMA = {f"sma{n}": ("avg", "close", n) for n in (10, 20, 50)}
BANDS = {"bb_mid": ("avg", "close", 20), "_sd": ("std", "close", 20)}
RSI = {"_gain": ("avg", "_up", 14), "_loss": ("avg", "_dn", 14)}
ATR = {"atr14": ("avg", "_tr", 14)}
MOVES = {"_trs": ("sum", "_tr", 14), "_pds": ("sum", "_pd", 14), "_mds": ("sum", "_md", 14)}
SPREAD = {f"volatility{n}": ("std", "return1", n) for n in (10, 20)}
VOLUME = {"_vma": ("avg", "volume", 20)}
EMA = {"ema9": ("close", 9), "ema20": ("close", 20)}
MACD = {"_fast": ("close", 12), "_slow": ("close", 26)}
# sources where zeros come in runs
ZEROS = ("_up", "_dn", "_pd", "_md")
RETURNS, LAGS = (1, 3, 5, 10, 20), (1, 2, 3, 5)


def _moves(bars):
    """Numbered rows with the session-to-session moves that the rolling features are made of."""
    df = positioned(bars, also={f"_{c[0]}1": F.lag(c).over(series()) for c in ("close", "high", "low")})
    change, up, down = F.col("close") - F.col("_c1"), F.col("high") - F.col("_h1"), F.col("_l1") - F.col("low")
    return df.withColumns({
        "return1": F.col("close") / F.nullif(F.col("_c1"), F.lit(0.0)) - 1,
        "_up": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))),
        "_dn": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))),
        "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_c1")), F.abs(F.col("low") - F.col("_c1"))),
        "_pd": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "_md": F.when((down > up) & (down > 0), down).otherwise(0.0),
        "_sv": F.coalesce(F.signum(change), F.lit(0.0)) * F.col("volume")})


def _bands(df):
    df = df.withColumns({"bb_upper": F.col("bb_mid") + 2 * F.col("_sd"), "bb_lower": F.col("bb_mid") - 2 * F.col("_sd")})
    return df.withColumn("bb_position", S.ratio(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")))


def _rsi(df):
    return df.withColumn("rsi14", F.when(F.col("_loss") > 0, 100 - 100 / (1 + F.col("_gain") / F.col("_loss")))
                         .when(F.col("_gain") > 0, 100.0).when(F.col("_gain") == 0, 50.0))


def _dx(df):
    df = df.withColumns({"_pi": 100 * S.ratio("_pds", "_trs"), "_mi": 100 * S.ratio("_mds", "_trs")})
    return df.withColumn("_dx", 100 * S.ratio(F.abs(F.col("_pi") - F.col("_mi")), F.col("_pi") + F.col("_mi")))


def _tidy(df, bars, *columns):
    """Result columns of a single operator next to those of its input."""
    return df.select(*bars.columns, *columns)


def with_sma(bars):
    return _tidy(with_rolling(positioned(bars), SMA, zeros=ZEROS), bars, *SMA)


def with_ema(bars):
    return _tidy(with_rolling(positioned(bars), emas=EMA), bars, *EMA)


def with_macd(bars):
    df = with_rolling(positioned(bars), emas=MACD).withColumn("macd", F.col("_fast") - F.col("_slow"))
    df = with_rolling(df, emas={"macd_signal": ("macd", 9)})
    return _tidy(df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")), bars, "macd", "macd_signal", "macd_hist")


def with_rsi(bars):
    """Relative strength from simple means of gains and losses."""
    return _tidy(_rsi(with_rolling(_moves(bars), RSI, zeros=ZEROS)), bars, "rsi14")


def with_atr(bars):
    df = with_rolling(_moves(bars), ATR, zeros=ZEROS)
    return _tidy(df.withColumn("atr_pct", S.ratio("atr14", "close")), bars, "atr14", "atr_pct")


def with_adx(bars):
    df = _dx(with_rolling(_moves(bars), MOVES, zeros=ZEROS))
    return _tidy(with_rolling(df, {"adx14": ("avg", "_dx", 14)}), bars, "adx14")


def with_bollinger(bars):
    return _tidy(_bands(with_rolling(positioned(bars), BANDS, zeros=ZEROS)), bars, "bb_mid", "bb_upper", "bb_lower", "bb_position")


def _returns():
    w = in_order()
    return {**{f"return{n}": change_over("close", n, w) for n in RETURNS if n > 1},
            **{f"close_lag{k}": F.lag("close", k).over(w) for k in LAGS},
            **{f"return_lag{k}": F.lag("return1", k).over(w) for k in LAGS}}


def with_returns(bars):
    df = _moves(bars).withColumns(_returns())
    return _tidy(df, bars, *[f"return{n}" for n in RETURNS], *[f"{p}_lag{k}" for p in ("close", "return") for k in LAGS])


def with_volatility(bars):
    return _tidy(with_rolling(_moves(bars), SPREAD, zeros=ZEROS), bars, *SPREAD)


def _obv():
    return {"obv": F.sum("_sv").over(to_date_so_far())}


def _obv_change():
    return {"obv_change": change_over("obv", 10, in_order())}


def with_volume_features(bars):
    df = with_rolling(_moves(bars), VOLUME, zeros=ZEROS, also=_obv()).withColumns(_obv_change())
    return _tidy(df.withColumn("volume_ratio", S.ratio("volume", "_vma")), bars, "volume_ratio", "obv", "obv_change")


def with_candle_shape(df):
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return df.withColumns({
        "high_low_range": S.ratio(h - l, c),
        "body_pct": S.ratio(c - o, o),
        "upper_wick": S.ratio(h - F.greatest(o, c), c),
        "lower_wick": S.ratio(F.least(o, c) - l, c)})


def feature_frame(bars, keep=()):
    """Bars plus all derived features; ``keep`` names further columns of the bars to carry along.

    One exchange by symbol, two sorts and five window operators; every level of rolling sums is
    computed for all features of that level together. What no other feature is made of comes last,
    so that the operators before it pass on narrow rows.
    """
    df = bars.select("symbol", "date", "open", "high", "low", "close", "volume", *keep)
    deviations = {**{k: v for k, v in BANDS.items() if v[0] == "std"}, **SPREAD}
    means = {k: v for k, v in BANDS.items() if v[0] != "std"}
    df = _moves(df)
    df = with_rolling(df, {**SMA, **means, **RSI, **ATR, **MOVES, **VOLUME}, {**EMA, **MACD}, zeros=ZEROS, also=_obv())
    df = _dx(_rsi(df)).withColumn("macd", F.col("_fast") - F.col("_slow"))
    df = with_rolling(df, {"adx14": ("avg", "_dx", 14), **deviations}, {"macd_signal": ("macd", 9)}, also={**_returns(), **_obv_change()})
    df = with_candle_shape(_bands(df)).withColumns({
        "macd_hist": F.col("macd") - F.col("macd_signal"), "atr_pct": S.ratio("atr14", "close"),
        "volume_ratio": S.ratio("volume", "_vma"), "close_vs_sma20": S.ratio("close", "sma20") - 1,
        "close_vs_sma50": S.ratio("close", "sma50") - 1, "ema9_vs_ema20": S.ratio("ema9", "ema20") - 1})
    return df.select("symbol", "date", *K.FEATURES, *keep)


TARGETS = ("open", "high", "low", "close", "volume")


def label_date(horizon):
    return f"label_date_{horizon}"


def with_labels(bars, horizons=()):
    """Bars with next-session targets and the date of the label ``horizon`` sessions ahead, and the names of these columns.

    Taken from the narrow bars in the sort that numbers them; the wide feature frame need not be sorted for them.
    """
    ahead = {f"target_{t}": F.lead(t, 1).over(series()) for t in TARGETS}
    ahead |= {label_date(h): F.lead("date", h).over(series()) for h in horizons}
    return bars.withColumns(ahead), list(ahead)


def supervised_frame(features, cutoff=None):
    """Features with next-session targets and the three-class direction.

    Labels come from the full series; only rows dated before the cutoff are
    kept, so the label of the cutoff session is never used. Targets that are there
    (``with_labels``) are taken as they are. Dates of labels may be missing.
    """
    df, cutoffs = features, [c for c in features.columns if c.startswith("label_date_")]
    if not {f"target_{t}" for t in TARGETS} <= set(df.columns):
        df = df.withColumns({f"target_{t}": F.lead(t, 1).over(series()) for t in TARGETS})
    df = df.withColumn("target_return", S.ratio("target_close", "close") - 1)
    r = F.col("target_return")
    df = df.withColumn("direction_class", F.when(r > K.DIRECTION_THRESHOLD, 2)
                       .when(r < -K.DIRECTION_THRESHOLD, 0).otherwise(1).cast("bigint"))
    if cutoff is not None:
        df = df.where(F.col("date") < F.lit(cutoff).cast("date"))
    return df.dropna(subset=[c for c in df.columns if c not in cutoffs])


def horizon_targets(bars, cutoff=None, horizons=K.HORIZONS):
    """Close and percent return h sessions ahead, from rows up to the cutoff only."""
    df = bars.select("symbol", "date", "close")
    if cutoff is not None:
        df = df.where(F.col("date") <= F.lit(cutoff).cast("date"))
    df = df.withColumns({f"target_close_{h}d": F.lead("close", h).over(series()) for h in horizons})
    return df.withColumns({
        f"target_return_{h}d": (S.ratio(f"target_close_{h}d", "close") - 1) * 100 for h in horizons})


def _label_dates(frame, horizon, panel):
    if label_date(horizon) in frame.columns:  # from the full series, by with_labels
        return frame.withColumn("_target", F.col(label_date(horizon)))
    dates = panel.select("symbol", "date").withColumn("_target", F.lead("date", horizon).over(series()))
    return frame.join(dates, ["symbol", "date"], "left")


def purged(frame, cutoff, horizon, panel):
    """Rows whose label, ``horizon`` sessions later in the full panel, lies before the cutoff."""
    return _label_dates(frame, horizon, panel).where(F.col("_target") < F.lit(cutoff).cast("date")).drop("_target")


def leakage_audit(frame, cutoff, horizon, features=K.FEATURES, panel=None):
    """One row: rows at or after the cutoff, labels that reach it, columns present.

    The date of a label is the date of the row ``horizon`` sessions later in ``panel``,
    the rows before anything was cut; without a panel, in the frame itself. A frame that
    carries the dates of its labels (``with_labels``) needs neither.
    """
    cutoff = F.lit(cutoff).cast("date")
    df = _label_dates(frame, horizon, frame if panel is None else panel)
    present = len([c for c in features if c in frame.columns])
    out = df.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum((F.col("date") >= cutoff).cast("bigint")), F.lit(0)).alias("future_rows"),
        F.coalesce(F.sum((F.col("_target") >= cutoff).cast("bigint")), F.lit(0)).alias("target_leak_rows"))
    ok = ((F.col("rows") > 0) & (F.col("future_rows") == 0) & (F.col("target_leak_rows") == 0)
          & F.lit(present == len(features)))
    return out.select(F.when(ok, "PASS").otherwise("FAIL").alias("status"), "rows",
                      F.lit(present).cast("bigint").alias("features"), "future_rows",
                      "target_leak_rows", F.lit(horizon).cast("bigint").alias("horizon"))


def technical_score(features):
    """Score of each symbol from its latest complete feature row."""
    # stays in the partitions of the feature frame: no further shuffle
    newest = F.max("date").over(Window.partitionBy("symbol"))
    latest = features.dropna().withColumn("_newest", newest).where("date = _newest")
    rsi, vr = F.col("rsi14"), F.col("volume_ratio")
    points = (
        F.when(rsi.between(50, 70), 10).when((rsi >= 45) & (rsi < 50), 4)
        .when(rsi > 75, -8).when(rsi < 30, -5).otherwise(0)
        + F.when(F.col("macd_hist") > 0, 10).otherwise(0)
        + F.when(F.col("close_vs_sma20") > 0, 8).otherwise(0)
        + F.when(F.col("close_vs_sma50") > 0, 8).otherwise(0)
        + F.when(F.col("ema9_vs_ema20") > 0, 6).otherwise(0)
        + F.when(vr > 1.2, 8).when(vr > 1, 3).otherwise(0)
        + F.when(F.col("adx14") > 25, 5).otherwise(0))
    return latest.select("symbol", "date", S.clamp(50.0 + points).alias("technical_score"))


def prescreen(scores, n=K.PRESCREEN_N):
    """Best symbols by technical score; a distributed top-k, no global sort."""
    return scores.orderBy(F.desc("technical_score"), "symbol").limit(n)
