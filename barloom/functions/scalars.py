"""Scalar column expressions: labels, clamps, ids, parsing, probabilities."""
from functools import reduce

from pyspark.sql import Column, functions as F

from barloom import constants as K


def col(c):
    return F.col(c) if isinstance(c, str) else c


def steady(c, digits=6):
    """Round for storage and display.

    Sums may be taken in any order on a cluster, so values that lie on a rounding
    boundary would flip between runs; the boundary is moved off the short
    decimals that prices and counts produce.
    """
    k = 10.0 ** digits
    # adding zero turns a negative zero into a plain one
    return F.rint((col(c) + 3.1 * 10 ** -(digits + 4)) * k) / k + F.lit(0.0)


def half_away(c, digits):
    """SQL's round() of a double: scaled, rounded half away from zero, scaled back.

    F.round rounds the shortest decimal text instead, which differs where scaling takes a
    value off the half: 1.005 is 1.0 here and 1.01 there.
    """
    k = 10.0 ** digits
    return F.round(col(c) * k, 0) / k


def rounded(df, digits=6, skip=()):
    """Round every double column of a result."""
    return df.select(*[
        steady(f.name, digits).alias(f.name)
        if f.dataType.typeName() == "double" and f.name not in skip else F.col(f.name)
        for f in df.schema.fields])


def ratio(a, b):
    """a / b, null when b is zero or null."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def finite(c):
    """NaN and both infinities become null."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def clamp(c, low=0.0, high=100.0):
    """Bound a value; null stays null (greatest/least alone would hide it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def clamp_or(c, default, low=0.0, high=100.0):
    """Bound a value, a missing or non-finite value being the neutral default."""
    return clamp(F.coalesce(finite(c), F.lit(float(default))), low, high)


def text_number(c):
    """Number from text; currency, percent and thousands marks are dropped."""
    return finite(F.trim(F.translate(col(c), "₹,%", "")).try_cast("double"))


def safe_number(c, default):
    return F.coalesce(text_number(c), F.lit(float(default)))


def band(value, bands, pick=1, missing="-"):
    """Label of the left-closed band that holds ``value``."""
    value = finite(value)
    out = F.when(value.isNull(), F.lit(missing))
    for edge in reversed(bands[1:]):
        out = out.when(value >= edge[0], F.lit(edge[pick]))
    return out.otherwise(F.lit(bands[0][pick]))


def price_bucket(value):
    return band(value, K.PRICE_BANDS)


def price_bucket_code(value):
    return band(value, K.PRICE_BANDS, pick=2, missing="OUT")


def legacy_price_bucket(value):
    return band(value, K.LEGACY_PRICE_BANDS)


def bucket_ordinal(code):
    """Position of a bucket code on the price axis (0 = cheapest)."""
    out = F.lit(len(K.PRICE_BANDS))
    for i, (_, label, name) in enumerate(K.PRICE_BANDS):
        out = F.when(col(code).isin(name, label), F.lit(i)).otherwise(out)
    return out


def direction_of_return(r, threshold=K.DIRECTION_THRESHOLD):
    r = col(r)
    return (F.when(r > threshold, "UP").when(r < -threshold, "DOWN").otherwise("NEUTRAL"))


def direction_of_prices(before, after):
    return direction_of_return(ratio(after, before) - 1)


def normalize_symbol(c):
    return F.regexp_replace(F.upper(F.trim(col(c))), r"\.NS$", "")


def fallback_ticker(c):
    """Exchange ticker for a free-text name that no name table knows."""
    text = F.upper(F.trim(col(c)))
    return F.when(text.endswith(".NS"), text).otherwise(
        F.concat(F.regexp_replace(text, "[^A-Z0-9]", ""), F.lit(".NS")))


def hashed_id(prefix, *parts):
    joined = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 16))


def prediction_id(run_date, symbol, cutoff, version):
    return hashed_id("P", run_date, symbol, cutoff, version)


def legacy_id(prediction_date, symbol):
    return hashed_id("LEGACY-", prediction_date, symbol)


def numbers_in_text(c):
    """All signed decimal numbers of a text, as an array of doubles."""
    text = F.regexp_replace(col(c), r"[,₹]|Rs\.", "")
    found = F.regexp_extract_all(text, F.lit(r"([-+]?\d+(?:\.\d+)?)"), F.lit(1))
    return F.transform(found, lambda x: x.cast("double"))


def squeeze(c):
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def relative_error(actual, predicted, floor=1e-8):
    """Signed percent error of a prediction against the actual."""
    actual, predicted = col(actual), col(predicted)
    return (actual - predicted) / F.greatest(F.abs(actual), F.lit(floor)) * 100


def accuracy_from_mape(m):
    return clamp(F.lit(100.0) - col(m))


def point_accuracy(ape):
    """Accuracy in percent of one row: one minus its absolute error, in [0, 100]."""
    return clamp(1 - F.abs(col(ape)) / 100, 0.0, 1.0) * 100


def hit_probability(level, mean, spread):
    """Logistic chance that a return exceeds ``level``."""
    sigma = F.greatest(F.abs(col(spread)), F.lit(0.5))
    z = F.least(F.greatest((F.lit(float(level)) - col(mean)) / sigma, F.lit(-20.0)), F.lit(20.0))
    return 100 / (1 + F.exp(z))


def downside_probability(mean, spread, raw=False):
    """Chance of losing more than two percent.

    ``raw=True`` gives the complementary value that older records carry.
    """
    above = hit_probability(-2.0, mean, spread)
    return above if raw else 100 - above


def blend_confidence(confidence, accuracy, samples):
    """Move stated confidence towards observed accuracy as evidence grows."""
    w = clamp_or(col(samples) / K.EVIDENCE_SAMPLES, 0.0, 0.0, 1.0)
    return (1 - w) * clamp_or(confidence, 50) + w * clamp_or(accuracy, 50)


def net_return(r, cost=K.COST_PCT):
    """Expected return after a round trip."""
    return F.coalesce(finite(r), F.lit(0.0)) - 2 * cost


def volatility_adjusted(r, vol):
    return F.coalesce(finite(r), F.lit(0.0)) / F.greatest(
        F.abs(F.coalesce(finite(vol), F.lit(3.0))), F.lit(0.25))


def money_text(c, currency="₹"):
    c = finite(c)
    return F.when(c.isNull(), F.lit("-")).otherwise(
        F.concat(F.lit(currency), F.format_number(c, 2)))


def percent_text(c, digits=2):
    c = finite(c)
    return F.when(c.isNull(), F.lit("-")).otherwise(F.format_string(f"%+.{digits}f%%", c))


def report_action(c):
    """Short action label of the report for the many decision texts in use."""
    s = F.upper(F.trim(F.coalesce(col(c), F.lit("-"))))
    return (F.when(s.startswith("SELL") | s.isin("EXIT", "PROFIT BOOK"), "SELL")
            .when(s.startswith("BUY") | (s == "ADD"), "BUY")
            .when(s.startswith("AVG") | s.isin("AVERAGE", "AVERAGING"), "AVERAGE")
            .when(s.startswith("WAIT") | s.startswith("DATA WAIT"), "WAIT")
            .when(s.startswith("REDUCE"), "EXIT")
            .when(s.startswith("HOLD") | (s == "RECOVERY"), "HOLD")
            .otherwise(s))


def weekday(c):
    """0 = Monday … 6 = Sunday."""
    return F.weekday(col(c))


def is_session(c, holidays=()):
    """Weekday that is not in the holiday list."""
    ok = weekday(c) < 5
    if holidays:
        ok = ok & ~col(c).cast("string").isin(*holidays)
    return ok


def weekdays_between(first, last):
    """Number of weekdays in the closed range [first, last], by arithmetic."""
    # weekdays counted from a fixed Monday up to and including the given day
    def upto(d):
        days = F.datediff(d, F.lit("1970-01-05").cast("date")) + 1
        full = F.floor(days / 7)
        return full * 5 + F.least(days - full * 7, F.lit(5))
    return upto(col(last)) - upto(F.date_sub(col(first), 1))


def weighted(parts):
    """Sum of weight * expression."""
    return reduce(Column.__add__, [F.lit(w) * col(e) for w, e in parts])
