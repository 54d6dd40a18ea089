"""Window helpers for per-symbol series.

Every window here runs over a frame that holds at most one row per symbol and
session, so one symbol's rows are bounded by the calendar (about 260 a year),
however many raw rows the symbol has. Raw rows are reduced by grouped
aggregates with map-side combine before they get here.

Moving frames (ROWS BETWEEN n PRECEDING ...) are re-added from scratch for every
row, which costs n steps a row. ``with_rolling`` uses running sums instead: rows
are numbered, cut into blocks, and a moving sum is the difference of two running
sums inside a block plus, where it reaches back, the total of the block before;
whether a window is full follows from the row of the last missing value.
The cost per row does not depend on the window length, and because sums restart
with every block their rounding error does not grow with the history.
"""
from pyspark.sql import Window, functions as F

from barloom.functions.scalars import col

# rows per block: no window may be longer, and decay**BLOCK has to be below the
# precision of a double, which it is for spans up to 27
BLOCK = 512
MARKS = ("_pos", "_blk", "_off")


def series(key="symbol", order="date"):
    return Window.partitionBy(key).orderBy(order)


def in_order(key="symbol"):
    """Rows of a positioned frame in series order; shares the sort of its blocks."""
    return Window.partitionBy(key).orderBy("_blk", "_off")


def to_date_so_far(key="symbol"):
    return in_order(key).rowsBetween(Window.unboundedPreceding, 0)


def positioned(df, key="symbol", order="date", also=None):
    """Number the rows of each series and cut them into blocks (no-op if done).

    ``also`` maps new columns to expressions over ``series`` windows, taken in the same operator.
    """
    if "_pos" in df.columns:
        return df
    df = df.withColumns({"_pos": F.row_number().over(series(key, order)) - 1, **(also or {})})
    return df.withColumns({"_blk": F.floor(F.col("_pos") / BLOCK).cast("int"),
                           "_off": (F.col("_pos") % BLOCK).cast("int")})


def rolling(fn, c, n, key="symbol", order="date"):
    """Rolling aggregate by a moving frame, null until ``n`` non-null values are there.

    For short series and short windows only; see ``with_rolling``.
    """
    w = series(key, order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(c)).over(w) == n, fn(col(c)).over(w))


def change_over(c, n, window=None):
    """Relative change against the value ``n`` rows earlier."""
    c = col(c)
    return c / F.nullif(F.lag(c, n).over(window or series()), F.lit(0.0)) - 1


def with_rolling(df, rolls=None, emas=None, key="symbol", zeros=None, also=None):
    """Rolling sums, means and sample deviations, and exponential averages.

    ``rolls`` maps a new column to (kind, source column, n) with kind sum, avg or
    std; the value is null until n non-null values are in the window. ``emas``
    maps a new column to (source column, span), seeded with the first value. The
    frame must be positioned. The plan is two window operators on one sort,
    however many columns are asked for. ``also`` maps new columns to expressions
    over ``in_order`` windows, which the second of them takes along.

    Deviations are taken over moving frames: differences of sums of squares would lose
    them where prices are large against their spread. Sums and means reach back one
    block and exponential averages two, so longer windows and spans are refused.

    ``zeros`` names the sources that hold runs of zeros, where a sum of nothing but
    zeros must be exactly zero; by default all do.
    """
    rolls, emas = rolls or {}, emas or {}
    for name, (_, _, n) in rolls.items():
        if n > BLOCK:
            raise ValueError(f"{name}: at most {BLOCK} rows, not {n}")
    for name, (_, span) in emas.items():
        if (1 - 2.0 / (span + 1)) ** BLOCK > 1e-16:
            raise ValueError(f"{name}: span {span} decays too slowly for blocks of {BLOCK} rows")
    sums = {k: v for k, v in rolls.items() if v[0] != "std"}
    zeros = [c for c in dict.fromkeys(c for _, c, _ in sums.values()) if zeros is None or c in zeros]
    ordered = f"PARTITION BY {key} ORDER BY _blk, _off"
    so_far, before = f"({ordered} ROWS UNBOUNDED PRECEDING)", f"({ordered} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    # running quantities inside a block: s sum, e decayed sum
    terms = {f"s_{c}": f"coalesce({c}, 0D)" for _, c, _ in sums.values()}
    for name, (c, span) in emas.items():
        a = 2.0 / (span + 1)
        terms[f"e_{name}"] = f"if(_pos = 0, 1D, {a!r}D) * {c} * pow({1 - a!r}D, -_off)"
    df = df.selectExpr("*", *[f"sum({e}) OVER (PARTITION BY {key}, _blk ORDER BY _off ROWS UNBOUNDED PRECEDING) AS _p_{k}" for k, e in terms.items()])

    reach = sorted({(c, n) for _, c, n in sums.values()})
    scratch = {f"_l{n}_{c}": f"lag(_p_s_{c}, {n}) OVER ({ordered})" for c, n in reach}
    # what the block before comes to is the running sum of its last row
    scratch |= {f"_b_{k}": f"last(if(_off = {BLOCK - 1}, _p_{k}, NULL), true) OVER {before}" for k in terms}
    # the rows of the last missing and of the last non-zero value: n rows back or more, and the window has none
    scratch |= {f"_n_{c}": f"max(if({c} IS NULL, _pos, NULL)) OVER {so_far}" for c in dict.fromkeys(c for _, c, _ in rolls.values())}
    scratch |= {f"_z_{c}": f"max(if({c} <> 0, _pos, NULL)) OVER {so_far}" for c in zeros}
    scratch |= {f"_d_{k}": f"stddev_samp({c}) OVER ({ordered} ROWS {n - 1} PRECEDING)" for k, (kind, c, n) in rolls.items() if kind == "std"}
    df = df.select("*", *[F.expr(e).alias(k) for k, e in scratch.items()], *[c.alias(k) for k, c in (also or {}).items()])

    out = []
    for name, (kind, c, n) in rolls.items():
        if kind == "std":
            value = f"_d_{name}"
        else:
            value = f"_p_s_{c} - coalesce(_l{n}_{c}, 0D) + if(_off < {n}, coalesce(_b_s_{c}, 0D), 0D)"
            # a sum of nothing but zeros is exactly zero, not rounding residue
            value = f"if(coalesce(_pos - _z_{c} >= {n}, true), 0D, {value})" if c in zeros else f"({value})"
            value = f"{value} / {n}" if kind == "avg" else value
        out.append(f"if(_pos >= {n - 1} AND coalesce(_pos - _n_{c} >= {n}, true), {value}, NULL) AS {name}")
    for name, (_, span) in emas.items():
        d = 1 - 2.0 / (span + 1)
        out.append(f"pow({d!r}D, _off) * (_p_e_{name} + coalesce(_b_e_{name}, 0D) * {d ** BLOCK!r}D) AS {name}")
    return df.selectExpr("*", *out).drop(*scratch, *[f"_p_{k}" for k in terms])
