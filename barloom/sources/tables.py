"""Loosely formed input tables: symbol lists, holdings, public offers."""
import re

from pyspark.sql import functions as F

from barloom.functions import scalars as S

# --- fixed values: accepted header names ---
SYMBOL_HEADERS = ("SYMBOL", "Symbol", "symbol", "Ticker", "ticker")
HOLDING_HEADERS = {
    "stock": ("Symbol", "Stock", "Ticker", "Name"),
    "quantity": ("Quantity", "Qty", "Shares"),
    "average_price": ("Average_Price", "Average Price", "Avg Price", "Avg_Price", "Cost Price"),
    "reported_pnl": ("Current_PnL_INR", "Current PnL INR", "PnL", "Profit Loss", "Profit_Loss"),
    "reported_return": ("Return_Percent", "Return Percent", "Return_Pct", "Return"),
}


def symbol_list(df):
    """Normalized distinct symbols of a list with any accepted header."""
    header = next((h for h in SYMBOL_HEADERS if h in df.columns), None)
    if header is None:
        return df.sparkSession.createDataFrame([], "symbol string")
    out = df.select(S.normalize_symbol(header).alias("symbol"))
    return out.where("symbol is not null and symbol not in ('', 'SYMBOL')").distinct()


def _plain(name):
    return re.sub(r"[^a-z0-9]", "", name.lower())


def load_holdings(df, name_table):
    """Holdings with resolved headers, numbers and tickers; positive quantity only.

    ``name_table(name, ticker)`` maps known names; other names are reduced to
    letters and digits.
    """
    have = {_plain(c): c for c in df.columns}
    found = {k: next((have[_plain(h)] for h in names if _plain(h) in have), None)
             for k, names in HOLDING_HEADERS.items()}
    number = lambda k: S.text_number(F.col(f"`{found[k]}`").cast("string")) if found[k] else F.lit(None).cast("double")
    out = df.select(F.trim(F.col(f"`{found['stock']}`")).alias("_n"),
                    F.coalesce(number("quantity"), F.lit(0.0)).alias("quantity"),
                    *[number(k).alias(k) for k in ("average_price", "reported_pnl", "reported_return")])
    names = name_table.select(S.squeeze(F.upper("name")).alias("_k"), F.col("ticker").alias("_t")).dropDuplicates(["_k"])
    out = out.withColumn("_k", S.squeeze(F.upper("_n"))).join(names, "_k", "left")
    out = out.withColumn("ticker", F.coalesce("_t", S.fallback_ticker("_n")))
    return out.where("quantity > 0 and ticker <> ''").select(
        S.normalize_symbol("ticker").alias("stock"), "ticker", "quantity", "average_price",
        "reported_pnl", "reported_return")


def normalize_offers(df):
    """Typed public offers from scraped text: names, prices, premium, dates."""
    price, gmp = S.numbers_in_text("price_text"), S.numbers_in_text("gmp_text")
    return df.withColumns({
        "ipo_name": S.squeeze("name_text"),
        "price_high": F.coalesce(F.try_element_at(price, F.lit(-1)), F.lit(0.0)),
        "gmp": F.coalesce(F.try_element_at(gmp, F.lit(1)), F.lit(0.0)),
        "open_date": F.try_to_date("open_text", "dd-MM-yyyy"),
        "close_date": F.try_to_date("close_text", "dd-MM-yyyy")})
