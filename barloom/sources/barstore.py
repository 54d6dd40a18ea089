"""The bar store: monthly partitions, per-symbol text files, range reads."""
import re
import uuid

from pyspark.sql import functions as F, types as T

from barloom.functions import scalars as S
from barloom.operators.upserts import keep_last, merge_sources

BAR_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()), T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()), T.StructField("volume", T.DoubleType())])


def scan_symbol_files(spark, path):
    """Text files of one symbol each; the symbol is the file name."""
    df = spark.read.schema(BAR_SCHEMA).option("header", True).option("enforceSchema", True).csv(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    return df.select(S.normalize_symbol(F.url_decode(name)).alias("symbol"), "*")


def with_month(bars):
    return bars.withColumn("ym", F.date_format("date", "yyyy-MM"))


def range_scan(store, start, end):
    """Bars of a date range; months outside it are pruned by the partition column."""
    start, end = F.lit(start).cast("date"), F.lit(end).cast("date")
    hit = store.where(F.col("ym").between(F.date_format(start, "yyyy-MM"), F.date_format(end, "yyyy-MM"))
                      & F.col("date").between(start, end))
    return hit.dropDuplicates(["symbol", "date"]).drop("ym")


def lookback_start(end, period="5y"):
    """First date of a period such as 5y, 3mo or 20d that ends at ``end``."""
    end = F.lit(end).cast("date")
    found = re.fullmatch(r"(\d*)(y|mo|d)", str(period).strip().lower())
    n, unit = (max(1, int(found[1] or 1)), found[2]) if found else (5, "y")
    return F.date_sub(end, n) if unit == "d" else F.add_months(end, -n * (12 if unit == "y" else 1))


def lookback(bars, end, period="5y"):
    return bars.where(F.col("date").between(lookback_start(end, period), F.lit(end).cast("date")))


def missing_ranges(bars, universe, start, end):
    """Date ranges of the wanted window that the store lacks, per symbol."""
    start, end = F.lit(start).cast("date"), F.lit(end).cast("date")
    held = bars.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    df = universe.select("symbol").distinct().join(held, "symbol", "left")
    part = lambda kind, lo, hi: F.struct(F.lit(kind).alias("kind"), lo.alias("range_start"), hi.alias("range_end"))
    ranges = F.array_compact(F.array(
        F.when(F.col("a").isNull(), part("ALL", start, end)),
        F.when(F.col("a") > start, part("BEFORE", start, F.col("a"))),
        F.when(F.col("b") < end, part("AFTER", F.date_add("b", 1), end))))
    return df.select("symbol", F.inline(ranges))


def upsert_bars(spark, path, bars, order=("date",), spread=4):
    """Write bars into the monthly store.

    Of repeated rows of one symbol and date the last by ``order`` counts. A month is written
    as ``spread`` files, dealt by symbol. Merged months are written in full to a folder beside
    the store before any partition is replaced and are replaced from there, so a lost executor
    or a run that ends half-way loses nothing: the folder then still holds them.

    Months that do not exist yet, or to which only later dates are added, are
    appended to; other months are merged with what is stored (new rows win) and
    replaced one partition at a time.
    """
    new = with_month(keep_last(bars, ["symbol", "date"], list(order), drop_order=False))
    by = ["ym", F.pmod(F.xxhash64("symbol"), F.lit(spread))]
    cols = ["symbol", "date", "open", "high", "low", "close", "volume", "ym"]
    new = new.select(*cols)
    try:
        old = spark.read.parquet(path).select(*cols)
    except Exception as e:  # an empty store has no schema to read
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        new.repartition(*by).sortWithinPartitions("symbol", "date").write.partitionBy("ym").parquet(path)
        return
    old = old.withColumn("ym", F.col("ym").cast("string"))
    held = old.groupBy("ym").agg(F.max("date").alias("_last"))
    months = new.groupBy("ym").agg(F.min("date").alias("_first"))
    # a month is rewritten only when a new date may meet a stored one
    touched = (months.join(held, "ym").where(F.col("_first") <= F.col("_last")).select("ym"))
    append = new.join(touched, "ym", "left_anti")
    merged = merge_sources([old.join(touched, "ym", "left_semi"), new.join(touched, "ym", "left_semi")],
                           ["symbol", "date", "ym"]).select(*cols)
    staged = f"{path.rstrip('/')}_staged/{uuid.uuid4().hex}"
    merged.write.parquet(staged)
    ready = spark.read.schema(merged.schema).parquet(staged)
    append.repartition(*by).sortWithinPartitions("symbol", "date").write.mode("append").partitionBy("ym").parquet(path)
    (ready.repartition(*by).sortWithinPartitions("symbol", "date").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("ym").parquet(path))
