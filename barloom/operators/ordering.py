"""Exact ranks, medians and row numbers that never gather a group in one task.

A plain rank() or median() over a group sorts the whole group in one task, and
one price bucket or sector may hold a third of all rows. Here equal values are
counted first (map-side combined), distinct values fall into monotone bins, bin
totals are summed over the short list of bins, and only the values inside one
bin are ordered by a task.
"""
from pyspark.sql import Window, functions as F

from barloom.functions.scalars import col
from barloom.session import stored


def log_bin(v, per_octave=256):
    """Monotone bin number of a double: a fixed number of bins per doubling."""
    v = col(v)
    step = F.floor((F.log2(F.abs(v)) + 1100) * per_octave) + 1
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * step).cast("bigint")


def value_positions(df, group, value):
    """Distinct (group, value) with its count, the count below it and the group total.

    Null values are left out. One row per distinct value.
    """
    counts = (df.where(F.col(value).isNotNull()).groupBy(*group, value)
              .agg(F.count("*").alias("_n")).withColumn("_bin", log_bin(value)))
    bins = counts.groupBy(*group, "_bin").agg(F.sum("_n").alias("_b"))
    w = Window.partitionBy(*group).orderBy("_bin")
    offsets = bins.select(
        *group, "_bin", (F.sum("_b").over(w) - F.col("_b")).alias("_base"),
        F.sum("_b").over(Window.partitionBy(*group)).alias("_total"))
    inside = Window.partitionBy(*group, "_bin").orderBy(value)
    return (counts.join(offsets, [*group, "_bin"])
            .withColumn("_below", F.col("_base") + F.sum("_n").over(inside) - F.col("_n"))
            .select(*group, value, "_n", "_below", "_total"))


def group_median(df, group, value, name):
    """Exact median (mean of the middle two) and count of non-null values per group."""
    pos = value_positions(df, group, value)
    low = F.floor((F.col("_total") - 1) / 2)
    high = F.floor(F.col("_total") / 2)
    covers = lambda k: (F.col("_below") <= k) & (k < F.col("_below") + F.col("_n"))
    return pos.groupBy(*group).agg(
        ((F.max(F.when(covers(low), F.col(value))) + F.max(F.when(covers(high), F.col(value)))) / 2).alias(name),
        F.max("_total").alias(f"{name}_count"))


def with_group_rank(df, group, value):
    """Competition rank (1 = largest), group size and percentile of every row.

    df is worked out once and stored: its groups are counted, binned and joined back.
    """
    df = stored(df, "ranked")
    pos = value_positions(df, group, value).select(
        *group, value, (F.col("_total") - F.col("_below") - F.col("_n") + 1).alias("rank"))
    sizes = df.groupBy(*group).agg(F.count("*").alias("group_count"))
    out = df.join(pos, [*group, value], "left").join(sizes, group, "left")
    return out.withColumn("percentile", (1 - (F.col("rank") - 1) / F.greatest(
        F.col("group_count"), F.lit(1))) * 100)


def _numbered(df, key, parts):
    """(rows with ``_position``, ``_total``) in the order of a unique key.

    Rows are dealt by ranges of the key, sorted inside them and stored; a row's number in its
    range comes with its partition, and the sums of the ranges before it, one row per
    range, are the offsets. Nothing passes through the driver, and a range is as large as
    the number of partitions makes it.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("_m", F.monotonically_increasing_id())
    dealt = stored(dealt.withColumns({"_range": F.shiftright("_m", 33), "_inside": F.col("_m").bitwiseAND((1 << 33) - 1)}).drop("_m"), "numbered")
    whole = Window.orderBy("_range")  # one row per range
    ranges = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    ranges = ranges.select("_range", (F.sum("_n").over(whole) - F.col("_n")).alias("_base"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    return dealt.join(ranges, "_range").withColumn("_position", F.col("_base") + F.col("_inside")).drop("_range", "_inside", "_base")


def number_rows(df, key, name="position", parts=None):
    """Zero-based position of each row in the order of a unique key."""
    return _numbered(df, key, parts).withColumnRenamed("_position", name).drop("_total")


def even_sample(df, key, n, parts=None):
    """n rows spread evenly over the key order (first and last included); all if there are no more."""
    rows = _numbered(df.select(key), key, parts)
    last, spot = F.greatest(F.col("_total") - 1, F.lit(1)), F.col("_position")
    near = F.floor(spot * (n - 1) / last)
    chosen = F.lit(False)
    for i in (near - 1, near, near + 1):  # the i-th of n is at the rounded multiple of (total - 1) / (n - 1)
        chosen = chosen | ((i >= 0) & (i < n) & (F.bround(i * (F.col("_total") - 1) / max(n - 1, 1), 0) == spot))
    return rows.where((F.col("_total") <= n) | chosen).select(key)
