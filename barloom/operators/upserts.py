"""Keyed merges: the last source or the last row wins."""
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

#: types that a hash aggregate holds in place
FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _fixed_order(df, cols, order):
    """The order as a column of a hash aggregate if there is one, null lowest; else None."""
    kinds = {f.name: f for f in df.schema}
    if len(order) != 1 or not all(isinstance(kinds[c].dataType, FIXED) for c in cols):
        return None
    only = kinds[order[0]]
    if not only.nullable:
        return F.col(only.name)
    if isinstance(only.dataType, T.DecimalType):
        return F.coalesce(only.name, F.lit("-" + "9" * (only.dataType.precision - only.dataType.scale)).cast(only.dataType))
    return None


def keep_last(df, keys, order, drop_order=True):
    """One row per key, the one with the largest ``order``.

    A grouped max_by combines on the map side, so a key with very many copies is
    reduced before the shuffle. With one order column and all columns of fixed width the
    buffers are too, and nothing is sorted; equal orders then agree on one row, as every
    column is chosen by the same comparisons.
    """
    cols = [c for c in df.columns if c not in keys]
    out = [c for c in cols if not (drop_order and c in order and c.startswith("_"))]
    by = _fixed_order(df, cols, order)
    if by is not None:
        return df.groupBy(*keys).agg(*[F.max_by(c, by).alias(c) for c in out])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in out])


def merge_sources(sources, keys):
    """Union of sources in rising priority; for equal keys the later source wins."""
    tagged = [s.withColumn("_prio", F.lit(i)) for i, s in enumerate(sources)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return keep_last(both, keys, ["_prio"])


def upsert(old, new, keys, protect=None):
    """Merge ``new`` into ``old``; old rows that satisfy ``protect`` stay."""
    keep = F.lit(False) if protect is None else protect
    a = old.withColumn("_prio", F.when(keep, 2).otherwise(0))
    b = new.withColumn("_prio", F.lit(1))
    return keep_last(a.unionByName(b, allowMissingColumns=True), keys, ["_prio"])


def first_non_empty(sources):
    """All rows of the first source that has any."""
    tagged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                    [s.withColumn("_prio", F.lit(i)) for i, s in enumerate(sources)])
    lowest = tagged.agg(F.min("_prio")).scalar()
    return tagged.where(F.col("_prio") == lowest).drop("_prio")


def bounded_log(df, order, n=250):
    """The last n observations, as a distributed top-k."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def read_with_fallback(primary, legacy, key="symbol"):
    """Rows of the primary store; the legacy store serves only keys it lacks."""
    known = primary.select(key).distinct()
    return primary.unionByName(legacy.join(known, key, "left_anti"))


def set_difference(left, right, key):
    """Keys on one side only, tagged MISSING (left only) or EXTRA (right only)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return (a.join(b, key, "left_anti").withColumn("side", F.lit("MISSING"))
            .unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("EXTRA"))))


def ordered_distinct(df, key, position, cap=None):
    """Distinct keys in order of first appearance."""
    out = df.groupBy(key).agg(F.min(position).alias("first_position"))
    return out if cap is None else out.orderBy("first_position").limit(cap)
