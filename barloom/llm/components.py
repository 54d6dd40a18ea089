"""Connected components by alternating large-star and small-star steps."""
from pyspark.sql import functions as F

from barloom.llm.staging import stored


def _state(edges):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges):
    """(id, component): every id of the links (u, v), with the least id it is connected to.

    Each round hangs all neighbours of a vertex on the least of them, so the rounds grow
    with the logarithm of the size. A vertex with very many links is only ever reduced to
    a minimum before the shuffle and joined back. Null ends and loops are left out; no
    links give an empty table.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = stored(edges.where("u is not null and v is not null and u <> v").distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(least, "u").where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v"))
        edges = stored(small.union(least.select("u", F.col("w").alias("v"))).distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct())
