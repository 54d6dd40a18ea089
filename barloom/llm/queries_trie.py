"""op12: prefix trie of conversations that are rebuilt to share beginnings."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.llm.prefix_trie import prefix_trie
from barloom.llm.registry import query, table


def _taken(conv):
    """How many turns a conversation takes from the first one of its group of five."""
    return F.crc32(conv.cast("string").cast("binary")) % 9


@query("op12_prefix_trie")
def op12_prefix_trie(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null")
    turns = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    turns = turns.withColumn("turn", F.row_number().over(order))
    ids = turns.select("conv_id").distinct()
    group = ids.select(F.col("conv_id").alias("c"), (F.col("conv_id") - F.col("conv_id") % 5).alias("conv_id"))
    heads = (turns.where("turn <= 8 and conv_id % 5 = 0").join(group, "conv_id").where(F.col("turn") <= _taken(F.col("c")))
             .select(F.col("c").alias("conv_id"), "turn", "role", "text"))
    tails = turns.where(F.col("turn") > _taken(F.col("conv_id"))).withColumn("turn", F.col("turn") + 8)
    return prefix_trie(heads.unionByName(tails), ids)
