"""op8: 20 nearest vectors of every twentieth row."""
from pyspark.sql import functions as F

from barloom.llm.registry import query, table
from barloom.llm.vptree import nearest

FACTOR = 2.0


@query("op8_vptree_search")
def op8_vptree_search(spark, sf_dir, factor=FACTOR):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20, factor=factor)
