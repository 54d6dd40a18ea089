"""op11: near-duplicate documents by 64-bit SimHash fingerprints at 3 bits."""
from pyspark.sql import functions as F

from barloom.llm.registry import query, table
from barloom.llm.simhash import near_prints


@query("op11_simhash_near_dedup")
def op11_simhash_near_dedup(spark, sf_dir):
    found = near_prints(table(spark, sf_dir, "documents"), shingle=3, bits=3)
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))
