"""op7: near-duplicate documents by 3-word shingles at 85 %."""
from barloom.llm.minhash import near_duplicates
from barloom.llm.registry import query, table


@query("op7_minhash_near_dedup")
def op7_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
