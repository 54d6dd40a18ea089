"""op13: periodic runs of words; in a tenth of the documents a tail is made periodic first."""
from pyspark.sql import functions as F

from barloom.llm.periodic import find_runs
from barloom.llm.registry import query, table

SPLIT = "[ \\t\\n\\x0B\\f\\r]+"


def _with_tails(docs):
    """Texts of the documents whose crc32 ends in 0 with their words from a on repeated with period p."""
    words = F.array_remove(F.split("text", SPLIT), "")
    docs = docs.withColumn("_h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    docs = docs.withColumn("_w", F.when(F.col("_h") % 10 == 0, words)).withColumn("_g", F.floor(F.col("_h") / 10)).withColumn("_n", F.size("_w"))
    n = F.greatest("_n", F.lit(1))
    docs = docs.withColumn("_a", (F.col("_g") % n).cast("int"))
    docs = docs.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    tail = F.col("_n") - F.col("_a")
    times = F.ceil(tail / F.col("_p")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), times))
    made = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.slice(again, F.lit(1), tail)), " ")
    return docs.select("doc_id", F.when(F.col("_n") > 0, made).otherwise(F.col("text")).alias("text"))


def _best(runs):
    """The run of the greatest exponent; of equal ones the first (runs are ordered by start, then period)."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")

    def better(a, b):
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    return F.reduce(runs, none, better)


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    found = find_runs(_with_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), _best(F.col("runs")).alias("b"),
                         F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"),
                        "runs_sha256", "collapsed_sha256")
