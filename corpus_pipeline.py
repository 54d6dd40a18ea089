"""Corpus pipeline: quality rules, line dedup, near dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir); docs is what the stage before kept. All but the last
return the columns of ``documents``. Documents that a stage leaves without a word, by taking
all they had, go.
"""
from pyspark.sql import functions as F

from barloom.llm.line_dedup import drop_lines
from barloom.llm.minhash import near_duplicates
from barloom.llm.packing import pack
from barloom.llm.quality_rules import certified_cutoffs, judge, with_statistics
from barloom.llm.registry import table
from barloom.llm.staging import stored
from barloom.llm.substring import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _rewritten(done):
    """Documents with their new texts; those that lost everything are left out."""
    has_words = F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]")
    kept = done.where((F.col("n_removed") == 0) | F.coalesce(has_words, F.lit(False)))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the base tests and the certified rules."""
    stats = stored(with_statistics(docs.select(*COLUMNS)), "rules")
    cutoffs = stored(certified_cutoffs(stats, table(spark, sf_dir, "labels")), "rules")
    return judge(stats, cutoffs).where("kept").select(*COLUMNS)


def line_dedup(spark, docs, sf_dir):
    """Documents without lines that an earlier line repeats up to one word."""
    return _rewritten(drop_lines(docs.select(*COLUMNS)))


def near_dedup(spark, docs, sf_dir):
    """The document of the least id of each group that shares 80 % of its runs of five words."""
    groups = near_duplicates(docs, shingle=5, percent=80, tables=14)
    return docs.select(*COLUMNS).join(groups.where(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark, docs, sf_dir):
    """Documents without passages of 50 words that a document of a smaller id has."""
    return _rewritten(remove_repeats(docs.select(*COLUMNS), window=50))


def packing(spark, docs, sf_dir):
    """Pieces of the documents with their bin, place and the bin's length."""
    return pack(docs.select("doc_id", "text"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup),
          ("substring dedup", substring_dedup), ("packing", packing)]
#: near-duplicate components and best-fit packing have no SQL form
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
