"""Quality rules and sharding."""
import hashlib
from decimal import Decimal
from math import comb

import pytest
from pyspark.sql import functions as F

from barloom.llm import quality_rules as Q
from barloom.llm.sharding import lookup_table, moved, place
from tests.llm import brute


def test_statistics(documents, rows):
    got = {r.doc_id: tuple(r[c] for c in Q.STATS) for r in Q.with_statistics(documents).collect()}
    assert got == {i: brute.rule_statistics(t) for i, t in rows}


def tail(n, k, rate):
    rate = Decimal(rate)
    return sum(comb(n, i) * rate ** i * (1 - rate) ** (n - i) for i in range(k + 1))


@pytest.mark.parametrize("n, rate, level", [(0, .01, .05), (10, .01, .05), (700, .0125, .001), (3000, .0125, .001), (500, .2, .01)])
def test_binomial_bound(spark, n, rate, level):
    got = spark.range(1).select(Q._most_allowed(F.lit(n).cast("long"), F.lit(rate), F.lit(level))).first()[0]
    assert got < 0 or tail(n, got, rate) <= level
    assert tail(n, got + 1, rate) > level


def test_cutoffs_are_certified_and_take_effect(spark):
    """Junk goes, good documents stay, a stratum without enough labels has no rule."""
    good, junk = "word " * 1 + " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}$$$" for i in range(60))
    docs = spark.range(6000).selectExpr("id AS doc_id", f"if(id % 5 = 0, '{junk}', concat('{good} ', id)) AS text",
                                        "if(id < 5900, 'a', null) AS lang", "id % 5 AS kept")
    labels = docs.selectExpr("doc_id", "int(kept > 0) AS quality").union(spark.createDataFrame([(None, 1), (7, None)], "doc_id long, quality int"))
    stats = Q.with_statistics(docs)
    cutoffs = Q.certified_cutoffs(stats, labels)
    rows = {(r.stratum, r.rule): r for r in cutoffs.collect()}
    assert set(rows) == {("a", "symbols")}
    r = rows["a", "symbols"]
    assert (r.n_good, r.n_false, r.n_caught, r.cutoff) == (4720, 0, 1180, 2000)
    assert tail(r.n_good, r.n_allowed, .0125) <= .05 / (2 * 4 * 15) < tail(r.n_good, r.n_allowed + 1, .0125)
    judged = Q.judge(stats, cutoffs)
    assert judged.columns.count("kept") == 1
    assert judged.where("lang = 'a' and kept <> (doc_id % 5 > 0)").count() == 0
    assert judged.where("lang is null and not kept").count() == 0


def test_rules_on_empty_tables(empty, documents):
    stats = Q.with_statistics(documents)
    none = Q.certified_cutoffs(stats, documents.selectExpr("doc_id", "1 AS quality").where("false"))
    assert none.count() == 0
    assert Q.judge(stats, none).where("kept = base_failed").count() == 0
    assert Q.judge(Q.with_statistics(empty), none).count() == 0


def offset_and_skip(size):
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    return lambda name: (number("offset:" + name) % size, number("skip:" + name) % (size - 1) + 1)


def test_table_is_filled_in_turns(spark):
    names, size = ["a", "b", "é", "shard 4"], 101
    shards = spark.createDataFrame([(n,) for n in names + ["a", None]], "shard string")
    got = {r.slot: r.shard for r in lookup_table(shards, size).collect()}
    assert [got[s] for s in range(size)] == brute.slots(names, size, offset_and_skip(size))


def test_placement_and_moves(spark, documents, empty):
    size = 211
    table = {k: lookup_table(spark.createDataFrame([(f"s{i}",) for i in range(k)], "shard string"), size) for k in (7, 8)}
    counts = [r["count"] for r in table[7].groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1 and sum(counts) == size
    gone = moved(table[7], table[8]).agg(F.sum("slots")).first()[0]
    assert size // 8 <= gone < size // 2
    extra = documents.withColumn("slot", F.lit("old")).union(documents.withColumn("slot", F.lit("old")).limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    placed = place(extra, table[7], size)
    assert placed.columns == [*documents.columns, "slot", "shard"]
    assert placed.count() == extra.count() and placed.where("shard is null").count() == 0
    assert place(empty, table[7], size).count() == 0
    none = lookup_table(spark.createDataFrame([], "shard string"), size)
    assert none.count() == 0 and place(documents, none, size).where("shard is not null").count() == 0
    with pytest.raises(ValueError):
        lookup_table(spark.createDataFrame([], "shard string"), 100)


def test_clashing_names(spark, documents):
    """Columns that the operators name so themselves are kept."""
    own = ("_t", "_l", "_w", "_x", "_h", "_s", "_k", "_cut_symbols", "_slot", "_c0", "_failed")
    docs = documents.select("doc_id", "text", "lang", *[F.lit(f"own{c}").alias(c) for c in own])
    labels = documents.selectExpr("doc_id", "int(doc_id % 4 > 0) quality")
    stats = Q.with_statistics(docs)
    judged = Q.judge(stats, Q.certified_cutoffs(stats, labels))
    placed = place(docs, spark.createDataFrame([(0, "a"), (1, "b")], "slot long, shard string"), 2)
    for frame in (judged, placed):
        assert frame.select(*own).distinct().collect() == [tuple(f"own{c}" for c in own)] and frame.count() == docs.count()
    assert placed.where("shard is null").count() == 0
    assert Q.judge(Q.with_statistics(docs.where("false")), Q.certified_cutoffs(stats, labels.where("false"))).count() == 0
