"""Packing, nearest neighbours and resampling."""
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import packing as P
from barloom.llm import resampling as R
from barloom.llm.queries_packing import op3_best_fit_packing
from barloom.llm.queries_resampling import op5_quality_resampling
from barloom.llm.queries_search import op8_vptree_search
from barloom.llm.vptree import nearest
from tests.llm import brute


def bins_of(runs):
    """{bin: (contents by place, capacity)} of a plan."""
    out = {}
    for length, first, items, each, start, at, capacity in runs:
        for n in range(items):
            out.setdefault(start + n // each, [[], capacity])[0].append((at + n % each * length, length))
    return {b: (tuple(x[1] for x in sorted(held)), capacity) for b, (held, capacity) in out.items()}


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_one_by_one(seed):
    rng = random.Random(seed)
    sizes = [(16, 32, 64), (10, 25), (40,)][seed % 3]
    cost = [P.sequence_cost, lambda s: s + 8, lambda s: s * s][seed % 3]
    lengths = [rng.randint(1, sizes[-1]) if rng.random() < .7 else 3 for _ in range(300)]
    got = bins_of(P.plan(Counter(lengths), sizes, cost))
    want = brute.best_fit(lengths, sizes, cost)
    assert [got[b] for b in sorted(got)] == want


def check_pieces(pieces, rows, most):
    lengths, bins, seen = [], {}, {}
    for r in pieces:
        seen.setdefault(r.doc_id, []).append((r.start, r.n_words))
        if r.n_words:
            lengths.append(r.n_words)
            bins.setdefault((r.bin_id, r.capacity), []).append((r.bin_offset, r.n_words))
        else:
            assert r.bin_id is None and r.capacity is None
    for i, text in rows:
        n = len(brute.words(text))
        assert sorted(seen[i]) == [(k, min(most, n - k)) for k in range(0, max(n, 1), most)]
    got = []
    for (b, capacity), held in sorted(bins.items()):
        held.sort()
        assert all(x[0] + x[1] == y[0] for x, y in zip(held, held[1:])) and held[0][0] == 0
        got.append((tuple(x[1] for x in held), capacity))
    assert got == brute.best_fit(lengths, P.SIZES, P.sequence_cost)


def test_packing_query(spark, sf_dir, rows):
    check_pieces(op3_best_fit_packing(spark, sf_dir).collect(), rows, 4096)


def test_packed_texts(documents, rows, empty):
    pieces = P.pack(documents)
    assert pieces.columns == [c for c in documents.columns if c != "n_words"] + ["piece", "start", "n_words", "bin_id", "bin_offset", "capacity"]
    texts = {}
    for r in sorted(pieces.collect(), key=lambda r: r.piece):
        texts.setdefault(r.doc_id, []).append(r.text)
    assert {i: " ".join(t).split() for i, t in texts.items()} == {i: [w.decode() for w in brute.words(t)] for i, t in rows}
    made = P.sequences(pieces).collect()
    assert all(r.n_words <= r.capacity and len(r.text.split()) == r.n_words and r.doc_ids for r in made)
    assert sum(r.n_words for r in made) == sum(len(brute.words(t)) for _, t in rows)
    assert P.pack(empty).count() == 0 and P.sequences(P.pack(empty)).count() == 0
    twice = P.pack(documents.select("doc_id", "text").union(documents.select(F.lit(None).cast("long"), "text")))
    assert twice.groupBy("bin_id", "bin_offset").count().where("bin_id is not null and count > 1").count() == 0


def exact(ids, x, k):
    out = {}
    for q in range(len(ids)):
        if ids[q] % 20 == 0:
            score = (x[q] * x).sum(1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
            out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_search_query_is_exact_at_factor_one(spark, sf_dir):
    rows = [r for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r.vec_id < 1000]
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = exact(ids, x, 20)
    assert found(op8_vptree_search(spark, sf_dir, factor=1.0)) == want
    got = found(op8_vptree_search(spark, sf_dir))
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= .9 * sum(len(w) for w in want.values())


def test_search_in_small_shards_and_leaves(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 1000").drop("label")
    scaled = vectors.withColumn("embedding", F.transform("embedding", lambda v: v * (1 + F.col("vec_id") % 7)))
    rows = scaled.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = found(nearest(scaled, scaled.where("vec_id % 20 = 0"), k=5, factor=1.0, shard=100, leaf=4))
    assert got == exact(ids, x, 5)


def test_search_with_few_rows_repeats_and_none(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(nearest(df, df.where("vec_id < 3"), k=3))
    assert got == {1: [(2, 1.0), (3, -1.0)], 2: [(1, 1.0), (3, -1.0)]}
    assert nearest(df.where("false"), df, k=3).count() == 0
    assert nearest(df, df.where("false"), k=3).count() == 0


def test_search_takes_the_length_of_the_vectors(spark):
    rows = [(i, [1.0, float(i)]) for i in range(1, 8)] + [(i, [1.0, 2.0, float(i)]) for i in (20, 40, 60)]
    df = spark.createDataFrame(rows + [(80, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert found(nearest(df, df.where("vec_id % 20 = 0"), k=2)) == {80: [(7, 7.0), (6, 6.0)]}


def corpus_with_labels(spark):
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(1200):
        w = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        good = i % 4 > 0
        if not good:
            for _ in range(len(w) // 6):
                w[rng.randrange(len(w))] = rng.choice(["bad1", "bad2", "bad3"])
        rows.append((i, " ".join(w), int(good), "ab"[i % 2]))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, lang string")
    return df.select("doc_id", "text", "lang"), df.select("doc_id", "quality", F.lit(0).alias("toxic"))


def test_held_out_accuracy_and_repeatable_draw(spark):
    docs, labels = corpus_with_labels(spark)
    drawn = R.resample(docs, labels.where("doc_id % 3 < 2"))
    held = drawn.join(labels, "doc_id").where("doc_id % 3 = 2")
    right = held.where("kept = (quality = 1)").count() / held.count()
    assert right > .9
    assert drawn.where("kept").count() == 900
    assert sorted(drawn.collect()) == sorted(R.resample(docs.repartition(7), labels.where("doc_id % 3 < 2")).collect())


@pytest.mark.parametrize("k", [0, 1, 17, 1199, 5000])
def test_draw_is_the_top_k(spark, k):
    docs, labels = corpus_with_labels(spark)
    rows = R.resample(docs, labels, k=k).collect()
    best = sorted(rows, key=lambda r: (-r.gumbel_key, -r.doc_id))[:k]
    assert {r.doc_id for r in rows if r.kept} == {r.doc_id for r in best}


def test_cut_of_equal_keys(spark):
    keys = spark.range(9000).selectExpr("double(id div 6000) AS key", "id AS _id")
    assert tuple(R._cut(keys, 5000)) == (0.0, 4000)
    assert tuple(R._cut(keys, 10)) == (1.0, 8990)


def test_cut_of_equal_keys_and_ids(spark):
    null = spark.range(3000).selectExpr("1.5D AS key", "-9223372036854775808L AS _id")
    assert tuple(R._cut(null, 10)) == (1.5, -(1 << 63))
    near = spark.range(9000).selectExpr("1.5D AS key", "9007199254740992 * 64 + id div 3000 AS _id")
    assert tuple(R._cut(near, 4000)) == (1.5, 9007199254740992 * 64 + 1)


def test_counts_of_all_text(spark, documents, rows):
    agreed = R.target_labels(documents.selectExpr("doc_id", "1 AS quality", "int(doc_id > 200) AS toxic"))
    ratio = R.log_ratio(documents, agreed, buckets=1 << 10, strength=0.5, errors=0.0)
    from barloom.llm import wordcols as W
    import pyarrow as pa
    raw, target = np.zeros(1 << 10), np.zeros(1 << 10)
    for i, text in rows:
        for w in W.chunks(pa.array([text]), lower=True):
            for k in (1, 2):
                for h in w.window(k, k)[1] % np.uint64(1 << 10):
                    raw[int(h)] += 1
                    target[int(h)] += i <= 200
    np.testing.assert_allclose(ratio, np.log((target * raw.sum() / target.sum() + .5) / (raw + .5)))


def test_resampling_query_edges(spark, sf_dir, rows, empty, documents):
    got = op5_quality_resampling(spark, sf_dir).collect()
    assert len(got) == len(rows)
    n = {i: max(0, 2 * len(brute.words(t)) - 1) for i, t in rows}
    assert {r.doc_id: r.n_grams for r in got} == n
    assert all((r.log_weight is None) == (n[r.doc_id] == 0) and not (r.kept and n[r.doc_id] == 0) for r in got)
    labels = documents.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    assert R.resample(empty, labels).count() == 0
    assert R.resample(documents, labels.where("false")).where("kept").count() == 0
