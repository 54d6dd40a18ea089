"""Quality by importance resampling: hashed n-gram models, Gumbel top-k.

Two models give every bucket of hashed one- and two-word runs a probability: one from target
text (labelled good), one from all text. Buckets whose counts differ by less than ``errors``
standard errors count as equal, and both counts get ``strength`` more. The log weight of a
document is its mean log(target / raw), less the average of labelled target documents of its
stratum (language), times ``length``: the importance of an excerpt of that many n-grams, so that
documents of all lengths and languages compare.
Documents are drawn without replacement in proportion to weight ** (1 / temperature) by the
Gumbel top-k rule: the k largest log weights after adding Gumbel noise, which a hash of the
id makes repeatable.

The raw model counts all documents. The target model uses at most ``sample`` labelled
documents, those with the least hash of the id. Both models have ``buckets`` entries whatever
the data; tasks add up their counts before anything is sent.
"""
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from barloom.llm import wordcols as W
from barloom.llm.staging import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])
BUCKETS, SAMPLE, SLICES = 1 << 20, 50_000, 64
LENGTH = 2000
STRENGTH, ERRORS = 10, 4.0
BINS, NEAR = 1024, 2000
BROADCAST_ROWS = 10_000  # a larger table of strata is joined by a shuffle
U = np.uint64
COUNTS = "slice long, raw binary, target binary"


def _grams(w, buckets):
    """(document, bucket) of the one- and two-word runs of a chunk, in document order per length."""
    for k in (1, 2):
        at, h = w.window(k, k)
        yield w.doc[at], (h % U(buckets)).astype(np.int64)


def _count(targets, buckets):
    def count(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(-1))
            good = np.isin(ids, targets) & np.asarray(batch.column(0).is_valid())
            for w in W.chunks(batch.column(1), lower=True):
                for doc, bucket in _grams(w, buckets):
                    raw += np.bincount(bucket, minlength=buckets)
                    target += np.bincount(bucket[good[w.lo + doc]], minlength=buckets)
        size = buckets // SLICES
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int64()), *[pa.array([x[i * size:(i + 1) * size].tobytes() for i in range(SLICES)], pa.binary()) for x in (raw, target)]],
            names=["slice", "raw", "target"])

    return count


def _add(table):
    sums = [sum(np.frombuffer(x.as_buffer(), np.int64) for x in table[c]) for c in ("raw", "target")]
    return pa.table({"slice": table["slice"][:1], **{c: pa.array([s.tobytes()], pa.binary()) for c, s in zip(("raw", "target"), sums)}})


def target_labels(labels, id_col="doc_id"):
    """(id, good): whether all labels of a document say quality 1 and toxic 0; null ids and qualities are left out."""
    return (labels.where(f"`{id_col}` is not null and quality is not null").groupBy(F.col(f"`{id_col}`").cast("long").alias("id"))
            .agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good")))


def log_ratio(docs, agreed, id_col="doc_id", text_col="text", buckets=BUCKETS, sample=SAMPLE, strength=STRENGTH, errors=ERRORS):
    """log(target / raw) per bucket; zeros if no labelled document is target text. ``agreed``: as from target_labels."""
    chosen = agreed.where("good").select("id").orderBy(F.xxhash64("id"), "id").limit(sample)  # the documented bound
    targets = np.sort(np.array([r.id for r in chosen.collect()], np.int64))
    if not len(targets):
        return np.zeros(buckets)
    held = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = held.mapInArrow(_count(targets, buckets), COUNTS).groupBy("slice").applyInArrow(_add, COUNTS).collect()  # SLICES rows
    raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    size = buckets // SLICES
    for r in rows:
        raw[r.slice * size:(r.slice + 1) * size] = np.frombuffer(r.raw, np.int64)
        target[r.slice * size:(r.slice + 1) * size] = np.frombuffer(r.target, np.int64)
    share = target.sum() / max(1, raw.sum())
    ratio = np.log((target / max(share, 1e-300) + strength) / (raw + strength))
    ratio[np.abs(target - share * raw) < errors * np.sqrt(share * raw)] = 0  # no difference beyond chance
    return ratio


def _score(ratio, length):
    buckets = len(ratio)

    def score(batches):
        for batch in batches:
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for w in W.chunks(batch.column(1), lower=True):
                for doc, bucket in _grams(w, buckets):
                    size = len(w.offsets) - 1
                    total[w.lo:w.lo + size] += np.bincount(doc, ratio[bucket], size)
                    n[w.lo:w.lo + size] += np.bincount(doc, minlength=size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(length * total / np.maximum(n, 1), mask=n == 0)], names=["_id", "_s", "n_grams", "w"])

    return score


def _cut(keys, k):
    """(key, id) of the k-th in descending (key, id) order, by histograms of ever smaller ranges.

    Rows of equal key and id are not told apart: those at the k-th place all lie at the bound.
    """
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while True:
        own = keys.where(F.col("key").between(low, high))
        if low == high or own.count() <= NEAR:
            rows = own.select("key", "_id").orderBy(F.desc("key"), F.desc("_id")).limit(k).collect() if low < high else None
            if rows is None:  # one key: the id decides; ids are cut the same way
                least, most = own.agg(F.min("_id"), F.max("_id")).first()
                if least == most:  # rows of equal key and id stay together
                    return low, least
                return low, _cut(own.select((F.col("_id").cast("decimal(20,0)") - F.lit(least).cast("decimal(20,0)")).cast("double").alias("key"), "_id"), k)[1] if own.count() > NEAR else \
                    own.orderBy(F.desc("_id")).limit(k).collect()[-1]["_id"]
            return rows[-1]["key"], rows[-1]["_id"]
        step = (high - low) / BINS
        bins = own.groupBy(F.least(F.floor((F.col("key") - low) / step), F.lit(BINS - 1)).alias("b")).agg(
            F.count("*").alias("c"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("b")).collect()  # BINS rows
        for b in bins:
            if k <= b["c"]:
                low, high = b["low"], b["high"]
                break
            k -= b["c"]


def resample(docs, labels, id_col="doc_id", text_col="text", stratum="lang", k=None, length=LENGTH, temperature=1.0, seed=0, buckets=BUCKETS, sample=SAMPLE, strength=STRENGTH, errors=ERRORS):
    """One row per document: id, ``n_grams``, ``log_weight``, ``gumbel_key``, ``kept`` (one of the k drawn).

    ``k`` defaults to the share of target text among the labelled documents times all documents.
    Documents without words (null, empty) have no weight and are never drawn; with fewer than k
    others all those are. Null ids can be drawn and come last among equal keys; rows with equal
    ids get equal noise. Rows of equal key and id are kept or left together, so more than k are kept
    if such rows lie across the k-th place. Without labelled target text all weights are 0 and k is 0 by default.
    """
    agreed = stored(target_labels(labels, id_col), "weights")
    n, n_good = agreed.agg(F.count("*"), F.count_if(F.col("good"))).first()
    share = n_good / max(1, n)
    ratio = log_ratio(docs, agreed, id_col, text_col, buckets, sample, strength, errors)
    held = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"),
                       F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")).alias("_s") if stratum else F.lit("").alias("_s"))
    scored = stored(held.mapInArrow(_score(ratio, length), "_id long, _s string, n_grams long, w double"), "weights")
    good = scored.join(agreed.where("good"), F.col("_id") == F.col("id")).where("w is not null")
    means = stored(good.groupBy(F.col("_s").alias("_m")).agg(F.avg("w").alias("mean")), "weights")
    overall = good.agg(F.avg("w")).first()[0] or 0.0
    scored = (scored.join(F.broadcast(means) if means.count() <= BROADCAST_ROWS else means, F.col("_s") == F.col("_m"), "left")
              .select("_id", "n_grams", (F.col("w") - F.coalesce("mean", F.lit(overall))).alias("log_weight")))
    u = (F.shiftrightunsigned(F.xxhash64("_id", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    scored = stored(scored.withColumn("key", F.col("log_weight") / temperature - F.log(-F.log(u))), "weights")
    n, weighted = scored.agg(F.count("*"), F.count("key")).first()
    k = round(share * n) if k is None else k
    if k >= weighted:
        kept = F.col("key").isNotNull()
    elif k <= 0:
        kept = F.lit(False)
    else:
        low = F.lit(-(1 << 63)).cast("long")
        key, last = _cut(scored.where("key is not null").select("key", F.coalesce("_id", low).alias("_id")), k)
        kept = F.coalesce((F.col("key") > key) | ((F.col("key") == key) & (F.coalesce("_id", low) >= last)), F.lit(False))
    return scored.select(F.col("_id").alias(id_col), "n_grams", "log_weight", F.col("key").alias("gumbel_key"), kept.alias("kept"))
