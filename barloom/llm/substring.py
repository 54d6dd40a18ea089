"""Repeated passages: fixed-block anchors, rolling probes, extension to maximal exact repeats.

A window is ``window`` consecutive words. Any window holds a whole block of the grid that
cuts its document into non-overlapping blocks of ``window // 2`` words, so a window that
occurs in two documents is found where a rolling probe of the one equals a block of the
other. Five steps, all keyed by hashes:

1. Documents are dealt once into parts by a hash of their id. Each part sends the distinct
   hashes of its rolling probes, marked where the probe is an indexed block or occurs in
   two documents of the part. A passage common to any number of documents is sent once per
   part, not once per document.
2. Per bucket of hashes, those that are an indexed block somewhere and occur in two
   documents are sent back to the parts that hold them.
3. Each part extends its hits: the windows around a hit are hashed to 96 bits and sent
   with the least document id the part has for them.
4. Per bucket, windows with a lesser id in another part are sent back.
5. Each part covers the words of windows that an earlier document has; adjoining windows
   merge, so what is covered are maximal exact repeats.

Parts and buckets are ``spark.sql.shuffle.partitions`` times four and as many; both grow
with the cluster's setting. The exchange of the texts is the same in steps 1, 3 and 5.
Step 2 works with 30 bits of hash per bucket, enough as a filter; step 3 decides on 96.
"""
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import wordcols as W

cloudpickle.register_pickle_by_value(sys.modules[__name__])
SEND = 2_000_000  # probes a task holds before it sends them
U = np.uint64
ABSENT = np.iinfo(np.int64).max


def _key(hashes, buckets):
    """Bucket and 30 bits of each hash, as one number that sorts by bucket."""
    return ((hashes >> U(34)) % U(buckets)) << U(30) | (hashes & U(0x3FFFFFFF))


def _ids(column):
    return np.asarray(column.cast(pa.int64()).fill_null(ABSENT))


def _send_probes(block, buckets):
    def send(held):
        part, doc, key, grid = (np.concatenate(x) for x in zip(*held))
        named, part = np.unique(part, return_inverse=True)
        key |= part.astype(U) << U(52)
        order = np.lexsort((doc, key))
        key, doc, grid = key[order], doc[order], grid[order]
        at, _ = W.runs(key)
        end = np.append(at[1:], len(key)) - 1
        many = doc[at] != doc[end]
        grid = np.maximum.reduceat(grid, at)
        key = key[at]
        rows, _ = W.runs(key >> U(30))
        ends = np.append(rows[1:], len(key))
        value = (key & U(0x3FFFFFFF)).astype(np.uint32) << np.uint32(2) | grid.astype(np.uint32) << np.uint32(1) | many
        for a, b in zip(rows, ends):
            top = int(key[a]) >> 30
            yield top & 0x3FFFFF, int(named[top >> 22]), W.planes(np.diff(value[a:b], prepend=np.uint32(0)))

    def emit(batches):
        held, n = [], 0
        for batch in batches:
            parts, ids = np.asarray(batch["_part"]), _ids(batch["_id"])
            for w in W.chunks(batch["_text"]):
                at, h = w.window(block)
                local = w.doc[at]
                known = ids[w.lo + local] != ABSENT
                at, h, local = at[known], h[known], local[known]
                if len(at):
                    held.append((parts[w.lo + local], ids[w.lo + local], _key(h, buckets), (at - w.bounds[local]) % block == 0))
                    n += len(at)
                if n >= SEND:
                    yield from _rows(send(held))
                    held, n = [], 0
        if held:
            yield from _rows(send(held))

    return emit


ROWS = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("part", T.LongType()),
                     T.StructField("blob", T.BinaryType())])


def _rows(rows):
    rows = list(rows)
    for i in range(0, len(rows), 1000):
        b, p, x = zip(*rows[i:i + 1000])
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(p, pa.int64()), pa.array(x, pa.binary())],
                                         names=["bucket", "part", "blob"])


def _table(batches):
    batches = list(batches)
    empty = pa.table({"bucket": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
    return pa.Table.from_batches(batches) if batches else empty


def _shared_blocks(table):
    bucket, part = np.asarray(table["bucket"]), np.asarray(table["part"])
    values = [np.cumsum(W.unplanes(x.as_buffer(), np.uint32), dtype=np.uint32) for x in table["blob"]]
    source = np.repeat(np.arange(len(values)), [len(v) for v in values])
    value = np.concatenate(values)
    del values
    order = np.argsort(value, kind="stable")
    value, source = value[order], source[order]
    at, run = W.runs(value >> np.uint32(2))
    flags = np.bitwise_or.reduceat(value & np.uint32(3), at)
    count = np.diff(np.append(at, len(value)))
    good = ((flags & 2) > 0) & ((count > 1) | ((flags & 1) > 0))
    hit = good[run]
    value, source = value[hit] >> np.uint32(2), source[hit]
    order = np.argsort(source, kind="stable")
    value, source = value[order], source[order]
    at, _ = W.runs(source)
    out = [(int(bucket[source[a]]), int(part[source[a]]), W.planes(np.diff(value[a:b], prepend=np.uint32(0))))
           for a, b in zip(at, np.append(at[1:], len(value)))]
    return _table(_rows(out))


def _send_windows(window, block, buckets):
    def extend(docs, hits):
        ids = _ids(docs["_id"])
        if not len(hits) or not len(ids):
            return _table([])
        known = np.unique(np.concatenate(
            [np.cumsum(W.unplanes(x.as_buffer(), np.uint32), dtype=np.uint32).astype(U) | U(b) << U(30)
             for b, x in zip(hits["bucket"].to_pylist(), hits["blob"])]))
        first, second, doc = [], [], []
        for w in W.chunks(docs["_text"]):
            at, h = w.window(block)
            key = _key(h, buckets)
            spot = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = np.zeros(len(w.hash) + 1, np.int64)
            hit[at[known[spot] == key] + 1] = 1
            hit = np.cumsum(hit)
            at, h = w.window(window)
            near = (hit[at + window - block + 1] > hit[at]) & (ids[w.lo + w.doc[at]] != ABSENT)
            first.append(h[near])
            second.append((w.second_window(window)[near] >> U(32)).astype(np.uint32))
            doc.append(ids[w.lo + w.doc[at[near]]])
        first, second, doc = np.concatenate(first), np.concatenate(second), np.concatenate(doc)
        order = np.lexsort((doc, second, first))
        first, second, doc = first[order], second[order], doc[order]
        fresh = np.ones(len(first), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        first, second, doc = first[fresh], second[fresh], doc[fresh]
        bucket = first >> U(32)
        bucket %= U(buckets)
        order = np.argsort(bucket, kind="stable")
        first, second, doc, bucket = first[order], second[order], doc[order], bucket[order]
        part = docs["_part"][0].as_py()
        at, _ = W.runs(bucket)
        return _table(_rows([(int(bucket[a]), part, W.planes(np.diff(doc[a:b], prepend=0)) + W.planes(first[a:b]) + W.planes(second[a:b]))
                             for a, b in zip(at, np.append(at[1:], len(bucket)))]))

    return extend


def _earlier_elsewhere(table):
    bucket, part = np.asarray(table["bucket"]), np.asarray(table["part"])
    doc, first, second = [], [], []
    for x in table["blob"]:
        x = x.as_buffer()
        n = x.size // 20
        doc.append(np.cumsum(W.unplanes(x[:8 * n], np.int64)))
        first.append(W.unplanes(x[8 * n:16 * n], U))
        second.append(W.unplanes(x[16 * n:], np.uint32))
    source = np.repeat(np.arange(len(doc)), [len(v) for v in doc])
    doc, first, second = np.concatenate(doc), np.concatenate(first), np.concatenate(second)
    order = np.lexsort((doc, second, first))
    doc, first, second, source = doc[order], first[order], second[order], source[order]
    fresh = np.ones(len(first), bool)
    fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    least = doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    later = least < doc
    first, source = first[later], source[later]
    order = np.argsort(source, kind="stable")
    first, source = first[order], source[order]
    at, _ = W.runs(source)
    return _table(_rows([(int(bucket[source[a]]), int(part[source[a]]), W.planes(first[a:b]))
                         for a, b in zip(at, np.append(at[1:], len(first)))]))


def _covered(window):
    """Words of a part that windows of earlier documents cover: (chunk, mask) by chunk."""
    def cover(docs, answers):
        ids = _ids(docs["_id"])
        known = np.unique(np.concatenate([np.zeros(0, U)] + [W.unplanes(x.as_buffer(), U) for x in answers["blob"]]))
        first, second, doc, size = [], [], [], []
        for w in W.chunks(docs["_text"]):
            at, h = w.window(window)
            first.append(h)
            second.append(w.second_window(window))
            doc.append(ids[w.lo + w.doc[at]])
        first, second, doc = np.concatenate(first), np.concatenate(second), np.concatenate(doc)
        order = np.lexsort((doc, second, first))
        a, b, d = first[order], second[order], doc[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        later = np.zeros(len(a), bool)
        if len(a):
            later[order] = d > d[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        del second, order, a, b, d, fresh
        if len(known):
            later |= known[np.minimum(np.searchsorted(known, first), len(known) - 1)] == first
        later &= doc != ABSENT
        n = 0
        for w in W.chunks(docs["_text"]):
            at, _ = w.window(window)
            hit = at[later[n:n + len(at)]]
            n += len(at)
            edge = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + window, -1)
            yield w, np.cumsum(edge[:-1]) > 0

    return cover


def _rewrite(window, join_words, carried):
    cover = _covered(window)

    def finish(docs, answers):
        texts, n_words, n_removed = [], [], []
        source = docs["_text"]
        for w, gone in cover(docs, answers):
            total = np.concatenate([[0], np.cumsum(gone)])
            for i in range(len(w.offsets) - 1):
                a, b = w.bounds[i], w.bounds[i + 1]
                removed = int(total[b] - total[a])
                n_words.append(int(b - a))
                n_removed.append(removed)
                raw = w.data[w.offsets[i]:w.offsets[i + 1]].tobytes()
                if not removed:
                    texts.append(b" ".join(raw.split()) if join_words else raw if source[w.lo + i].is_valid else None)
                elif join_words:
                    words = raw.split()
                    texts.append(b" ".join([words[k] for k in np.flatnonzero(~gone[a:b])]))
                else:  # a removed run goes with the white space after it
                    base, edge = w.offsets[i], np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0))
                    cuts = [0, *(w.start[a + edge] - base), *([len(raw)] if len(edge) % 2 else [])]
                    pieces = [raw[x:y] for x, y in zip(cuts[0::2], cuts[1::2])]
                    if len(cuts) % 2:
                        pieces.append(raw[cuts[-1]:])
                    texts.append(b"".join(pieces).rstrip() if len(edge) % 2 else b"".join(pieces))
        out = {c: docs[c] for c in carried}
        out["_text"] = pa.array(texts, pa.binary()).cast(pa.string())
        out["_words"] = pa.array(n_words, pa.int64())
        out["_removed"] = pa.array(n_removed, pa.int64())
        return pa.table(out)

    return finish


def remove_repeats(docs, id_col="doc_id", text_col="text", window=50, join_words=False):
    """Documents without the passages that documents with a smaller id already have.

    A word goes when a window of ``window`` words covers it whose words also start
    somewhere in a document with a smaller id; windows are judged on the input texts.
    Returns the columns of ``docs`` with the text rewritten, and ``n_words`` and
    ``n_removed`` (long); a column of ``docs`` with one of these two names is replaced.
    ``join_words`` joins the kept words by one space; otherwise the white space of the
    text stays, and a text that loses nothing is returned as it is.

    Null or empty text: no words, returned as it is (joined: empty). Null id: the
    document is returned whole and no other document is held against it. Rows with
    equal ids never remove words of each other. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = window // 2
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    inner = {c: "_id" if c == id_col else "_text" if c == text_col else f"_c{i}" for i, c in enumerate(names)}
    part = F.pmod(F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.col("_text"))), F.lit(4 * buckets))
    dealt = (docs.select(*[F.col(f"`{c}`").alias(inner[c]) for c in names])
             .withColumn("_part", part).repartition(buckets, "_part"))
    probes = dealt.mapInArrow(_send_probes(block, buckets), ROWS)
    hits = probes.groupBy("bucket").applyInArrow(_shared_blocks, ROWS)
    windows = (dealt.groupBy("_part").cogroup(hits.groupBy("part"))
               .applyInArrow(_send_windows(window, block, buckets), ROWS))
    answers = windows.groupBy("bucket").applyInArrow(_earlier_elsewhere, ROWS)
    kinds = {inner[f.name]: f.dataType for f in docs.schema if f.name in inner}
    carried = [c for c in kinds if c != "_text"]
    schema = T.StructType([T.StructField(c, kinds[c]) for c in carried] + [
        T.StructField("_text", T.StringType()), T.StructField("_words", T.LongType()), T.StructField("_removed", T.LongType())])
    done = (dealt.groupBy("_part").cogroup(answers.groupBy("part"))
            .applyInArrow(_rewrite(window, join_words, carried), schema))
    return done.select(*[F.col(inner[c]).alias(c) for c in names], F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"))
