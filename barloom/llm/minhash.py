"""Near-duplicates: tensored MinHash tables, exact confirmation, connected components.

Two small collections of ``TABLES`` keys are computed, each key from ``WIDTH`` minhashes.
A table is a pair (key of the first, key of the second), so 10 + 10 keys of 3 minhashes
give 100 tables of 6: 60 minhashes instead of 600. Documents meet in a table when any key
of either collection agrees; at similarity s that is missed with probability of about
2 (1 - s**3)**10: 1.5e-4 at 0.85, 4e-6 at 0.9, 1e-9 at 0.95, for a single pair.

Documents with equal shingle sets are one class, found by a 128-bit sum over the set, and
only classes meet. Within a table entry each class is compared with one pivot, the class
whose keys most others share, so a group of near copies gives one pair per member. What
the pivot leaves apart is compared in blocks: classes not connected with the pivot against
all that share it, by products of incidence matrices that emit only links which join two
components. No pair is dropped and nothing is capped; the blocks' work is the number of
left-over classes of a pivot times those that share it.
"""
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from barloom.llm import wordcols as W
from barloom.llm.components import components
from barloom.llm.staging import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])
TABLES, WIDTH = 10, 3
BLOCK = 1000  # classes on a side of a block
U = np.uint64
SIGNED = "_id long, _n long, _f1 long, _f2 long, _a array<long>, _b array<long>"


def _shingles(w, size):
    """(document, hash) of the distinct shingles of a chunk, sorted; short texts are one shingle."""
    at, h = w.window(size)
    doc = w.doc[at]
    count = np.diff(w.bounds)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        doc = np.concatenate([doc, short])
        h = np.concatenate([h, np.array([w.sequence(d) for d in short], U)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[fresh], h[fresh]


def _sign(size, tables, width):
    rng = np.random.default_rng(20240607)
    flips = rng.integers(0, 1 << 63, (2, tables, width), dtype=U)
    odds = rng.integers(0, 1 << 63, (2, tables, width), dtype=U) * U(2) + U(1)

    def sign(batches):
        for batch in batches:
            n = batch.num_rows
            count, f1, f2 = np.zeros(n, np.int64), np.zeros(n, U), np.zeros(n, U)
            keys = np.zeros((2, n, tables), U)
            for w in W.chunks(batch["_text"], lower=True):
                doc, h = _shingles(w, size)
                if not len(h):
                    continue
                at, _ = W.runs(doc)
                row = w.lo + doc[at]
                count[row] = np.diff(np.append(at, len(h)))
                f1[row], f2[row] = np.add.reduceat(W.mix(h, 1), at), np.add.reduceat(W.mix(h, 2), at)
                for side in range(2):
                    for t in range(tables):
                        key = np.full(len(row), 2 * t + side + 1, U)
                        for k in range(width):
                            key = W.mix(key + np.minimum.reduceat((h ^ flips[side, t, k]) * odds[side, t, k], at))
                        keys[side, row, t] = key
            lists = [pa.ListArray.from_arrays(np.arange(0, n * tables + 1, tables, dtype=np.int32),
                                              pa.array(x.reshape(-1).view(np.int64))) for x in keys]
            yield pa.RecordBatch.from_arrays([batch["_id"].cast(pa.int64()), pa.array(count), pa.array(f1.view(np.int64)),
                                              pa.array(f2.view(np.int64)), *lists], names=["_id", "_n", "_f1", "_f2", "_a", "_b"])

    return sign


def _sets(column, size):
    """The shingle set of each text as a sorted array."""
    for w in W.chunks(column, lower=True):
        doc, h = _shingles(w, size)
        cuts = np.searchsorted(doc, np.arange(len(w.offsets)))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield h[a:b]


def _alike(both, one, other, share):
    """Whether sets of these sizes with ``both`` elements in common are linked; whole numbers only."""
    return 100 * both >= share * (one + other - both)


def _confirm(size, share):
    def confirm(batches):
        for batch in batches:
            good = []
            for x, y in zip(_sets(batch["_tx"], size), _sets(batch["_ty"], size)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(bool(both) and _alike(both, len(x), len(y), share))
            kept = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["x"].filter(kept), batch["pivot"].filter(kept)], names=["u", "v"])

    return confirm


def _block_links(size, share):
    def link(table):
        sets = list(_sets(table["_text"], size))
        ids, comp = np.asarray(table["x"]), np.asarray(table["component"])
        left = np.asarray(table["left"].combine_chunks().cast(pa.int8())).astype(bool)
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        _, spot = np.unique(np.concatenate(sets), return_inverse=True)
        often = np.flatnonzero(np.bincount(spot) > 1)
        rank = np.full(spot.max() + 1, -1)
        rank[often] = np.arange(len(often))
        column = rank[spot]
        doc, column = doc[column >= 0], column[column >= 0]
        one, two = np.flatnonzero(left), np.flatnonzero(~left)
        both = np.zeros((len(one), len(two)), np.float32)
        for lo in range(0, len(often), 4096):  # counts stay below 2**24, so float32 is exact
            here = (column >= lo) & (column < lo + 4096)
            grid = np.zeros((len(sets), min(4096, len(often) - lo)), np.float32)
            grid[doc[here], column[here] - lo] = 1
            both += grid[one] @ grid[two].T
        n = np.array([len(s) for s in sets])
        both = both.astype(np.int64)
        good = _alike(both, n[one][:, None], n[two][None, :], share) & (both > 0) & (comp[one][:, None] != comp[two][None, :])
        root, links = {}, []

        def find(c):
            while root.get(c, c) != c:
                c = root[c]
            return c

        for i, j in zip(*np.nonzero(good)):
            a, b = find(comp[one[i]]), find(comp[two[j]])
            if a != b:
                root[a] = b
                links.append((int(ids[one[i]]), int(ids[two[j]])))
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})

    return link


def _left_over(dealt, pairs, first, size, share, block):
    """Links between classes that share a pivot and that the links to pivots leave apart."""
    member = pairs.union(pairs.select("pivot", "pivot").distinct())
    label = first.select(F.col("id").alias("x"), "component")
    member = (member.join(label, "x", "left").withColumn("component", F.coalesce("component", "x"))
              .join(label.select(F.col("x").alias("pivot"), F.col("component").alias("_pc")), "pivot", "left")
              .withColumn("apart", F.col("component") != F.coalesce("_pc", "pivot")))
    # stored, so that the join deals only plain rows by pivot and a hot pivot can be split
    size_of = stored(member.groupBy("pivot").agg(F.count("*").alias("_m"), F.sum(F.col("apart").cast("long")).alias("_l"))
               .where("_l > 0 and _m > 2")
               .select("pivot", F.ceil(F.col("_m") / block).cast("int").alias("_m"), F.ceil(F.col("_l") / block).cast("int").alias("_l")), "pivots")
    rows = member.join(size_of, "pivot").select(
        "pivot", "x", "component", F.explode(F.expr("""
            concat(transform(sequence(0, _l - 1), i -> struct(false AS left, i AS bl, int(pmod(xxhash64(x), _m)) AS bm)),
                   if(apart, transform(sequence(0, _m - 1), i -> struct(true AS left, int(pmod(xxhash64(x, 1), _l)) AS bl, i AS bm)),
                      array()))""")).alias("s")).select("pivot", "x", "component", "s.*")
    texts = dealt.select(F.col("_id").alias("x"), "_text")
    return (rows.join(texts, "x").groupBy("pivot", "bl", "bm")
            .applyInArrow(_block_links(size, share), "u long, v long"))


def near_duplicates(docs, id_col="doc_id", text_col="text", shingle=5, percent=80, tables=TABLES, width=WIDTH, block=BLOCK):
    """One row per document: id, ``n_shingles``, ``component_id`` (least id it is connected to), ``kept``.

    The set of a text: the distinct runs of ``shingle`` words, A-Z in lower case; a text of
    fewer words is one run. Texts are linked when 100 * intersection >= percent * union of
    their whole sets. Null or empty text: empty set, linked with nothing, kept. Null id:
    takes no part, component null, kept. Rows with equal ids count as one document. Other
    columns of ``docs`` are not read; an empty table gives an empty table.
    """
    dealt = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    signed = stored(dealt.mapInArrow(_sign(shingle, tables, width), SIGNED), "signed")
    full = signed.where("_n > 0 and _id is not null")
    classes = full.groupBy("_f1", "_f2").agg(F.min("_id").alias("x"))
    keyed = (full.join(classes, ["_f1", "_f2"]).where("_id = x").select("x", "_a", "_b").dropDuplicates(["x"]))
    first = keyed.select("x", F.explode("_a").alias("a"))
    shared = first.groupBy("a").agg(F.count("*").alias("c")).where("c > 1")
    met = first.join(shared, "a")
    score = met.groupBy("x").agg(F.sum("c").alias("score"))
    entry = (met.select("x", "a").join(keyed.select("x", "_b"), "x").join(score, "x")
             .select("x", "score", "a", F.explode("_b").alias("b")))
    pivots = (entry.groupBy("a", "b").agg(F.max(F.struct("score", (-F.col("x")).alias("x"))).alias("top"), F.count("*").alias("c"))
              .where("c > 1").select("a", "b", (-F.col("top.x")).alias("pivot")))
    pairs = stored(entry.join(pivots, ["a", "b"]).where("x <> pivot").select("x", "pivot").distinct(), "pairs")
    texts = dealt.where("_id is not null")
    sides = (pairs.join(texts.select(F.col("_id").alias("x"), F.col("_text").alias("_tx")), "x")
             .join(texts.select(F.col("_id").alias("pivot"), F.col("_text").alias("_ty")), "pivot"))
    links = stored(sides.mapInArrow(_confirm(shingle, percent), "u long, v long"), "links")
    joined = components(links)
    rest = stored(_left_over(texts, pairs, joined, shingle, percent, block), "links")
    joined = components(joined.select(F.col("id").alias("u"), F.col("component").alias("v")).union(rest))
    label = classes.join(joined, classes["x"] == joined["id"], "left").select("_f1", "_f2", F.coalesce("component", "x").alias("_c"))
    out = signed.join(label, ["_f1", "_f2"], "left")
    component = F.when(F.col("_n") == 0, F.col("_id")).when(F.col("_id").isNotNull(), F.col("_c"))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))
