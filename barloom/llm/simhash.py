"""Near-duplicates by SimHash: pivot distance tables, verification, connected components.

A fingerprint has 64 bits: bit k is 1 where more than half of the shingle hashes have it. Its
pivot table holds the Hamming distances to ``PIVOTS`` fixed reference fingerprints, 8 bits each,
packed into longs and computed once per distinct fingerprint. Distances of two fingerprints at
d bits to any reference differ by d at most, so a pair with a larger coordinate difference is
discarded; what is left is verified bit by bit.

One coordinate leaves about 46 % of all pairs of random fingerprints, so tables alone would
compare a constant share of all pairs. Pairs are therefore looked for where they can be: the
bits are cut into ``blocks`` blocks and two fingerprints at ``bits`` bits agree in all but
``bits`` of the blocks. Each choice of the other blocks is a bucket key (20 keys of 32 bits
for 6 blocks and 3 bits; 8 blocks give 56 keys of 40 bits, for more than 10**10 documents).

Equal fingerprints are one row from the start. In a bucket each fingerprint is first compared
with one representative, an aggregate with a map-side part, and the links give components.
Buckets whose members are in one component are done, whatever their size. In the others the
members outside of the most frequent component are compared with all members, in blocks, and
only links that join two components come out; no pair is dropped and nothing is capped.
"""
import itertools
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F

from barloom.llm.components import components
from barloom.llm.staging import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])
SEED = 42
#: reference fingerprints, 8 to a long of the table
PIVOTS = 16
#: fingerprints on a side of a block, and of one step inside it
BLOCK, STEP = 2048, 256
#: shingles counted at once; longer texts are counted in several steps
AT_ONCE = 50_000


def _fingerprint(text, size):
    """Unsigned fingerprint of the bytes of a text; 0 without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends]
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1:]
    count = np.zeros(64, np.int64)
    for lo in range(0, n, AT_ONCE):
        h = np.array([digest(joined[a:b - 1], SEED) for a, b in zip(starts[lo:min(n, lo + AT_ONCE)], last[lo:lo + AT_ONCE])], np.uint64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def _signer(size):
    def sign(batches):
        for batch in batches:
            texts = batch["_text"].cast(pa.large_binary()).fill_null(b"")
            prints = np.array([_fingerprint(t.as_py(), size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(prints)], names=["_id", "fp"])

    return sign


def fingerprints(docs, id_col="doc_id", text_col="text", shingle=3):
    """(_id long, fp long): the signed fingerprint of each whole text, A-Z in lower case.

    The hash of a shingle of words joined by one space is XXH64 with seed 42, repeats count;
    a text of fewer words is one shingle; a null text and one without words have fingerprint 0.
    """
    held = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return held.mapInArrow(_signer(shingle), "_id long, fp long")


def _references():
    """Fixed reference fingerprints as signed longs."""
    return np.random.default_rng(SEED).integers(-(1 << 63), (1 << 63) - 1, PIVOTS).tolist()


def _table(fp):
    """Pivot table of a fingerprint column: longs that hold 8 distances each."""
    refs = _references()
    far = [F.bit_count(fp.bitwiseXOR(F.lit(r))).cast("long") for r in refs]
    packed = []
    for lo in range(0, PIVOTS, 8):
        lanes = [F.shiftleft(d, 8 * k) for k, d in enumerate(far[lo:lo + 8])]
        all_ = lanes[0]
        for lane in lanes[1:]:
            all_ = all_.bitwiseOR(lane)
        packed.append(all_)
    return packed


def _close(a, b, bits):
    """No coordinate of two packed tables differs by more than ``bits``."""
    near = F.lit(True)
    for x, y in zip(a, b):
        for k in range(8):
            one, other = (F.shiftright(c, 8 * k).bitwiseAND(F.lit(255)) for c in (x, y))
            near = near & (F.abs(one - other) <= bits)
    return near


def _masks(blocks, bits):
    """Signed masks of all choices of blocks - bits blocks."""
    cuts = [64 * b // blocks for b in range(blocks + 1)]
    part = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    whole = [sum(c) for c in itertools.combinations(part, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def _pairs(one, other, t_one, t_other, bits):
    """Indices of pairs at ``bits`` bits or fewer of two arrays with their pivot tables."""
    order = np.argsort(t_other[:, 0], kind="stable")
    first = t_other[order, 0]
    for lo in range(0, len(one), STEP):
        here = t_one[lo:lo + STEP]
        a, b = np.searchsorted(first, here[:, 0] - bits, "left"), np.searchsorted(first, here[:, 0] + bits, "right")
        i = np.repeat(np.arange(len(here)), b - a)
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]
        for k in range(1, t_one.shape[1]):
            near = np.abs(here[i, k] - t_other[j, k]) <= bits
            i, j = i[near], j[near]
        near = np.bitwise_count(one[lo + i] ^ other[j]) <= bits
        yield lo + i[near], j[near]


def _block_links(bits):
    def link(table):
        fp, comp = np.asarray(table["fp"]).view(np.uint64), np.asarray(table["component"])
        left = np.asarray(pc.cast(table["left"], pa.int8())).astype(bool)
        packed = [np.asarray(table[c]).astype("<i8") for c in ("t0", "t1")]
        tables = np.concatenate([p.view(np.uint8).reshape(-1, 8) for p in packed], axis=1).astype(np.int16)
        one, two = np.flatnonzero(left), np.flatnonzero(~left)
        root, links = {}, []

        def find(c):
            while root.get(c, c) != c:
                root[c] = c = root.get(root[c], root[c])
            return c

        for i, j in _pairs(fp[one], fp[two], tables[one], tables[two], bits):
            apart = comp[one[i]] != comp[two[j]]
            for x, y in zip(one[i[apart]].tolist(), two[j[apart]].tolist()):
                a, b = find(int(comp[x])), find(int(comp[y]))
                if a != b:
                    root[a] = b
                    links.append((x, y))
        at = np.array(links, np.int64).reshape(-1, 2)
        signed = fp.view(np.int64)
        return pa.table({"u": pa.array(signed[at[:, 0]]), "v": pa.array(signed[at[:, 1]])})

    return link


def _left_over(keyed, labelled, bits, block):
    """Links between members of a bucket that are in different components."""
    member = keyed.join(labelled, "fp").select("j", "key", "fp", "component")
    split = (member.groupBy("j", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo <> hi").select("j", "key"))
    member = stored(member.join(split, ["j", "key"]), "open-buckets")
    sizes = member.groupBy("j", "key", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("j", "key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("m"))
    main = stored(main.select("j", "key", F.col("top.component").alias("main"), F.ceil(F.col("m") / block).cast("int").alias("_m"),
                              F.ceil((F.col("m") - F.col("top.n")) / block).cast("int").alias("_l")), "open-buckets")
    rows = member.join(main, ["j", "key"]).select("j", "key", "fp", "component", F.explode(F.expr("""
        concat(transform(sequence(0, _l - 1), i -> struct(false AS left, i AS bl, int(pmod(xxhash64(fp), _m)) AS bm)),
               if(component <> main, transform(sequence(0, _m - 1), i -> struct(true AS left, int(pmod(xxhash64(fp, 1), _l)) AS bl, i AS bm)), array()))""")).alias("s"))
    t0, t1 = _table(F.col("fp"))
    rows = rows.select("j", "key", "fp", "component", "s.*", t0.alias("t0"), t1.alias("t1"))
    return rows.groupBy("j", "key", "bl", "bm").applyInArrow(_block_links(bits), "u long, v long")


def near_prints(docs, id_col="doc_id", text_col="text", shingle=3, bits=3, blocks=6, block=BLOCK):
    """One row per document: id, ``fingerprint`` (long), ``component_id`` (least id it is connected to).

    Fingerprints with ``bits`` or fewer differing bits are linked, equal ones too. A null text and
    one without words have fingerprint 0 and are linked like any other. Null id: takes no part,
    component null. Rows of equal ids each keep their own fingerprint and component. Other
    columns of ``docs`` are not read; an empty table gives an empty table.
    """
    if not 0 < bits < blocks:
        raise ValueError("more blocks than bits are needed")
    signed = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = signed.where("_id is not null").groupBy("fp").agg(F.min("_id").alias("x"), F.count("*").alias("n"))
    t0, t1 = _table(F.col("fp"))
    prints = stored(classes.select("fp", "x", "n", t0.alias("t0"), t1.alias("t1")), "prints")
    keys = F.array(*[F.struct(F.lit(j).cast("tinyint").alias("j"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for j, m in enumerate(_masks(blocks, bits))])
    bucketed = prints.select("fp", "t0", "t1", F.explode(keys).alias("k")).select("k.j", "k.key", "fp", "t0", "t1")
    reps = bucketed.groupBy("j", "key").agg(F.min("fp").alias("rep"), F.max("fp").alias("other")).where("rep <> other")
    r0, r1 = _table(F.col("rep"))
    reps = reps.select("j", "key", "rep", r0.alias("r0"), r1.alias("r1"))
    met = stored(bucketed.join(reps, ["j", "key"]), "buckets")
    links = (met.where("fp <> rep").where(_close(("t0", "t1"), ("r0", "r1"), bits)).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("rep"))) <= bits)
             .select(F.col("fp").alias("u"), F.col("rep").alias("v")).distinct())
    joined = components(links)
    labelled = prints.join(joined, prints["fp"] == joined["id"], "left").select("fp", F.coalesce("component", "fp").alias("component"))
    rest = stored(_left_over(met.select("j", "key", "fp"), labelled, bits, block), "links")
    joined = components(joined.select(F.col("id").alias("u"), F.col("component").alias("v")).union(rest))
    grouped = prints.join(joined, prints["fp"] == joined["id"]).select("fp", "x", "component")
    least = grouped.groupBy("component").agg(F.min("x").alias("c"))
    label = grouped.join(least, "component").select("fp", "c")
    label = stored(prints.select("fp", "x", "n").join(label, "fp", "left").select("fp", "n", F.coalesce("c", "x").alias("c")), "labels")
    # fingerprints of more than a share of all rows, at most 1 / share of them, do not go through the shuffle
    share = 1 / (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    often = F.col("n") > signed.count() * share
    known = signed.join(F.broadcast(label.where(often).select("fp", F.col("c").alias("_often"))), "fp", "left")
    out = known.where("_often is not null").withColumn("c", F.col("_often")).unionByName(
        known.where("_often is null").join(label.where(~often).select("fp", "c"), "fp", "left"))
    return out.select(F.col("_id").alias(id_col), F.col("fp").alias("fingerprint"), F.when(F.col("_id").isNotNull(), F.col("c")).alias("component_id"))
