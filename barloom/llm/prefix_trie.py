"""Trie of conversation prefixes: sorted neighbours, union-find in descending depth, merged forests.

A conversation is the sequence of its turns, a turn a 128-bit hash of (role, text). Sorted by
their turns, all conversations under a trie node are neighbours, and two neighbours share as
many turns as their longest common prefix (LCP). The edges between neighbours are taken in
descending order of their LCP: what an edge joins was one component each down to that depth,
so the nodes of both chains above the edge's depth are complete, and the merge makes the
branching node at that depth. Sums over a subtree are sums over its interval of conversations
(what each one adds to the trie: the turns beyond its LCP), so a component only carries totals.

The sorted order is cut into partitions, by ranges of (turns, id), so that any number of copies
of one conversation can be split, and these into pieces of at most ``PIECE`` conversations. Each
piece gives its forest. Every value of a node is a sum, a least id or a hash of ids in
ascending order, so what lies on a boundary, the nodes on the paths to the first and last
conversation of a piece, is merged by the node's key (the hash of its turns) afterwards; LCPs
at boundaries are those of the whole order, so nothing is counted twice.
"""
import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.llm.staging import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])
#: conversations and turns of a piece, about; a longer conversation is a piece of its own
PIECE, PIECE_TURNS = 2000, 200_000
U = np.uint64
PART = ("k1 long, k2 long, depth long, p1 long, p2 long, conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends array<long>")
NODE = ("k1 long, k2 long, depth long, p1 long, p2 long, conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")
ADDED = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def _mix(x):
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Piece:
    """Consecutive conversations of the sorted order, flat: turns of row j are cut[j] to cut[j + 1]."""

    def __init__(self, ids, keys, sizes, before, after):
        self.ids = ids
        self.n = [len(s) for s in sizes]
        cut = np.cumsum([0] + self.n)
        flat = np.concatenate([np.asarray(k, np.int64) for k in keys]).astype(np.int64).view(U).reshape(-1, 2)
        place = np.arange(len(flat)) - np.repeat(cut[:-1], self.n) + 1  # depth of each turn
        self.lcp = [before, *self._shared(flat, cut), after]
        # per row one entry more than it has turns: depth 0 to its end
        row = np.repeat(np.arange(len(ids)), self.n)
        at = np.arange(len(flat)) + row + 1
        self.base = (cut[:-1] + np.arange(len(ids))).tolist()
        total = len(flat) + len(ids)

        def running(values, dtype):
            out = np.zeros(total, dtype)
            out[at] = values
            out = np.cumsum(out, dtype=dtype)
            return out - np.repeat(out[self.base], np.array(self.n) + 1)

        depth = place.astype(U) * U(0x9E3779B97F4A7C15)
        self.k1 = running(_mix(flat[:, 0] + depth), U).view(np.int64).tolist()
        self.k2 = running(_mix(flat[:, 1] ^ depth), U).view(np.int64).tolist()
        self.bytes = running(np.concatenate([np.asarray(s, np.int64) for s in sizes]).astype(np.int64), np.int64).tolist()

    def _shared(self, flat, cut):
        """LCP of each row with the one before it."""
        for j in range(1, len(self.n)):
            m = min(self.n[j - 1], self.n[j])
            same = (flat[cut[j - 1]:cut[j - 1] + m] == flat[cut[j]:cut[j] + m]).all(axis=1)
            yield m if same.all() else int(np.argmin(same))

    def nodes(self):
        """Rows of PART: the nodes of the piece, with what its conversations add to them."""
        m, n, lcp = len(self.ids), self.n, self.lcp
        whole = [self.bytes[b + k] for b, k in zip(self.base, n)]
        last, root = list(range(m)), list(range(m))  # of the component that starts at j: its last row; union-find parents
        deep = list(n)             # depth of the component's topmost node, not yet emitted
        least = list(self.ids)
        size, fresh = list(whole), [0] * m  # bytes of all turns; of the turns its rows but the first add
        leaves = [int(lcp[j + 1] < n[j]) for j in range(m)]
        kids = [0] * m             # children the rows but the first add to the topmost node

        def find(j):
            while root[j] != j:
                root[j] = j = root[root[j]]
            return j

        def chain(lo, down_to):
            """The nodes of depth deep[lo] down to down_to; all have the same conversations."""
            base, count = self.base[lo], last[lo] - lo + 1
            for d in range(deep[lo], down_to - 1, -1):
                at, above = base + d, base + d - 1
                ends = []
                if d == n[lo]:
                    hi = lo
                    while hi <= last[lo] and n[hi] == d:
                        hi += 1
                    ends = self.ids[lo:hi]
                new = int(d < n[lo] and lcp[lo] <= d) + (kids[lo] if d == deep[lo] else 0)
                upto = self.bytes[above] if d else 0
                added = fresh[lo] + whole[lo] - self.bytes[base + max(lcp[lo], d - 1, 0)]
                yield (self.k1[at], self.k2[at], d, self.k1[above] if d else None, self.k2[above] if d else None, least[lo],
                       count, new, leaves[lo], size[lo] - count * upto - added, ends)

        for j in sorted(range(1, m), key=lambda j: -lcp[j]):
            depth, a = lcp[j], find(j - 1)
            for side in (a, j):
                if deep[side] > depth:
                    yield from chain(side, depth + 1)
                    deep[side], kids[side] = depth, 0
            kids[a] += kids[j] + int(n[j] > depth)
            root[j], last[a], least[a] = a, last[j], min(least[a], least[j])
            size[a] += size[j]
            fresh[a] += fresh[j] + whole[j] - self.bytes[self.base[j] + depth]
            leaves[a] += leaves[j]
        yield from chain(0, 0)


def _lcp(a, b):
    """Turns two rows of interleaved keys have in common."""
    m = min(len(a), len(b))
    same = a[:m] == b[:m]
    return (m if same.all() else int(np.argmin(same))) // 2


def _pieces(batches):
    """Pieces of sorted rows (part, conv, keys, sizes, before, after)."""
    held, turns, before, part, after = [], 0, None, None, None

    def made(to):
        ids, keys, sizes = zip(*held)
        return Piece(list(ids), keys, sizes, before, to)

    for batch in batches:
        keys, sizes = batch["k"], batch["size"]
        for r, (p, conv, lo, hi) in enumerate(zip(*(batch[c].to_pylist() for c in ("part", "conv", "before", "after")))):
            k, s = (x[r].values.to_numpy(zero_copy_only=False) for x in (keys, sizes))
            if p != part:
                if held:
                    yield made(after)
                held, turns, before, part, after = [], 0, lo, p, hi
            elif len(held) >= PIECE or turns + len(s) > PIECE_TURNS:
                shared = _lcp(held[-1][1], k)
                yield made(shared)
                held, turns, before = [], 0, shared
            held.append((conv, k, s))
            turns += len(s)
    if held:
        yield made(after)


def _columns(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _names(schema):
    return [x.strip().split(" ")[0] for x in schema.split(",")]


def _forest(batches):
    kinds = [pa.int64()] * 10 + [pa.list_(pa.int64())]
    for piece in _pieces(batches):
        rows = []
        for row in piece.nodes():
            rows.append(row)
            if len(rows) == 5000:
                yield _columns(rows, _names(PART), kinds)
                rows = []
        if rows:
            yield _columns(rows, _names(PART), kinds)


def _merged(batches):
    """One row per node from its sorted parts; ids of ends are hashed as they come."""
    kinds, names = [pa.int64()] * 10 + [pa.string()], _names(PART)
    node, digest, out = None, None, []
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in names)):
            row = dict(zip(names, row))
            if node is None or (row["k1"], row["k2"], row["depth"]) != (node["k1"], node["k2"], node["depth"]):
                if node:
                    out.append((*[node[c] for c in names[:-1]], digest.hexdigest()))
                node, digest, some = row, hashlib.sha256(), False
            else:
                node["conv_id"] = min(node["conv_id"], row["conv_id"])
                for c in ADDED:
                    node[c] += row[c]
            if row["ends"]:
                digest.update(("," if some else "").encode() + ",".join(map(str, row["ends"])).encode())
                some = True
        if len(out) >= 5000:
            yield _columns(out, _names(NODE), kinds)
            out = []
    if node:
        out.append((*[node[c] for c in names[:-1]], digest.hexdigest()))
        yield _columns(out, _names(NODE), kinds)


def prefix_trie(turns, ids=None, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text"):
    """One row per trie node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (root: null), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (long) and ``ends_sha256`` (string).

    A node of depth d is a distinct sequence of first d turns (role, text); the root has no turns
    and all conversations. ``saved_tokens`` is the sum over the node's subtree, itself included, of (n_convs - 1)
    times the UTF-8 bytes of the last text. ``ends_sha256`` hashes the decimal ids of the conversations of exactly these d
    turns, ascending, joined by commas. Turns are ordered by number, null first, equal numbers by the
    hash of (role, text); null role or text counts as empty. Rows of a null conversation take no part.
    ``ids`` may name further conversations in ``conv_col``; those without turns are members of the root only. Repeated
    rows are repeated turns. Other columns are not read; no conversations give an empty table.

    A conversation's turns are one row of 24 bytes a turn, never its texts.
    """
    spark = turns.sparkSession
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    keys = F.struct(F.col(f"`{turn_col}`").alias("t"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"),
                    F.octet_length(text).cast("long").alias("n"))
    rows = turns.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), keys.alias("s"))
    if ids is not None:
        rows = rows.unionByName(ids.select(F.col(f"`{conv_col}`").cast("long").alias("conv")).distinct().withColumn("s", F.lit(None).cast(rows.schema["s"].dataType)))
    seq = rows.where("conv is not null").groupBy("conv").agg(F.sort_array(F.collect_list("s")).alias("s"))
    seq = stored(seq.select("conv", F.flatten(F.transform("s", lambda x: F.array(x["a"], x["b"]))).alias("k"), F.transform("s", lambda x: x["n"]).alias("size")), "turns")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(seq.repartitionByRange(parts, "k", "conv").withColumn("part", F.spark_partition_id()), "sorted-turns")
    # a handful of rows: the least and greatest sequence of each part
    ends = dealt.groupBy("part").agg(F.min(F.struct("k", "conv")).alias("lo"), F.max(F.struct("k", "conv")).alias("hi"))
    order = Window.orderBy("part")

    def shared(a, b):
        place = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
        return F.when(b.isNull() | a.isNull(), -1).when(place == 0, F.size(a)).otherwise(place - 1)

    ends = ends.select("part", F.floor(shared(F.col("lo.k"), F.lag("hi.k").over(order)) / 2).cast("long").alias("before"),
                       F.floor(shared(F.col("hi.k"), F.lead("lo.k").over(order)) / 2).cast("long").alias("after"))
    pieces = (dealt.join(ends, "part").repartition(parts, "part").sortWithinPartitions("part", "k", "conv")
              .select("part", "conv", "k", "size", "before", "after"))
    partial = pieces.mapInArrow(_forest, PART).withColumn("first", F.get("ends", F.lit(0)))
    partial = partial.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "depth", "first").drop("first")
    nodes = stored(partial.mapInArrow(_merged, NODE), "nodes")
    top = nodes.where("depth = 0").agg(F.min("conv_id")).first()[0]  # one number
    above = nodes.where("n_children > 0 and depth > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("_above"))
    deep = nodes.where("depth > 1").join(above, ["p1", "p2"], "left").withColumn("parent_conv_id", F.col("_above"))
    flat = nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(top)).cast("long"))
    columns = ("conv_id", "depth", "parent_conv_id", *ADDED, "ends_sha256")
    return flat.select(*columns).union(deep.select(*columns))
