"""Nearest neighbours by inner product: vantage-point trees per shard.

Largest inner product becomes least distance by one more coordinate, sqrt(M**2 - |x|**2) for
rows (M the largest norm) and 0 for queries: the squared distance is then |q|**2 + M**2 -
2 <q, x>. Rows are dealt to shards by a hash of their id; each shard is one tree of vantage
points, with the range of distances of either side. A side is skipped for a query when the
triangle inequality puts all of it beyond the query's k-th best so far; with a ``factor``
above one the gap counts that many times, which skips more and may lose neighbours. Factor
one is exact.

Queries go in blocks against groups of shards; a task searches its shards one after another
with one list of the best per query, so the bound tightens, and returns k rows per query.
The work is queries times shards: every row is compared unless a bound skips it. Of rows
with equal vectors only the k + 1 least ids can be among the answers, so only those are kept;
the limit is applied in each task before the shuffle.

Bounds and products use double precision; the score of every candidate is computed anew in
one fixed order of summation, so equal vectors have equal scores and ties go to the smaller id.
"""
import io
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.llm.staging import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])
SHARD, GROUP, BLOCK, LEAF = 4096, 4, 1024, 256
SLACK = 1e-9  # products within this of a bound are computed anew in the fixed order
FOUND = "query_id long, vec_id long, score double"


def usable(vectors, id_col, vec_col, length=None):
    """(_id, _v): rows with an id and a finite, non-zero vector of ``length``, by default the commonest, each once."""
    v = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double"))
    held = vectors.select(F.col(f"`{id_col}`").cast("long").alias("_id"), v.alias("_v")).where("_id is not null and _v is not null")
    finite = ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("_v", lambda x: x != 0)
    held = held.where(finite).dropDuplicates()
    if length is not None:
        return held.where(F.size("_v") == length)
    common = held.groupBy(F.size("_v").alias("n")).agg(F.count("*").alias("c")).agg(F.max(F.struct("c", "n")).alias("m")).select("m.n")
    return held.where(F.size("_v") == common.scalar())


def _matrix(column):
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _build(top, leaf):
    def build(table):
        x, ids = _matrix(table["_v"]), np.asarray(table["_id"])
        order = np.argsort(ids)
        x, ids = x[order], ids[order]
        lifted = np.concatenate([x, np.sqrt(np.maximum(0, top * top - (x * x).sum(1)))[:, None]], 1)
        perm, nodes, rng = np.arange(len(ids)), [], np.random.default_rng(len(ids))

        def grow(lo, hi):
            """Node of the rows perm[lo:hi]: (lo, hi, vantage row, inner, outer, ranges of distances)."""
            own = len(nodes)
            nodes.append([lo, hi, -1, -1, -1, 0.0, 0.0, 0.0, 0.0])
            if hi - lo > leaf:
                at = int(perm[lo + rng.integers(hi - lo)])
                d = np.sqrt(((lifted[perm[lo:hi]] - lifted[at]) ** 2).sum(1))
                rank = np.argsort(d, kind="stable")
                perm[lo:hi], d = perm[lo:hi][rank], d[rank]
                half = (hi - lo) // 2
                nodes[own][2:] = [at, grow(lo, lo + half), grow(lo + half, hi), d[0], d[half - 1], d[half], d[-1]]
            return own

        grow(0, len(ids))
        out = io.BytesIO()
        place = np.empty(len(perm), np.int64)
        place[perm] = np.arange(len(perm))
        nodes = np.array(nodes, np.float64)
        nodes[:, 2] = np.where(nodes[:, 2] >= 0, place[np.maximum(nodes[:, 2], 0).astype(np.int64)], -1)
        np.savez(out, x=x[perm], lift=lifted[perm, -1], ids=ids[perm], nodes=nodes)
        return pa.table({"shard": table["shard"][:1], "tree": pa.array([out.getvalue()], pa.binary())})

    return build


class Best:
    """The k best of each query, by score and then by the smaller id."""

    def __init__(self, queries, own, k):
        self.q, self.own, self.k = queries, own, k
        self.score = np.full((len(queries), k), -np.inf)
        self.id = np.full((len(queries), k), np.iinfo(np.int64).max)

    def offer(self, rows, x, ids):
        """Compares the queries ``rows`` with all of x."""
        products = self.q[rows] @ x.T
        least = self.score[rows, -1]
        if len(ids) > self.k + 1:  # one more than k, as a query's own row does not count
            least = np.maximum(least, np.partition(products, len(ids) - self.k - 1, 1)[:, len(ids) - self.k - 1])
        i, j = np.nonzero(products >= least[:, None] - SLACK)
        i, new = rows[i], ids[j]
        other = new != self.own[i]
        i, j, new = i[other], j[other], new[other]
        exact = (self.q[i] * x[j]).sum(1)
        touched = np.unique(i)
        query = np.concatenate([i, np.repeat(touched, self.k)])
        score = np.concatenate([exact, self.score[touched].reshape(-1)])
        name = np.concatenate([new, self.id[touched].reshape(-1)])
        order = np.lexsort((name, -score, query))
        query, score, name = query[order], score[order], name[order]
        first = np.searchsorted(query, touched)
        take = (first[:, None] + np.arange(self.k)).reshape(-1)
        self.score[touched] = score[take].reshape(-1, self.k)
        self.id[touched] = name[take].reshape(-1, self.k)


def _search_tree(tree, best, top, factor):
    x, lift, ids, nodes = tree["x"], tree["lift"], tree["ids"], tree["nodes"]
    square = (best.q * best.q).sum(1) + top * top

    def far(rows, gap):
        """Which queries the side may hold something for: its least distance is within the k-th best."""
        reach = np.sqrt(np.maximum(0, square[rows] - 2 * best.score[rows, -1])) + SLACK
        return rows[np.maximum(gap, 0) * factor <= reach]

    def visit(k, rows):
        if not len(rows):
            return
        lo, hi, at, inner, outer, a, b, c, d = nodes[k]
        if at < 0:
            best.offer(rows, x[int(lo):int(hi)], ids[int(lo):int(hi)])
            return
        at = int(at)
        dist = np.sqrt(np.maximum(0, square[rows] + (x[at] @ x[at] + lift[at] ** 2 - top * top) - 2 * (best.q[rows] @ x[at])))
        near = dist <= (b + c) / 2
        for mine, first, second in ((near, (inner, a, b), (outer, c, d)), (~near, (outer, c, d), (inner, a, b))):
            own, away = rows[mine], dist[mine]
            for child, low, high in (first, second):
                gap = np.maximum(low - away, away - high)
                visit(int(child), far(own, gap))

    visit(0, np.arange(len(best.q)))


def _search(k, top, factor):
    def search(trees, queries):
        if not len(queries) or not len(trees):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        best = Best(_matrix(queries["_v"]), np.asarray(queries["_id"]), k)
        for blob in trees["tree"]:
            with np.load(io.BytesIO(blob.as_py())) as tree:
                _search_tree(dict(tree), best, top, factor)
        found = np.isfinite(best.score)
        query = np.repeat(best.own, k)[found.reshape(-1)]
        return pa.table({"query_id": query, "vec_id": best.id[found], "score": best.score[found]})

    return search


def nearest(vectors, queries, k=20, factor=2.0, id_col="vec_id", vec_col="embedding", shard=SHARD, leaf=LEAF):
    """``query_id``, ``rank`` (int, from 1), ``vec_id``, ``score``: the k rows of largest inner product.

    Both DataFrames have ``id_col`` and ``vec_col``. A row with a query's id is its own and no
    answer. Null ids, and vectors that are null, zero, hold null or non-finite components or
    have not the commonest length of ``vectors`` take no part; repeated rows count once. A query
    with fewer than k other rows gets all; no rows give an empty table. Other columns are not read.
    """
    own = Window.partitionBy("_v").orderBy("_id")
    points = stored(usable(vectors, id_col, vec_col), "vectors")
    count, top, length = points.agg(F.count("*"), F.max(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x)), F.max(F.size("_v"))).first()
    if not count:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top = float(top) ** 0.5 * (1 + 1e-12)
    shards, groups = -(-count // shard), -(-count // (shard * GROUP))
    kept = points.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= k + 1).drop("_r")
    trees = (kept.withColumn("shard", F.pmod(F.xxhash64("_id"), F.lit(shards))).groupBy("shard")
             .applyInArrow(_build(top, leaf), "shard long, tree binary"))
    trees = stored(trees, "trees")
    asked = usable(queries, id_col, vec_col, length)
    asked = stored(asked, "queries")
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(blocks)))
    # every block of queries meets every group of shards
    left = trees.select("tree", (F.col("shard") % groups).alias("group"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    right = asked.select("_id", "_v", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"))
    found = (left.groupBy("block", "group").cogroup(right.groupBy("block", "group"))
             .applyInArrow(_search(k, top, factor), FOUND))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
