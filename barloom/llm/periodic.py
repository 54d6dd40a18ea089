"""Periodic stretches of words inside one text: sparse diagonals of equal words.

Word i lies on the diagonal of lag q when word i - q is the same. A diagonal that stays active
for L words in a row is a stretch of L + q words with period q. Words are read from left to
right; each one's earlier occurrences keep the diagonals of their lags active, and a diagonal
that the next word does not extend ends there and is emitted if it is long enough.

Two conditions of the bound keep the diagonals sparse without losing a run. A run of period q
repeats it three times or more, so its diagonal holds 2 q equal words: earlier occurrences
count for lags of at least K / 2 and less than K only where the whole window of K words
occurs again (exact ranks of windows, by prefix doubling; only windows that repeat go on to
the next doubling). And of the occurrences of one window at such lags only the farthest can
be a smallest period, and the nearest of those below the first K / 2: the others are multiples
of the window's own period, which a smaller lag reports. So a word has one active diagonal
per doubling, in texts of one repeated word too, and the work is n log n.
"""
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])
#: words worked off at once; a longer text is worked off by itself
WORDS_AT_ONCE = 200_000
#: documents of one returned batch
AT_ONCE = 500
RUNS = T.ArrayType(T.StructType([T.StructField(x, T.LongType(), False) for x in ("start", "length", "period")]), False)


def _word_ranks(texts):
    """(words of each text, ranks: equal for equal words of one text only)."""
    found = [t.split() for t in texts]
    ranks, base = [], 0
    for words in found:
        index = {}
        ranks += [index.setdefault(w, base + len(index)) for w in words]
        base += len(index)
    return found, np.array(ranks, np.int64)


def _repeated(at, key):
    """Of places and their keys those whose key occurs twice or more, and the rank of the key."""
    _, rank, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[rank] > 1
    return at[twice], rank[twice]


def _doubled(at, rank, k, n):
    """Repeated windows of 2 k words from those of k: place and rank."""
    dense = np.full(n + k, -1, np.int64)
    dense[at] = rank
    after = dense[at + k]
    both = after >= 0
    return _repeated(at[both], rank[both] * n + after[both])


def _lags(at, rank, k, n):
    """Active lags of each repeated window of k words: (places, lags) of at least k / 2, then of less."""
    order = np.argsort(rank, kind="stable")  # by window, then by place
    at, rank = at[order], rank[order]
    place = rank * n + at
    far = at - at[np.searchsorted(place, rank * n + np.maximum(at - (k - 1), 0))]
    near = np.zeros_like(at)
    near[1:] = np.where(rank[1:] == rank[:-1], at[1:] - at[:-1], 0)
    yield at[far >= (k + 1) // 2], far[far >= (k + 1) // 2]
    low = (near > 0) & (near < k // 2)
    yield at[low], near[low]


def _diagonals(at, lag, k):
    """(start, end, lag) of the stretches of diagonals that stay active from word to word."""
    if not len(at):
        return at, at, lag
    order = np.argsort(at)
    at, lag = at[order], lag[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1
    return at[first] - lag[first], at[last] + k, lag[first]


def _smaller_period(ranks, start, q):
    """Whether the stretch of period q has a period that divides q."""
    rest, p = q, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            step = q // p
            if np.array_equal(ranks[start:start + q], ranks[start + step:start + step + q]):
                return True
            while rest % p == 0:
                rest //= p
        p += 1
    return False


def _runs(ranks, least, times):
    """Sorted (start, end, period) of all runs in a row of texts."""
    n = len(ranks)
    if not n:
        return []
    at, rank = _repeated(np.arange(n), ranks)
    k, first, out = 1, 2, []
    while 2 * first <= 2 * least / 3:  # every run has a diagonal of two thirds of the least length
        first *= 2
    while len(at):
        if k >= first:
            bands = list(_lags(at, rank, k, n))
            for place, lag in bands if k == first else bands[:1]:
                for start, end, q in zip(*(x.tolist() for x in _diagonals(place, lag, k))):
                    if end - start >= max(least, times * q) and not _smaller_period(ranks, start, q):
                        out.append((start, end, q))
        at, rank = _doubled(at, rank, k, n)
        k *= 2
    return sorted(out, key=lambda r: (r[0], r[2]))


def _read(texts, least, times):
    """(runs as (start, length, period), words, collapsed text) of each text."""
    found, ranks = _word_ranks(texts)
    cuts = np.cumsum([0] + [len(w) for w in found])
    runs = _runs(ranks, least, times)
    doc = (np.searchsorted(cuts, [r[0] for r in runs], "right") - 1).tolist()
    own = [[] for _ in found]
    for d, (start, end, q) in zip(doc, runs):
        own[d].append((start - int(cuts[d]), end - start, q))
    for words, mine in zip(found, own):
        kept = words
        if mine:
            step = np.zeros(len(words) + 1, np.int64)
            for start, length, q in mine:
                step[start + q] += 1
                step[start + length] -= 1
            gone = np.cumsum(step[:-1]) > 0
            kept = [w for w, g in zip(words, gone.tolist()) if not g]
        yield mine, len(words), b" ".join(kept)


def _slices(sizes):
    """Runs of documents, by the bytes of each: at most AT_ONCE texts and about WORDS_AT_ONCE words."""
    lo, size = 0, 0
    for i, held in enumerate(sizes):
        more = held // 5 + 1
        if i > lo and (i - lo == AT_ONCE or size + more > WORDS_AT_ONCE):
            yield lo, i
            lo, size = i, 0
        size += more
    if lo < len(sizes):
        yield lo, len(sizes)


def find_runs(docs, text_col="text", least=24, times=3):
    """docs with ``n_words`` long, ``runs`` array<struct<start, length, period>> and ``collapsed`` string.

    A run is a stretch of words with smallest period q and a length of at least ``least`` words and
    ``times`` (3 or more) periods that no word beside it extends; runs are ordered by start, then
    period, words are numbered from 0. ``collapsed`` has the words joined by one space without
    those that a run contains after its first period. Null or empty text: no words, no runs, empty
    ``collapsed``. Rows are treated one by one, so repeated rows and null ids are nothing special;
    columns of these three names are replaced, all others kept. An empty table gives an empty table.
    """
    if times < 3:
        raise ValueError("times must be 3 or more")
    names = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    width = len(names)
    kind = pa.list_(pa.struct([pa.field(x, pa.int64(), False) for x in ("start", "length", "period")]))

    def run(batches):
        for batch in batches:
            texts = batch.column(width).cast(pa.large_binary()).fill_null(b"")
            for lo, hi in _slices(pc.binary_length(texts).to_pylist()):
                runs, words, kept = zip(*_read(texts[lo:hi].to_pylist(), least, times))
                found = pa.array([[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs], kind)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(lo, hi - lo).columns[:width], pa.array(words, pa.int64()), found, pa.array(kept, pa.binary()).cast(pa.string())],
                    names=[f"_{i}" for i in range(width + 3)])

    kinds = {f.name: f.dataType for f in docs.schema}
    schema = T.StructType([T.StructField(f"_{i}", kinds[c]) for i, c in enumerate(names)] + [
        T.StructField(f"_{width}", T.LongType()), T.StructField(f"_{width + 1}", RUNS), T.StructField(f"_{width + 2}", T.StringType())])
    held = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col(f"`{text_col}`").alias("_text"))
    return held.mapInArrow(run, schema).toDF(*names, "n_words", "runs", "collapsed")
