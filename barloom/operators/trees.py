"""Trees on binned columns: boosting, forests and extremely randomised trees inside one task.

A task has the rows of one cohort of symbols for one target and fold, so its size is bounded by
the cohort, and Spark deals out cohorts, targets, folds and kinds of model. Rows to be scored
come along, so no model leaves its task. Every random choice is a hash of (row, tree) or of
(tree, node, column) and rows are sorted before, so the result does not depend on the partitioning.
"""
import sys

import numpy as np
from pyspark import cloudpickle

# tasks get these functions by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
BINS = 32
#: ridge on the leaves of boosted trees
RIDGE = 1.0
#: nodes of a level up to which two columns share a histogram; cells of histograms worked on at a time
PAIRED, CELLS = 16, 1 << 16
#: nodes of a level up to which histograms are kept, so that one child of two is had by subtraction
KEPT = 128
#: sums up to each cut
UP_TO = np.tril(np.ones((BINS - 1, BINS)))
U = np.uint64


def hashed(*keys):
    """Mixed 64-bit hash of integer arrays and numbers."""
    x = U(0x243F6A8885A308D3)
    with np.errstate(over="ignore"):
        for k in keys:
            x = (x ^ np.asarray(k).astype(np.int64).view(U)) * U(0x9E3779B97F4A7C15)
            x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
            x = x ^ (x >> U(32))
    return x


def uniform(*keys):
    """Repeatable numbers in [0, 1) from hashes of integer keys."""
    return (hashed(*keys) >> U(11)).astype(np.float64) / float(1 << 53)


def sampled_columns(count, share, *keys):
    """The share of the columns with the smallest hashes, at least one, in order."""
    take = max(1, int(count * share))
    return np.sort(np.argsort(hashed(*keys, np.arange(count)), kind="stable")[:take])


def poisson(u):
    """Weights of a bootstrap sample: counts of a Poisson law of mean one from uniform numbers."""
    steps = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1), dtype=float) for k in range(12)])
    return np.searchsorted(steps, u, "right").astype(np.float64)


def paired(x):
    """Bins of columns 2 k and 2 k + 1 as one number: below ``PAIRED`` nodes two columns cost one pass over the rows."""
    odd = np.zeros((x.shape[0] % 2, x.shape[1]), np.uint8)
    x = np.concatenate([x, odd]).astype(np.int64)
    return x[::2] * BINS + x[1::2]


def _parts(g, w):
    """What is added up per bin, how to read (sum of g, sum of w) from sums of it, and what a weight of one adds to the last part.

    Whole weights share a double with g, held as whole multiples of a unit of about 2**-18 of the
    mean size of g for 50,000 rows: one pass instead of two, and the sums do not depend on the order.
    """
    if w is not None and (w != np.rint(w)).any():
        return [g, w], lambda sums: sums, 1.0
    weight = len(g) if w is None else w.sum()
    room = 2.0 ** (51 - int(weight).bit_length())
    unit = np.abs(g).sum() * 2 / room or 1.0

    def read(sums):
        many = np.rint(sums[0] / (2 * room))
        return (sums[0] - many * (2 * room)) * unit, many

    return [np.rint(g / unit) + (2 * room if w is None else 2 * room * w)], read, 2 * room


def _histogram(x, pairs, at, parts, m, columns, rows=None):
    """Sums by part, column, node and bin over rows, all if None; rows of node m take no part."""
    out = np.empty((len(parts), len(columns), m, BINS))
    if m <= PAIRED and pairs is not None:
        base, size, done = at * BINS ** 2, m * BINS ** 2, {}
        for i, c in enumerate(columns):
            if c // 2 not in done:
                cell = base + (pairs[c // 2] if rows is None else pairs[c // 2].take(rows))
                done = {c // 2: [np.bincount(cell, p, size + BINS ** 2)[:size].reshape(m, BINS, BINS) for p in parts]}
            for k, held in enumerate(done[c // 2]):
                held.sum(axis=1 if c % 2 else 2, out=out[k, i])
        return out
    base, size = at * BINS, m * BINS
    for i, c in enumerate(columns):
        cell = base + (x[c] if rows is None else x[c].take(rows))
        for k, p in enumerate(parts):
            out[k, i] = np.bincount(cell, p, size + BINS)[:size].reshape(m, BINS)
    return out


def _gains(left_g, left_w, total, weight, ridge, least):
    """Score of each split above T * T / (weight + 2 ridge); -1 where a side is lighter than ``least``.

    With a, b the weights of the sides plus the ridge and V = a + b, the squares of the two sides over
    a and b are T * T / V + V * (L - a * T / V) ** 2 / (a * b), and a * b is least where a side is lightest.
    """
    both = weight + 2 * ridge
    a = left_w + ridge if ridge else left_w
    gain = a * (total / both)
    gain -= left_g
    gain *= gain
    b = both - a
    b *= a
    with np.errstate(divide="ignore", invalid="ignore"):
        gain /= b
        gain *= both
    gain[b < (least + ridge) * (weight - least + ridge) * (1 - 1e-12)] = -1.0
    return gain


def _children(held, split, x, pairs, at, parts, columns):
    """Histograms of the children of the split nodes: the one with fewer rows by its rows, the other by subtraction."""
    m = np.count_nonzero(split)
    count = np.bincount(at, minlength=2 * m + 1)[:2 * m].reshape(m, 2)
    fewer = 2 * np.arange(m) + (count[:, 1] < count[:, 0])
    pick = np.zeros(2 * m + 1, bool)
    pick[fewer] = True
    rows = np.flatnonzero(pick.take(at))
    few = _histogram(x, pairs, at.take(rows) >> 1, [p.take(rows) for p in parts], m, columns, rows)
    out = np.empty((*held.shape[:2], 2 * m, BINS))
    out[:, :, fewer] = few
    out[:, :, fewer ^ 1] = held[:, :, split] - few
    return out


def _best_cuts(histograms, read, total, weight, ridge, least):
    """(score, column, last bin of the left side) of each node over all cuts, by histograms."""
    m = len(total)
    best, column, cut, nodes = np.full(m, -1.0), np.zeros(m, np.int64), np.zeros(m, np.int64), np.arange(m)
    for chunk, held in histograms:
        gain = _gains(*read(np.matmul(UP_TO, held.swapaxes(2, 3))), total, weight, ridge, least)
        top = gain.max(axis=1)
        first = top.argmax(axis=0)
        value = top[first, nodes]
        better = np.flatnonzero(value > best)
        best[better], column[better], cut[better] = value[better], chunk[first[better]], gain[first[better], :, better].argmax(axis=1)
    return best, column, cut


def _random_cuts(histograms, read, one, total, weight, ridge, least, names, seed):
    """As ``_best_cuts`` over one random cut per node and column, drawn between the node's least and greatest bin."""
    m = len(total)
    best, column, cut, nodes = np.full(m, -1.0), np.zeros(m, np.int64), np.zeros(m, np.int64), np.arange(m)
    for chunk, held in histograms:
        sums = np.matmul(UP_TO, held.swapaxes(2, 3))
        low, high = ((sums[-1] < edge).view(np.uint8).sum(axis=1, dtype=np.uint8).astype(np.int64) for edge in (0.5 * one, (weight - 0.5) * one))
        cuts = low + (uniform(seed, names[None, :], chunk[:, None]) * (high - low)).astype(np.int64)
        at = np.take_along_axis(sums, np.minimum(cuts, BINS - 2)[None, :, None, :], axis=2)[:, :, 0]
        gain = _gains(*read(at), total, weight, ridge, least)
        gain[low == high] = -1.0
        first = gain.argmax(axis=0)
        value = gain[first, nodes]
        better = np.flatnonzero(value > best)
        best[better], column[better], cut[better] = value[better], chunk[first[better]], cuts[first[better], better]
    return best, column, cut


def grow(x, g, w, depth, least, ridge=0.0, columns=None, seed=None, pairs=None):
    """One tree as arrays over node numbers: column (-1: leaf), last bin of the left side, value, gain.

    x: bins, a row per column; g: targets or negative gradients times the weight; w: weights, None
    for ones. A node splits at the cut of greatest gain if that is positive and its value is the
    sum of g over the sum of w plus ``ridge``; with ``seed`` cuts are random. Children of node k
    are 2 k + 1 and 2 k + 2. ``pairs``: ``paired(x)``, if at hand.
    """
    return _grow(x, g, w, depth, least, ridge, columns, seed, pairs)[0]


def _grow(x, g, w, depth, least, ridge=0.0, columns=None, seed=None, pairs=None):
    """The tree and the leaf of every row of x."""
    columns = np.arange(len(x)) if columns is None else columns
    size = (2 << depth) - 1
    tree = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
    (parts, read, one), n = _parts(g, w), x.shape[1]
    at, names, leaf, place, held = np.zeros(n, np.int64), np.zeros(1, np.int64), np.zeros(n, np.int64), None, None
    for level in range(depth + 1):
        m = len(names)
        # gains are taken from sums in the unit of the parts, values from g itself
        sums, weight = read([np.bincount(at, p, m + 1)[:m] for p in parts])
        total = sums if len(parts) > 1 else np.bincount(at, g, m + 1)[:m]
        tree[2][names] = total / (weight + ridge)
        heavy = weight >= 2 * least
        if level == depth or not heavy.any():
            break
        if not heavy.all():  # nodes too light to split are done
            names, total, weight, sums, held = names[heavy], total[heavy], weight[heavy], sums[heavy], None if held is None else held[:, :, heavy]
            at = np.append(np.where(heavy, np.cumsum(heavy) - 1, len(names)), len(names)).take(at)
            m = len(names)
            live = at < m
            if np.count_nonzero(live) < 0.75 * len(at):  # rows of leaves are put aside
                rows = np.flatnonzero(live)
                place = rows if place is None else place[rows]
                x, pairs = x.take(rows, axis=1), None if pairs is None or m > PAIRED else pairs.take(rows, axis=1)
                g, at, parts = g.take(rows), at.take(rows), [p.take(rows) for p in parts]
        if held is None and m <= KEPT:
            held = _histogram(x, pairs, at, parts, m, columns)
        room = max(1, CELLS // (m * BINS))
        chunks = ((columns[i:i + room], _histogram(x, pairs, at, parts, m, columns[i:i + room]) if held is None else held[:, i:i + room]) for i in range(0, len(columns), room))
        if seed is None:
            gain, column, cut = _best_cuts(chunks, read, sums, weight, ridge, least)
        else:
            gain, column, cut = _random_cuts(chunks, read, one, sums, weight, ridge, least, names, seed)
        split = gain >= 0
        gain = gain + sums ** 2 / (weight + 2 * ridge) - sums ** 2 / (weight + ridge) if ridge else gain
        split &= gain > 1e-12 * np.maximum(1.0, np.abs(total))
        if not split.any():
            break
        for part, value in zip((0, 1, 3), (column, cut, gain)):
            tree[part][names[split]] = value[split]
        width = x.shape[1]
        right = x.ravel().take(np.append(column * width, 0).take(at) + np.arange(width)) > np.append(cut, 0).astype(np.uint8).take(at)
        if split.all() and place is None and at.max() < m:
            leaf = 2 * leaf + 1 + right
            at = 2 * at + right
        else:
            new = np.append(np.where(split, 2 * (np.cumsum(split) - 1), -1), -1).take(at)
            moved = new >= 0
            rows = np.flatnonzero(moved) if place is None else place[moved]
            leaf[rows] = 2 * leaf[rows] + 1 + right[moved]
            at = np.where(moved, new + right, 2 * np.count_nonzero(split))
        names = np.stack([2 * names[split] + 1, 2 * names[split] + 2], axis=1).ravel()
        held = _children(held, split, x, pairs, at, parts, columns) if held is not None and len(names) <= KEPT and level + 1 < depth else None
    return tree, leaf


def value_of(tree, x):
    """Value of the leaf of every row."""
    column, cut, value, _ = tree
    flat, node, rows = x.ravel(), np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
    while True:
        k = node[rows]
        inner = column[k] >= 0
        if not inner.all():
            rows, k = rows[inner], k[inner]
        if not len(rows):
            return value[node]
        node[rows] = 2 * k + 1 + (flat.take(column[k] * x.shape[1] + rows) > cut[k])


def boosted(x, y, keys, scored, rounds, depth, rate, least, rows, columns, seed=42):
    """Predictions for the columns of ``scored`` by boosting squared error on x, y."""
    base, pairs = y.mean(), paired(x)
    fit, out = np.full(len(y), base), np.full(scored.shape[1], base)
    for r in range(rounds):
        own = (uniform(seed, r, keys) < rows).astype(np.float64)  # rows left out have weight 0
        if own.any():
            tree, leaf = _grow(x, (y - fit) * own, own, depth, least, RIDGE, sampled_columns(len(x), columns, seed, r), pairs=pairs)
            fit += rate * tree[2][leaf]
            out += rate * value_of(tree, scored)
    return out


def forest(x, y, keys, scored, trees, depth, least, seed=42):
    """Mean over trees of bootstrap samples that try all cuts."""
    out, pairs = np.zeros(scored.shape[1]), paired(x)
    for t in range(trees):
        times = poisson(uniform(seed, t, keys))
        own = np.flatnonzero(times)
        if len(own):
            out += value_of(grow(x.take(own, axis=1), (y * times)[own], times[own], depth, least, pairs=pairs.take(own, axis=1)), scored)
    return out / trees


def extra_trees(x, y, keys, scored, trees, depth, least, seed=42):
    """Mean over extremely randomised trees of all rows."""
    pairs = paired(x)
    return sum(value_of(grow(x, y, None, depth, least, seed=seed * 100_003 + t, pairs=pairs), scored) for t in range(trees)) / trees


def class_boosted(x, label, keys, scored, classes, rounds, depth, rate, least, rows, columns, seed=42):
    """Class chances (a row per class) by softmax boosting, a tree per class and round.

    With one class among the training rows its chance is one.
    """
    seen = np.unique(label)
    if len(seen) < 2:
        chance = np.zeros((classes, scored.shape[1]))
        chance[seen] = 1.0
        return chance

    def softmax(margin):
        e = np.exp(margin - margin.max(axis=0))
        return e / e.sum(axis=0)

    hit = np.stack([label == c for c in range(classes)]).astype(np.float64)
    fit, out, pairs = np.zeros((classes, len(label))), np.zeros((classes, scored.shape[1])), paired(x)
    for r in range(rounds):
        own = (uniform(seed, r, keys) < rows).astype(np.float64)  # rows left out have weight 0
        if not own.any():
            continue
        chance, chosen = softmax(fit), sampled_columns(len(x), columns, seed, r)
        for c in range(classes):
            curve = np.maximum(2 * chance[c] * (1 - chance[c]), 1e-16)
            tree, leaf = _grow(x, (hit[c] - chance[c]) * own, curve * own, depth, least, RIDGE, chosen, pairs=pairs)
            fit[c] += rate * tree[2][leaf]
            out[c] += rate * value_of(tree, scored)
    return softmax(out)
