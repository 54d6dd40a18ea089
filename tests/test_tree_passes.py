"""Passes over the rows that a tree takes, and independence of the order of rows."""
import numpy as np
import pytest

from barloom.operators import trees as T
from barloom.plans import model_queries as MQ
from barloom.sources.bindings import Tables


def frame(n=4000, columns=20):
    rng = np.random.default_rng(8)
    x = rng.integers(0, T.BINS, (columns, n)).astype(np.uint8)
    return x, (x[0] > 9) * 1.0 + 0.1 * x[1] + rng.normal(size=n)


@pytest.mark.parametrize("weighted", [False, True])
def test_a_tree_of_depth_four_reads_the_rows_seldom(monkeypatch, weighted):
    x, y = frame()
    w = np.random.default_rng(9).uniform(0.5, 1.0, len(y)) if weighted else None
    read, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda at, *rest, **more: read.append(len(at)) or plain(at, *rest, **more))
    T.grow(x, y, w, 4, 3, T.RIDGE, pairs=T.paired(x))
    per_column = sum(read) / len(y) / len(x)
    assert per_column < (3.5 if weighted else 2.0)


def test_trees_do_not_depend_on_the_order_of_rows():
    x, y = frame(600, 6)
    order = np.random.default_rng(10).permutation(len(y))
    times = T.poisson(T.uniform(1, np.arange(len(y))))
    for w, seed in ((None, None), (times, None), (None, 5)):
        one = T.grow(x, y if w is None else y * w, w, 7, 2, seed=seed)
        other = T.grow(x[:, order], (y if w is None else y * w)[order], w if w is None else w[order], 7, 2, seed=seed)
        for a, b in zip(one[:2], other[:2]):
            assert (a == b).all()
        np.testing.assert_allclose(one[2], other[2], rtol=1e-12)


def test_children_had_by_subtraction_equal_their_own_sums():
    x, y = frame(3000, 5)
    parts, read, _ = T._parts(y, None)
    top = np.zeros(len(y), np.int64)
    held = T._histogram(x, T.paired(x), top, parts, 1, np.arange(5))
    child = (x[0] > 9).astype(np.int64)
    got = T._children(held, np.array([True]), x, T.paired(x), child, parts, np.arange(5))
    assert (got == T._histogram(x, None, child, parts, 2, np.arange(5))).all()
    g, w = read(got)
    np.testing.assert_allclose(g[0, 1].sum(), y[child == 1].sum(), rtol=1e-9)
    assert w[0, 1].sum() == (child == 1).sum()


def test_panel_of_the_forecasts_is_stored(spark):
    assert "lineitem" not in " ".join(MQ._frame(Tables(spark, "/root/testdata/sf0.001")).inputFiles())
