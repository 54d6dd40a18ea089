"""Trees against plain versions: every split gain, leaf value and boosting step on small frames."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import forecasts as Y
from barloom.operators import trees as T


def frame(n=60, columns=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (columns, n)).astype(np.uint8)
    return x, (x[0] > 2) * 2.0 + 0.3 * x[1] + rng.normal(size=n), rng.integers(0, 1 << 62, n)


def plain_tree(x, g, w, depth, least, ridge, columns, rows=None, node=0, out=None):
    """{node: (column, cut, gain) or value} by trying every cut of every column."""
    rows, out = (np.arange(x.shape[1]), {}) if rows is None else (rows, out)
    part = lambda r: g[r].sum() ** 2 / (w[r].sum() + ridge)
    best = None
    for c in columns:
        for cut in range(T.BINS - 1):
            left, right = rows[x[c, rows] <= cut], rows[x[c, rows] > cut]
            if depth and min(w[left].sum(), w[right].sum()) >= least and len(left) and len(right):
                gain = part(left) + part(right) - part(rows)
                if gain > 1e-9 and (best is None or gain > best[2] + 1e-12):
                    best = (c, cut, gain)
    out[node] = (g[rows].sum() / (w[rows].sum() + ridge), best)
    if best:
        side = x[best[0], rows] <= best[1]
        plain_tree(x, g, w, depth - 1, least, ridge, columns, rows[side], 2 * node + 1, out)
        plain_tree(x, g, w, depth - 1, least, ridge, columns, rows[~side], 2 * node + 2, out)
    return out


def plain_value(tree, x, i, node=0):
    value, best = tree[node]
    return value if best is None else plain_value(tree, x, i, 2 * node + (1 if x[best[0], i] <= best[1] else 2))


@pytest.mark.parametrize("least, ridge, weighted", [(1, 0.0, False), (3, 1.0, False), (2, 0.0, True)])
def test_splits_gains_and_leaves(least, ridge, weighted):
    x, y, _ = frame()
    w = np.random.default_rng(1).integers(1, 4, len(y)).astype(float) if weighted else np.ones(len(y))
    want = plain_tree(x, y * w, w, 4, least, ridge, range(3))
    column, cut, value, gain = got = T.grow(x, y * w, w if weighted else None, 4, least, ridge)
    assert sum(column >= 0) == sum(best is not None for _, best in want.values())
    for node, (leaf, best) in want.items():
        np.testing.assert_allclose(value[node], leaf, rtol=1e-12)
        if best:
            assert (column[node], cut[node]) == best[:2]
            np.testing.assert_allclose(gain[node], best[2], rtol=1e-9)
    np.testing.assert_allclose(T.value_of(got, x), [plain_value(want, x, i) for i in range(len(y))])


def test_boosting_rounds():
    x, y, keys = frame(seed=2)
    fit, w = np.full(len(y), y.mean()), np.ones(len(y))
    for r in range(6):
        own = np.flatnonzero(T.uniform(42, r, keys) < 0.85)
        tree = plain_tree(x[:, own], (y - fit)[own], w[own], 3, 3, T.RIDGE, T.sampled_columns(3, 0.85, 42, r))
        fit = fit + 0.1 * np.array([plain_value(tree, x, i) for i in range(len(y))])
    np.testing.assert_allclose(T.boosted(x, y, keys, x, 6, 3, 0.1, 3, 0.85, 0.85), fit, rtol=1e-9)


def test_class_boosting_rounds():
    x, y, keys = frame(seed=3)
    label = np.digitize(y, [0.8, 2.2])
    margin = np.zeros((3, len(y)))
    for r in range(4):
        p = np.exp(margin) / np.exp(margin).sum(axis=0)
        own = np.flatnonzero(T.uniform(42, r, keys) < 0.9)
        for c in range(3):
            h = np.maximum(2 * p[c] * (1 - p[c]), 1e-16)
            tree = plain_tree(x[:, own], ((label == c) - p[c])[own], h[own], 3, 2, T.RIDGE, T.sampled_columns(3, 0.9, 42, r))
            margin[c] += 0.2 * np.array([plain_value(tree, x, i) for i in range(len(y))])
    got = T.class_boosted(x, label, keys, x, 3, 4, 3, 0.2, 2, 0.9, 0.9)
    np.testing.assert_allclose(got, np.exp(margin) / np.exp(margin).sum(axis=0), rtol=1e-9)
    one = T.class_boosted(x, np.full(len(y), 2), keys, x, 3, 4, 3, 0.2, 2, 0.9, 0.9)
    assert (one == np.array([[0.0], [0.0], [1.0]])).all()


def test_random_cuts_lie_between_the_bounds_of_a_node():
    x, y, keys = frame(seed=4)
    column, cut, value, gain = tree = T.grow(x, y, None, 5, 2, seed=9)
    node = np.zeros(len(y), int)
    for _ in range(5):
        for k in np.unique(node[column[node] >= 0]):
            rows = node == k
            held = x[column[k], rows]
            assert held.min() <= cut[k] < held.max()
            u = T.uniform(9, np.array([k]), column[k])[0]
            assert cut[k] == held.min() + int(u * (int(held.max()) - int(held.min())))
        inner = column[node] >= 0
        node = np.where(inner, 2 * node + 1 + (x[column[node], np.arange(len(y))] > cut[node]), node)
    for k in np.unique(node):
        np.testing.assert_allclose(value[k], y[node == k].mean())
    np.testing.assert_allclose(T.value_of(tree, x), value[node])


def test_forests_learn_and_do_not_depend_on_scored_rows():
    x, y, keys = frame(n=400, seed=5)
    for fit in (T.forest, T.extra_trees):
        whole = fit(x, y, keys, x, 20, 6, 2)
        assert np.abs(whole - y).mean() < 0.75 * np.abs(y - y.mean()).mean()
        np.testing.assert_allclose(fit(x, y, keys, x[:, :7], 20, 6, 2), whole[:7])


def test_bootstrap_weights_have_mean_one():
    times = T.poisson(T.uniform(1, np.arange(200_000)))
    assert abs(times.mean() - 1) < 0.01 and abs((times == 0).mean() - np.exp(-1)) < 0.01


def test_fits_do_not_depend_on_the_partitioning(spark):
    rng = np.random.default_rng(6)
    days = [r[0] for r in spark.sql("select explode(sequence(date'2020-01-01', date'2020-06-30'))").collect()]
    rows = [(f"S{s}", d, 100.0, [float(v) for v in rng.normal(size=4)], float(rng.normal())) for s in range(4) for d in days]
    data = spark.createDataFrame(rows, "symbol string, date date, close double, x array<double>, t double")
    one, other = (Y.fit_ensemble(part, "t", sizes=Y.QUICK) for part in (data, data.repartition(7)))
    assert one.weights == pytest.approx(other.weights, rel=1e-12) and one.mape == pytest.approx(other.mape, rel=1e-12)
    last = Y.latest_rows(data)
    values = lambda fit, df: [x for r in fit.predict(df, "p").orderBy("symbol").collect() for x in (r.p, r.p_agreement)]
    assert values(one, last) == pytest.approx(values(other, last.repartition(2)), rel=1e-9) and len(values(one, last)) == 8


def test_cohorts_cover_all_symbols(spark, monkeypatch):
    monkeypatch.setattr(Y, "COHORT_ROWS", 150)
    days = [r[0] for r in spark.sql("select explode(sequence(date'2020-01-01', date'2020-05-29'))").collect()]
    rows = [(f"S{s}", d, 100.0, [float(k % 7), float(s)], float(s)) for s in range(8) for k, d in enumerate(days)]
    data = spark.createDataFrame(rows, "symbol string, date date, close double, x array<double>, t double")
    binned = Y._binned(data, ["symbol", "date", "t"])
    held = binned.groupBy("symbol").agg(F.countDistinct("cohort").alias("c")).collect()
    assert len(held) == 8 and all(r.c == 1 for r in held) and binned.select("cohort").distinct().count() > 1
    out = Y.fit_ensemble(data, "t", sizes=Y.QUICK).predict(Y.latest_rows(data), "p").collect()
    assert len(out) == 8 and all(r.p is not None for r in out)
