"""Exact ranks, medians and positions against brute force, with one hot group and many ties."""
import random

from pyspark.sql import functions as F

from barloom.operators import ordering as O, ranking as T


def test_rank_and_median_with_hot_group(spark):
    rnd = random.Random(3)
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", rnd.choice([None, 0.0, -1.5, 2.25, float(rnd.randint(-40, 40))])) for i in range(900)]
    df = spark.createDataFrame(rows, "i int, g string, v double")
    groups = {}
    for _, g, v in rows:
        groups.setdefault(g, []).append(v)
    got = {r["i"]: (r["rank"], r["group_count"]) for r in O.with_group_rank(df, ["g"], "v").collect()}
    for i, g, v in rows:
        want = None if v is None else 1 + sum(1 for x in groups[g] if x is not None and x > v)
        assert got[i] == (want, len(groups[g]))
    med = {r["g"]: r["m"] for r in O.group_median(df, ["g"], "v", "m").collect()}
    for g, vs in groups.items():
        xs = sorted(x for x in vs if x is not None)
        assert med[g] == (xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]) / 2


def test_positions_and_even_sample(spark):
    keys = [f"k{i:04d}" for i in range(500)]
    random.Random(1).shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r["k"]: r["position"] for r in O.number_rows(df, "k", parts=7).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    want = {sorted(keys)[round(i * 499 / 9)] for i in range(10)}
    assert {r["k"] for r in O.even_sample(df, "k", 10).collect()} == want
    for total, n in ((500, 499), (500, 500), (500, 600), (37, 9), (12, 1), (1, 1), (0, 3)):
        want = [] if not total else sorted(keys)[:total] if total <= n else [sorted(keys)[p] for p in {round(i * (total - 1) / max(n - 1, 1)) for i in range(n)}]
        part = df.where(F.col("k").isin(sorted(keys)[:total]))
        assert sorted(r["k"] for r in O.even_sample(part, "k", n, parts=3).collect()) == sorted(want)


COLS = ("symbol string, price_bucket string, trade_confidence double, score double, confidence double, direction_confidence double, "
        "prediction_uncertainty_pct double, direction string, expected_return double, multi_horizon_expected_return double, "
        "direction_return_alignment double")


def candidate(i, bucket, score, direction="UP", u=3.0, e=2.0):
    return (f"S{i:02d}", bucket, score, score, 70.0, 70.0, u, direction, e, 1.0, 80.0)


def test_diversified_top_caps_buckets(spark):
    rows = [candidate(i, "B1", 90.0 - i) for i in range(12)] + [candidate(20, "B2", 50.0), candidate(21, "B3", 40.0)]
    out = [r["symbol"] for r in T.diversified_top(spark.createDataFrame(rows, COLS)).collect()]
    assert out[:3] == ["S00", "S20", "S21"] and out[3:] == ["S01", "S02", "S03", "S04", "S05"]


def test_cascade_never_takes_down(spark):
    df = spark.createDataFrame([candidate(1, "B1", 90.0, "DOWN"), candidate(2, "B1", 80.0, "UP", u=20.0)], COLS)
    assert [r["symbol"] for r in T.cascade(df).collect()] == ["S02"]
    assert T.cascade(df.where("direction = 'DOWN'")).count() == 0


def test_top_k_is_limited_before_the_shuffle(spark):
    rows = [candidate(i, "B1", float(i)) for i in range(50)]
    df = T.top_per_bucket(spark.createDataFrame(rows, COLS), 3)
    assert "WindowGroupLimit" in df._jdf.queryExecution().toString()
    assert df.count() == 3
