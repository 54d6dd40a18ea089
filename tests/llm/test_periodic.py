"""Periodic runs against a plain search over all periods."""
import hashlib
import random
import zlib

from pyspark.sql import functions as F

from barloom.llm import periodic
from barloom.llm.periodic import find_runs
from barloom.llm.queries_periodic import op13_periodic_runs
from tests.llm import brute


def plain_runs(w, least=24, times=3):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s = i - q
            if j - s >= max(least, times * q) and not any(w[s + p:j] == w[s:j - p] for p in range(1, q)):
                out.append((s, j - s, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [x for i, x in enumerate(w) if i not in gone]


def periodic_texts(seed=7, n=250):
    rng = random.Random(seed)
    for _ in range(n):
        w, letters = [], "abc"[:rng.randint(1, 3)]
        while len(w) < rng.randint(0, 150):
            w += [rng.choice(letters) for _ in range(rng.randint(1, 20))] * rng.randint(1, 6)
            if rng.random() < .3:
                w += w[-rng.randint(1, len(w)):]
        yield w[:200]


def test_runs_of_small_alphabets(spark):
    texts = dict(enumerate(periodic_texts()))
    docs = spark.createDataFrame([(i, "\t".join(w)) for i, w in texts.items()], "doc_id long, text string")
    for least, times in ((24, 3), (5, 3), (10, 4)):
        got = {r.doc_id: r for r in find_runs(docs, least=least, times=times).collect()}
        for i, w in texts.items():
            want = plain_runs(w, least, times)
            assert [tuple(r) for r in got[i].runs] == want
            assert got[i].n_words == len(w) and got[i].collapsed == " ".join(plain_collapse(w, want))


def test_long_texts_and_slices(monkeypatch):
    """One word 60,000 times, nested periods, and slices of few words."""
    (runs, n, kept), = periodic._read([b"x " * 60_000], 24, 3)
    assert (runs, n, kept) == ([(0, 60_000, 1)], 60_000, b"x")
    (runs, n, kept), = periodic._read([(b"x " * 30 + b"y ") * 40], 24, 3)
    assert runs == [(0, 1240, 31), *((31 * i, 30, 1) for i in range(1, 40))] or runs == sorted([(0, 1240, 31)] + [(31 * i, 30, 1) for i in range(40)], key=lambda r: (r[0], r[2]))
    monkeypatch.setattr(periodic, "WORDS_AT_ONCE", 3)
    assert list(periodic._slices([40, 0, 1, 5])) == [(0, 1), (1, 3), (3, 4)]


def test_edges(spark, documents, empty):
    line = " ".join(["a b c"] * 9)
    docs = spark.createDataFrame([(None, line), (2, None), (3, ""), (4, " \n "), (5, line), (5, line)], "doc_id long, text string").withColumn("runs", F.lit("old"))
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in find_runs(docs.withColumn("_text", F.lit(1))).collect()))
    found = (27, [(0, 27, 3)], "a b c")
    assert got == [(0, *found), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""), (5, *found), (5, *found)]
    assert find_runs(empty).count() == 0
    assert find_runs(documents).columns == [c for c in documents.columns if c != "n_words"] + ["n_words", "runs", "collapsed"]


def test_query(spark, sf_dir, rows):
    got = {r.doc_id: r for r in op13_periodic_runs(spark, sf_dir).collect()}
    some = 0
    for i, text in rows:
        w, h = brute.words(text), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w) if len(w) < 2000 else [tuple(map(int, r)) for r in next(periodic._read([b" ".join(w)], 24, 3))[0]]
        some += bool(runs)
        top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert (got[i].n_runs, got[i].start, got[i].length, got[i].period) == (len(runs), *top)
        assert got[i].exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert got[i].runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert got[i].collapsed_sha256 == hashlib.sha256(b" ".join(plain_collapse(w, runs))).hexdigest()
    assert some > 20 and len(got) == len(rows)
