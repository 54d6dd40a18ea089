"""SimHash fingerprints and their components against plain versions."""
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from barloom.llm import simhash
from barloom.llm.queries_simhash import op11_simhash_near_dedup
from barloom.llm.simhash import _fingerprint, near_prints
from tests.llm import brute


def plain_print(text, size=3):
    w = [x.lower() for x in brute.words(text)]
    runs = [b" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(prints, bits):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query(spark, sf_dir, rows):
    prints = {i: plain_print(t) for i, t in rows}
    want = plain_components(prints, 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op11_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_shingle_hash_is_that_of_spark(spark):
    text = "Eins zwei drei é vier"
    h = spark.sql("select xxhash64('eins zwei drei'), xxhash64('zwei drei é'), xxhash64('drei é vier')").first()
    assert _fingerprint(text.encode(), 3) == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > 3)


def test_long_text_in_steps(monkeypatch):
    text = " ".join(str(i * i) for i in range(400))
    whole = plain_print(text)
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    assert _fingerprint(text.encode(), 3) == whole


@pytest.mark.parametrize("block, bits, blocks", [(3, 3, 6), (2048, 3, 8), (2048, 2, 4)])
def test_components_of_dense_groups(spark, monkeypatch, block, bits, blocks):
    """Chains of prints at the bound and a dense cloud; the reading of texts is replaced by given prints."""
    rng = random.Random(block + bits)
    prints = [0, (1 << 64) - 1, 1 << 63]
    for centre in [rng.getrandbits(64) for _ in range(12)]:
        here = centre
        for _ in range(15):
            for k in rng.sample(range(64), rng.randint(1, bits + 1)):
                here ^= 1 << k
            prints.append(here)
    cloud = rng.getrandbits(64)
    prints += [cloud ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for _ in range(120)]
    prints += [rng.getrandbits(64) for _ in range(60)] + prints[:20]
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.select(F.col("doc_id").alias("_id"), F.col("fp")))
    got = {r.doc_id: r.component_id for r in near_prints(spark.createDataFrame(signed, "doc_id long, fp long"), bits=bits, blocks=blocks, block=block).collect()}
    assert got == plain_components(dict(enumerate(prints)), bits)


def test_edges(spark, empty):
    docs = spark.createDataFrame([(None, "a b c d"), (2, "A b c d"), (2, "A b c d"), (3, "a B\tc d"), (4, None), (5, ""), (6, "z")],
                                 "doc_id long, text string").withColumn("fp", F.lit(1))
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in near_prints(docs).collect())
    one, z = (x - (1 << 64) if x >> 63 else x for x in (plain_print("a b c d"), plain_print("z")))
    assert got == [(0, one, None), (2, one, 2), (2, one, 2), (3, one, 2), (4, 0, 4), (5, 0, 4), (6, z, 6)]
    assert near_prints(empty).count() == 0
    with pytest.raises(ValueError):
        near_prints(docs, bits=6, blocks=6)
