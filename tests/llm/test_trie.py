"""Prefix trie of conversations against a plain one."""
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from barloom.llm import prefix_trie as module
from barloom.llm.prefix_trie import prefix_trie
from barloom.llm.queries_trie import op12_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(convs):
    """Sorted rows of all nodes of {id: [(role, text), ...]}."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for node, members in nodes.items():
        below = [n for n in nodes if n[:len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[:-1] == n for m in nodes if m)]
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == len(node)))
        rows.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(kids), len(leaves), saved,
                     hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def some_conversations(seed, n=60):
    rng = random.Random(seed)
    out = {}
    for c in range(n):
        start = rng.choice(list(out.values())) if out and rng.random() < .7 else []
        start = start[:rng.randint(0, len(start))]
        out[c * 7 - 40] = start + [("user" if rng.random() < .5 else "bot", rng.choice("aébcd") * rng.randint(1, 3)) for _ in range(rng.randint(0, 4))]
    return out


@pytest.mark.parametrize("piece, turns", [(2000, 200_000), (3, 200_000), (7, 9), (1, 1)])
def test_nodes_for_any_pieces(spark, monkeypatch, piece, turns):
    monkeypatch.setattr(module, "PIECE", piece)
    monkeypatch.setattr(module, "PIECE_TURNS", turns)
    convs = some_conversations(piece)
    rows = [(c, t, r, x) for c, seq in convs.items() for t, (r, x) in enumerate(seq)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    assert got(prefix_trie(frame, ids)) == plain_trie(convs)


def test_many_copies(spark, monkeypatch):
    """A third of all conversations is one text, so it spans pieces and partitions."""
    monkeypatch.setattr(module, "PIECE", 5)
    convs = {c: [("user", "hello"), ("bot", "yes"), ("user", f"q{c}")][:3 if c % 3 else 2] for c in range(120)}
    rows = [(c, t, r, x) for c, seq in convs.items() for t, (r, x) in enumerate(seq)]
    assert got(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie(convs)


def test_edges(spark):
    rows = [(1, 2, "b", "y"), (1, None, None, None), (1, 1, "a", "x"), (None, 1, "a", "lost"), (2, None, "", ""), (2, 1, "a", "x")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("old")).withColumn("k", F.lit(1))
    assert got(prefix_trie(frame)) == plain_trie({1: [("", ""), ("a", "x"), ("b", "y")], 2: [("", ""), ("a", "x")]})
    twice = spark.createDataFrame([(5, 1, "a", "x")] * 3, SCHEMA)
    assert got(prefix_trie(twice)) == plain_trie({5: [("a", "x")] * 3})
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(none).count() == 0
    assert got(prefix_trie(none, spark.createDataFrame([(4,), (3,)], "conv_id long"))) == plain_trie({3: [], 4: []})


def test_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(module, "PIECE_TURNS", 50)
    long = [("user", str(k % 7)) for k in range(300)]
    convs = {1: long, 2: long[:120], 3: long[:200] + [("bot", "z")], 4: long}
    rows = [(c, t, r, x) for c, seq in convs.items() for t, (r, x) in enumerate(seq)]
    assert got(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie(convs)


def test_query(spark, tmp_path):
    rng = random.Random(4)
    own = {c: [(rng.choice(["user", "assistant", None]), rng.choice(["hi", "é", "", None, f"t{c % 3}"])) for _ in range(rng.randint(1, 12))]
           for c in range(83) if c % 11}
    rows = [(c, t if t else None, r, x) for c, seq in own.items() for t, (r, x) in enumerate(seq)] + [(None, 0, "user", "lost")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    clean = {c: [(r or "", x or "") for r, x in seq] for c, seq in own.items()}
    built = {}
    for c in clean:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = clean.get(c - c % 5, [])[:h] + clean[c][h:]
    frame = op12_prefix_trie(spark, str(tmp_path))
    assert frame.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got(frame) == plain_trie(built)
