"""Line, substring and near-duplicate removal against plain versions."""
import hashlib

import pytest
from pyspark.sql import functions as F

from barloom.llm.components import components
from barloom.llm.line_dedup import drop_lines
from barloom.llm.minhash import near_duplicates
from barloom.llm.queries_minhash import op7_minhash_near_dedup
from barloom.llm.substring import remove_repeats
from tests.llm import brute


def test_lines(documents, rows):
    got = drop_lines(documents)
    assert got.columns == [*documents.columns, "n_lines", "n_removed"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got.collect()} == brute.drop_lines(rows)


def test_lines_null_ids_repeated_rows_and_empty(spark, empty):
    line = "a b c d e f g h i"
    docs = spark.createDataFrame([(None, line), (5, line), (5, line), (6, line + " j"), (7, "x " + line), (None, None), (8, line + "\n" + line)],
                                 "doc_id long, text string").withColumn("n_removed", F.lit("old"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text, r.n_removed) for r in drop_lines(docs).where("text is not null").collect())
    assert got == [(False, 5, line, 0), (False, 5, line, 0), (False, 6, "", 1), (False, 7, "", 1), (False, 8, "", 2), (True, 0, "", 1)]
    assert drop_lines(empty).count() == 0


def test_repeats(documents, rows):
    want = brute.removed_words(rows)
    got = {r.doc_id: r for r in remove_repeats(documents.withColumnRenamed("n_words", "part"), join_words=True).collect()}
    for i, text in rows:
        kept = b" ".join(w for w, gone in zip(brute.words(text), want[i]) if not gone).decode()
        assert (got[i].n_words, got[i].n_removed, got[i].text, got[i].part) == (len(want[i]), sum(want[i]), kept, "x")
    whole = {r.doc_id: r for r in remove_repeats(documents).collect()}
    for i, text in rows:
        kept = [w for w, gone in zip(brute.words(text), want[i]) if not gone]
        assert brute.words(whole[i].text) == kept and (any(want[i]) or whole[i].text == text)


def test_repeats_null_ids_equal_ids_and_empty(spark, empty):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text), (None, None), (4, text), (4, text), (9, "y\n" + text + " \n z")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed, r.text or "") for r in remove_repeats(docs).collect())
    assert got == [(0, 0, ""), (0, 0, text), (4, 0, text), (4, 0, text), (9, 60, "y\nz")]
    assert remove_repeats(empty).count() == 0


@pytest.mark.parametrize("size, percent, block", [(3, 85, 1000), (3, 60, 2), (5, 80, 3)])
def test_components_of_near_copies(documents, rows, size, percent, block):
    """A small block and a low bound send many classes through the comparison in blocks."""
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           near_duplicates(documents, shingle=size, percent=percent, tables=24 if percent < 80 else 10, width=1 if percent < 80 else 3, block=block).collect()}
    assert got == brute.near_components(rows, size, percent)


def test_near_copies_query(spark, sf_dir, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op7_minhash_near_dedup(spark, sf_dir).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute.near_components(rows, 3, 85).items()}


def test_near_copies_null_ids_repeated_rows_and_empty(spark, empty):
    docs = spark.createDataFrame([(None, "a b c d"), (2, "A b c d"), (2, "A b c d"), (3, "a B c d"), (4, None), (5, "")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_duplicates(docs, shingle=3).collect())
    assert got == [(0, 2, 0, True), (2, 2, 2, True), (2, 2, 2, True), (3, 2, 2, False), (4, 0, 4, True), (5, 0, 5, True)]
    assert near_duplicates(empty).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(10, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (5, 4), (4, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 10 for i in range(10, 61)}, **{i: 100 for i in range(100, 140)}, 4: 4, 5: 4}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_substring_query(spark, sf_dir, rows):
    from barloom.llm.queries_substring import op6_substring_dedup
    want = brute.removed_words(rows)
    got = {r.doc_id: r.kept_sha256 for r in op6_substring_dedup(spark, sf_dir).collect()}
    assert got == {i: hashlib.sha256(b" ".join(w for w, g in zip(brute.words(t), want[i]) if not g)).hexdigest() for i, t in rows}


def test_second_hash_is_no_function_of_the_first():
    """A word of 1024 bytes and its mirror image agree in the first family only; equal windows agree in both."""
    import numpy as np
    import pyarrow as pa
    from barloom.llm import wordcols as W
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    mirror = word.translate(str.maketrans("ab", "ba"))
    texts = [f"x {word} y z", f"x {mirror} y z", f" x\n{word} y", "", "x"]
    for size in (1, 1 << 20):
        chunks = list(W.chunks(pa.array(texts), size=size))
        first, second = (np.concatenate(h) for h in zip(*[(w.window(3)[1], w.second_window(3)) for w in chunks]))
        assert len(first) == len(second) == 5 and first[0] == first[2] == first[4] and second[0] == second[4] != second[2]


def test_large_chunks_and_small_ones(spark, monkeypatch):
    """A text beyond the size of a chunk, and chunks of a few bytes, give what one chunk gives."""
    import numpy as np
    import pyarrow as pa
    from barloom.llm import wordcols as W
    rng = np.random.default_rng(1)
    long = " ".join(rng.integers(0, 5000, 700_000).astype(str).tolist())
    assert len(long) > 3 * W.CHUNK
    texts = ["a b c d", long, None, "b c d e"]
    parts = {size: [(w.lo + w.doc[at], h, w.second_window(3)) for w in W.chunks(pa.array(texts), size=size) for at, h in [w.window(3)]]
             for size in (5, W.CHUNK, 1 << 30)}
    whole = {size: [np.concatenate(x) for x in zip(*p)] for size, p in parts.items()}
    for size in (5, W.CHUNK):
        assert all((a == b).all() for a, b in zip(whole[size], whole[1 << 30]))
    assert len(whole[5][0]) == 2 + 2 + 699_998
