"""Byte-level BPE and token files against the libraries."""
import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barloom.llm import byte_bpe as B
from barloom.llm.queries_tokens import op9_byte_bpe, op10_token_files
from barloom.llm.token_files import Coder, read_tokens, write_tokens

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "♥ a♥b ™ ♥♥", "▁ a", "'s'll I've", "  two  spaces\n\n\t", "\x00\x1c\x85 　x", "é é ñ 字 🙂👩‍👧", "<|endoftext|> 12345 ４", "a" * 3000, "ＡΣς ǅ"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return B.Coder(B.serialise(B.read_ranks(PATH)), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def words_coder():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    return Coder(definition, "<u2"), Tokenizer.from_str(definition)


def test_odd_texts(library, coder, words_coder):
    for text in ODD:
        ids = np.frombuffer(coder.encode([text])[0], np.int32).tolist()
        assert ids == library.encode_ordinary(text) and coder.decode(ids) == text.encode()
        mine, other = words_coder
        assert np.frombuffer(mine.encode([text.encode()], b"")[0], "<u2").tolist() == other.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, coder, words_coder, text):
    ids = np.frombuffer(coder.encode([text])[0], np.int32).tolist()
    assert ids == library.encode_ordinary(text) and coder.decode(ids) == text.encode()
    mine, other = words_coder
    assert np.frombuffer(mine.encode([text.encode()], b"")[0], "<u2").tolist() == other.encode(text, add_special_tokens=False).ids


def test_vocabulary_with_gaps():
    with pytest.raises(ValueError):
        B.serialise({b"a": 0, b"b": 2})


def test_round_trip_query(spark, sf_dir, rows, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op9_byte_bpe(spark, sf_dir).collect()}
    want = {}
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert got == want


def test_encode_keeps_columns_and_empty_tables(documents, empty):
    ranks = B.read_ranks(PATH)
    coded = B.encode(documents, ranks, public_tokenizers.PATTERN)
    assert coded.columns == [*documents.columns, "ids"]
    assert coded.where("n_words <> 'x'").count() == 0
    assert B.decode(coded, ranks, public_tokenizers.PATTERN).where("string(decoded) <> coalesce(text, '')").count() == 0
    assert B.encode(empty, ranks, public_tokenizers.PATTERN).count() == 0


def test_files_query(spark, sf_dir, rows, words_coder):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op10_token_files(spark, sf_dir).collect()}
    want, at = {}, 0
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = words_coder[1].encode(text or "", add_special_tokens=False).ids + [2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want


def test_files_with_null_and_equal_ids_and_empty(spark, empty, scratch):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(None, "last"), (5, "a b"), (5, "a b"), (-3, None)], "doc_id long, text string")
    manifest = write_tokens(docs, path, scratch + "/a", end_id=70_000, parts=3)
    assert manifest["width"] == "<u4"
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in read_tokens(spark, scratch + "/a").collect())
    assert got == [(0, -3, 1), (1, 5, 3), (4, 5, 3), (7, None, 2)]
    assert write_tokens(empty, path, scratch + "/b", end_id=2)["parts"] == []
    assert read_tokens(spark, scratch + "/b").count() == 0


def test_words_and_whole_texts(spark, rows, tmp_path):
    """Byte-level definitions keep white space, so their texts are encoded whole; the word one goes word by word."""
    from barloom.llm.token_files import by_words
    texts = [t for _, t in rows[:60] if t] + ["Ünter, ÉTÉ. a,b x., İstanbul H̱. don't'S. «mot», ×, 3. 4,5 a b.", "a.\n", "^ a^b ♥", ".", ",", "Ångström, Ångström,"]
    for name, split in (("word_bpe_49k.json", (True, True)), ("byte_bpe_50k.json", (False, False))):
        definition = open(public_tokenizers.path(name), encoding="utf-8").read()
        assert by_words(definition) == split
        model, coder = Tokenizer.from_str(definition), Coder(definition, "<u4")
        want = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
        for _ in range(2):  # the second time from the words met
            got = coder.encode([t.encode() for t in texts], b"")
            assert [np.frombuffer(b, "<u4").tolist() for b in got] == want


def test_words_beyond_the_store(monkeypatch):
    from barloom.llm import token_files
    definition = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + k % 26)} same" for k in range(i, i + 9)).encode() for i in range(40)]
    want = token_files.Coder(definition, "<u2").encode(texts, b"")
    monkeypatch.setattr(token_files, "KEPT", 20)
    coder = token_files.Coder(definition, "<u2")
    assert [b for t in texts for b in coder.encode([t], b"")] == want and len(coder.ids) < 60
