"""Byte-level BPE through a sentencepiece model serialised from a rank vocabulary.

The vocabulary is a list of byte strings with ranks. Each byte string becomes a piece by the
usual byte map (printable bytes stand for themselves, the others for code points from 256
on), its score is the negative rank, normalisation is the identity. Merging the pair of the
highest score is then merging the pair of the lowest rank, so the model gives the ids of a
rank encoder. Texts are cut by the pattern first and each match is encoded by itself; a match
that is a piece is that piece. Decoding maps pieces back to bytes.

The vocabulary is read on the driver and travels with the code; tasks need no file. A worker
keeps the ids of at most ``KEPT`` matches and then starts over.
"""
import base64
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.workers import kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])
KEPT = 300_000
AT_ONCE = 100  # documents that are worked off together


def byte_map():
    """Code point of each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {**{b: b for b in shown}, **{b: 256 + i for i, b in enumerate(rest)}}


def read_ranks(path):
    """{bytes: rank} of a file of base64 strings and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number, value):
    """One field of a protobuf message: bytes and strings by length, floats fixed, numbers as varints."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (1 << 64) - 1)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks):
    """Bytes of the sentencepiece model; piece ids are ranks, the unknown piece comes last.

    Field numbers of the public model format: piece 1 (text 1, score 2, type 3), trainer 2 (model
    type 3, size 4, ids of unknown, begin, end, padding 40 to 43), normaliser 3 (name 1, dummy
    prefix 3, extra white space 4, escapes 5).
    """
    order = sorted(ranks, key=ranks.get)
    if [ranks[b] for b in order] != list(range(len(order))):
        raise ValueError("ranks must run from 0 without gaps")
    shown = byte_map()
    pieces = b"".join(_field(1, _field(1, "".join(chr(shown[x]) for x in b)) + _field(2, float(-i))) for i, b in enumerate(order))
    unknown = _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    none = (1 << 64) - 1  # -1: there is no such piece
    trainer = _field(3, 2) + _field(4, len(order) + 1) + _field(40, len(order)) + _field(41, none) + _field(42, none) + _field(43, none)
    plain = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + unknown + _field(2, trainer) + _field(3, plain)


class Coder:
    """Encoder and decoder of one worker."""

    def __init__(self, model, pattern):
        import regex
        import sentencepiece

        # white space as Unicode defines it, also for the four separators U+001C to U+001F
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        shown = byte_map()
        back = {chr(c): b for b, c in shown.items()}
        self.map = {b: chr(c) for b, c in shown.items()}
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size() - 1)]
        self.bytes = [bytes([back[c] for c in name]) for name in names]
        self.whole = {name: i for i, name in enumerate(names)}
        self.ids = {}

    def encode(self, texts):
        """The ids of each text as little-endian 32-bit integers."""
        found = [self.find(t) for t in texts]
        fresh = set().union(*found).difference(self.ids)
        if len(self.ids) + len(fresh) > KEPT:
            self.ids = {}
            fresh = set().union(*found)
        fresh = list(fresh)
        shown = [m.encode().decode("latin-1").translate(self.map) for m in fresh]
        for m, s, ids in zip(fresh, shown, self.model.encode(shown, out_type=int, num_threads=1) if shown else ()):
            known = self.whole.get(s)
            self.ids[m] = np.array(ids if known is None else [known], np.int32).tobytes()
        get = self.ids.__getitem__
        return [b"".join(map(get, f)) for f in found]

    def decode(self, ids):
        return b"".join(map(self.bytes.__getitem__, ids))


def _coder(model, pattern):
    return kept(("byte bpe", hash(model), pattern), lambda: Coder(model, pattern))


def encode(docs, ranks, pattern, text_col="text", to="ids"):
    """docs with ``to``, the ids of each whole text (array of int, null text: empty); it replaces a column of that name."""
    model, names = serialise(ranks), [c for c in docs.columns if c != to]

    def run(batches):
        coder = _coder(model, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(lo, AT_ONCE)
                coded = coder.encode(part.column(len(names)).fill_null("").to_pylist())
                ends = np.cumsum([0] + [len(p) // 4 for p in coded]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:len(names)], ids], names=[f"_{i}" for i in range(len(names) + 1)])

    kinds = {f.name: f.dataType for f in docs.schema}
    schema = T.StructType([T.StructField(f"_{i}", kinds[c]) for i, c in enumerate(names)]
                          + [T.StructField(f"_{len(names)}", T.ArrayType(T.IntegerType(), False))])
    held = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col(f"`{text_col}`").alias("_text"))
    return held.mapInArrow(run, schema).toDF(*names, to)


def decode(docs, ranks, pattern, ids_col="ids", to="decoded"):
    """docs with ``to``, the bytes of each array of ids (null ids: empty)."""
    model, names = serialise(ranks), [c for c in docs.columns if c != to]

    def run(batches):
        coder = _coder(model, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(lo, AT_ONCE)
                texts = [coder.decode(ids or ()) for ids in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(names)], pa.array(texts, pa.binary())], names=[f"_{i}" for i in range(len(names) + 1)])

    kinds = {f.name: f.dataType for f in docs.schema}
    schema = T.StructType([T.StructField(f"_{i}", kinds[c]) for i, c in enumerate(names)] + [T.StructField(f"_{len(names)}", T.BinaryType())])
    held = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col(f"`{ids_col}`").alias("_ids"))
    return held.mapInArrow(run, schema).toDF(*names, to)
