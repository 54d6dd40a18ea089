"""Token ids as flat binary files with 64-bit document offsets.

A folder holds, for parts 0, 1, 2, ... in ascending document id:

    00007.bin    the ids of the part's documents one after the other, little-endian unsigned,
                 2 bytes wide if the vocabulary allows, else 4
    00007.off    for each document its id, and the place in the .bin after its last id, as
                 little-endian signed 64-bit pairs
    parts.json   width, and of each part its documents, its ids and its base: the ids of all
                 parts before it

Ranges of document ids are taken from quantiles of the ids, so only ids decide where a
document goes and one pass tokenises, deals and writes. A task streams its sorted rows into
files under a name of its own and renames them when they are complete, so a repeated or
speculative task leaves the same files. The driver sees one row per part, whose prefix sums
are the bases. Readers map the files into memory; on a store other than a mounted folder
they read them through pyarrow's file systems.
"""
import itertools
import json
import os
import re
import sys
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import functions as F

from barloom.llm.workers import kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])
KEPT = 800_000
#: bytes that only characters beyond U+00FF have; their composition can depend on case
FAR = re.compile(b"[\xc4-\xff]")
#: a comma or full stop that ends a word of letters
LAST_SIGN = re.compile(b"[,.](?:(?<=[a-z].)|(?<=\xc3[\xa0-\xb6\xb8-\xbf].))(?=[ \t-\r]|\\Z)")
#: what normalising can change in a word; words without it are learnt without a normaliser
CHANGED = re.compile(b"[A-Z\xc2\xc4-\xff]|\xc3[\x80-\x9e]")
#: candidates for the mark between words
MARKS = "^♥™€…•★"
AT_ONCE = 200
LAST = np.iinfo(np.int64).max
WRITTEN = "part long, docs long, ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def by_words(definition):
    """(whether words between white space can be encoded one by one, whether letters and a mark after them can be too).

    The first holds where the normaliser only composes, lower-cases or joins white space and the
    first cut of the text drops white space; the second where it lower-cases and that cut also parts
    letters from signs. Other tokenizers get whole texts.
    """
    told = json.loads(definition)

    def steps(part, names):
        part = told.get(part) or {"type": "Sequence", names: []}
        return part[names] if part["type"] == "Sequence" else [part]

    def harmless(step):
        return step["type"] in ("NFC", "Lowercase") or step["type"] == "Replace" and step["pattern"] == {"Regex": "\\s+"} and step["content"] == " "

    plain = all(harmless(step) for step in steps("normalizer", "normalizers"))
    cuts = steps("pre_tokenizer", "pretokenizers")
    first = cuts[0] if cuts else {"type": ""}
    pattern = first.get("pattern", {}).get("Regex", "") if isinstance(first.get("pattern"), dict) else ""
    dropped = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and pattern.endswith("[^\\s\\p{L}\\p{N}]+")
    parts = pattern.removesuffix("[^\\s\\p{L}\\p{N}]+").strip("|").split("|")
    dropped = dropped and all(p in ("[\\p{L}]+", "[\\p{N}]", "[\\p{N}]+") or p.startswith("'") and p[1:].isalpha() for p in parts)
    dropped = dropped or first["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")
    lower = any(step["type"] == "Lowercase" for step in steps("normalizer", "normalizers"))
    return plain and dropped, plain and dropped and lower and "[\\p{L}]+" in parts


def apart(text):
    """A text of characters up to U+00FF in lower case (A-Z), with a space before a sign that ends a word."""
    return LAST_SIGN.sub(b" \\g<0>", text.lower())


class Coder:
    """Ids by the tokenizers library, each word between ASCII white space by itself where ``by_words`` allows it.

    A worker keeps the words it has met; when they are too many it keeps the half it met first, in
    which the frequent ones are. New words are encoded as one text with a mark between them: a character with one
    id of its own, which no word without that character can have. Words with it are encoded
    alone. Where the definition lower-cases and parts letters from signs, the same word in capitals
    or before a comma or full stop is not new (``apart``).
    """

    def __init__(self, definition, width):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.width, self.ids = Tokenizer.from_str(definition), width, {}
        self.words, self.parted = by_words(definition)
        self.bare = _bare(definition) if self.parted else None
        # whole strings with ids of their own, which case and the model's rules do not reach
        own = [t["content"].lower().encode() for t in json.loads(definition).get("added_tokens") or ()]
        self.own = re.compile(b"|".join(map(re.escape, own))) if own else None
        marks = [(m, self._ids(m)) for m in MARKS]
        self.mark, self.mark_id = next(((m, ids[0]) for m, ids in marks if len(ids) == 1 and self._ids(f"a {m} b").count(ids[0]) == 1), (None, None))

    def _ids(self, text, model=None):
        return (model or self.model).encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, fresh, to, model=None):
        """Ids of new words (bytes) into a dict."""
        if self.mark is None:
            alone, fresh = fresh, []
        else:
            mark = self.mark.encode()
            alone, fresh = [w for w in fresh if mark in w], [w for w in fresh if mark not in w]
        for word in alone:
            to[word] = np.array(self._ids(word.decode(), model), self.width).tobytes()
        if fresh:
            ids = np.array(self._ids(f" {self.mark} ".encode().join(fresh).decode(), model), self.width)
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
            if len(ends) != len(fresh):  # the mark is not kept apart by this tokenizer
                self.mark = None
                return self._learn(fresh, to, model)
            raw, size = ids.tobytes(), ids.itemsize
            starts = np.concatenate([[0], ends[:-1] + 1]) * size
            to.update(zip(fresh, [raw[a:b] for a, b in zip(starts.tolist(), (ends * size).tolist())]))

    def encode(self, texts, end):
        if not self.words:
            return [np.array(e.ids, self.width).tobytes() + end for e in self.model.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        words, cuts = [], [0]
        for t in texts:
            words += (apart(t) if self.parted and not FAR.search(t) and not (self.own and self.own.search(t.lower())) else t).split()
            cuts.append(len(words))
        ids = list(map(self.ids.get, words))
        if None in ids:
            fresh = {w for w, held in zip(words, ids) if held is None}
            if len(self.ids) + len(fresh) > KEPT:
                self.ids = dict(itertools.islice(self.ids.items(), KEPT // 2))
                fresh = set(words).difference(self.ids)
            changed = [w for w in fresh if CHANGED.search(w) or self.own and self.own.search(w)] if self.bare else list(fresh)
            self._learn(changed, self.ids)
            if len(changed) < len(fresh):
                self._learn(list(fresh.difference(changed)), self.ids, self.bare)
            ids = [self.ids[w] if held is None else held for w, held in zip(words, ids)]
        return [b"".join(ids[a:b]) + end for a, b in zip(cuts, cuts[1:])]


def _bare(definition):
    """The tokenizer without its normaliser and without the library's store of words, if it is of pair merges; else None."""
    from tokenizers import Tokenizer, models

    told = json.loads(definition)
    model = told["model"]
    if model["type"] != "BPE":
        return None
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    rest = {k: model[k] for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k) is not None}
    bare = Tokenizer(models.BPE(vocab=model["vocab"], merges=pairs, cache_capacity=0, **rest))
    bare.pre_tokenizer = Tokenizer.from_str(definition).pre_tokenizer
    return bare


def _coder(definition, width):
    return kept(("tokenizers", hash(definition), width), lambda: Coder(definition, width))


def _store(folder):
    system, path = pa.fs.FileSystem.from_uri(folder)
    return system, path.rstrip("/")


def _tokenise(definition, width, end_id, bounds):
    end = np.array([end_id], width).tobytes()

    def run(batches):
        coder = _coder(definition, width)
        for batch in batches:
            ids = np.asarray(batch.column(0).cast(pa.int64()).fill_null(LAST))
            texts = batch.column(1).fill_null("").cast(pa.binary())
            for lo in range(0, len(texts), AT_ONCE):
                own = ids[lo:lo + AT_ONCE]
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, own).astype(np.int64)), pa.array(own),
                                                  pa.array(coder.encode(texts[lo:lo + AT_ONCE].to_pylist(), end), pa.binary())], names=["part", "id", "ids"])

    return run


def _write(folder, width):
    width = np.dtype(width).itemsize

    def run(batches):
        system, root = _store(folder)
        part, out = None, None

        def close():
            out.close()
            with system.open_output_stream(f"{own}.off") as offsets:
                offsets.write(np.array(index, "<i8").tobytes())
            for kind in ("bin", "off"):
                system.move(f"{own}.{kind}", f"{root}/{part:05d}.{kind}")
            row = [pa.array([x], pa.int64()) for x in (part, len(index), index[-1][1] if index else 0)]
            return pa.RecordBatch.from_arrays(row, names=["part", "docs", "ids"])

        for batch in batches:
            for p, i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if p != part:
                    if out:
                        yield close()
                    part, own, index, at = p, f"{root}/_{uuid.uuid4().hex}", [], 0
                    out = system.open_output_stream(f"{own}.bin")
                blob = blob.as_buffer()
                out.write(blob)
                at += len(blob) // width
                index.append((i, at))
        if out:
            yield close()

    return run


def write_tokens(docs, tokenizer, folder, end_id, id_col="doc_id", text_col="text", parts=None):
    """Writes the ids of all whole texts, each followed by ``end_id``, to a new folder in ascending id order.

    ``tokenizer`` is the path of a definition of the tokenizers library, read on the driver; no
    special tokens are added. Texts are encoded word by word where the definition allows it (``by_words``), else whole. ``folder`` is a path all executors share. Null text: only the end
    id. Null id: written with the largest 64-bit id, so last. Documents of equal id stand in the
    order of their ids' bytes. An empty table gives a folder without parts. Returns the manifest.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        definition = file.read()
    from tokenizers import Tokenizer

    top = max(Tokenizer.from_str(definition).get_vocab().values())
    width = "<u2" if max(top, end_id) < 1 << 16 else "<u4"
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    cuts = held.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else None
    bounds = np.unique(np.array(cuts or [], np.int64))
    system, root = _store(folder)
    system.create_dir(root, recursive=True)
    coded = held.mapInArrow(_tokenise(definition, width, end_id, bounds), "part long, id long, ids binary")
    dealt = coded.repartition(parts, "part").sortWithinPartitions("part", "id", "ids")
    found = {r.part: r for r in dealt.mapInArrow(_write(folder, width), WRITTEN).collect()}  # one row per part
    manifest, base = {"width": width, "parts": []}, 0
    for part in sorted(found):
        manifest["parts"].append({"part": part, "docs": found[part].docs, "ids": found[part].ids, "base": base})
        base += found[part].ids
    with system.open_output_stream(f"{root}/parts.json") as file:
        file.write(json.dumps(manifest).encode())
    return manifest


def _open(system, path):
    if isinstance(system, pa.fs.LocalFileSystem) and system.get_file_info(path).size:
        return pa.memory_map(path).read_buffer()
    with system.open_input_file(path) as file:
        return file.read_buffer()


def _digest(folder, width):
    def run(batches):
        system, root = _store(folder)
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(_open(system, f"{root}/{part:05d}.bin"), width)
                index = np.frombuffer(_open(system, f"{root}/{part:05d}.off"), "<i8").reshape(-1, 2)
                start = np.concatenate([[0], index[:-1, 1]])
                for lo in range(0, len(index), 5000):
                    a, b = start[lo:lo + 5000], index[lo:lo + 5000, 1]
                    crc = [zlib.crc32(ids[x:y].astype("<u4")) for x, y in zip(a, b)]
                    doc = index[lo:lo + 5000, 0]
                    yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == LAST), pa.array(a + base), pa.array(b - a), pa.array(crc, pa.int64())],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(spark, folder):
    """One row per document of a folder, read from its files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    system, root = _store(folder)
    with system.open_input_file(f"{root}/parts.json") as file:
        manifest = json.loads(file.read())
    rows = spark.createDataFrame([(p["part"], p["base"]) for p in manifest["parts"]], "part long, base long")
    return rows.repartition(max(1, len(manifest["parts"]))).mapInArrow(_digest(folder, manifest["width"]), READ)
