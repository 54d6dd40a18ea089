"""Words of an Arrow text column as numpy arrays, and hashes of word windows.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r; these are
ASCII, so UTF-8 text can be cut on bytes. A batch is worked off in chunks of about
``CHUNK`` bytes (a longer document is a chunk of its own), which bounds the memory
of a task. Hashes are polynomials modulo 2**64 with odd bases: prefix sums give the
hash of any run of bytes or words by one subtraction and a product with the inverse
power, and a final mix spreads the bits. A second family, for those who need more than 64
bits, is no function of the first: its word hash is a sum of mixed (byte, place in the word)
and its windows have another base.
"""
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# tasks get these functions by value, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 20
U = np.uint64
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
SECOND_SALT, SECOND_BASE = 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = {}


def powers(base, n):
    """The first n powers of an odd base and of its inverse modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        have = _powers[base] = tuple(pair)
    return have[0][:n], have[1][:n]


def mix(x, salt=0):
    """Spreads the bits of 64-bit values; another salt gives another hash."""
    x = x ^ U((salt * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """Words of the documents ``lo`` to ``hi`` of a batch: byte spans, document index, hash."""

    def __init__(self, data, offsets, lo, lower):
        self.lo, self.offsets, n = lo, offsets, len(data)
        self.data = LOWER[data] if lower else data
        inside = ~SPACE[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] |= inside[cuts]
        last[cuts - 1] |= inside[cuts - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        docs = len(offsets) - 1
        self.bounds = np.searchsorted(self.doc, np.arange(docs + 1))
        power, inverse = powers(BYTE_BASE, n)
        total = np.zeros(n + 1, U)
        np.cumsum((self.data.astype(U) + U(1)) * power, out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start]) if n else np.zeros(0, U)
        self._sum = self._second = None

    def window(self, k, salt=0):
        """(starts, hashes) of all windows of k words that stay inside one document."""
        m = len(self.hash)
        if m < k:
            return np.zeros(0, np.int64), np.zeros(0, U)
        power, inverse = powers(WORD_BASE, m)
        if self._sum is None:
            self._sum = np.zeros(m + 1, U)
            np.cumsum(self.hash * power, out=self._sum[1:])
        at = np.flatnonzero(self.doc[:m - k + 1] == self.doc[k - 1:])
        return at, mix((self._sum[at + k] - self._sum[at]) * inverse[at], salt)

    def second_window(self, k):
        """Hashes of the second family of the windows of ``window(k)``, in the same order."""
        m, n = len(self.hash), len(self.data)
        if m < k:
            return np.zeros(0, U)
        power, inverse = powers(SECOND_BASE, m)
        if self._second is None:
            place = np.arange(n)
            place[self.start[0]:] -= np.repeat(self.start, np.diff(np.append(self.start, n)))
            total = np.zeros(n + 1, U)
            np.cumsum(mix((self.data.astype(U) | (place.astype(U) << U(8))) + U(SECOND_SALT)), out=total[1:])
            self._second = np.zeros(m + 1, U)
            np.cumsum(mix(total[self.end] - total[self.start]) * power, out=self._second[1:])
        at = np.flatnonzero(self.doc[:m - k + 1] == self.doc[k - 1:])
        return mix((self._second[at + k] - self._second[at]) * inverse[at])

    def sequence(self, doc):
        """Hash of all words of one document (by its index in the chunk)."""
        a, b = self.bounds[doc], self.bounds[doc + 1]
        power, _ = powers(WORD_BASE, max(1, b - a))
        return mix((self.hash[a:b] * power[:b - a]).sum(dtype=U, keepdims=True), int(b - a))[0]


def text_bytes(column):
    """(bytes, 64-bit offsets) of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column, lower=False, size=CHUNK):
    """Words of consecutive runs of documents with about ``size`` bytes each."""
    data, offsets = text_bytes(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        own = offsets[lo:hi + 1]
        yield Words(data[own[0]:own[-1]], own - own[0], lo, lower)
        lo = hi


def planes(values):
    """Bytes of an unsigned integer array, most alike bytes together; shuffles compress them well."""
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplanes(blob, dtype):
    dtype = np.dtype(dtype)
    return np.frombuffer(blob, np.uint8).reshape(dtype.itemsize, -1).T.copy().view(dtype).reshape(-1)


def runs(sorted_values):
    """Start of each run of equal values, and the run of each value."""
    fresh = np.ones(len(sorted_values), bool)
    fresh[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(fresh), np.cumsum(fresh) - 1
