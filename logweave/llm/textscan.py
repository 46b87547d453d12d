"""Vectorised scanning of texts inside Arrow batches: word spans, word hashes and n-gram hashes.

A batch's texts lie in one UTF-8 buffer. Words are runs of bytes of a class; a word's hash is a
polynomial over its bytes, taken from prefix sums modulo 2**64, so no word becomes a Python object.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.types import StructType

PIECE_BYTES = 2 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers = {}


def mix64(x):
    """Bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def power(base, n):
    """Powers 0 to n - 1 of ``base`` modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        got = _powers[base] = np.multiply.accumulate(steps)
    return got[:n]


BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def extended(schema, name, kind):
    """A copy of ``schema`` with one more column."""
    return StructType(list(schema.fields)).add(name, kind)


def byte_class(test):
    """Table of 256 flags from a test of the byte value."""
    return np.array([bool(test(b)) for b in range(256)])


NOT_BLANK = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def text_buffer(column):
    """Bytes and row offsets of an Arrow text column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        return buf[:0], np.zeros(1, np.int64)
    return buf[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch, text="text", limit=PIECE_BYTES):
    """Parts of a record batch of at most ``limit`` text bytes each, one row at least."""
    offsets = text_buffer(batch.column(text))[1]
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


class Words:
    """Words of a buffer: byte ``starts`` and ``ends``, ``rows`` and 64-bit ``hashes``."""

    def __init__(self, starts, ends, rows, hashes):
        self.starts, self.ends, self.rows, self.hashes = starts, ends, rows, hashes

    def __len__(self):
        return len(self.starts)


def _piece(buf, is_word, values):
    m = is_word[buf]
    edge = np.empty(len(m) + 1, np.int8)
    edge[0], edge[-1] = m[0], -int(m[-1])
    edge[1:-1] = np.diff(m.view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * power(BASE, len(buf)), out=total[1:])
    h = (total[ends] - total[starts]) * power(INVERSE, len(buf))[starts]
    return starts, ends, mix64(h + (ends - starts).astype(np.uint64))


def find_words(buf, offsets, is_word=NOT_BLANK, fold=ASCII_LOWER, values=None):
    """The words of every row; a word ends with its row. ``fold`` maps bytes before hashing."""
    values = BYTE_VALUES[fold] if values is None else values
    rows = len(offsets) - 1
    parts, at = [], 0
    while at < len(buf):
        end = min(len(buf), at + PIECE_BYTES)
        reach = PIECE_BYTES
        while end < len(buf):  # cut behind a byte that is in no word, or between rows
            gaps = np.flatnonzero(~is_word[buf[max(at, end - 4096):end]])
            cut = max(at, end - 4096) + int(gaps[-1]) + 1 if len(gaps) else at
            row = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            cut = max(cut, row)
            if cut > at:
                end = cut
                break
            reach *= 2
            end = min(len(buf), at + reach)
        bounds = offsets[np.searchsorted(offsets, at, "right"):np.searchsorted(offsets, end, "left")]
        bounds = np.unique(bounds[(bounds > at) & (bounds < end)]) - at
        piece = buf[at:end]
        glued = bounds[is_word[piece[bounds]] & is_word[piece[bounds - 1]]] if len(bounds) else bounds
        if len(glued):  # words of neighbouring rows touch: scan row groups apart
            for lo, hi in zip(np.r_[0, glued], np.r_[glued, len(piece)]):
                s, e, h = _piece(piece[lo:hi], is_word, values)
                parts.append((s + at + lo, e + at + lo, h))
        elif len(piece):
            s, e, h = _piece(piece, is_word, values)
            parts.append((s + at, e + at, h))
        at = end
    if not parts:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64))
    starts, ends, hashes = (np.concatenate(x) for x in zip(*parts))
    return Words(starts, ends, np.searchsorted(offsets[1:rows + 1], starts, "right"), hashes)


def row_bounds(rows, n):
    """First position of each of ``n`` rows in the sorted array ``rows``, and the end."""
    return np.searchsorted(rows, np.arange(n + 1))


def hash_word(word, values=None):
    """The hash that :func:`find_words` gives ``word``, a string."""
    buf = np.frombuffer(word.encode(), np.uint8)
    return find_words(buf, np.array([0, len(buf)]), np.ones(256, bool), values=values).hashes[0]


def ngrams(hashes, k):
    """Hashes of every ``k`` consecutive entries."""
    n = max(0, len(hashes) - k + 1)
    acc = hashes[:n].copy()
    for j in range(1, k):
        acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + hashes[j:j + n])
    return acc
