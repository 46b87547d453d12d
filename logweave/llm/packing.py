"""Packing documents into token sequences: best-fit decreasing over open windows.

1. Tokenising. White space ends every token of the tokenizer, so a batch's texts are cut at ASCII white
   space and each distinct word is encoded once; the ids of a document are its words' ids, then ``end_id``.
2. Documents over ``window`` ids are first cut into full windows; the rest joins the pieces to be packed.
3. Best fit, longest piece first. A segment tree over the remaining capacities 0 to ``window`` tells which
   capacities have an open window; a search in it finds the tightest one that holds the piece, else a
   window is opened. Each task packs its own rows in blocks of about ``BLOCK`` ids, so no token is
   shuffled, memory does not follow the input, and a lost task is packed again alone.
4. What is left open. A window that misses more than ``SLACK`` ids is filled up with cuts from the emptiest
   windows of the block; the last open window goes on to the next block, and at the end of a task it is
   cut into sequences whose lengths are powers of two, which need no padding.

Sequence numbers hold the task's number, so rows must come in the same partitions when a task runs again,
as they do from a file scan or a written table; other inputs should be materialised first.

Nulls and edges: a null or empty text is ``end_id`` alone; rows with a null or repeated key are documents
of their own; texts of any length are encoded in parts; an empty table gives no rows. Only the key and
text columns are read, so other columns never clash.
"""

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import functions as F

from logweave.llm.textscan import ASCII_LOWER, slices, text_buffer
from logweave.session import spread

WINDOW = 4096
END_ID = 2
BLOCK = 1 << 22
SLACK = 8
MEMORY_WORDS, LEARN = 1 << 19, 1 << 14
_LETTERS = "".join(c for c in map(chr, range(97, 256)) if c.isalpha() and c.islower() and c not in "\u00AA\u00B5\u00BA")
_WORD = re.compile(f"[{_LETTERS}]+").fullmatch
_MARK = r"([a-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([.,;:!?])(\s|$)"
_encoders = {}


class WordIds:
    """Ids of words, remembered for the words of earlier batches.

    Where the tokenizer lower-cases and keeps letters apart from what follows them (tried out on samples),
    ASCII case is folded and one mark behind a word is set apart first, which leaves far fewer distinct
    words, and words of letters go to the tokenizer's model directly. All others, among them special
    tokens, are encoded whole.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.letters = None
        if tokenizer.normalizer and tokenizer.pre_tokenizer:
            cut = lambda text: [piece for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text))]
            alone = {c: cut(c) for c in _LETTERS}
            if cut("AZ,") == ["az", ","] and all(len(x) == 1 for x in alone.values()) and cut(_LETTERS) == ["".join(x for c in _LETTERS for x in alone[c])]:
                self.letters = str.maketrans({c: x[0] for c, x in alone.items()})
        self._forget()

    def _forget(self):
        self.known, self.flat, self.bounds = {}, np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, words):
        plain = [w for w in words if _WORD(w)] if self.letters else []
        rest = [w for w in words if not _WORD(w)] if self.letters else words
        tokenize = self.tokenizer.model.tokenize
        got = [[token.id for token in tokenize(w.translate(self.letters))] for w in plain]
        for at in range(0, len(rest), LEARN):
            got += [e.ids for e in self.tokenizer.encode_batch_fast(rest[at:at + LEARN], add_special_tokens=False)]
        self.known.update(zip(plain + rest, range(len(self.known), len(self.known) + len(words))))
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for ids in got for i in ids), np.uint32, int(sizes.sum()))
        self.flat = np.concatenate([self.flat, flat])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])

    def encode(self, column):
        """Flat ids of a text column and row bounds; nulls count as empty."""
        buf, offsets = text_buffer(column)
        fold = self.letters and b"<|" not in buf.tobytes()  # special tokens keep their case
        data = ASCII_LOWER[buf] if fold else np.ascontiguousarray(buf)
        texts = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data))
        if fold:
            texts = pc.replace_substring_regex(texts, _MARK, r"\1 \2\3")
        parts = pc.ascii_split_whitespace(texts)
        rows = np.asarray(parts.offsets) - parts.offsets[0].as_py()
        words = parts.flatten().dictionary_encode()
        names = words.dictionary.to_pylist()
        if len(self.known) > MEMORY_WORDS:
            self._forget()
        fresh = [w for w in names if w not in self.known]
        if fresh:
            self._learn(fresh)
        place = np.fromiter((self.known[w] for w in names), np.int64, len(names))[words.indices.to_numpy(zero_copy_only=False)]
        starts, sizes = self.bounds[place], self.bounds[place + 1] - self.bounds[place]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        at = np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])
        return self.flat[at], ends[rows]


def _encoder(tokenizer_file):
    """The worker process's encoder; loaded once, its memory of words is bounded."""
    if tokenizer_file not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        _encoders[tokenizer_file] = WordIds(Tokenizer.from_file(tokenizer_file))
    return _encoders[tokenizer_file]


class Capacities:
    """Segment tree over remaining capacities 0 to ``top``: a node is true where an open window lies below it."""

    def __init__(self, top):
        self.size = 1 << top.bit_length()
        self.some = bytearray(2 * self.size)
        self.open = [[] for _ in range(top + 1)]

    def add(self, capacity, window):
        self.open[capacity].append(window)
        if len(self.open[capacity]) == 1:
            node = self.size + capacity
            while node and not self.some[node]:
                self.some[node] = 1
                node //= 2

    def tightest(self, need):
        """The smallest capacity of at least ``need`` with an open window, or None."""
        node = self.size + need
        if not self.some[node]:
            while node & 1 or not self.some[node + 1]:  # up to the first right neighbour that holds a window
                node //= 2
                if node <= 1:
                    return None
            node += 1
            while node < self.size:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        return node - self.size

    def take(self, capacity):
        window = self.open[capacity].pop()
        node = self.size + capacity
        if not self.open[capacity]:
            self.some[node] = 0
            while node > 1:
                node //= 2
                if self.some[2 * node] or self.some[2 * node + 1]:
                    break
                self.some[node] = 0
        return window


def best_fit(lengths, window=WINDOW):
    """Windows as lists of positions in ``lengths``, each at most ``window``; longest first, ties in order."""
    tree, windows = Capacities(window), []
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        need = int(lengths[i])
        capacity = tree.tightest(need)
        if capacity is None:
            at, capacity = len(windows), window
            windows.append([])
        else:
            at = tree.take(capacity)
        windows[at].append(i)
        if capacity > need:
            tree.add(capacity - need, at)
    return windows


def fill_up(windows, window=WINDOW, slack=SLACK):
    """Windows of ``(piece, start, length)`` in which only the last may miss more than ``slack`` ids.

    Missing ids are cut from the emptiest windows, whose pieces are thus split up.
    """
    used = [sum(p[2] for p in w) for w in windows]
    order = sorted(range(len(windows)), key=lambda i: (-used[i], i))
    windows, used = [list(windows[i]) for i in order], [used[i] for i in order]
    at, last = 0, len(windows) - 1
    while at < last:
        if window - used[at] <= slack:
            at += 1
            continue
        piece, start, length = windows[last].pop()
        cut = min(length, window - used[at])
        windows[at].append((piece, start, cut))
        if cut < length:
            windows[last].append((piece, start + cut, length - cut))
        used[at] += cut
        used[last] -= cut
        if not windows[last]:
            last -= 1
    return windows[:last + 1]


def power_cuts(pieces):
    """The pieces of one window as sequences of power-of-two lengths, largest first."""
    pieces, out = list(pieces)[::-1], []
    left = sum(p[2] for p in pieces)
    while left:
        want, one = 1 << (left.bit_length() - 1), []
        left -= want
        while want:
            piece, start, length = pieces.pop()
            cut = min(length, want)
            one.append((piece, start, cut))
            if cut < length:
                pieces.append((piece, start + cut, length - cut))
            want -= cut
        out.append(one)
    return out


class Packer:
    """Collects the documents of a task and emits packed pieces block by block."""

    def __init__(self, window, first, slack=SLACK):
        self.window, self.slack, self.sequence = window, slack, first
        self.pieces, self.size = [], 0  # (key, start, ids, document's ids)

    def add(self, key, ids):
        """Full windows of the document at once; its rest waits for the block."""
        whole = len(ids) - len(ids) % self.window
        for start in range(0, whole, self.window):
            yield self._row((key, start, ids[start:start + self.window], len(ids)), 0, self.window, 0)
            self.sequence += 1
        if whole < len(ids):
            self.pieces.append((key, whole, ids[whole:], len(ids)))
            self.size += len(ids) - whole

    @staticmethod
    def _cut(piece, start, length):
        key, at, ids, total = piece
        return key, at + start, ids[start:start + length], total

    def _row(self, piece, start, length, offset):
        key, at, ids, total = self._cut(piece, start, length)
        return key, at, length, total, self.sequence, offset, ids.tobytes()

    def _emit(self, windows):
        for one in windows:
            offset = 0
            for piece, start, length in one:
                yield self._row(self.pieces[piece], start, length, offset)
                offset += length
            self.sequence += 1

    def flush(self, end=False):
        if not self.pieces:
            return
        windows = [[(i, 0, len(self.pieces[i][2])) for i in w] for w in best_fit([len(p[2]) for p in self.pieces], self.window)]
        windows = fill_up(windows, self.window, self.slack)
        rest = windows[-1] if sum(p[2] for p in windows[-1]) < self.window - self.slack else []
        yield from self._emit(windows[:-1] if rest else windows)
        if end:
            yield from self._emit(power_cuts(rest))
            rest = []
        self.pieces = [self._cut(self.pieces[i], start, length) for i, start, length in rest]
        self.size = sum(len(p[2]) for p in self.pieces)


_FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]


def _table(rows, kind):
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, [("key", kind), *_FIELDS])], ["key", *(n for n, _ in _FIELDS)])


def _pack(tokenizer_file, window, end_id, block):
    def run(batches):
        encoder = _encoder(tokenizer_file)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        rows, size, kind = [], 0, None
        for batch in batches:
            kind = batch.column("key").type
            for part in slices(batch):
                flat, bounds = encoder.encode(part.column("text"))
                for i, key in enumerate(part.column("key").to_pylist()):
                    ids = np.append(flat[bounds[i]:bounds[i + 1]], np.uint32(end_id))
                    for row in packer.add(key, ids):
                        rows.append(row)
                        size += row[2]
                if packer.size >= block:
                    for row in packer.flush():
                        rows.append(row)
                        size += row[2]
                if size >= 1 << 20:
                    yield _table(rows, kind)
                    rows, size = [], 0
        rows.extend(packer.flush(end=True))
        for at in range(0, len(rows), 4096):
            yield _table(rows[at:at + 4096], kind)
    return run


def pack(docs, tokenizer_file, key="doc_id", text="text", window=WINDOW, end_id=END_ID, block=BLOCK):
    """Pieces ``key, start, length, doc_tokens, sequence_id, offset, ids`` of all documents.

    ``ids`` are little-endian unsigned 32-bit integers; ``start`` counts the ids of the document before the
    piece, ``offset`` those of the sequence before it. ``tokenizer_file`` must lie at the same path on
    every executor, and its pre-tokenizer must drop white space.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return spread(rows).mapInArrow(_pack(tokenizer_file, window, end_id, block), schema)
