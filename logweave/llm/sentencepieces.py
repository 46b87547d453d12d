"""Offset-preserving SentencePiece encoding and decoding (byte-pair models).

A text is normalised by longest-prefix matches in the model's compiled character map, white space is
escaped, and every normalised character keeps the byte span of the source it came from. Pieces come
from byte-pair merges by score; each piece thus maps back to a span of source bytes. No piece spans
a word start, so the distinct words of a batch are merged, all at once in numpy, and put together.

Nulls and edges: a null text is empty and gets only the begin and end ids; text without a known
piece falls back to its bytes, or to the unknown id in models without byte pieces.
"""

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from logweave.llm.textscan import BASE, INVERSE, extended, mix64, power, slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NO_PAIR = 2**31 - 1
PART = 1 << 20


def _varint(data, at):
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data):
    """Field number and value of each entry of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at:at + size], at + size
        yield key >> 3, value


class CharMap:
    """The compiled character map: a double-array trie over source bytes and a block of targets."""

    def __init__(self, blob=b""):
        self.units, self.targets = np.zeros(0, np.uint32), b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4)
            self.targets = blob[4 + size:]
        self.trie = self.units.tolist()

    def longest(self, data, at):
        """Bytes matched at ``at`` and their replacement, or ``(0, b"")``."""
        units, best, text = self.trie, 0, b""
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                best, text = i + 1 - at, self.targets[value:self.targets.index(b"\0", value)]
        return best, text


def _width(lead):
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class PieceModel:
    """A model file's pieces, scores and normaliser settings."""

    def __init__(self, data):
        self.pieces, self.kinds, scores = [], [], []
        self.dummy_prefix, self.squeeze, self.escape, blob = True, True, True, b""
        suffix, ids = False, {40: 0, 41: 1, 42: 2}
        for number, value in _fields(data):
            if number == 1:
                piece = {1: b"", 2: struct.pack("<f", 0), 3: NORMAL} | dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0])
                self.kinds.append(piece[3])
            elif number == 2:
                spec = dict(_fields(value))
                if spec.get(3, 1) != 2:
                    raise ValueError("only byte-pair models are supported")
                suffix = bool(spec.get(24, 0))
                ids |= {k: v for k, v in spec.items() if k in ids}
            elif number == 3:
                spec = dict(_fields(value))
                blob = spec.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if suffix or USER_DEFINED in self.kinds or UNUSED in self.kinds:
            raise ValueError("white space as suffix, user-defined and unused pieces are not supported")
        self.unk, self.bos, self.eos = ids[40], ids[41], ids[42]
        self.charmap = CharMap(blob) if blob else None
        self.rank = {p: s for p, s, k in zip(self.pieces, scores, self.kinds) if k == NORMAL}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.glued = any(SPACE in p.lstrip(SPACE) for p in self.rank)
        self.is_byte, self.is_control = (np.array([k == kind for k in self.kinds]) for kind in (BYTE, CONTROL))
        # characters of the normalised text that a piece takes; of byte pieces, those that begin one
        self.piece_chars = np.array([len(p) if k != BYTE else int(p[3:5], 16) & 0xC0 != 0x80 for p, k in zip(self.pieces, self.kinds)], np.int64)
        shown = [self._shown(i) for i in range(len(self.pieces))]
        self.shown_sizes = np.array([len(b) for b in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_sizes) - self.shown_sizes
        self.shown_bytes = np.frombuffer(b"".join(shown), np.uint8)
        self._tables()

    # --- normalisation ---

    def normalize(self, text):
        """The normalised text and, for each of its characters, the source bytes ``[start, end)``.

        Spans are an array of character boundaries when the map leaves characters as they are.
        """
        if self.charmap is None and not self.squeeze:
            raw = text.replace(" ", SPACE) if self.escape else text
            return (SPACE if self.escape else " ") * bool(self.dummy_prefix and raw) + raw, None
        data, out, spans, at = text.encode(), [], [], 0
        while at < len(data):
            size, new = self.charmap.longest(data, at) if self.charmap else (0, b"")
            if not size:
                size = _width(data[at])
                new = data[at:at + size]
            for char in new.decode():
                if char == " " and self.squeeze and (not out or out[-1] == " "):
                    continue
                out.append(char)
                spans.append((at, at + size))
            at += size
        if self.squeeze:
            while out and out[-1] == " ":
                out.pop()
                spans.pop()
        if self.dummy_prefix and out:
            out.insert(0, " ")
            spans.insert(0, (spans[0][0],) * 2)
        return "".join(out).replace(" ", SPACE) if self.escape else "".join(out), spans

    # --- encoding ---

    def _tables(self):
        """Symbols of characters, and every pair of symbols that is a piece: keys, ranks and results.

        A symbol is a piece's id or, from ``len(pieces)`` on, a character that is no piece.
        """
        n = len(self.pieces)
        chars = sorted({c for p in self.rank for c in p} - set(self.ids))
        symbol = self.ids | {c: n + i for i, c in enumerate(chars)}
        order = {s: i for i, s in enumerate(sorted(set(self.rank.values()), reverse=True))}
        pairs = {}
        for piece, score in self.rank.items():
            for cut in range(1, len(piece)):
                left, right = symbol.get(piece[:cut]), symbol.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (order[score], self.ids[piece])
        keys = sorted(pairs)
        self.pair_keys = np.array(keys, np.int64)
        self.pair_ranks = np.array([pairs[k][0] for k in keys] + [NO_PAIR], np.int32)
        self.pair_ids = np.array([pairs[k][1] for k in keys] + [0], np.int64)
        self.char_symbols = np.arange(0x110000, dtype=np.int64) + (n + len(chars))
        for char, i in symbol.items():
            if len(char) == 1:
                self.char_symbols[ord(char)] = i
        if self.escape and SPACE in symbol:
            self.char_symbols[32] = symbol[SPACE]
        self.first_raw, self.extra = n + len(chars), chars

    def _pairs(self, left, right):
        """Positions in the pair table, its last one for pairs that are no piece."""
        keys = left << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        if len(self.pair_keys):
            at[self.pair_keys[at] != keys] = len(self.pair_keys)
        return at

    def _merge(self, symbols, starts):
        """Byte-pair merges of many words at once: symbols left, and their counts.

        In each round every word merges its best-ranked pair, the leftmost of equals; words without
        a pair leave.
        """
        counts = np.diff(np.append(starts, len(symbols)))
        word = np.repeat(np.arange(len(starts)), counts)
        pair = np.full(len(symbols), len(self.pair_keys))
        inner = np.flatnonzero(word[:-1] == word[1:])
        pair[inner] = self._pairs(symbols[inner], symbols[inner + 1])
        done = []
        while len(symbols):
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            ranks = self.pair_ranks[pair]
            best = np.minimum.reduceat(ranks, heads)
            sizes = np.diff(np.append(heads, len(symbols)))
            live = np.repeat(best < NO_PAIR, sizes)
            if not live.all():
                done.append((word[~live], symbols[~live]))
                symbols, word, pair, ranks = symbols[live], word[live], pair[live], ranks[live]
                if not len(symbols):
                    break
                sizes, best = sizes[best < NO_PAIR], best[best < NO_PAIR]
            hits = np.flatnonzero(ranks == np.repeat(best, sizes))
            hits = hits[np.r_[True, word[hits[1:]] != word[hits[:-1]]]]
            symbols[hits] = self.pair_ids[pair[hits]]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            hits = hits - np.arange(len(hits))  # each word before has lost one symbol
            symbols, word, pair = symbols[keep], word[keep], pair[keep]
            for at in (hits, hits[(hits > 0)] - 1):
                last = (at + 1 >= len(symbols))
                near = at[~last]
                same = word[near] == word[near + 1]
                pair[at] = len(self.pair_keys)
                pair[near[same]] = self._pairs(symbols[near[same]], symbols[near[same] + 1])
        word, symbols = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, int), np.zeros(0, np.int64))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(starts))

    def _ids(self, symbols):
        """Ids of symbols, the count of ids of each, and whether it is unknown."""
        unknown = symbols >= len(self.pieces)
        if not unknown.any():
            return symbols.astype("<u4"), np.ones(len(symbols), np.int64)
        counts = np.ones(len(symbols), np.int64)
        made = []
        for symbol in symbols[unknown].tolist():
            char = chr(symbol - self.first_raw) if symbol >= self.first_raw else self.extra[symbol - len(self.pieces)]
            made.append([self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unk])
        counts[unknown] = [len(m) for m in made]
        out = np.empty(counts.sum(), "<u4")
        ends = np.cumsum(counts)
        out[(ends - counts)[~unknown]] = symbols[~unknown]
        spots = _ranges((ends - counts)[unknown], counts[unknown])
        out[spots] = [i for m in made for i in m]
        return out, counts

    def encode_batch(self, texts):
        """Ids of all ``texts`` in one array, and the bounds of each text's. No begin and end ids.

        Every distinct word of the batch is merged once.
        """
        normal = [self.normalize(t)[0] for t in texts]
        lengths = np.array([len(t) for t in normal])
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        points = np.frombuffer("".join(normal).encode("utf-32-le"), "<u4")
        if not len(points):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        symbols = self.char_symbols[points]
        heads = np.zeros(len(points), bool)
        if not self.glued:
            blank = symbols == self.char_symbols[ord(SPACE)]
            heads[1:] = blank[1:] & ~blank[:-1]
        heads[bounds[:-1][lengths > 0]] = True
        starts = np.flatnonzero(heads)
        sizes = np.diff(np.append(starts, len(points)))
        _, first, word = np.unique(_span_hashes(symbols, starts, sizes), return_index=True, return_inverse=True)
        flat = symbols[_ranges(starts[first], sizes[first])]
        merged, counts = self._merge(flat, np.cumsum(sizes[first]) - sizes[first])
        ids, widths = self._ids(merged)
        per_word = np.add.reduceat(widths, np.cumsum(counts) - counts)
        at = np.cumsum(per_word) - per_word
        out = ids[_ranges(at[word], per_word[word])]
        total = np.concatenate([[0], np.cumsum(per_word[word])])
        ends = total[np.searchsorted(starts, bounds)]
        if self.byte_ids:
            return out, ends
        again = np.zeros(len(out), bool)  # unknown pieces in a row are one
        again[1:] = (out[1:] == self.unk) & (out[:-1] == self.unk)
        again[ends[:-1][ends[:-1] < len(out)]] = False
        return out[~again], ends - np.concatenate([[0], np.cumsum(again)])[ends]

    def encode(self, text):
        return self.encode_batch([text])[0].tolist()

    def spans(self, text):
        """``(id, start, end)`` of every piece, in bytes of the source text.

        The byte pieces of one character all carry its span; the leading space that the model adds
        is empty.
        """
        normal, spans = self.normalize(text)
        if spans is None:
            widths = [len(c.encode()) for c in text]
            ends = np.cumsum(widths, dtype=np.int64)
            bounds = list(zip((ends - widths).tolist(), ends.tolist()))
            spans = ([(0, 0)] if self.dummy_prefix and text else []) + bounds
        out, at, wait = [], 0, 0
        for i in self.encode(text):
            if self.kinds[i] == BYTE:
                out.append((i, *spans[at]))
                wait = wait or len(normal[at].encode())
                wait -= 1
                at += not wait
            elif i == self.unk and not self.byte_ids:
                first = at
                while at < len(normal) and self.char_symbols[ord(normal[at])] >= len(self.pieces):
                    at += 1
                out.append((i, spans[first][0], spans[max(first, at - 1)][1]))
            else:
                size = len(self.pieces[i])
                out.append((i, spans[at][0], spans[at + size - 1][1]))
                at += size
        return out

    def align(self, texts, ids, bounds):
        """Source bytes ``[start, end)`` of every id of a batch, relative to its text, as :meth:`spans` gives them."""
        if self.charmap is not None or self.squeeze or not self.byte_ids:
            both = [s[1:] for t in texts for s in self.spans(t)]
            return np.array(both, np.int64).reshape(-1, 2).T
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        widths = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        sizes = np.array([len(t) for t in texts], np.int64)
        heads = np.cumsum(sizes) - sizes
        text_at = np.concatenate([[0], np.cumsum(widths)])[heads]
        if self.dummy_prefix:
            widths = np.insert(widths, heads[sizes > 0], 0)
        ends = np.cumsum(widths)
        steps = self.piece_chars[ids]
        first = np.cumsum(steps) - steps - (steps == 0)  # later bytes of a character stay on it
        last = first + np.maximum(steps, 1) - 1
        base = np.repeat(text_at, np.diff(bounds))
        return np.stack([(ends - widths)[first] - base, ends[last] - base])

    # --- decoding ---

    def _shown(self, i):
        kind = self.kinds[i]
        if kind == CONTROL:
            return b""
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return " ⁇ ".encode() if kind == UNKNOWN else self.pieces[i].replace(SPACE, " ").encode()

    def decode_batch(self, ids, bounds):
        """The decoded texts, as UTF-8, of ids with ``bounds`` for each text."""
        sizes = self.shown_sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        blob = self.shown_bytes[_ranges(self.shown_at[ids], sizes)].tobytes()
        raw = np.concatenate([[0], np.cumsum(self.is_byte[ids])])
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            text = blob[ends[a]:ends[b]]
            first = ids[a:b][:16]
            first = first[~self.is_control[first]]
            if len(first) and (self.dummy_prefix or self.squeeze) and self.kinds[first[0]] == NORMAL:
                text = text.lstrip(b" ") if self.squeeze else text.removeprefix(b" ")
            out.append(_whole(text) if raw[b] > raw[a] else text)
        return out

    def decode(self, ids):
        ids = np.array(ids, "<u4")
        return self.decode_batch(ids, np.array([0, len(ids)]))[0].decode()


def _ranges(starts, sizes):
    """All positions of the ranges ``[start, start + size)``, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _span_hashes(symbols, starts, sizes):
    """A 64-bit hash of each span of symbols."""
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(mix64(symbols.astype(np.uint64) + np.uint64(1)) * power(BASE, len(symbols)), out=total[1:])
    return mix64((total[starts + sizes] - total[starts]) * power(INVERSE, len(symbols))[starts] + sizes.astype(np.uint64))


def _whole(raw):
    """``raw`` with one U+FFFD for every byte that is in no whole character."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode("utf-8", "surrogateescape").translate(_LOST).encode()


_LOST = dict.fromkeys(range(0xDC80, 0xDD00), "�")


def read_model(spark, path):
    """The bytes of a model file, sent to every executor once; a model is a few MB at most."""
    filesystem, place = pyarrow.fs.FileSystem.from_uri(path)
    with filesystem.open_input_file(place) as f:
        return spark.sparkContext.broadcast(f.read())


_models = {}


def _model(shared):
    """One model for each Python worker."""
    key = hashlib.md5(shared.value).digest()
    if key not in _models:
        _models[key] = PieceModel(shared.value)
    return _models[key]


def _encoded(model, texts):
    """Ids with begin and end of every text, and their bounds."""
    return _framed(model, *model.encode_batch([t or "" for t in texts]))


def _framed(model, ids, bounds):
    """Begin and end ids put around every text's ids."""
    n = len(bounds) - 1
    wider = bounds + 2 * np.arange(n + 1)
    out = np.empty(len(ids) + 2 * n, "<u4")
    inner = np.ones(len(out), bool)
    inner[wider[:-1]] = inner[wider[1:] - 1] = False
    out[inner] = ids
    out[wider[:-1]], out[wider[1:] - 1] = model.bos, model.eos
    return out, wider


def encode_texts(df, path, text="text"):
    """``df`` with ``ids`` (array of long, begin and end ids included), in place of a column of that name."""
    shared = read_model(df.sparkSession, path)
    plain = df.drop("ids")

    def run(batches):
        model = _model(shared)
        for batch in batches:
            for part in slices(batch, text, PART):
                ids, bounds = _encoded(model, part.column(text).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "ids"])
    return plain.mapInArrow(run, extended(plain.schema, "ids", ArrayType(LongType())))


def piece_spans(df, path, text="text"):
    """``df`` with ``pieces``: array of id and source bytes ``[start, end)``, in place of a column of that name."""
    shared = read_model(df.sparkSession, path)
    plain = df.drop("pieces")

    def run(batches):
        model = _model(shared)
        for batch in batches:
            for part in slices(batch, text, PART):
                rows = [[{"id": i, "start": a, "end": b} for i, a, b in model.spans(t or "")] for t in part.column(text).to_pylist()]
                kind = pa.list_(pa.struct([("id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, kind)], [*part.schema.names, "pieces"])
    return plain.mapInArrow(run, extended(plain.schema, "pieces", ArrayType(StructType().add("id", "long").add("start", "long").add("end", "long"))))


def _tiles(starts, ends, size):
    """Whether spans lead from 0 to ``size`` without a gap; byte pieces of one character repeat its span."""
    if not len(starts):
        return size == 0
    follows = (starts[1:] == ends[:-1]) | ((starts[1:] == starts[:-1]) & (ends[1:] == ends[:-1]))
    return bool(starts[0] == 0 and ends[-1] == size and follows.all())


def digests(df, path):
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, n_pieces, spans_sha256, aligned`` of every row, encoded and decoded again.

    ``n_pieces`` counts ids without begin and end; ``spans_sha256`` is over their source spans, start and end as
    little-endian unsigned 32-bit integers; ``aligned`` says that the spans lead through the whole source without a gap
    (a model whose map deletes characters leaves gaps).
    """
    shared = read_model(df.sparkSession, path)

    def run(batches):
        model = _model(shared)
        for batch in batches:
            for part in slices(batch, limit=PART):
                texts = [t or "" for t in part.column("text").to_pylist()]
                plain, inner = model.encode_batch(texts)
                spans = model.align(texts, plain, inner)
                pairs = spans.T.astype("<u4")
                cuts = list(zip(inner[:-1].tolist(), inner[1:].tolist()))
                ids, bounds = _framed(model, plain, inner)
                marks = [hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(bounds, bounds[1:])]
                back = [hashlib.sha256(t).hexdigest() for t in model.decode_batch(ids, bounds)]
                where = [hashlib.sha256(pairs[a:b].tobytes()).hexdigest() for a, b in cuts]
                whole = [_tiles(spans[0, a:b], spans[1, a:b], len(t.encode())) for t, (a, b) in zip(texts, cuts)]
                columns = [pa.array(np.diff(bounds)), pa.array(marks), pa.array(back), pa.array(np.diff(inner)), pa.array(where), pa.array(whole, pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], _DIGESTS)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_pieces long, spans_sha256 string, aligned boolean")


_DIGESTS = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_pieces", "spans_sha256", "aligned"]
