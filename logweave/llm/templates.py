"""Benchmark decontamination by canonical templates.

1. Words of a text become template tokens: numbers (also spelled out), units behind a number and
   names give way to a typed placeholder, other words are lower-cased. A name is a capitalised word
   inside a sentence. A placeholder keeps its value as a slot.
2. Windows of ``WINDOW`` tokens with at least ``LITERALS`` literal ones are hashed. Benchmark items with
   the same template are one item, known by the smallest id; shorter items are one window each. Of
   their values the template keeps every distinct pattern: which of its slots hold the same value.
   Windows of the case-folded words themselves are hashed as well, without placeholders and with no
   literals asked for, once for each distinct wording: verbatim copies depend on no token's type.
3. A Bloom filter of fixed size over the benchmark's hashes thins the documents' windows where they are
   made; the rest is joined on the hash. Matches that lie on one diagonal of (document, item) belong
   together.
4. Slot consistency: along a diagonal each value of some item of the template must stand for one
   document value of its type, so slots that are equal in the item are equal in the document. Which
   values they are does not matter. Slots changed throughout that way are a re-parameterised question;
   slots that contradict every item are a chance match of the template. A copy is exact where the
   windows of one wording reach as far.

A document counts from ``RUN`` consecutive words or half of an item's windows on, of its template or
of one wording. Nulls and edges:
null texts have no windows; rows with a null id cannot be reported and are kept; rows that share a
doc_id count as one document; items or texts without words match nothing.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from logweave.llm.textscan import BYTE_VALUES, byte_class, find_words, hash_word, mix64, ngrams, row_bounds, slices, text_buffer
from logweave.session import materialize

WINDOW, LITERALS = 8, 4
RUN = 13
COVER = 0.5
FILTER_BITS = 1 << 26

_WORD = byte_class(lambda b: b >= 0x80 or chr(b).isalnum())
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_STOP = byte_class(lambda b: b in b"\n\r!.?")
_SMALL = byte_class(lambda b: 97 <= b <= 122)
_DIGIT = byte_class(lambda b: 48 <= b <= 57)
_VALUES = BYTE_VALUES[_FOLD]
# Latin capitals with a mark are 0xC3 0x80..0x9E: 0x20 below their small letters
_UPPER_AFTER_C3 = byte_class(lambda b: 0x80 <= b <= 0x9E and b != 0x97)

NUMBER, NAME, UNIT = 1, 2, 3
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
                "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million").split()
UNIT_WORDS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound "
              "pounds ton tons ml l liter liters litre litres gallon gallons second seconds s ms minute minutes min hour hours h "
              "day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees mph kmh "
              "meter meters metre metres kilometer kilometers kilometre kilometres watt watts volt volts hz khz mb gb tb").split()
_PLAIN = np.uint64(0x5DEECE66D1CE4E5B)  # keeps hashes of plain windows apart from those of templates
_TAGS = mix64(np.array([0, NUMBER, NAME, UNIT], np.uint64) + np.uint64(0xABCDEF))


def _hashes(vocabulary):
    return np.sort(np.array([hash_word(w, _VALUES) for w in vocabulary], np.uint64))


_NUMBERS, _UNITS = _hashes(NUMBER_WORDS), _hashes(UNIT_WORDS)


def _among(values, vocabulary):
    at = np.minimum(np.searchsorted(vocabulary, values), len(vocabulary) - 1)
    return vocabulary[at] == values


def _folded(column):
    """The texts without case. Letters map to letters, so the words keep their places."""
    try:
        return pc.utf8_lower(pc.utf8_upper(column))
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        return _folded(pa.array([None if v is None else v.decode("utf-8", "replace") for v in column.cast(pa.binary()).to_pylist()], pa.string()))


class Tokens:
    """Template tokens of a batch of texts: ``rows``, ``keys``, ``kinds``, the ``values`` of slots and the ``plain`` words."""

    def __init__(self, column):
        raw, offsets = text_buffer(column)
        buf = raw.copy()
        marked = np.flatnonzero((raw[:-1] == 0xC3) & _UPPER_AFTER_C3[raw[1:]]) + 1 if len(raw) else np.zeros(0, int)
        buf[marked] += 0x20
        words = find_words(buf, offsets, _WORD, values=_VALUES)
        self.rows, self.values = words.rows, words.hashes
        n = len(words)
        kinds = np.zeros(n, np.int8)
        if n:
            digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
            number = (digits[words.ends] - digits[words.starts] == words.ends - words.starts) | _among(self.values, _NUMBERS)
            first = raw[words.starts]
            capital = (first >= 65) & (first <= 90)
            if len(marked):
                capital |= np.isin(words.starts + 1, marked) & (first == 0xC3)
            # a sentence starts with a row, and behind . ! ? or a line end
            stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
            begins = np.ones(n, bool)
            begins[1:] = (stops[words.starts[1:]] > stops[words.ends[:-1]]) | (self.rows[1:] != self.rows[:-1])
            small = np.concatenate([[0], np.cumsum(_SMALL[raw])])
            name = capital & ~begins & (small[words.ends] > small[words.starts])
            after = np.zeros(n, bool)
            after[1:] = number[:-1] & (self.rows[1:] == self.rows[:-1])
            kinds[name] = NAME
            kinds[after & _among(self.values, _UNITS)] = UNIT
            kinds[number] = NUMBER
        self.kinds = kinds
        self.keys = np.where(kinds > 0, _TAGS[kinds], self.values)
        self.count = len(offsets) - 1
        self.plain = self.values
        if len(raw) and raw.max() >= 0x80:
            self.plain = find_words(*text_buffer(_folded(column)), _WORD, values=_VALUES).hashes

    def plain_windows(self, size):
        """Start positions and hashes of all windows of ``size`` plain words."""
        grams = ngrams(self.plain, size)
        at = np.flatnonzero(self.rows[:len(grams)] == self.rows[size - 1:]) if len(grams) else np.zeros(0, int)
        return at, mix64(grams[at] ^ np.uint64(size) ^ _PLAIN)

    def windows(self, size, literals):
        """Start positions and hashes of the windows of ``size`` tokens with enough literal ones."""
        grams = ngrams(self.keys, size)
        if not len(grams):
            return np.zeros(0, int), grams
        literal = np.concatenate([[0], np.cumsum(self.kinds == 0)])
        good = (self.rows[:len(grams)] == self.rows[size - 1:]) & (literal[size:] - literal[:-size] >= literals)
        at = np.flatnonzero(good)
        return at, mix64(grams[at] ^ np.uint64(size))


def _sizes(length):
    """Window size of an item of ``length`` tokens and the literal tokens it needs."""
    size = min(WINDOW, length)
    return size, min(LITERALS, max(1, size // 2))


def _item_windows(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            tokens = Tokens(part.column("text"))
            bounds = row_bounds(tokens.rows, tokens.count)
            out = []
            for r, item in enumerate(part.column("item_id").to_pylist()):
                a, b = bounds[r], bounds[r + 1]
                if b == a or item is None:
                    continue
                one = tokens.keys[a:b]
                whole = mix64(ngrams(one, b - a) + np.uint64(b - a))[0]
                size, need = _sizes(b - a)
                grams = mix64(ngrams(one, size) ^ np.uint64(size))
                literal = np.concatenate([[0], np.cumsum(tokens.kinds[a:b] == 0)])
                slots = np.flatnonzero(tokens.kinds[a:b])
                same = _pattern(tokens.kinds[a:b][slots], tokens.values[a:b][slots])
                for p in np.flatnonzero(literal[size:] - literal[:-size] >= need):
                    held = tokens.kinds[a + p:a + p + size]
                    first = int(np.searchsorted(slots, p))
                    out.append((item, whole, 0, size, int(p), grams[p], bytes(held[held > 0].tolist()), first, len(slots), same))
                words = tokens.plain[a:b]
                wording = mix64(ngrams(words, b - a) + np.uint64(b - a))[0] | np.uint64(1)  # 0 stands for the template
                for p, h in enumerate(mix64(ngrams(words, size) ^ np.uint64(size) ^ _PLAIN)):
                    out.append((item, whole, wording, size, p, h, b"", 0, 0, b""))
            yield _rows(out, ["item_id", "template", "wording", "size", "pos", "hash", "kinds", "first", "slots", "same"], {"template", "wording", "hash"})


def _pattern(kinds, values):
    """For each slot of an item the number of the first slot with its value; nothing if all values differ."""
    seen = {}
    same = [seen.setdefault(v, i) for i, v in enumerate(zip(kinds.tolist(), values.tolist()))]
    return b"" if len(seen) == len(same) else np.array(same, np.int32).tobytes()


def _slots(tokens, at, size):
    """Kinds of the window's tokens and the values of its slots, literal tokens left out."""
    kinds = tokens.kinds[at:at + size]
    held = kinds > 0
    return bytes(kinds[held].tolist()), tokens.values[at:at + size][held].tobytes()


def _rows(rows, names, unsigned):
    def column(i, name):
        values = [r[i] for r in rows]
        if name in ("vals", "kinds", "same"):
            return pa.array(values, pa.binary())
        if name in unsigned:
            return pa.array(np.array(values, np.uint64).view(np.int64))
        return pa.array([int(v) for v in values], pa.int64())
    return pa.RecordBatch.from_arrays([column(i, n) for i, n in enumerate(names)], names)


def benchmark_windows(items):
    """Windows of each distinct template (``wording`` 0) and wording: ``template, item, wording, size, pos,
    hash, kinds, first, windows``, written out, and ``template, patterns`` of the templates where values repeat in
    every item. ``first`` counts the slots before a window."""
    made = materialize(items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
        _item_windows, "item_id long, template long, wording long, size long, pos long, hash long, kinds binary, first long, slots long, same binary"), "item-windows")
    firsts = made.groupBy("template").agg(F.min("item_id").alias("item"))
    counts = made.groupBy("template", "wording").agg(F.countDistinct("pos").alias("windows"))
    windows = materialize(made.select("template", "wording", "size", "pos", "hash", "kinds", "first").distinct()
                          .join(firsts, "template").join(counts, ["template", "wording"]), "templates")
    # an item whose values all differ allows every document value, so its siblings' patterns add nothing
    patterns = (made.where("wording = 0 AND slots > 0").select("template", "same").distinct().groupBy("template")
                .agg(F.collect_set("same").alias("patterns")).where(~F.array_contains("patterns", F.lit(b""))))
    return windows, materialize(patterns, "slot-patterns")


def _document_windows(sizes, shared):
    """Windows of documents that the filter lets pass. Its test is the hash's own bits, see ``_spots``."""
    def run(batches):
        table = shared.value
        for batch in batches:
            for part in slices(batch):
                tokens = Tokens(part.column("text"))
                ids, texts = part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist()
                bounds = row_bounds(tokens.rows, tokens.count)
                out = []
                for size in sizes:
                    for plain, (at, hashes) in enumerate((tokens.windows(size, _sizes(size)[1]), tokens.plain_windows(size))):
                        hit = np.ones(len(at), bool)
                        for spots in _spots(hashes):
                            hit &= (table[spots >> 5] >> (spots & 31).astype(np.uint32) & 1).astype(bool)
                        for p, h in zip(at[hit], hashes[hit]):
                            r = tokens.rows[p]
                            if ids[r] is not None:
                                out.append((ids[r], texts[r], size, p - bounds[r], h, *((b"", b"") if plain else _slots(tokens, p, size))))
                yield _rows(out, ["doc_id", "text_hash", "size", "pos", "hash", "kinds", "vals"], {"hash"})
    return run


def _spots(hashes):
    """Three filter positions of each hash."""
    mask = np.uint64(FILTER_BITS - 1)
    return [((hashes >> np.uint64(s)) & mask).astype(np.int64) for s in (0, 19, 38)]


def _bits(batches):
    """The filter positions of hashes, as rows."""
    for batch in batches:
        hashes = batch.column("hash").to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_spots(hashes)))], ["bit"])


def _bloom(windows):
    """Bits of fixed number over the benchmark's window hashes, packed into words of 32.

    They are gathered by word in Spark; what reaches the driver is the filter, not the hashes.
    """
    bits = windows.select("hash").mapInArrow(_bits, "bit long")
    packed = bits.groupBy(F.expr("bit div 32").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int)))").alias("bits"))
    rows = packed.toPandas()  # FILTER_BITS / 32 rows at most
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint32)
    return table


def _fits(batches):
    """Alignments whose slots agree with one of the patterns, if there are any: slots with one item value hold one document value."""
    for batch in batches:
        good = []
        for patterns, held in zip(batch.column("patterns").to_pylist(), batch.column("held").to_pylist()):
            theirs = {}
            for h in held if patterns else ():
                values = np.frombuffer(h["vals"], np.int64).tolist()
                theirs.update(zip(range(h["first"], h["first"] + len(values)), values))
            good.append(not patterns or any(_agrees(np.frombuffer(p, np.int32), theirs) for p in patterns))
        yield batch.filter(pa.array(good, pa.bool_())).select(_LINE)


def _agrees(pattern, theirs):
    found = {}
    return all(found.setdefault(pattern[slot], value) == value for slot, value in theirs.items())


_LINE = ["doc_id", "item", "wording", "at", "size", "windows", "exact"]


def contaminated(docs, items, run=RUN, cover=COVER):
    """``doc_id, item_id, n_windows, coverage, exact, reparameterised`` of every contaminated document
    and distinct benchmark template found in it; ``exact`` tells of its longest alignment."""
    windows, patterns = benchmark_windows(items)
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # WINDOW values at most
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(windows))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        _document_windows(sizes, shared), "doc_id long, text_hash long, size long, pos long, hash long, kinds binary, vals binary")
    theirs = found.withColumnsRenamed({"pos": "start", "kinds": "doc_kinds"})
    matched = theirs.join(windows, ["hash", "size"]).where("kinds = doc_kinds").withColumn("diagonal", F.col("start") - F.col("pos"))
    # rows that share a doc_id have alignments of their own; windows of an alignment are at most those of the item, so its sets stay small
    lines = matched.groupBy("doc_id", "text_hash", "template", "item", "wording", "diagonal").agg(
        F.sort_array(F.collect_set("pos")).alias("at"), F.max("size").alias("size"), F.max("windows").alias("windows"),
        F.collect_set(F.when(F.length("kinds") > 0, F.struct("first", "vals"))).alias("held"))
    lines = lines.join(patterns, "template", "left").withColumn("exact", F.size("held") == 0).select(*_LINE, "held", "patterns").mapInArrow(
        _fits, "doc_id long, item long, wording long, at array<long>, size long, windows long, exact boolean")
    # consecutive window starts on a diagonal make a run of words
    need = F.greatest(F.lit(1), F.lit(run) - F.col("size") + 1)
    runs = F.exists("at", lambda p: F.size(F.filter("at", lambda q: (q >= p) & (q < p + need))) >= need)
    hits = lines.withColumn("run", runs).groupBy("doc_id", "item", "wording").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n_windows"), F.max("windows").alias("windows"),
        F.max("run").alias("run"), F.max(F.struct(F.size("at").alias("length"), "exact")).alias("longest"))
    hits = hits.withColumn("coverage", F.col("n_windows") / F.col("windows"))
    counts = F.col("run") | (F.col("coverage") >= cover)
    best = hits.groupBy("doc_id", "item").agg(F.max(F.when(counts, F.struct("coverage", "n_windows"))).alias("best"),
                                              F.max("longest")["exact"].alias("exact")).where("best IS NOT NULL")
    return best.select("doc_id", F.col("item").alias("item_id"), F.col("best.n_windows").cast("long").alias("n_windows"), "best.coverage",
                       "exact", (~F.col("exact")).alias("reparameterised"))
