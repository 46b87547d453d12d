"""Secret scanning: fixed rules plus a character convolutional network over every candidate.

Candidates are maximal runs of letters, digits and ``+/_=.-``: all of at least ``LONG`` characters, and
those of at least ``SHORTEST`` that are no plain word, as they hold a digit, one of ``+/_=`` or a capital
behind a small letter. The network sees the characters of the candidate (its two ends where it is long)
and ``CONTEXT`` bytes on both sides: embedding, convolution, maximum over positions, logistic output; all
in numpy. It learns from the distinct labelled findings of all texts: candidates that a rule has found,
synthetic secrets of common formats put into the same surroundings, so that it does not merely learn the
rules' words; against them all other candidates and synthetic identifiers, addresses, dates and paths,
``LEAST_MADE`` of each kind or one a text if that is more. Other candidates that look random are of no known label and are left out.

The findings lie in blocks of about ``BLOCK`` in the shared folder. In every round a task goes once through each of
its blocks, from the network of the last round, and the new network is the mean over all blocks. The threshold is the
largest that keeps ``RECALL`` of all held-back secrets, on a grid of log odds (``STEPS`` a unit) whose counts are
summed by Spark; what share of the other held-back candidates passes is kept as ``false_share``.

Spans of the rules always stay; the network adds kind ``net`` where no rule span overlaps. Spans are
in code points, end exclusive. Nulls and edges: a null text counts as empty; texts of any length are
scanned whole; without findings of the rules the synthetic ones train the network alone.
"""

import hashlib
import pickle
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from logweave.llm.textscan import NOT_BLANK, byte_class, find_words, slices, text_buffer
from logweave.session import materialize

# The rules' patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "net")

SHORTEST, LONG = 8, 16
CONTEXT, WIDTH = 24, 48
LEAST_MADE = 2000
RECALL, STEPS = 0.95, 256
BLOCK, ROUNDS, LEAST_ROUNDS = 16384, 12, 6  # one block is gone through ROUNDS times, many LEAST_ROUNDS times each
EMBED, FILTERS, SPAN = 12, 24, 5
LENGTH = 2 * CONTEXT + WIDTH + 2

_RUN = byte_class(lambda b: chr(b).isalnum() and b < 0x80 or chr(b) in "+/_=.-")
_DIGIT = byte_class(lambda b: 48 <= b <= 57)
_UPPER = byte_class(lambda b: 65 <= b <= 90)
_SMALL = byte_class(lambda b: 97 <= b <= 122)
_MARK = byte_class(lambda b: chr(b) in "+/_=")
_HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
# the same rules on bytes; all that they name is ASCII
_BYTES = {r: re.compile(r.pattern.encode(), r.flags & re.I) for r in (ASSIGN, ACCESS, HEX, _HINT)}
# 0 pads; letters of either case, digits and marks each have a code, all other bytes share classes
_CODES = np.zeros(256, np.int64)
for _i, _c in enumerate(string.ascii_letters + string.digits + "+/_=.-:\"' @\n(){}<>,;$%&#*"):
    _CODES[ord(_c)] = _i + 1
_CODES[_CODES == 0] = _CODES.max() + 1
_CODES[128:] = _CODES.max() + 1
VOCABULARY = int(_CODES.max()) + 1
_CODES = _CODES.astype(np.uint8)


def rule_spans(text):
    """``(start, end, kind)`` of the rules, leftmost and without overlap within a kind."""
    found = []
    if _HINT.search(text):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found


def candidates(buf, offsets):
    """Rows, byte starts and byte ends of all candidates of a batch."""
    runs = find_words(buf, offsets, _RUN)
    size = runs.ends - runs.starts
    sums = lambda marks: np.concatenate([[0], np.cumsum(marks)])
    odd = sums(_DIGIT[buf] | _MARK[buf])
    turns = sums(_SMALL[buf[:-1]] & _UPPER[buf[1:]] if len(buf) else np.zeros(0, bool))  # places where a capital follows
    last = np.maximum(runs.ends - 1, runs.starts)
    named = (odd[runs.ends] > odd[runs.starts]) | (turns[last] > turns[runs.starts])
    kept = (size >= LONG) | (size >= SHORTEST) & named
    return runs.rows[kept], runs.starts[kept], runs.ends[kept]


def encode(buf, lo, hi, start, end):
    """Codes of candidates at ``[start, end)`` of texts at ``[lo, hi)``, all arrays: left context, the
    candidate, right context; a long candidate shows its two ends."""
    lo, hi, start, end = (np.asarray(x, np.int64)[:, None] for x in (lo, hi, start, end))
    side, own = np.arange(CONTEXT), np.arange(WIDTH)
    left, right, inner = start - CONTEXT + side, end + side, start + own
    inner = np.where((end - start > WIDTH) & (own >= WIDTH // 2), end - WIDTH + own, inner)
    codes = np.zeros((len(start), LENGTH), np.uint8)
    for first, at, there in ((0, left, left >= lo), (CONTEXT + 1, inner, inner < end), (CONTEXT + WIDTH + 2, right, right < hi)):
        codes[:, first:first + at.shape[1]] = np.where(there, _CODES[buf[np.clip(at, 0, len(buf) - 1)]], 0)
    return codes


class CharNet:
    """Embedding, one convolution, maximum over positions in each of three zones, logistic output.

    Embedding and convolution are linear, so what a character adds to a filter at each place of its span
    is looked up in tables of all characters."""

    ZONES = ((0, CONTEXT), (CONTEXT, CONTEXT + WIDTH - 1), (CONTEXT + WIDTH - 1, LENGTH - SPAN + 1))
    NAMES = ("embed", "kernel", "bias", "out", "shift")

    def __init__(self, seed=7):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.3, (VOCABULARY, EMBED))
        self.kernel = r.normal(0, np.sqrt(2 / (SPAN * EMBED)), (SPAN * EMBED, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.out = r.normal(0, 0.1, 3 * FILTERS)
        self.shift = np.zeros(1)
        self.moments = [np.zeros(sum(getattr(self, n).size for n in self.NAMES)) for _ in range(2)]
        self.threshold = 0.5

    def _tables(self):
        return (self.embed @ self.kernel.reshape(SPAN, EMBED, FILTERS)).astype(np.float32)

    def _sums(self, codes, tables):
        """What every filter sums up at every position, without its bias."""
        n = LENGTH - SPAN + 1
        found = tables[0][codes[:, :n]]
        for s in range(1, SPAN):
            found += tables[s][codes[:, s:s + n]]
        return found

    def _odds(self, tops):
        pooled = np.maximum(tops.astype(np.float64) + self.bias, 0).reshape(len(tops), 3 * FILTERS)
        return pooled, np.clip(pooled @ self.out + self.shift, -30, 30)

    def log_odds(self, codes, block=64):
        if not len(codes):
            return np.zeros(0)
        tables, found = self._tables(), []
        for i in range(0, len(codes), block):
            sums = self._sums(codes[i:i + block], tables)
            found.append(self._odds(np.stack([sums[:, lo:hi].max(axis=1) for lo, hi in self.ZONES], axis=1))[1])
        return np.concatenate(found)

    def scores(self, codes):
        return 1 / (1 + np.exp(-self.log_odds(codes)))

    def _gradient(self, codes, labels, weight):
        sums = self._sums(codes, self._tables())
        at = np.stack([sums[:, lo:hi].argmax(axis=1) + lo for lo, hi in self.ZONES], axis=1)  # n, zones, FILTERS
        pooled, odds = self._odds(np.take_along_axis(sums, at.reshape(len(at), -1, FILTERS), 1))
        d = (1 / (1 + np.exp(-odds)) - labels) * weight / len(codes)
        back = d[:, None] * self.out * (pooled > 0)
        kernel = self.kernel.reshape(SPAN, EMBED, FILTERS)
        g_embed, g_kernel = np.zeros_like(self.embed), np.zeros_like(kernel)
        row, own = np.arange(len(codes))[:, None, None], np.arange(FILTERS)
        for s in range(SPAN):
            cell = codes[row, at + s].astype(np.int64) * FILTERS + own
            table = np.bincount(cell.ravel(), back.ravel(), VOCABULARY * FILTERS).reshape(VOCABULARY, FILTERS)
            g_kernel[s] = self.embed.T @ table
            g_embed += table @ kernel[s].T
        parts = [g_embed, g_kernel, back.reshape(-1, FILTERS).sum(axis=0), pooled.T @ d, d.sum(keepdims=True)]
        return np.concatenate([p.ravel() for p in parts])

    def state(self):
        """All that training changes, as one vector."""
        return np.concatenate([*(getattr(self, n).ravel() for n in self.NAMES), *self.moments])

    def restore(self, state):
        for n in self.NAMES:
            size = getattr(self, n).size
            setattr(self, n, state[:size].reshape(getattr(self, n).shape))
            state = state[size:]
        self.moments = np.split(state, 2)
        return self

    def learn(self, codes, labels, weight, turn, rate=0.004, block=64, seed=11):
        """Go once through a block of examples; ``turn`` counts the rounds from 0."""
        order = np.random.default_rng(seed + turn).permutation(len(codes))
        t = turn * -(-BLOCK // block)
        for i in range(0, len(order), block):
            pick = order[i:i + block]
            g = self._gradient(codes[pick], labels[pick], weight[pick])
            t += 1
            m = 0.9 * self.moments[0] + 0.1 * g
            v = 0.999 * self.moments[1] + 0.001 * g**2
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            now = self.state()
            now[:len(g)] -= step
            self.restore(np.concatenate([now[:len(g)], m, v]))
        return self


_LETTERS = string.ascii_letters + string.digits


def _of(r, chars, n):
    return "".join(r.choice(chars) for _ in range(n))


def _synthetic(r):
    """A secret of a common format: prefix and random characters, or random characters alone."""
    return r.choice([
        lambda: "ghp_" + _of(r, _LETTERS, 36), lambda: "xoxb-" + _of(r, string.digits, 12) + "-" + _of(r, _LETTERS, 24),
        lambda: "sk_live_" + _of(r, _LETTERS, 24), lambda: "AIza" + _of(r, _LETTERS + "_-", 35), lambda: "AKIA" + _of(r, string.ascii_uppercase + string.digits, 16),
        lambda: "eyJ" + _of(r, _LETTERS, 33) + "." + _of(r, _LETTERS + "_-", 60), lambda: _of(r, _LETTERS + "+/", 40), lambda: _of(r, _LETTERS, 32) + "=",
        lambda: _of(r, "0123456789abcdef", r.choice([24, 32, 40, 64])), lambda: _of(r, "0123456789ABCDEF", 32), lambda: _of(r, _LETTERS, r.randint(12, 24)),
        lambda: _of(r, string.ascii_letters, r.choice([32, 40])),
    ])()


def _harmless(r):
    """A run that looks like a secret and is none: identifiers, addresses, dates, versions, names and paths."""
    word = lambda: "".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
    hexa = "0123456789abcdef"
    return r.choice([
        lambda: "-".join(_of(r, hexa, n) for n in (8, 4, 4, 4, 12)), lambda: "-".join(_of(r, hexa, n) for n in (8, 4, 4, 4, 12)).upper(),
        lambda: "/" + "/".join(word() for _ in range(r.randint(2, 5))) + r.choice(["", ".html", ".png", f"/{r.randint(1, 99999)}"]),
        lambda: f"{r.choice(['www', 'docs', 'api'])}.{word()}.{r.choice(['com', 'org', 'net'])}/{word()}/{word()}_{r.randint(1, 9999)}",
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}" + r.choice(["", f"T{r.randint(0, 23):02d}"]),
        lambda: f"{word()}-{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 99)}" + r.choice(["", ".tar.gz", "-beta1"]),
        lambda: "_".join(word() for _ in range(r.randint(2, 5))), lambda: word() + word().capitalize() + word().capitalize(),
        lambda: "-".join(word() for _ in range(r.randint(3, 6))), lambda: _of(r, string.digits, r.randint(8, 19)),
        lambda: "-".join(_of(r, string.digits, n) for n in r.choice([(3, 3, 4), (4, 4, 4, 4)])), lambda: word() + word() + word() + word() + word(),
        lambda: f"{word()}{r.randint(10, 99999)}", lambda: "=" * r.randint(16, 60), lambda: "-" * r.randint(16, 60), lambda: "." * r.randint(16, 60),
    ])()


def _random_looking(run):
    """Whether a run mixes letters of both cases with digits, or hexadecimal digits, at random."""
    if len(run) < 20:
        return False
    shares = np.unique(np.frombuffer(run, np.uint8), return_counts=True)[1] / len(run)
    both = any(48 <= c <= 57 for c in run) and any(97 <= c <= 122 for c in run) and any(65 <= c <= 90 for c in run)
    return bool(-(shares * np.log2(shares)).sum() >= 3.3 and (both or re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", run) is not None))


def _ruled(buf, offsets, rows, starts, ends):
    """Which candidates meet a finding of the rules."""
    assign, access, hexa, hint = (_BYTES[r] for r in (ASSIGN, ACCESS, HEX, _HINT))
    spans = []
    for row in np.unique(rows):
        lo, raw = int(offsets[row]), buf[offsets[row]:offsets[row + 1]].tobytes()
        if hint.search(raw):
            spans += [(lo + m.start(), lo + m.end()) for m in assign.finditer(raw) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
        if b"AKIA" in raw:
            spans += [(lo + m.start(), lo + m.end()) for m in access.finditer(raw) if m.end() - m.start() >= LEAST_ACCESS]
    spans = np.array(sorted(spans), np.int64).reshape(-1, 2)
    reach = np.concatenate([[-1], np.maximum.accumulate(spans[:, 1])])  # the furthest end of the spans before
    met = reach[np.searchsorted(spans[:, 0], ends, "left")] > starts
    for i in np.flatnonzero(~met & (ends - starts >= 32)):
        met[i] = hexa.search(buf[starts[i]:ends[i]].tobytes()) is not None
    return met


def _made(raw, blanks, r):
    """A synthetic secret and a harmless run, each as a text of its own and its place there: at a blank of the text
    ``raw``, with as much of the text on both sides as the network sees."""
    for make in (_synthetic, _harmless):
        at = int(blanks[r.randrange(len(blanks))]) + 1
        lead = r.choice([b"", b"", b"", b'key = "', b"auth: ", b"export X=", b"'", b"bearer "])
        fake = make(r).encode()
        tail = b'"' if b'"' in lead else b"'" if b"'" in lead else b" "
        start = min(at, CONTEXT) + len(lead)
        yield raw[max(0, at - CONTEXT):at] + lead + fake + tail + raw[at:at + CONTEXT], start, start + len(fake), make is _synthetic


def labelled_findings(column, made=1, block=4096):
    """Codes, labels, synthetic and held-back flags of the candidates of an Arrow text column and of ``made`` synthetic
    pairs for each text that has a candidate, a block at a time. Equal texts give equal findings."""
    buf, offsets = text_buffer(column)
    rows, starts, ends = candidates(buf, offsets)
    if not len(rows):
        return
    blanks = np.flatnonzero(~NOT_BLANK[buf])
    held = np.zeros(len(offsets) - 1, bool)
    fakes = []

    def flush():
        size = np.cumsum([0] + [len(f[0]) for f in fakes])
        own = np.frombuffer(b"".join(f[0] for f in fakes), np.uint8)
        codes = encode(own, size[:-1], size[1:], size[:-1] + [f[1] for f in fakes], size[:-1] + [f[2] for f in fakes])
        return codes, np.array([f[3] for f in fakes]), np.ones(len(fakes), bool), np.array([f[4] for f in fakes])
    for row in np.unique(rows):
        raw = buf[offsets[row]:offsets[row + 1]].tobytes()
        digest = hashlib.md5(raw).digest()
        held[row] = digest[0] % 4 == 0
        mine = blanks[np.searchsorted(blanks, offsets[row]):np.searchsorted(blanks, offsets[row + 1])] - offsets[row]
        r = random.Random(digest)
        for _ in range(made if len(mine) else 0):
            fakes += [(*f, held[row]) for f in _made(raw, mine, r)]
            if len(fakes) >= block:
                yield flush()
                fakes = []
    if fakes:
        yield flush()
    ruled = _ruled(buf, offsets, rows, starts, ends)
    odd = np.zeros(len(rows), bool)
    for i in np.flatnonzero(~ruled & (ends - starts >= 20)):
        odd[i] = _random_looking(buf[starts[i]:ends[i]].tobytes())
    kept = np.flatnonzero(~odd)
    for i in range(0, len(kept), block):
        k = kept[i:i + block]
        codes = encode(buf, offsets[rows[k]], offsets[rows[k] + 1], starts[k], ends[k])
        yield codes, ruled[k], np.zeros(len(k), bool), held[rows[k]]


def _weights(labels, good, bad):
    """Both classes weigh the same over all ``good`` and ``bad`` examples."""
    return np.where(labels > 0, 0.5 / good, 0.5 / bad) * (good + bad)


def _bins(net, codes):
    return np.floor(net.log_odds(codes) * STEPS).astype(np.int64)


def _set_threshold(net, good, bad):
    """The threshold from counts of held-back log odds, ``{bin: count}`` of secrets and of others."""
    at = sorted(good)
    counts = np.cumsum([good[b] for b in at])
    least = at[int(np.searchsorted(counts, int((1 - RECALL) * (counts[-1] - 1)), "right"))]
    net.threshold = float(1 / (1 + np.exp(-least / STEPS)))
    net.recall, net.false_share = (sum(n for b, n in of.items() if b >= least) / sum(of.values()) for of in (good, bad))
    return net


def _undecided():
    net = CharNet()
    net.threshold = 2.0  # nothing to tell apart: the rules alone
    return net


def fit(texts):
    """A trained network with its threshold, from a short list of texts that is one block."""
    parts = list(labelled_findings(pa.array(texts, pa.string()), -(-LEAST_MADE // max(1, len(texts)))))
    if not parts:
        return _undecided()
    codes, labels, _, held = (np.concatenate(x) for x in zip(*parts))
    good, bad = labels[~held].sum(), (~labels[~held]).sum()
    if not good or not bad:
        return _undecided()
    net = CharNet()
    for turn in range(ROUNDS):
        net.learn(codes[~held], labels[~held], _weights(labels[~held], good, bad), turn)
    test = held if labels[held].any() and not labels[held].all() else ~held
    found = [np.unique(_bins(net, codes[test & (labels == flag)]), return_counts=True) for flag in (True, False)]
    return _set_threshold(net, *(dict(zip(b.tolist(), n.tolist())) for b, n in found))


def _examples(docs, made):
    """The distinct labelled findings of all texts: ``codes, label, made, held``, stored."""
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                for codes, *flags in labelled_findings(part.column("text"), made):
                    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LENGTH), len(codes), [None, pa.py_buffer(codes)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([raw, *(pa.array(f, pa.bool_()) for f in flags)], ["codes", "label", "made", "held"])
    return materialize(docs.select("text").mapInArrow(run, "codes binary, label boolean, made boolean, held boolean").distinct(), "findings")


def _blocks(examples, n):
    """The examples in ``n`` blocks, a row each; which block and place an example has depends on itself alone."""
    def pack(rows):
        rows = rows.sort_by([(c, "ascending") for c in ("codes", "label", "held")]).combine_chunks()
        flags = [np.asarray(rows[c]).astype(np.uint8).tobytes() for c in ("label", "held")]
        return pa.table({c: pa.array([x], pa.binary()) for c, x in zip(("codes", "label", "held"), (b"".join(rows["codes"].to_pylist()), *flags))})
    dealt = examples.select("codes", "label", "held", F.pmod(F.xxhash64("codes"), F.lit(n)).alias("block"))
    return materialize(dealt.groupBy("block").applyInArrow(pack, "codes binary, label binary, held binary"), "blocks")


def _opened(batches):
    """Codes, labels and held-back flags of every block."""
    for batch in batches:
        for codes, label, held in zip(*(batch.column(c) for c in ("codes", "label", "held"))):
            flat = [np.frombuffer(x.as_buffer(), np.uint8) for x in (codes, label, held)]
            yield flat[0].reshape(-1, LENGTH), flat[1] > 0, flat[2] > 0


def _round(blocks, net, turn, good, bad):
    """The mean of the networks that every block makes of ``net``, weighted by examples. Sums are exact decimals,
    so they do not depend on the order of the blocks."""
    def run(batches):
        for codes, labels, held in _opened(batches):
            mine = ~held
            if mine.any():
                made = CharNet().restore(state).learn(codes[mine], labels[mine], _weights(labels[mine], good, bad), turn)
                yield pa.RecordBatch.from_arrays([pa.array([made.state() * mine.sum()], pa.list_(pa.float64()))], ["state"])
    state = net.state()
    moved = blocks.mapInArrow(run, "state array<double>").select(F.posexplode("state").alias("i", "x"))
    sums = moved.groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,18)")).cast("double").alias("x")).collect()  # a row a weight
    return CharNet().restore(np.array([r["x"] for r in sorted(sums, key=lambda r: r["i"])]) / (good + bad))


def _calibrate(blocks, net, side):
    """Set the threshold by the held-back examples (``side``), or by the others where those hold one class only."""
    def run(batches):
        for codes, labels, held in _opened(batches):
            for flag in (True, False):
                bins, n = np.unique(_bins(net, codes[(held == side) & (labels == flag)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([flag] * len(bins), pa.bool_()), pa.array(bins, pa.int64()), pa.array(n, pa.int64())], ["label", "bin", "n"])
    counts = blocks.mapInArrow(run, "label boolean, bin long, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).collect()  # at most a row a grid point
    return _set_threshold(net, *({r["bin"]: r["n"] for r in counts if r["label"] == flag} for flag in (True, False)))


def train(docs):
    """A network learned from all texts, in rounds over blocks of their findings."""
    examples = _examples(docs, 1)
    pairs = examples.where("made AND label").count()
    if 0 < pairs < LEAST_MADE:
        examples = _examples(docs, -(-LEAST_MADE // pairs))
    counts = {(r["label"], r["held"]): r["n"] for r in examples.groupBy("label", "held").agg(F.count("*").alias("n")).collect()}
    good, bad = counts.get((True, False), 0), counts.get((False, False), 0)
    if not good or not bad:
        return _undecided()
    n = -(-sum(counts.values()) // BLOCK)
    blocks, net = _blocks(examples, n), CharNet()
    for turn in range(max(LEAST_ROUNDS, -(-ROUNDS // n))):
        net = _round(blocks, net, turn, good, bad)
    return _calibrate(blocks, net, counts.get((True, True), 0) > 0 and counts.get((False, True), 0) > 0)


_nets = {}


def _net(data):
    if data not in _nets:
        _nets.clear()
        _nets[data] = pickle.loads(data)
    return _nets[data]


def _points(buf, lo, at):
    """Code point of byte ``at`` in the text that starts at byte ``lo``."""
    return int(((buf[lo:at] & 0xC0) != 0x80).sum())


def _passing(net, buf, offsets, rows, starts, ends, block=4096):
    """Numbers of the candidates at or above the threshold; codes are made for a block at a time."""
    for first in range(0, len(rows), block):
        k = slice(first, first + block)
        codes = encode(buf, offsets[rows[k]], offsets[rows[k] + 1], starts[k], ends[k])
        yield from first + np.flatnonzero(net.scores(codes) >= net.threshold)


def scan_part(column, net):
    """Spans ``(start, end, kind)`` of every text of an Arrow column, sorted."""
    texts = [t or "" for t in column.to_pylist()]
    buf, offsets = text_buffer(column)
    found = [rule_spans(t) for t in texts]
    rows, starts, ends = candidates(buf, offsets)
    for row in np.unique(rows[(ends - starts) >= 32]):
        found[row] += [(m.start(), m.end(), 2) for m in HEX.finditer(texts[row])]
    if len(rows) and net.threshold <= 1:
        for i in _passing(net, buf, offsets, rows, starts, ends):
            row, lo = rows[i], offsets[rows[i]]
            a, b = _points(buf, lo, starts[i]), _points(buf, lo, ends[i])
            if not any(x < b and a < y for x, y, _ in found[row]):
                found[row].append((a, b, 3))
    return texts, [sorted(f, key=lambda s: (s[0], s[2])) for f in found]


def _text(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def findings(docs, net):
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_net`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))

    def run(batches):
        mine = _net(shared.value)
        for batch in batches:
            for part in slices(batch):
                _, found = scan_part(part.column("text"), mine)
                counts = [pa.array([sum(s[2] == k for s in f) for f in found], pa.int64()) for k in range(4)]
                base = [hashlib.sha256(_text([s for s in f if s[2] < 3]).encode()).hexdigest() for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *counts[:3], pa.array(base, pa.string()), pa.array(list(map(_text, found)), pa.string()), counts[3]],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_net"])
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_net long")


def redact(docs, net, mark="[SECRET]"):
    """``docs`` with every span replaced by ``mark``; other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))

    def run(batches):
        mine = _net(shared.value)
        for batch in batches:
            for part in slices(batch):
                texts, found = scan_part(part.column("text"), mine)
                whole = part.column("text").to_pylist()
                new = [t if t is None or not f else _cut(t, f, mark) for t, f in zip(whole, found)]
                at = part.schema.names.index("text")
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(new, part.schema.field(at).type), *part.columns[at + 1:]], part.schema.names)
    return docs.mapInArrow(run, docs.schema)


def _cut(text, spans, mark):
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
