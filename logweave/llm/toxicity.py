"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic and one on windows of ordinary texts.
Every window of a text is compressed with both; the difference of the two lengths says which
dictionary knows it better. How many windows pass each length threshold becomes a probability by a
logistic calibration on the same labelled rows.

A window is a word, written twice so that the frame is large enough to be compressed at all; a
word's lengths never depend on its neighbours, so each distinct word is compressed once per task.
Words over ``LONGEST`` letters are cut into several windows.

The classifier is fitted on at most ``max_rows`` labelled rows of each class, whose texts have at
most ``max_bytes`` bytes; every text is scored whole. Nulls and edges: rows without a label or with
a null id are not learned from, of several labels of one id the largest holds; a null text counts as
empty; a text without words gets the score of no windows. Without both classes the score is the
share of toxic labels.
"""

import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from logweave.llm.textscan import extended, slices

MAX_ROWS, MAX_BYTES = 2000, 20_000
LONGEST = 32
LEVEL = 13
DICTIONARY_BYTES = 16_384
THRESHOLDS = np.arange(1, 8)
CACHED_WORDS = 400_000
_WORD = re.compile(r"[^\W\d_]{1,%d}" % LONGEST)


UNDECIDED = 0.49


def words(text):
    return _WORD.findall((text or "").lower())


def window(word):
    return f" {word} {word} ".encode()


def _stems(word):
    """Word beginnings of four letters or more, and the word itself."""
    return {word[:k] for k in (4, 5, 6, 7) if len(word) >= k} | {word + " "}


def _training_words(texts, toxic):
    """Words that mark toxic texts, and the commonest of the others; most frequent last."""
    seen = {0: Counter(), 1: Counter()}
    stems = {0: Counter(), 1: Counter()}
    for text, flag in zip(texts, toxic):
        found = set(words(text))
        seen[flag].update(found)
        stems[flag].update(set().union(*map(_stems, found)))
    n0, n1 = toxic.count(0), toxic.count(1)
    least = max(3, min(8, n1 // 20))
    marked = set()
    for stem, a in stems[1].items():
        b = stems[0][stem]
        odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
        if a >= least and odds > 1.2 and odds > 4 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)):
            marked.add(stem)
    bad = [w for w, a in seen[1].items() if a > 1 and not marked.isdisjoint(_stems(w)) and (a + 0.5) / n1 > 3 * (seen[0][w] + 0.5) / n0]
    bad.sort(key=lambda w: (seen[1][w], w))
    good = [w for w in seen[0] if len(w) > 3 and w not in bad]
    good.sort(key=lambda w: (seen[0][w], w))
    return bad, good[-max(50, len(bad)):]


def _dictionary(vocabulary):
    return b"".join(map(window, vocabulary))[-DICTIONARY_BYTES:]


class Scorer:
    """The dictionaries and the calibration; ``scores`` are probabilities."""

    def __init__(self, toxic, ordinary, weights=None, prior=0.0):
        self.toxic, self.ordinary, self.weights, self.prior = toxic, ordinary, weights, prior
        self.cache, self._pair = {}, None

    def __reduce__(self):
        return Scorer, (self.toxic, self.ordinary, self.weights, self.prior)

    def _difference(self, word):
        if self._pair is None:
            self._pair = []
            for content in (self.ordinary, self.toxic):
                made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(content), write_content_size=False)
                self._pair.append(zstandard.ZstdCompressor(dict_data=made, compression_params=how))
        if len(self.cache) >= CACHED_WORDS:
            self.cache.clear()
        text = window(word)
        got = self.cache[word] = len(self._pair[0].compress(text)) - len(self._pair[1].compress(text))
        return got

    def features(self, text):
        get, make = self.cache.get, self._difference
        found = words(text)
        gaps = [g if (g := get(w)) is not None else make(w) for w in found]
        n = max(1, len(found))
        passed = (np.array(gaps or [0])[:, None] >= THRESHOLDS).sum(axis=0)
        return np.concatenate([np.log1p(passed), passed / n, np.log((passed + 0.5) / (n + 5)), [np.log(n), 1.0]])

    def scores(self, texts):
        if self.weights is None:
            return np.full(len(texts), self.prior)
        x = np.array([self.features(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _logistic(x, y, ridge=1.0, rounds=30):
    """Weights of a ridge-penalised logistic regression on standardised columns, in raw units."""
    mean, scale = x[:, :-1].mean(axis=0), x[:, :-1].std(axis=0) + 1e-6
    z = np.c_[(x[:, :-1] - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        bend = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w -= np.linalg.solve(bend, z.T @ (p - y) + ridge * w)
    return np.r_[w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum()]


def fit(texts, toxic):
    """A scorer from texts and their 0/1 labels."""
    toxic = [int(t) for t in toxic]
    bad, good = _training_words(texts, toxic) if len(set(toxic)) == 2 else ([], [])
    if not bad or not good:  # nothing told the classes apart, so no text is marked
        return Scorer(b"", b"", None, min(UNDECIDED, sum(toxic) / max(1, len(toxic))))
    scorer = Scorer(_dictionary(bad), _dictionary(good))
    scorer.weights = _logistic(np.array([scorer.features(t) for t in texts]), np.array(toxic, float))
    return scorer


def fold(doc_id):
    """``crc32`` of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_rows(docs, labels, max_rows=MAX_ROWS, max_bytes=MAX_BYTES):
    """``text, toxic`` of a bounded sample of labelled rows outside the held-out fold."""
    known = (labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(fold(F.col("doc_id")) != 0)
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [known.where(F.col("toxic") == flag).orderBy(*order).limit(max_rows) for flag in (0, 1)]
    picked = F.broadcast(some[0].unionByName(some[1]))  # 2 * max_rows rows of two columns
    fits = docs.select("doc_id", "text").where(F.octet_length("text") <= max_bytes)
    return fits.join(picked, "doc_id").select("text", "toxic").orderBy(F.xxhash64("text"), "text", "toxic").limit(4 * max_rows)


def train(docs, labels, max_rows=MAX_ROWS, max_bytes=MAX_BYTES):
    rows = training_rows(docs, labels, max_rows, max_bytes).collect()
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


_scorers = {}


def _scorer(data):
    """One scorer with its word cache for each Python worker."""
    if data not in _scorers:
        _scorers.clear()
        _scorers[data] = pickle.loads(data)
    return _scorers[data]


def with_score(docs, scorer, name="score"):
    """``docs`` with the score in column ``name``; all other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(scorer))
    plain = docs.drop(name)

    def run(batches):
        mine = _scorer(shared.value)
        for batch in batches:
            for part in slices(batch):
                got = mine.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], [*part.schema.names, name])
    return plain.mapInArrow(run, extended(plain.schema, name, "double"))


def classify(docs, labels, max_rows=MAX_ROWS, max_bytes=MAX_BYTES):
    """``doc_id, held_out, score, predicted`` of every document."""
    scorer = train(docs, labels, max_rows, max_bytes)
    scored = with_score(docs.select("doc_id", "text"), scorer)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
