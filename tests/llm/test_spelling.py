"""Spelling variants against plain searches; the whole table is held against SQL in test_queries."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from logweave.llm import spelling

DOCS = "doc_id long, text string"


def _near(a, b):
    """Exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def _brute(words, ratio=5):
    near = {w: [x for x in words if _near(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * n else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else 0) for w, n in words.items())


def _rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def _words(seed, letters, sizes, count):
    rng = random.Random(seed)
    out = {}
    for _ in range(count):
        out["".join(rng.choices(letters, k=rng.choice(sizes)))] = int(5 * 6 ** rng.uniform(0, 5))
    return out


@pytest.mark.parametrize("node, letters, sizes", [(20_000, "abq", [5, 6]), (3, "ab", [6, 7, 8]), (3, "aqAé", [3, 4]), (40, "abcdefghijklmnop", [2, 3])])
def test_agrees_with_brute_force_at_every_depth(spark, monkeypatch, node, letters, sizes):
    monkeypatch.setattr(spelling, "PAIRS", 50)
    words = _words(len(letters) + node, letters, sizes, 150)
    df = spark.createDataFrame([(*x, "extra") for x in words.items()], "word string, n long, near string")
    assert _rows(spelling.variants(df, node=node)) == _brute(words)


def test_very_long_words_and_chains(spark):
    long = "ab" * 40_000
    words = {long: 5, long[:-1]: 30, long + "c": 5, "chain": 5, "chains": 25, "chainse": 125, "chainset": 625, "alone": 9}
    assert _rows(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == _brute(words)


def test_counts_words_as_described(spark):
    rng = random.Random(4)
    vocabulary = ["Letters", "letters", "ÉCLAIRS", "Straße", "six666six", "sevenths", "×÷strange", "short"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=40))) for i in range(300)] + [(None, "letters " * 7), (5, None), (6, ""), (7, "letters"), (7, "letters")]
    want = Counter()
    import re
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                want[run] += 1
    got = spelling.word_counts(spark.createDataFrame([(*d, "extra") for d in docs], DOCS + ", run string"))
    assert {r.word: r.n for r in got.collect()} == {w: n for w, n in want.items() if n >= 5}


def test_empty_tables(spark):
    assert spelling.variants(spelling.word_counts(spark.createDataFrame([], DOCS))).count() == 0
    one = spark.createDataFrame([("lonely", 7)], "word string, n long")
    assert _rows(spelling.variants(one)) == [("lonely", "", "lonely", 7, 0, 0)]


def test_trie_search_finds_all_vectors_in_the_budget():
    rng = np.random.default_rng(1)
    asked, stored = (np.unique(rng.integers(0, 3, (n, 6)), axis=0) for n in (200, 150))
    got = {(int(a), int(b)) for left, right in spelling.leaf_pairs(asked, stored) for a, b in zip(left, right)}
    want = set()
    for (i, u), (j, v) in itertools.product(enumerate(asked), enumerate(stored)):
        change = [x for x in (v - u).tolist() if x]
        if change in ([], [1], [1, -1]):
            want.add((i, j))
    assert got == want
