"""Licence notices by an exact set-similarity join of text blocks with templates.

A block is a line or a paragraph (lines up to a blank one). A template matches a block that contains
at least ``CONTAINMENT`` of its distinct words, or all of them where it has fewer than ``WHOLE_BELOW``: one word of a short
notice may be the licence's name. Of matching templates with other labels that share ``CONTAINMENT`` of the smaller one's words
(rivals, such as CC BY and CC BY-NC) a block keeps the one it holds best, of equals the longest. Words have one global order, rarest first, by counts
over all documents. The join needs three filters and loses nothing:

* prefix: a block that holds ``need`` of a template's words holds one of the template's
  ``size - need + 1`` rarest, so only blocks with such a word are looked at;
* length: a block with fewer than ``need`` distinct words is out;
* position: after the first common word at position ``p`` of the template, at most ``size - p`` can
  be common; the block is out where that is below ``need``.

The templates are an argument of at most ``MOST_TEMPLATES`` entries, which bounds what every executor
holds. Fixed phrases are found as consecutive words of the whole text.

Words are runs of letters and digits (any character outside ASCII counts as a letter), A-Z lowered.
Nulls and edges: a null text is empty: no words, no labels, score 0.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from logweave.llm.textscan import byte_class, find_words, row_bounds, slices, text_buffer

CONTAINMENT = 0.8
WHOLE_BELOW = 8
MOST_TEMPLATES = 1000

# Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

TEMPLATES = {
    "mit": ["released under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
            "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "apache-2": ["licensed under the apache license version 2 0",
                 "you may not use this file except in compliance with the license you may obtain a copy of the license at"],
    "gpl-3": ["this work is licensed under the gnu general public license version 3",
              "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"],
    "lgpl": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"],
    "agpl-3": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}

_WORD = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A or b >= 0x80)


def _word_hashes(text):
    buf = np.frombuffer(text.encode(), np.uint8)
    return find_words(buf, np.array([0, len(buf)]), _WORD).hashes


class Templates:
    """Templates as sets of word hashes in the global order, with what each needs.

    ``whole_below``: templates of fewer words must be held whole. ``resolve``: rivals drop each other.
    """

    def __init__(self, templates, containment=CONTAINMENT, counts=None, whole_below=0, resolve=False):
        self.labels, self.sets = [], []
        for label, texts in templates.items():
            for text in texts:
                words = np.unique(_word_hashes(text))
                if len(words):
                    self.labels.append(label)
                    self.sets.append(words)
        if len(self.sets) > MOST_TEMPLATES:
            raise ValueError(f"{len(self.sets)} templates; at most {MOST_TEMPLATES} are held by every executor")
        self.needs = [len(s) if len(s) < whole_below else int(np.ceil(containment * len(s) - 1e-9)) for s in self.sets]
        self.rivals = self._rivals(containment) if resolve else {}
        self.vocabulary = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        known = counts or {}
        order = [known.get(int(w), 0) for w in self.vocabulary.view(np.int64)]
        rank = np.lexsort((self.vocabulary, order))
        self.rank = np.empty(len(rank), np.int64)
        self.rank[rank] = np.arange(len(rank))  # position in the global order, rarest first
        self.ordered = [np.sort(self._ranks(s)) for s in self.sets]
        self.prefixes = {}
        for t, (words, need) in enumerate(zip(self.ordered, self.needs)):
            for word in words[:len(words) - need + 1].tolist():
                self.prefixes.setdefault(word, []).append(t)
        self.in_prefix = np.zeros(len(self.vocabulary), bool)
        self.in_prefix[list(self.prefixes)] = True

    def _rivals(self, containment):
        """For each template those of other labels that share most words with it."""
        out = {}
        for a, (label, words) in enumerate(zip(self.labels, self.sets)):
            for b, (other, others) in enumerate(zip(self.labels, self.sets)):
                common = len(np.intersect1d(words, others, assume_unique=True)) if label != other else 0
                if common and common >= containment * min(len(words), len(others)) - 1e-9:
                    out.setdefault(a, []).append(b)
        return out

    def _ranks(self, words):
        return self.rank[np.searchsorted(self.vocabulary, words)]

    def known(self, hashes):
        """Ranks of words, -1 for those in no template."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, self.rank[at], -1)

    def match(self, ranks):
        """``(template, containment)`` of the templates that a block's distinct known ranks reach."""
        found = []
        block = np.unique(ranks)
        asked = set()
        for word in block[self.in_prefix[block]].tolist():
            for t in self.prefixes[word]:
                mine, need = self.ordered[t], self.needs[t]
                if t in asked or len(block) < need:
                    continue
                asked.add(t)
                if len(mine) - int(np.searchsorted(mine, word)) < need:
                    continue  # ``word`` is the first in common: what follows it cannot suffice
                common = int(np.isin(mine, block, assume_unique=True).sum())
                if common >= need:
                    found.append((t, common / len(mine)))
        if not self.rivals or len(found) < 2:
            return found
        worth = {t: (share, len(self.ordered[t])) for t, share in found}
        return [(t, share) for t, share in found if not any(worth.get(r, (0, 0)) > worth[t] for r in self.rivals.get(t, ()))]


def word_counts(docs, templates):
    """How often each template word occurs in all documents; one row per word at most is returned."""
    vocabulary = Templates(templates).vocabulary
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        mine = shared.value
        total = np.zeros(len(mine), np.int64)
        for batch in batches:
            for part in slices(batch):
                hashes = find_words(*text_buffer(part.column("text")), _WORD).hashes
                if len(mine) and len(hashes):
                    at = np.minimum(np.searchsorted(mine, hashes), len(mine) - 1)
                    total += np.bincount(at[mine[at] == hashes], minlength=len(mine))
        yield pa.RecordBatch.from_arrays([pa.array(mine.view(np.int64)), pa.array(total)], ["word", "n"])
    counts = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counts.collect()}


def _blocks(words, buf):
    """Start and end word of every line and of every paragraph of several lines."""
    n = len(words)
    lines = np.concatenate([[0], np.cumsum(buf == 10)])
    # a blank line is a line end that only blanks part from the one before
    solid = np.concatenate([[0], np.cumsum((buf != 10) & (buf != 13) & (buf != 32) & (buf != 9))])
    ends = np.flatnonzero(buf == 10)
    blank = np.zeros(len(buf) + 1, np.int64)
    if len(ends) > 1:
        double = ends[1:][solid[ends[1:]] == solid[ends[:-1] + 1]]
        blank[double + 1] = 1
    paragraphs = np.cumsum(blank)
    row = words.rows[1:] != words.rows[:-1]
    line_break = row | (lines[words.starts[1:]] != lines[words.starts[:-1]])
    para_break = row | (paragraphs[words.starts[1:]] != paragraphs[words.starts[:-1]])
    for breaks in (line_break, para_break):
        heads = np.r_[0, np.flatnonzero(breaks) + 1]
        yield heads, np.r_[heads[1:], n]


def scan_part(column, templates, phrases=PHRASES):
    """Per text: words, phrase places (start words, labels), template labels and best containment."""
    buf, offsets = text_buffer(column)
    words = find_words(buf, offsets, _WORD)
    count = len(offsets) - 1
    bounds = row_bounds(words.rows, count)
    places = [[] for _ in range(count)]
    for phrase, label in phrases.items():
        wanted = _word_hashes(phrase)
        hit = np.flatnonzero(words.hashes[:max(0, len(words) - len(wanted) + 1)] == wanted[0])
        hit = hit[words.rows[hit] == words.rows[hit + len(wanted) - 1]]
        for k in range(1, len(wanted)):
            hit = hit[words.hashes[hit + k] == wanted[k]]
        for at in hit:
            places[words.rows[at]].append((int(at - bounds[words.rows[at]]), label))
    matched = [{} for _ in range(count)]
    if len(words) and templates.sets:
        ranks = templates.known(words.hashes)
        starters = np.concatenate([[0], np.cumsum((ranks >= 0) & templates.in_prefix[ranks])])
        held = np.concatenate([[0], np.cumsum(ranks >= 0)])
        least = min(templates.needs, default=1)
        for heads, tails in _blocks(words, buf):
            maybe = (starters[tails] > starters[heads]) & (held[tails] - held[heads] >= least)
            for a, b in zip(heads[maybe], tails[maybe]):
                part = ranks[a:b]
                for t, share in templates.match(part[part >= 0]):
                    best = matched[words.rows[a]]
                    best[templates.labels[t]] = max(share, best.get(templates.labels[t], 0))
    return np.diff(bounds), places, matched


def scan(docs, templates=None, containment=CONTAINMENT):
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every document."""
    templates = TEMPLATES if templates is None else templates
    made = Templates(templates, containment, word_counts(docs, templates), WHOLE_BELOW, True)
    shared = docs.sparkSession.sparkContext.broadcast(made)

    def run(batches):
        mine = shared.value
        for batch in batches:
            for part in slices(batch):
                n, places, matched = scan_part(part.column("text"), mine)
                base = [sorted({label for _, label in p}) for p in places]
                both = [sorted(set(b) | set(m)) for b, m in zip(base, matched)]
                columns = [
                    pa.array(n), pa.array([len(p) for p in places], pa.int64()), pa.array([min(p)[0] if p else None for p in places], pa.int64()),
                    pa.array([max(p)[0] if p else None for p in places], pa.int64()), pa.array([",".join(b) for b in base], pa.string()),
                    pa.array([",".join(b) for b in both], pa.string()),
                    pa.array([1.0 if p else max(m.values(), default=0.0) for p, m in zip(places, matched)], pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns],
                                                 ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
