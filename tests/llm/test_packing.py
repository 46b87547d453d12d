"""Packing against a tokenizer run over whole texts, and its parts against plain searches."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logweave.llm import packing
from logweave.llm.queries import QUERIES

FILE = public_tokenizers.path("word_bpe_49k.json")
ODD = "tab\tnl\nvt\x0bff\x0cfs\x1cgs\x1dnel\x85nbsp\xa0em zero​ don't We'LL été ́x <|endoftext|>a<|startoftext|> 漢字かな １２ 3.14 ÀÉ İ Σας ﻿ 🙂👍🏽"


def _check(rows, docs, window=packing.WINDOW):
    """Every id of every document in exactly one piece, no gaps in sequences; the share of padding."""
    tokenizer = Tokenizer.from_file(FILE)
    want = defaultdict(list)
    for key, text in docs:
        want[key].append(np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    expected = {key: sum(len(i) for i in ids) for key, ids in want.items()}
    assert {key: sum(p[1] for p in own) for key, own in pieces.items()} == expected
    for key, ids in want.items():
        if len(ids) == 1:
            at = 0
            for start, length, crc, total in sorted(pieces[key]):
                assert (start, total) == (at, len(ids[0])) and length > 0
                assert zlib.crc32(ids[0][at:at + length].tobytes()) == crc
                at += length
        else:
            assert {p[2] for p in pieces[key]} <= {zlib.crc32(i[s:s + n].tobytes()) for i in ids for s, n, _, _ in pieces[key]}
    padding = used = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
        used += at
        padding += window - at if at & (at - 1) else 0
    return padding / max(1, used + padding)


def _crc(df):
    from pyspark.sql import functions as F
    return df.select(F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset").collect()


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert _check(QUERIES["op11_best_fit_packing"](spark, sf).collect(), docs) < 0.005


def test_edges_in_small_windows(spark):
    rng = random.Random(2)
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, ODD), (5, ODD * 50), (None, "no key"), (7, "same"), (7, "same"), (8, "unbroken" * 400)]
    docs += [(i, " ".join(rng.choices(["alpha", "x", "Überaus", "q9"], k=rng.choice([1, 3, 30, 33, 34, 300])))) for i in range(10, 400)]
    df = spark.createDataFrame([(*d, 0, "clash", b"clash") for d in docs], "doc_id long, text string, start int, key string, ids binary")
    assert _check(_crc(packing.pack(df, FILE, window=64, block=1000)), docs, 64) < 0.06  # SLACK of 64 is much
    assert packing.pack(df.limit(0), FILE).count() == 0


def test_words_of_later_slices(spark, monkeypatch):
    """Batches are read in slices; forgetting words between them changes nothing."""
    monkeypatch.setattr(packing, "MEMORY_WORDS", 1)
    docs = [(i, f"Æon {i} ÇA, VÀ! Größe; {i * i}. <|ENDOFTEXT|> x" if i % 7 else "ÀÉ, b'S <|endoftext|>") for i in range(3000)]
    encoder = packing.WordIds(Tokenizer.from_file(FILE))
    assert encoder.letters
    import pyarrow as pa
    batch = pa.record_batch([pa.array([t for _, t in docs])], ["text"])
    got = []
    for part in packing.slices(batch, limit=5000):
        flat, bounds = encoder.encode(part.column("text"))
        got += [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    tokenizer = Tokenizer.from_file(FILE)
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for _, t in docs]


def test_one_very_long_text(spark):
    text = "Long words and shörter ones, 12 at a time. " * 60_000
    docs = [(1, text)]
    assert _check(_crc(packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), FILE)), docs) == 0


@pytest.mark.parametrize("seed", range(5))
def test_search_tree_takes_the_tightest_window(seed):
    rng, window = random.Random(seed), 100
    lengths = [rng.randint(1, 99) for _ in range(300)]
    left, want = [], 0
    for need in sorted(lengths, reverse=True):  # brute force best fit
        fits = [c for c in left if c >= need]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - need)
        else:
            left.append(window - need)
            want += 1
    got = packing.best_fit(lengths, window)
    assert sorted(i for w in got for i in w) == list(range(300))
    assert len(got) == want and sorted(window - sum(lengths[i] for i in w) for w in got) == sorted(left)


@pytest.mark.parametrize("seed", range(5))
def test_filling_and_cutting_keep_every_id(seed):
    rng = random.Random(seed)
    windows = [[(i, 0, rng.randint(51, 90))] for i in range(60)]
    full = packing.fill_up(windows, 100, 0)
    assert all(sum(p[2] for p in w) == 100 for w in full[:-1])
    cuts = packing.power_cuts(full[-1])
    sizes = [sum(p[2] for p in w) for w in cuts]
    assert all(s & (s - 1) == 0 for s in sizes) and sorted(sizes, reverse=True) == sizes
    ids = sorted((i, start + k) for w in full[:-1] + cuts for i, start, n in w for k in range(n))
    assert ids == sorted((w[0][0], k) for w in windows for k in range(w[0][2]))
