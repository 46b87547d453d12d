"""Near-duplicate documents by SuperMinHash.

1. A document is the set of its distinct word shingles. Documents with equal sets form a class that
   is known by its smallest doc_id; only classes go on.
2. SuperMinHash signatures. Each shingle draws a random permutation of the slots; its value in the
   slot it reaches in round j is j plus a fraction. Rounds run over all shingles of a batch at once,
   and a document leaves once all its slots are filled, as later rounds only bring larger values.
3. Banding. ``BANDS`` bands of ``ROWS`` slots: a pair at similarity 0.8 shares no band with
   probability (1 - 0.8**4)**36, below 1e-8.
4. Verification on the full sets. In each bucket every class is first paired with the smallest one.
   What those links leave apart is compared within blocks of bounded size; full sets are compared
   where components differ and signatures agree in ``AGREE`` slots. A linked pair falls below that
   with probability under 1e-9.
5. Components of the links, smallest doc_id as the name.

Nulls and edges: a null or blank text is the empty set, linked with nothing. Rows that share a
doc_id count as one document. A row with a null doc_id takes no part: component null, kept.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from logweave.llm.textscan import find_words, mix64, ngrams, row_bounds, slices, text_buffer
from logweave.operators.patterns import components
from logweave.session import materialize

SHINGLE = 4
BANDS, ROWS = 36, 4
SLOTS = BANDS * ROWS
AGREE = 84
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21


def shingle_sets(texts, offsets, k=SHINGLE):
    """Sorted distinct shingle hashes of each row: flat values and row bounds."""
    words = find_words(texts, offsets)
    n = len(offsets) - 1
    bounds = row_bounds(words.rows, n)
    counts = np.diff(bounds)
    grams = ngrams(words.hashes, k)
    inside = words.rows[:len(grams)] == words.rows[k - 1:k - 1 + len(grams)] if len(grams) else np.zeros(0, bool)
    values, rows = grams[inside], words.rows[:len(grams)][inside]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.array([mix64(ngrams(words.hashes[bounds[r]:bounds[r + 1]], int(counts[r])) + np.uint64(counts[r]))[0] for r in short])
        values, rows = np.concatenate([values, extra]), np.concatenate([rows, short])
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[fresh], rows[fresh]
    return values, row_bounds(rows, n)


def superminhash(values, bounds, slots=SLOTS):
    """Signatures, one row of ``slots`` 64-bit ranks per set; an empty set keeps the largest value."""
    n = len(bounds) - 1
    sig = np.full((n, slots), np.uint64(2**64 - 1))
    flat = sig.reshape(-1)
    row = np.repeat(np.arange(n), np.diff(bounds))
    seeds, drawn = mix64(values ^ np.uint64(0x5851F42D4C957F2D)), []
    for j in range(slots):
        if not len(row):
            break
        draw = mix64(seeds + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        at = (j + ((draw >> np.uint64(40)) * np.uint64(slots - j) >> np.uint64(24)).astype(np.int64)).astype(np.int16)
        drawn.append(at)
        slot = at.copy()
        for t in range(j - 1, -1, -1):  # what earlier swaps have put there
            slot[drawn[t] == slot] = t
        rank = (np.uint64(j) << np.uint64(48)) | mix64(draw) >> np.uint64(16)
        np.minimum.at(flat, row * slots + slot, rank)
        full = (sig < np.uint64((j + 1) << 48)).all(axis=1)
        stay = ~full[row]
        if not stay.all():
            row, seeds, drawn = row[stay], seeds[stay], [d[stay] for d in drawn]
    return sig


def _keys(sig):
    """A 64-bit key per band; the band's number is part of it."""
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    parts = sig.reshape(len(sig), BANDS, ROWS)
    for r in range(ROWS):
        acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return acc.view(np.int64)


def _sign(batches, shingle):
    for batch in batches:
        for part in slices(batch, limit=1 << 20):
            values, bounds = shingle_sets(*text_buffer(part.column("text")), shingle)
            sig = superminhash(values, bounds)
            keys = pa.ListArray.from_arrays(np.arange(0, (len(sig) + 1) * BANDS, BANDS, dtype=np.int32), _keys(sig).ravel())
            brief = [row.tobytes() for row in (mix64(sig) & np.uint64(0xFFFF)).astype(np.uint16)]
            marks = [hashlib.md5(values[a:b].tobytes()).digest() if b > a else None for a, b in zip(bounds, bounds[1:])]
            columns = [part.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(marks, pa.binary()), keys, pa.array(brief, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "mark", "keys", "sig"])


def _agree(batches):
    """Pairs whose signatures agree often enough."""
    for batch in batches:
        if batch.num_rows:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SLOTS) for c in ("sig_a", "sig_b"))
            near = pa.array((one == two).sum(axis=1) >= AGREE)
            yield batch.select(["a", "b"]).filter(near)


def _linked(batches, shingle):
    """Pairs whose full sets reach the threshold: 100 * intersection >= 80 * union."""
    for batch in batches:
        for half in slices(batch, "text_a"):
            for part in slices(half, "text_b"):
                left, lb = shingle_sets(*text_buffer(part.column("text_a")), shingle)
                right, rb = shingle_sets(*text_buffer(part.column("text_b")), shingle)
                keep = []
                for i in range(part.num_rows):
                    keep.append(_reaches(left[lb[i]:lb[i + 1]], right[rb[i]:rb[i + 1]]))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _open_pairs(table, shingle):
    """Links between different components within two blocks of a bucket.

    A pair counts in the first band it shares only, if its sizes and signatures allow a link, and
    only while its components are still apart; then its full sets decide.
    """
    table = table.combine_chunks()
    side, ids, comp, n = (table.column(c).to_numpy() for c in ("side", "doc_id", "comp", "n"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, SLOTS)
    keys = np.array(table.column("keys").to_pylist(), np.int64).reshape(-1, BANDS)
    band = int(np.flatnonzero(keys[0] == table.column("key")[0].as_py())[0])
    values, bounds = shingle_sets(*text_buffer(table.column("text")), shingle)
    root = {c: c for c in comp.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c
    same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    right, links = np.flatnonzero(side == 1) if not same else np.arange(len(ids)), []
    for x in np.flatnonzero(side == 0):
        y = right[right > x] if same else right
        y = y[(comp[y] != comp[x]) & (100 * np.minimum(n[y], n[x]) >= 80 * np.maximum(n[y], n[x]))]
        y = y[((sig[y] == sig[x]).sum(axis=1) >= AGREE) & ~(keys[y, :band] == keys[x, :band]).any(axis=1)]
        mine = values[bounds[x]:bounds[x + 1]]
        for z in y.tolist():
            a, b = find(comp[x]), find(comp[z])
            if a != b and _reaches(mine, values[bounds[z]:bounds[z + 1]]):
                root[max(a, b)] = min(a, b)
                links.append((int(ids[x]), int(ids[z])))
    return pa.table({"a": pa.array([p[0] for p in links], pa.int64()), "b": pa.array([p[1] for p in links], pa.int64())})


def _reaches(x, y):
    """Whether two sorted sets are linked: 100 * intersection >= 80 * union."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
    return len(x) > 0 and 100 * both >= 80 * (len(x) + len(y) - both)


def _brief(signed, pairs):
    """``pairs`` (a, b) that pass the size filter and whose signatures agree, written out."""
    side = lambda x: signed.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    near = (pairs.join(side("a"), "a").join(side("b"), "b").where("100 * least(n_a, n_b) >= 80 * greatest(n_a, n_b)")
            .select("a", "b", "sig_a", "sig_b").mapInArrow(_agree, "a long, b long"))
    return materialize(near.distinct(), "candidates")


def _verify(near, texts, shingle):
    """The pairs of ``near`` that are links, written out."""
    one = near.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(lambda b: _linked(b, shingle), "a long, b long"), "links")


def _open_links(shared, comps, known, texts, shingle):
    """Links that the leaders' pairs leave undecided: pairs of a bucket in different components.

    A bucket of two is settled by its leader's pair, one of a single component by its links. Large
    buckets are cut into blocks, and each pair of blocks is a group of bounded size.
    """
    named = (shared.join(comps.select(F.col("id").alias("doc_id"), "label"), "doc_id", "left")
             .select("key", "doc_id", F.coalesce("label", "doc_id").alias("comp")))
    undecided = materialize(named.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                            .where("size > 2 AND lo < hi").select("key"), "open")
    rows = materialize(named.join(undecided, "key").join(known.select("doc_id", "n", "sig", "keys"), "doc_id"), "open-rows")
    sizes = rows.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    spread = rows.join(materialize(sizes, "sizes"), "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # block b meets every block from itself on as the left side, every one before as the right
    places = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "doc_id", "comp", "n", "sig", "keys")
    groups = places.join(texts, "doc_id").groupBy("key", "i", "j")
    return materialize(groups.applyInArrow(lambda t: _open_pairs(t, shingle), "a long, b long"), "open-links")


def _ends(links):
    return links.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def near_duplicates(docs, shingle=SHINGLE):
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(docs.mapInArrow(lambda b: _sign(b, shingle), "doc_id long, n long, mark binary, keys array<long>, sig binary"), "signatures")
    known = signed.where("doc_id IS NOT NULL AND mark IS NOT NULL")
    copied = materialize(known.groupBy("mark").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("last"))
                         .where("b < last").select("mark", "b"), "classes")
    member = materialize(known.select("mark", F.col("doc_id").alias("a")).join(copied, "mark").where("a <> b").select("a", "b"), "members")
    copies = member.select(F.col("a").alias("doc_id"))

    buckets = known.select("doc_id", "keys").join(copies, "doc_id", "left_anti").select("doc_id", F.explode("keys").alias("key"))
    leads = materialize(buckets.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last"))
                        .where("lead < last").select("key", "lead"), "leads")
    shared = materialize(buckets.join(leads, "key"), "buckets")
    pairs = shared.where("doc_id <> lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    # the only pass of whole texts: those in a bucket with others
    texts = materialize(docs.join(shared.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), "texts")
    links = _verify(_brief(known, pairs), texts, shingle)
    more = _open_links(shared, components(_ends(links), links), known, texts, shingle)
    links = materialize(links.unionByName(more).unionByName(member), "links")
    labels = components(_ends(links), links).where("id <> label").select(F.col("id").alias("doc_id"), "label")

    return (signed.select("doc_id", "n").join(labels, "doc_id", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
