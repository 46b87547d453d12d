"""Spelling variants: words one edit apart, found in a trie over letter-group counts.

1. Words are counted over all texts as plain expressions: partial counts per task, one row per word.
2. Letters fall into ``GROUPS`` groups; a word's vector counts its letters per group. Arranged by successive
   counts the vectors form a trie. One edit adds one letter (surplus 1), drops one (deficit 1) or does both,
   so the words near a word lie where the vectors differ by a surplus and a deficit of at most one each.
   Pairs are looked for from one side only: from the word whose first differing count is the smaller.
3. The top of the trie deals the words out. A node at depth ``STEP`` holds the words that share that many
   counts; nodes with more than ``NODE`` words are divided further down, and whole vectors with more
   words by halves of the word, one of which an edit leaves as it is. A word is sent to its own node and to
   the nodes that the budget reaches.
4. Each node is searched depth first: pairs of a query's and a stored prefix go down level by level with
   what is left of the budget, in batches from a stack, so that memory stays bounded.
5. Words of the leaves reached are verified: common beginning and common end must cover the shorter word,
   or all but one letter of two equally long ones.

A word's form is its near word of largest count, ties to the smaller word, if that is ``RATIO`` times as
frequent; the root follows forms to the last. Forms grow by that factor, so doubling ends after few rounds.

Nulls and edges: null and empty texts have no words; a null id counts as an empty one; equal rows count each;
an empty table gives no rows. Only the id and text columns are read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from logweave.session import materialize, spread

GROUPS, STEP = 16, 4
#: Code points fall into groups by their remainder; those of frequent Latin letters come first, as they divide words best.
ORDER = np.array([5, 14, 4, 15, 1, 9, 2, 3, 12, 8, 0, 6, 7, 10, 11, 13])
PLACE = np.argsort(ORDER)
NODE = 4_000
RATIO = 5
PAIRS, CELLS = 1 << 17, 1 << 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs, least_letters=6, least_count=5, key="doc_id", text="text"):
    """``word, n`` of all texts' runs of letters; one in 199 runs of a document loses a letter, by the
    checksum of id and run, which plants variants of known origin."""
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit("[A-Za-z\\u00C0-\\u00FF]{%d,}" % least_letters), F.lit(0))
    words = spread(docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text))).select("k", F.explode(runs).alias("run"))
    h = F.crc32(F.concat("k", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % 199 == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return words.select(word.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


# --- letter groups ---

def _codes(words):
    """Code points of a list of words, flat, and their bounds."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return flat, np.concatenate([np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])


def vectors(words):
    """Letter-group counts, one row per word."""
    flat, bounds = _codes(words)
    row = np.repeat(np.arange(len(words)), np.diff(bounds))
    return np.bincount(row * GROUPS + PLACE[flat % GROUPS], minlength=len(words) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def _with_vector(batches):
    for batch in batches:
        counts = vectors(batch.column("word").to_pylist())
        v = pa.ListArray.from_arrays(np.arange(0, counts.size + 1, GROUPS, dtype=np.int32), counts.ravel())
        yield pa.RecordBatch.from_arrays([*batch.columns, v], [*batch.schema.names, "v"])


# --- dealing words out to nodes ---

def _moves():
    """``(change, state before, state after)`` of ``STEP`` counts; state 1 has spent the surplus, 2 the deficit too."""
    unit = np.eye(STEP, dtype=int)
    stay = [(0 * unit[0], s, s) for s in range(3)]
    plus = [(u, 0, 1) for u in unit]
    minus = [(-u, 1, 2) for u in unit]
    both = [(unit[i] - unit[j], 0, 2) for i in range(STEP) for j in range(i + 1, STEP)]
    return [(change.tolist(), a, b) for change, a, b in stay + plus + minus + both]


def _node(v, depth):
    return F.xxhash64(F.lit(depth), F.slice(v, 1, depth))


def _halves(word, short):
    """Keys of a word's halves next to a word of at least ``short`` letters: an edit leaves one of them."""
    half = (short / 2).cast("int")
    return F.array(F.struct(F.lit(0).alias("side"), short.alias("short"), F.substring(word, F.lit(1), half).alias("half")),
                   F.struct(F.lit(1).alias("side"), short.alias("short"), F.substring(word, F.length(word) - short + half + 1, short).alias("half")))


def deal(words, node=NODE):
    """``node, word, n, home`` rows: every word at home in its node, and as a query in all nodes it reaches."""
    words = materialize(words.withColumn("size", F.length("word")), "vectors")
    moves = F.array(*[F.struct(F.array(*map(F.lit, c)).alias("change"), F.lit(a).alias("a"), F.lit(b).alias("b")) for c, a, b in _moves()])
    home, asked, out = words, words.select("*", F.col("v").alias("goal"), F.lit(0).alias("state")), []
    for depth in range(STEP, GROUPS + 1, STEP):
        home = home.withColumn("node", _node("v", depth))
        sizes = home.groupBy("node").agg(F.count("*").alias("held"))
        sizes = materialize(sizes, "spelling-nodes")
        reach = asked.select("*", F.explode(moves).alias("move")).where(F.col("state") == F.col("move.a"))
        level = lambda x: F.slice(x, depth - STEP + 1, STEP)
        changed = F.zip_with(level(F.col("goal")), F.col("move.change"), lambda a, b: a + b)
        goal = F.concat(F.slice("goal", 1, depth - STEP), changed, F.slice("goal", depth + 1, GROUPS))
        asked = (reach.where(F.forall(changed, lambda c: c >= 0)).select("word", "n", "size", "v", goal.alias("goal"), F.col("move.b").alias("state"))
                 .withColumn("node", _node("goal", depth)).join(sizes, "node"))
        home = home.join(sizes, "node")
        small = F.col("held") <= node
        away = asked.where("state > 0")  # with nothing spent a word is in its own node
        out += [home.where(small).select("node", "word", "n", F.lit(True).alias("home")), away.where(small).select("node", "word", "n", F.lit(False).alias("home"))]
        if not sizes.where(~small).limit(1).count():
            break
        home = home.where(~small).drop("node", "held")
        asked = materialize(asked.where(~small).drop("node", "held"), "spelling-queries")
    else:  # whole vectors with very many words
        size = F.col("size")
        stored = home.select("*", F.explode(F.array_union(_halves("word", size), _halves("word", size - 1))).alias("h"))
        query = asked.where("state > 0").select("*", F.explode(_halves("word", size)).alias("h"))
        key = lambda v: F.xxhash64(F.lit(GROUPS + 1), v, "h")
        out += [stored.select(key("v").alias("node"), "word", "n", F.lit(True).alias("home")),
                query.select(key("goal").alias("node"), "word", "n", F.lit(False).alias("home"))]
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    return every


# --- searching a node ---

class _Trie:
    """Nodes of all depths over sorted distinct vectors: counts, and each node's range of children."""

    def __init__(self, distinct):
        self.levels, start = [], np.zeros(1, np.int64)
        last = np.concatenate([np.ones((1, distinct.shape[1]), bool), distinct[1:] != distinct[:-1]])
        fresh = np.zeros(len(distinct), bool)
        fresh[:1] = True
        for depth in range(distinct.shape[1]):
            fresh = fresh | last[:, depth]
            here = np.flatnonzero(fresh)  # first row of each node
            self.levels.append((distinct[here, depth], np.searchsorted(here, np.append(start, len(distinct)))))
            start = here


def _spread_ranges(lo, hi):
    """Positions of all ranges ``lo[i]`` to ``hi[i]``, and the i of each."""
    size = hi - lo
    owner = np.repeat(np.arange(len(lo)), size)
    return owner, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[owner]


def leaf_pairs(asked, stored):
    """Batches of ``(row of asked, row of stored)`` of sorted distinct vectors within the budget."""
    left, right = _Trie(asked), _Trie(stored)
    depths = asked.shape[1]
    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int8))]
    while stack:
        depth, a, b, state = stack.pop()
        if depth == depths:
            yield a, b
            continue
        (ca, sa), (cb, sb) = left.levels[depth], right.levels[depth]
        owner, a2 = _spread_ranges(sa[a], sa[a + 1])
        inner, b2 = _spread_ranges(sb[b[owner]], sb[b[owner] + 1])
        a2, state2 = a2[inner], state[owner][inner]
        change = cb[b2] - ca[a2]
        # the surplus comes first, then the deficit
        good = (change == 0) | (change == 1) & (state2 == 0) | (change == -1) & (state2 == 1)
        a2, b2, state2 = a2[good], b2[good], (state2 + (change != 0))[good].astype(np.int8)
        for at in range(0, len(a2), PAIRS):
            stack.append((depth + 1, a2[at:at + PAIRS], b2[at:at + PAIRS], state2[at:at + PAIRS]))


def _one_edit(flat, bounds, a, b):
    """Whether words ``a[i]`` and ``b[i]`` are exactly one edit apart; pairs must differ in length by at most one."""
    la, lb = bounds[a + 1] - bounds[a], bounds[b + 1] - bounds[b]
    short = np.minimum(la, lb)
    out = np.zeros(len(a), bool)
    order = np.argsort(short, kind="stable")
    ranked, at = short[order], 0
    while at < len(order):  # as many pairs at a time as fit, by the longest of them
        cells = np.arange(1, len(order) - at + 1) * ranked[at:]
        part = order[at:at + max(1, int(np.searchsorted(cells, CELLS, "right")))]
        at += len(part)
        step = np.arange(ranked[at - 1])
        inside = step < short[part][:, None]
        first = lambda x: np.minimum(bounds[x[part]][:, None] + step, len(flat) - 1)
        final = lambda x: np.maximum(bounds[x[part] + 1][:, None] - 1 - step, 0)
        covered = _run((flat[first(a)] == flat[first(b)]) & inside) + _run((flat[final(a)] == flat[final(b)]) & inside)
        out[part] = np.where(la[part] == lb[part], covered == short[part] - 1, covered >= short[part])
    return out


def _run(equal):
    """How many leading cells of each row are true."""
    return np.concatenate([equal, np.zeros((len(equal), 1), bool)], axis=1).argmin(axis=1)


def search(table):
    """Near pairs ``a, na, b, nb`` of one node's words."""
    words = table.column("word").to_pylist()
    n = table.column("n").to_numpy()
    home = np.flatnonzero(table.column("home").to_numpy(zero_copy_only=False))
    flat, bounds = _codes(words)
    v = vectors(words)
    distinct, group = np.unique(v, axis=0, return_inverse=True)
    group = group.reshape(-1)
    by_query, by_home = np.argsort(group, kind="stable"), home[np.argsort(group[home], kind="stable")]
    kept, own = np.unique(group[home], return_inverse=True)
    q_from = np.searchsorted(group[by_query], np.arange(len(distinct) + 1))
    h_from = np.searchsorted(np.sort(own.reshape(-1)), np.arange(len(kept) + 1))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for u, w in leaf_pairs(distinct, distinct[kept]) if len(home) else ():
        owner, x = _spread_ranges(q_from[u], q_from[u + 1])
        y_from, y_to = h_from[w][owner], h_from[w + 1][owner]
        for part in np.split(np.arange(len(x)), np.flatnonzero(np.diff(np.cumsum(y_to - y_from) // PAIRS)) + 1):
            inner, y = _spread_ranges(y_from[part], y_to[part])
            a, b = by_query[x[part][inner]], by_home[y]
            once = (group[a] != group[b]) | (a < b)  # words of one vector meet from both sides
            a, b = a[once], b[once]
            good = _one_edit(flat, bounds, a, b)
            left.append(a[good])
            right.append(b[good])
    a, b = np.concatenate(left), np.concatenate(right)
    take = pa.array(words, pa.string())
    return pa.table({"a": take.take(pa.array(a)), "na": n[a], "b": take.take(pa.array(b)), "nb": n[b]})


def near_words(words, node=NODE):
    """``word, n, near, near_n``: every near pair of ``words`` (``word, n``), from both sides."""
    dealt = deal(words.mapInArrow(_with_vector, "word string, n long, v array<int>"), node)
    pairs = dealt.groupBy("node").applyInArrow(search, "a string, na long, b string, nb long")
    pairs = pairs.distinct()  # both halves of a pair may meet
    side = lambda *names: F.struct(*[F.col(c).alias(as_) for c, as_ in zip(names, ("word", "n", "near", "near_n"))])
    return pairs.select(F.inline(F.array(side("a", "na", "b", "nb"), side("b", "nb", "a", "na"))))


def variants(words, ratio=RATIO, node=NODE):
    """``word, form, root, n, n_near, form_n`` of every word of ``words`` (``word, n``)."""
    words = words.select("word", "n")
    best = near_words(words, node).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.join(best, "word", "left")
    form = (-F.col("best.less") >= ratio * F.col("n"))
    out = materialize(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best.near")).alias("form"),
                                   F.when(form, -F.col("best.less")).alias("form_n")), "forms")
    roots = materialize(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:  # each round doubles the steps taken
        following = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialize(roots.join(following, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = further.drop("moved")
        if not further.where("moved").limit(1).count():
            break
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
