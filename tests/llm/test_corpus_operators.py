"""Near copies, kNN search, archives, HTML, surrogates and the pipeline on small tables."""

import gzip
import io
import json
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest

from logweave.llm import html_layout, knn, minhash, surrogates, warc

DOCS = "doc_id long, text string"


# --- near copies ---

def _sets(text, k):
    words = (text or "").split()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def _components(docs, k):
    """Brute force: smallest id reachable over all links."""
    sets = {i: _sets(t.lower() if t else t, k) for i, t in docs}
    label = {i: i for i in sets}
    ids = sorted(sets)

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= 80 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def _noisy_copies(seed=3, groups=6, size=25):
    """Groups of copies with a few or many words changed: similarities from 0.4 to 1."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([8, 40, 120]))
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("k", [4, 5])
def test_components_agree_with_brute_force(spark, k):
    docs = _noisy_copies() + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One two"), (1004, "one TWO"), (1005, "one")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(docs, DOCS), k).collect()}
    assert got == _components(docs, k)


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    docs = _noisy_copies(7, 2, 40)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, DOCS), 4).collect()}
    assert got == {i: c for i, (_, c) in _components(docs, 4).items()}


def test_rows_without_id_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(5, "a b c d e", 1), (5, "a b c d e", 2), (None, "a b c d e", 3), (7, "a b c d e", 4)], DOCS + ", kept int")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(0, 0, True), (5, 5, True), (5, 5, True), (7, 5, False)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    import numpy as np
    common = [rng.getrandbits(64) for _ in range(120)]
    sides = [np.sort(np.array(common + [rng.getrandbits(64) for _ in range(40)], np.uint64)) for _ in range(2)]
    sig = minhash.superminhash(np.concatenate(sides), np.array([0, 160, 320]), 1024)
    assert abs((sig[0] == sig[1]).mean() - 120 / 200) < 0.06 and (sig < 2**63).all()


# --- kNN ---

def test_top_k_agrees_with_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * (5 if i % 7 else 0.1) for _ in range(4)]) for i in range(400)] + [(i, [0.5] * 4) for i in range(400, 700)]
    rows += [(1000, None), (1001, [float("nan")] * 4), (1002, [1.0, None, 2.0, 3.0]), (1003, [float("inf")] * 4), (-20, [1.0] * 4), (1020, [2.0, 2.0]),
             (1021, [1.0, -1.0]), (None, [1.0] * 4), (1040, []), (1060, [2.0**40, 1.0, 1.0, -2.0**40])]
    data = knn.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(tuple(r) for r in knn.top_k(data, data.where("id % 20 = 0"), 5, 8).collect())
    held, want = [(r.id, r.v) for r in data.collect()], []
    for q, v in held:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in held if i != q and len(x) == len(v))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert knn.top_k(data.limit(0), data.limit(0)).count() == 0


def test_bounds_leave_cells_out(spark):
    rows = [(20 * i, [float(10 * (i % 4)), float(i % 3)]) for i in range(200)]
    data = knn.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    centres = knn._pivots(data, 8)
    cells = [{"dim": 2, "cell": c, "radius": 0.0, "norm": 1e4, "near": [0.0] * 17} for c in range(len(centres[2]))]
    groups = [{"dim": 2, "cell": c, "radius": 0.0, "norm": 1e4} for c in range(len(centres[2]))]
    assert 0 < len(knn._needed(centres, cells, groups, 3)) < len(cells) * len(groups)


def test_one_id_on_many_rows(spark):
    rng = random.Random(12)
    rows = [(20, [100.0, 0.0])] * 60
    rows += [(i, [x + rng.random(), rng.random()]) for x, ids in ((60.0, range(101, 111)), (-60.0, range(201, 231))) for i in ids]
    data = knn.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    want = sorted((-6400 * r.v[0], r.id) for r in data.collect() if r.id != 20)[:12]
    got = sorted(knn.top_k(data, data.where("id = 20"), 12, 40).collect(), key=lambda r: r["rank"])
    assert [(-r.score, r.vec_id) for r in got] == want


def test_clustered_vectors_are_sent_to_few_groups(spark):
    rng = random.Random(13)
    heads = [[100.0 * (d == c) for d in range(8)] for c in range(8)]
    rows = [(i, [x + rng.random() for x in heads[i % 8]]) for i in range(800)]
    data = knn.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    held = {r.id: r.v for r in data.collect()}
    got = sorted(tuple(r) for r in knn.top_k(data, data.where("id % 20 = 0"), 5, 64).collect())
    want = []
    for q in [i for i in held if i % 20 == 0]:
        best = sorted((-sum(a * b for a, b in zip(held[q], v)), i) for i, v in held.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    # each group needs the cells around its own head, an eighth of all, and few others
    centres = knn._pivots(data, 64)
    cells = spark.createDataFrame(data.mapInArrow(knn._assign(centres), knn._CELLS).collect(), knn._CELLS).toPandas()
    spans = [{"dim": 8, "cell": c, "radius": g.e.max(), "norm": g.norm.max(), "near": sorted(g.e)[:6], "ids": g.sort_values("e").id.tolist()[:6]} for c, g in cells.groupby("cell")]
    asked = [{"dim": 8, "cell": c, "radius": g.e.max(), "norm": g.norm.max()} for c, g in cells[cells.id % 20 == 0].groupby("cell")]
    assert len(knn._needed(centres, spans, asked, 5)) < 0.5 * len(spans) * len(asked)


def test_rows_are_dealt_alike_when_a_task_runs_again(spark):
    data = knn.quantised(spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(500)], "vec_id long, embedding array<double>"))
    cells = spark.createDataFrame(data.mapInArrow(knn._assign(knn._pivots(data, 2)), knn._CELLS).collect(), knn._CELLS)
    one, two = (sorted((r.cell, r.block, bytes(r.ids)) for r in knn._pack(c, 50).selectExpr("cell", "block", "ids").collect()) for c in (cells, cells.orderBy("id")))
    one, two = ([(c, b, sorted(np.frombuffer(i, np.int64))) for c, b, i in blocks] for blocks in (one, two))
    assert one == two and cells.select("place").distinct().count() == 500


# --- archives ---

def test_archives_round_trip(spark):
    rows = [(5, "http://a/é", "x" * 200), (3, "http://b", "x" * 200), (7, None, "x" * 99), (8, "u\nv", "x" * 99), (9, "h", None), (10, "h", ""),
            (None, "n", "x" * 200), (3, "http://b", "x" * 200), (11, "q", "é\r\n\r\nContent-Length: 5\r\n\r\nzz" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest")
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {(5, 200, "revisit", 3), (3, 200, "response", None), (7, 99, "response", None), (8, 99, "response", None), (9, 0, "response", None),
                   (10, 0, "response", None), (None, 200, "revisit", 3), (11, 580, "response", None)}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_members_stand_alone_and_the_index_names_them(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "payload %d " % i * 50) for i in range(30)], "page_id long, url string, html string")
    whole, parts = f"file://{tmp_path}/whole", f"file://{tmp_path}/parts"
    archives = warc.write_archives(warc.record_kinds(pages), whole)
    index = warc.normalise(archives, whole, parts)
    assert index.count() == 30
    for row in index.collect():
        with open(f"{tmp_path}/parts/{row.archive}", "rb") as f:
            f.seek(row.offset)
            record = gzip.decompress(f.read(row.length))
        assert record.startswith(b"WARC/1.1\r\n") and warc.parse(record)[3] == "response"
    lines = [json.loads(x) for a in archives.collect() for x in open(f"{tmp_path}/parts/{a.archive}.idx")]
    assert sorted(map(str, lines)) == sorted(str(r.asDict()) for r in index.collect())
    name = archives.first().archive
    assert gzip.open(f"{tmp_path}/whole/{name}").read() == gzip.open(f"{tmp_path}/parts/{name}").read()


def test_a_torn_archive_is_an_error():
    data = gzip.compress(warc.record(1, "u", b"x" * 300, "d", "response", None)[:-20])
    with pytest.raises(ValueError):
        list(warc.records_of(pa.PythonFile(io.BytesIO(data), mode="r")))


# --- HTML ---

@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<", "<"), ("a &amp; b<br>c", "a & b\nc"), ("<p>One<p>Two <b>x</b>", "One\n\nTwo x"),
    ("<ul><li>a<li>b<ol start=3><li>n<li>m</ol><li>c</ul>", "- a\n- b\n  3. n\n  4. m\n- c"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple<td>1<tr><td>banana<td>22</table>", "Name    Qty\napple   1\nbanana  22"),
    ("<table><td>a<table><tr><td>x<td>y</table><td>b</table>", "a     b\n\nx  y"),
    ("<head><title>t</title><style>p{}</style><body><div hidden>no</div><i style='display: none'>no</i>yes<script>'</p>'</script> tail", "yes tail"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"), ("x<!-- c -->y<input type=hidden value=q><input value=v>", "xyv"), ("<div>" * 20000 + "deep", "deep"),
    ("<h1>T</h1>text<blockquote>q</blockquote>", "T\n\ntext\n\n  q"), ("<textarea>a<b></textarea>", "a<b>"),
])
def test_rendering(page, text):
    assert html_layout.render(page) == text


@pytest.mark.parametrize("page, text", [
    ("<table><a><tr><td>x", "x"), ("<table><center><tr><td>y", "y"), ("<table><tr>text</tr>", "text"), ("<table><tbody><div>text", "text"),
    ("<table><p>text", "text"), ("<table><form><td>x", "x"), ("a<table>b<tr>c<td>d</td>e</table>f", "abce\n\nd\n\nf"),
    ("<math><mi>x</mi><mo>=</mo><annotation>no</annotation></math> y", "x= y"),
    ("<svg><title>no</title><defs><text>no</text></defs><g><text>A <tspan>b</tspan></text><circle/><text>C</text></g></svg>end", "A b\nC\nend"),
    ("<svg><g><p>out", "out"), ("<select><option>one<option selected>two</select>", "two"), ("<select><option>one<option>two</select>", "one"),
    ("<select multiple><option>one<option>two</select>", "one two"),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"),
    ("<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>yes</table>", "  yes"),
    ("<style>.x{display:none} #a, p.y {visibility : hidden}</style><i class='q x'>no</i><b id=a>no</b><p class=y>no</p><b class=y>yes</b>", "yes"),
    ("<style>@media print{.x{display:none}} div .x{display:none}</style><i class=x>yes</i>", "yes"),
    ("<style>@media screen{.x{display:none}} .x{color:red}</style><i class=x>no</i><i class=x style='display:inline'>yes</i>", "yes"),
    ("<style>.x{display:none!important}</style><i class=x style='display:inline'>no</i><style media=print>i{display:none}</style><i>yes</i>", "yes"),
    ("<style>p{display:none}/*</style>", ""), ("<style>}}{{p{display:none</style><p>shown", "shown"),
    ("<input type=checkbox value=no><input type=password value=no>a<input type=submit value=Go>", "aGo"),
    ("<ol><li>a<li value=5>b<li>c</ol>", "1. a\n5. b\n6. c"),
    ("<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>", "ab    c\nd  e  f"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<table><tr><td colspan=9999999>a<td>b</table>", "a  b"),
    ("<table><tr><td>\u6f22\u5b57<td>b<tr><td>abcd<td>c</table>", "\u6f22\u5b57  b\nabcd  c"),
    ("<table><tr><td>a<td>b<table><table><td>c</table>d", "a  b\n\n   c\n\n   d"),
])
def test_rendering_of_visible_text(page, text):
    assert html_layout.render(page) == text


class _Texts(HTMLParser):
    """All text nodes outside of elements that never show, by a parser that knows no tree."""

    def __init__(self):
        super().__init__()
        self.words, self.hidden = Counter(), []

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            self.hidden += [tag] * (tag == self.hidden[0])
        elif tag in ("script", "style", "title", "noscript", "template", "iframe", "object", "audio", "video", "canvas"):
            self.hidden = [tag]

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[0]:
            self.hidden.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.words.update(re.findall(r"\w{3,}", data))


def test_no_visible_text_is_lost(spark, sf):
    """Every word of a text node is in the result, however tables are broken; hidden parts aside, nothing is added."""
    r = random.Random(3)
    tags = "table tr td th tbody thead caption div p a b ul li center form h2 pre blockquote span".split()
    made = ["".join(r.choice([f"<{t}>", f"</{t}>", f"<{t}> word{i}x{j} ", f" word{i}y{j} "]) for j in range(60) for t in [r.choice(tags)]) for i in range(300)]
    real = [p for (p,) in spark.read.parquet(f"{sf}/pages.parquet").select("html").where("html IS NOT NULL AND NOT contains(lower(html), 'hid') AND NOT contains(lower(html), 'none')").collect()]
    for page in made + real:
        twin = _Texts()
        twin.feed(page)
        twin.close()
        missing = twin.words - Counter(re.findall(r"\w{3,}", html_layout.render(page)))
        assert not missing, (page, missing)


def test_extraction_keeps_all_rows(spark):
    pages = spark.createDataFrame([(1, "<p>a", 0), (1, "<p>a", 0), (None, None, 0), (2, "<b>" * 100 + "x" * 100000, 0)], "page_id long, html string, text int")
    assert sorted(r.n_chars for r in html_layout.extract(pages).collect()) == [0, 1, 1, 100000]
    assert html_layout.extract(pages.limit(0)).count() == 0


# --- surrogates ---

KEY = b"a test"
LETTER = ("Mr. John Smith (john.smith@acme.co.uk, +1 (555) 010-2345) met Mrs Anna Jones. Later Mr. Smith paid with 4111-1111-1111-1111 "
          "from 10.0.0.255; IBAN DE89 3704 0044 0532 0130 00. Иван Петров. JOHN.SMITH@ACME.CO.UK")


def test_surrogates_keep_type_form_and_coreference():
    text, n = surrogates.rewrite(LETTER, {}, KEY)
    old, new = surrogates.entities(LETTER), surrogates.entities(text)
    assert n == 10 and [e[2] for e in old] == [e[2] for e in new] and not {(e[2], e[3]) for e in old} & {(e[2], e[3]) for e in new}
    last = [e[3] for e in new if e[2] == "person"]
    assert last[0] == last[2] != last[1] and len({e[3] for e in new if e[2] == "email"}) == 1
    card = next(e for e in new if e[2] == "card")
    assert surrogates.luhn(card[3]) and text[card[0] + 4] == "-"
    firsts = [text[e[0]:e[1]] for e in new if e[2] == "given"]
    assert [surrogates._GENDER_OF[f] for f in firsts] == ["m", "f", "m"] and surrogates._script(firsts[2]) == "cyrillic"
    assert text.count("JOHN") == 0 and surrogates.rewrite(text[:0], {}, KEY) == ("", 0) and surrogates.rewrite("plain 12 words", {}, KEY) == ("plain 12 words", 0)


def test_collisions_move_on_until_all_surrogates_differ(spark, monkeypatch):
    made = lambda rows: [str((int(c) * 7 + a) % 40 + 100) for c, a in rows]

    def table(key):
        def run(batches):
            for b in batches:
                rows = list(zip(b.column("canonical").to_pylist(), b.column("attempt").to_pylist()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made(rows), pa.string())], ["kind", "canonical", "attempt", "made"])
        return run
    monkeypatch.setattr(surrogates, "_made", table)
    names = [str(i) for i in range(95, 110)]
    late = {r.canonical: r.attempt for r in surrogates.resolve(spark.createDataFrame([("card", c) for c in names], "kind string, canonical string"), KEY).collect()}
    final = made([(c, late.get(c, 0)) for c in names])
    assert late and len(set(final)) == len(names) and not set(final) & set(names)


@pytest.mark.parametrize("most", [100, -1])
def test_texts_are_rewritten_either_way(spark, monkeypatch, most):
    monkeypatch.setattr(surrogates, "MOST_BROADCAST", most)
    docs = spark.createDataFrame([(1, LETTER, "x"), (1, LETTER, "x"), (None, None, "y"), (2, "", "z"), (3, "nothing here", "z")], DOCS + ", made string")
    rows = surrogates.pseudonymise(docs, KEY).collect()
    assert sorted((r.made, r.n_entities) for r in rows) == [("x", 10), ("x", 10), ("y", 0), ("z", 0), ("z", 0)]
    assert {r.text for r in rows if r.made == "x"} == {surrogates.rewrite(LETTER, {}, KEY)[0]} and any(r.text is None for r in rows)
    assert surrogates.pseudonymise(docs.limit(0), KEY).count() == 0


@pytest.mark.parametrize("most", [100_000, -1])
def test_given_names_stay_distinct_and_coreferent(spark, monkeypatch, most):
    monkeypatch.setattr(surrogates, "MOST_BROADCAST", most)
    women = [a + b for a in "Ana Bel Cor Dor Eli Fra Gil Han Ira Jan".split() for b in "da fa ka la ma na pa ra sa ta".split()]
    docs = [f"Mrs {w} Jones" for w in women] + [f"Mr. {w[:-1]}o Jones" for w in women]
    docs += ["Dr. Alex Smith met Mr. Alex Smith", "Mrs Anna Miller. Mrs Alice Miller.", "Mrs Anna Jones came. Jones said hello. Anna left. ANNA?"]
    rows = surrogates.pseudonymise(spark.createDataFrame([(i, t, 7, 8, 9) for i, t in enumerate(docs)], DOCS + ", n_entities int, _late int, _text_hash int"), KEY).orderBy("doc_id").collect()
    assert len({r.text.split()[1] for r in rows[:200]}) == 200 and {r.text.split()[2] for r in rows[:200]} == {rows[0].text.split()[2]}
    assert all((r.n_entities, r._late, r._text_hash) == (7, 8, 9) and r.n_entities_ > 0 for r in rows)
    smith = re.findall(r"(\w+) (\w+)(?: met|$)", rows[200].text)
    assert smith[0] == smith[1] and "Alex" not in rows[200].text
    _, anna, miller, _, alice, again = re.findall(r"\w+", rows[201].text)
    assert anna != alice and miller == again
    words = re.findall(r"\w+", rows[202].text)
    assert words[1] == anna == words[7] and words[2] == words[4] and words[9] == anna.upper() and not {"Anna", "Jones", "ANNA"} & set(words)


# --- pipeline ---

def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline as c
    assert [n for n, _ in c.STAGES] == ["toxicity", "minhash", "decontamination", "secrets", "sentencepiece"]
    spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my ni omicron"
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    calm = "the quiet river runs past the old stone house number%d every single morning"
    rows = [(i, "you idiot moron idiot scum moron word%d idiot" % i if i % 2 == 0 else calm % i, "en", "s", 0, 7) for i in range(40)]
    copied = "one long text that stays the same in both of its copies apart from the very last word of %s"
    rows += [(50, copied % "it", "en", "s", 0, 7), (51, copied % "it", "en", "s", 0, 7), (60, calm % 60 + " " + leak, "en", "s", 0, 7),
             (70, calm % 70 + ' token = "0123456789abcdef0123" and more of the quiet river', "en", "s", 0, 7), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    kept = {r.doc_id: r for r in docs.collect()}
    assert not any(i in kept for i in range(0, 40, 2)) and all(i in kept for i in range(1, 40, 2))
    assert 50 in kept and 51 not in kept and 60 not in kept and None in kept
    assert "0123456789abcdef" not in kept[70].text and kept[70].n_chars == len(kept[70].text)
    assert c.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_pipeline_of_an_empty_table(spark, sf):
    import corpus_pipeline as c
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in c.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
    assert docs.count() == 0


def test_near_copy_stage_decides_by_row(spark, sf):
    import corpus_pipeline as c
    one, two, three = ("%s stays a text of nine words in a row" % w for w in ("alpha", "beta", "gamma"))
    rows = [(5, one, 1), (5, one, 2), (5, one, 3), (5, two, 4), (None, three, 5), (None, three, 6), (None, None, 7), (None, None, 8), (9, two, 9), (3, "", 10), (3, "", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = c.drop_near_copies(spark, docs, sf)
    assert got.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert left == sorted([(5, one), (5, two), (None, three), (None, None), (None, None), (3, ""), (3, "")], key=str)


def test_toxicity_stage_keeps_all_where_nothing_marks_toxic_rows(spark, tmp_path):
    import corpus_pipeline as c
    docs = spark.createDataFrame([(i, "这个人真是白痴他什么都不懂" if i % 2 else "今天的天气很好我们去公园散步") for i in range(200)], DOCS)
    spark.createDataFrame([(i, int(i % 2 or i < 40)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = {r.doc_id for r in c.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert {i for i in range(0, 200, 2)} <= clean
    spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    assert c.drop_toxic(spark, docs, str(tmp_path)).count() == 200
