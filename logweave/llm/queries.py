"""The ``opN_<name>`` queries over the whole tables, and their SQL where SQL can say it."""

from pyspark.sql import functions as F

QUERIES = {}
SQL = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_superminhash", r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept
FROM n JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n""")
def _op9(spark, sf_dir):
    from logweave.llm.minhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_sentencepiece")
def _op10(spark, sf_dir):
    import public_tokenizers
    from logweave.llm.sentencepieces import digests
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_compression_toxicity")
def _op3(spark, sf_dir):
    from logweave.llm.toxicity import classify
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_template_decontamination")
def _op4(spark, sf_dir):
    from logweave.llm.templates import contaminated
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_secret_network")
def _op5(spark, sf_dir):
    from logweave.llm.secrets import findings, train
    docs = table(spark, sf_dir, "documents")
    return findings(docs, train(docs))


@query("op7_warc_members", """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d""")
def _op7(spark, sf_dir):
    from logweave.llm.warc import round_trip
    return round_trip(table(spark, sf_dir, "pages"))


def _license_sql():
    """The rules of op8: a template's share of words in the best line or paragraph, rivals resolved, by brute force."""
    from logweave.llm.licenses import CONTAINMENT, PHRASES, TEMPLATES, WHOLE_BELOW
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    rows = [f"('{label}', '{text}')" for label, texts in TEMPLATES.items() for text in texts]
    places = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS pos, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) WHERE w[i:i + {len(p.split()) - 1}] = {p.split()!r}"
        for p, label in PHRASES.items())
    return rf"""
WITH d AS (SELECT doc_id, {low} AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_extract_all(t, {word}), lambda x: x <> '') AS w FROM d),
p AS ({places}),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi FROM p GROUP BY doc_id),
blocks AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS b FROM d
  UNION ALL SELECT doc_id, unnest(regexp_split_to_array(t, '\n[ \t\r]*\n')) FROM d),
sets AS (SELECT DISTINCT doc_id, list_sort(list_distinct(regexp_extract_all(b, {word}))) AS s FROM blocks),
tpl AS (SELECT row_number() OVER () AS id, label, list_distinct(string_split(words, ' ')) AS s FROM (VALUES {", ".join(rows)}) v(label, words)),
rivals AS (SELECT a.id AS a, b.id AS b FROM tpl a, tpl b WHERE a.label <> b.label AND len(list_intersect(a.s, b.s)) >= {CONTAINMENT} * least(len(a.s), len(b.s)) - 1e-9),
met AS (SELECT doc_id, sets.s AS block, id, label, len(list_intersect(sets.s, tpl.s)) / len(tpl.s) AS share, len(tpl.s) AS size FROM sets, tpl
  WHERE len(list_intersect(sets.s, tpl.s)) >= CASE WHEN len(tpl.s) < {WHOLE_BELOW} THEN len(tpl.s) ELSE {CONTAINMENT} * len(tpl.s) - 1e-9 END),
hits AS (SELECT * FROM met ANTI JOIN (SELECT h.doc_id, h.block, h.id FROM met h JOIN rivals ON a = h.id JOIN met g ON g.id = b AND g.doc_id = h.doc_id AND g.block = h.block
  WHERE g.share > h.share OR (g.share = h.share AND g.size > h.size)) USING (doc_id, block, id)),
best AS (SELECT doc_id, max(share) AS share FROM hits GROUP BY doc_id),
names AS (SELECT doc_id, label, true AS b FROM p UNION SELECT doc_id, label, false FROM hits),
texts AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE b) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM names GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0) END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN texts USING (doc_id)"""


@query("op8_license_join", _license_sql())
def _op8(spark, sf_dir):
    from logweave.llm.licenses import scan
    return scan(table(spark, sf_dir, "documents"))


@query("op2_voronoi_knn", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20""")
def _op2(spark, sf_dir):
    from logweave.llm.knn import quantised, top_k
    data = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(data, data.where(F.col("id") % 20 == 0))


@query("op6_html_layout")
def _op6(spark, sf_dir):
    from logweave.llm.html_layout import extract
    return extract(table(spark, sf_dir, "pages"))


@query("op1_pii_surrogates")
def _op1(spark, sf_dir):
    from logweave.llm.surrogates import pseudonymise
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"), F.sha2("text", 256).alias("source_sha256"))
    key = spark.conf.get("spark.logweave.surrogateKey", "an example, not a secret").encode()
    return pseudonymise(docs, key).withColumn("changed", F.sha2("text", 256) != F.col("source_sha256")).drop("source_sha256")


def _cluster_sql(k=16, rounds=3, dim=64):
    """Lloyd's rounds spelled out: each assigns by brute force and floors the means."""
    nearest = """SELECT r, id, v, list_extract(list_sort(list(struct_pack(d := d, c := c))), 1) AS best FROM (
  SELECT k.r, k.id, k.v, m.c, CAST(list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM k, {m} m) GROUP BY r, id, v"""
    steps = [f"""kept AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
k AS (SELECT row_number() OVER () AS r, id, v FROM kept),
m0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || id) NULLS LAST, v) - 1 AS c, v FROM k QUALIFY c < {k})"""]
    for r in range(rounds):
        steps.append(f"a{r} AS ({nearest.format(m=f'm{r}')})")
        steps.append(f"""s{r} AS (SELECT c, list(mean ORDER BY i) AS v FROM (SELECT best.c AS c, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS mean
  FROM a{r}, range(1, {dim + 1}) g(i) GROUP BY best.c, i) GROUP BY c)""")
        steps.append(f"m{r + 1} AS (SELECT m{r}.c, coalesce(s{r}.v, m{r}.v) AS v FROM m{r} LEFT JOIN s{r} USING (c))")
    return f"""WITH {", ".join(steps)}, a AS ({nearest.format(m=f"m{rounds}")})
SELECT id AS vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a JOIN m{rounds} m ON m.c = best.c"""


@query("op13_subvector_clusters", _cluster_sql())
def _op13(spark, sf_dir):
    from logweave.llm.subvectors import cluster, report, whole_vectors
    return report(*cluster(whole_vectors(table(spark, sf_dir, "embeddings"))))


@query("op11_best_fit_packing")
def _op11(spark, sf_dir):
    import public_tokenizers
    from logweave.llm.packing import pack
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), " \
    "lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)"
_UTF8 = "flatten(list_transform(string_split(k || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]::BIGINT[] END))"


@query("op12_spelling_variants", rf"""
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
counted AS (SELECT k, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY k, run),
hashed AS (SELECT run, n, {_CRC.format(bytes=_UTF8)} AS h FROM counted),
words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
cuts AS (SELECT DISTINCT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near FROM cuts a JOIN words b ON a.d = b.word UNION SELECT b.word, a.word FROM cuts a JOIN words b ON a.d = b.word
  UNION SELECT a.word, b.word FROM cuts a JOIN cuts b ON a.d = b.d AND a.i = b.i AND a.word <> b.word),
best AS (SELECT p.word, count(*) AS n_near, list_extract(list(w.word ORDER BY w.n DESC, w.word), 1) AS near, max(w.n) AS near_n FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
steps(word, last) AS (SELECT word, word FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.last AS root, f.n, f.n_near, f.form_n FROM forms f JOIN steps s ON s.word = f.word JOIN forms l ON l.word = s.last WHERE l.form IS NULL""")
def _op12(spark, sf_dir):
    from logweave.llm.spelling import variants, word_counts
    from logweave.session import materialize
    return variants(materialize(word_counts(table(spark, sf_dir, "documents")), "words"))
