"""Checked queries: full-text search, suggestions, exports."""

from pyspark.sql import functions as F

from logweave.functions.text import STOP_WORDS, stem, tokens
from logweave.operators import search as S
from logweave.plans.base import logs, query, table, with_logs
from logweave.session import balanced, checkpoint_dir

_TOKEN = r"[0-9]+(?:\.[0-9]+)+|[\p{L}\p{N}]+"
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def stem_sql(source):
    """CTEs ending in ``stems(term, stem)``: Porter's steps, one column per step, for the words of ``source``."""
    c, v = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"

    def m0(s): return f"regexp_matches({s}, '^({c})?{v}{c}')"
    def m1(s): return f"regexp_matches({s}, '^({c})?{v}{c}{v}{c}')"
    def meq1(s): return f"regexp_matches({s}, '^({c})?{v}{c}({v})?$')"
    def vowel(s): return f"regexp_matches({s}, '^({c})?[aeiouy]')"
    def cvc(s): return f"regexp_matches({s}, '^{c}[aeiouy][^aeiouwxy]$')"
    def cut(s, n): return f"left({s}, length({s}) - {n})"

    def table_step(old, rules):
        out = "CASE"
        for suffix, target in sorted(rules.items(), key=lambda kv: -len(kv[0])):
            base = cut(old, len(suffix))
            out += f" WHEN ends_with({old}, '{suffix}') AND length({old}) > {len(suffix)} THEN CASE WHEN {m0(base)} THEN {base} || '{target}' ELSE {old} END"
        return out + f" ELSE {old} END"

    step2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
             "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
             "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
    step3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
    step4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
    fixed = "fx"
    repair = (f"CASE WHEN regexp_matches({fixed}, '(at|bl|iz)$') THEN {fixed} || 'e' "
              f"WHEN regexp_matches({fixed}, '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$') THEN {cut(fixed, 1)} "
              f"WHEN {cvc(fixed)} THEN {fixed} || 'e' ELSE {fixed} END")
    four = "CASE"
    for suffix in sorted(step4 + ["sion", "tion"], key=lambda s: -len(s)):
        n = 3 if suffix in ("sion", "tion") else len(suffix)
        four += f" WHEN ends_with(w3, '{suffix}') AND length(w3) > {n} THEN CASE WHEN {m1(cut('w3', n))} THEN {cut('w3', n)} ELSE w3 END"
    four += " ELSE w3 END"
    return [
        f"p0 AS (SELECT DISTINCT term, CASE WHEN starts_with(term, 'y') THEN 'Y' || substr(term, 2) ELSE term END AS w FROM {source} WHERE regexp_matches(term, '^[a-z]{{3,}}$'))",
        f"p1 AS (SELECT term, CASE WHEN regexp_matches(w, '^.+(ss|i)es$') THEN {cut('w', 2)} WHEN regexp_matches(w, '^.+[^s]s$') THEN {cut('w', 1)} ELSE w END AS w FROM p0)",
        f"p2 AS (SELECT term, w, CASE WHEN ends_with(w, 'eed') THEN NULL WHEN ends_with(w, 'ed') AND {vowel(cut('w', 2))} THEN {cut('w', 2)} WHEN ends_with(w, 'ing') AND {vowel(cut('w', 3))} THEN {cut('w', 3)} END AS fx FROM p1)",
        f"p3 AS (SELECT term, CASE WHEN ends_with(w, 'eed') AND {m0(cut('w', 3))} THEN {cut('w', 1)} WHEN fx IS NULL THEN w ELSE {repair} END AS w FROM p2)",
        f"p4 AS (SELECT term, CASE WHEN ends_with(w, 'y') AND {vowel(cut('w', 1))} THEN {cut('w', 1)} || 'i' ELSE w END AS w FROM p3)",
        f"p5 AS (SELECT term, {table_step('w', step2)} AS w FROM p4)",
        f"p6 AS (SELECT term, {table_step('w', step3)} AS w3 FROM p5)",
        f"p7 AS (SELECT term, {four} AS w FROM p6)",
        f"p8 AS (SELECT term, CASE WHEN ends_with(w, 'e') AND ({m1(cut('w', 1))} OR ({meq1(cut('w', 1))} AND NOT {cvc(cut('w', 1))})) THEN {cut('w', 1)} ELSE w END AS w FROM p7)",
        f"p9 AS (SELECT term, CASE WHEN ends_with(w, 'll') AND {m1('w')} THEN {cut('w', 1)} ELSE w END AS w FROM p8)",
        f"stems AS (SELECT term, replace(w, 'Y', 'y') AS stem FROM p9 UNION ALL SELECT DISTINCT term, term FROM {source} WHERE NOT regexp_matches(term, '^[a-z]{{3,}}$'))",
    ]


def _tok(source, fields):
    parts = [f"SELECT id, '{name}' AS field, {w} AS tenths, unnest(regexp_extract_all(lower({name}), '{_TOKEN}')) AS term FROM {source}"
             for name, w in fields.items()]
    return f"tok AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE term NOT IN ({_STOPS}))"


def _hits(source, words, fields=None):
    """CTEs ending in ``hits(id, rank)`` for a query of the given words."""
    fields = fields or {"level": 10, "service_name": 10, "message": 4, "host": 2}
    asked = ", ".join(f"'{w}'" for w in words)
    return [
        _tok(source, fields),
        f"asked AS (SELECT unnest([{asked}]) AS term)",
        "vocab AS (SELECT term FROM tok UNION SELECT term FROM asked)",
        *stem_sql("vocab"),
        "want AS (SELECT DISTINCT stem FROM stems JOIN asked USING (term))",
        "hits AS (SELECT id, sum(tenths) / 10.0::DOUBLE AS rank FROM tok JOIN stems USING (term) JOIN want USING (stem) "
        "GROUP BY id HAVING count(DISTINCT stem) = (SELECT count(*) FROM want))",
    ]


_LOG = "id, log_ts AS \"timestamp\", level, service_name, message, trace_id, span_id, environment, host, metadata, error_fingerprint, ingested_at"
_NO_RANK = f"SELECT {_LOG}, 0.0::DOUBLE AS rank FROM logs"


@query("stem_documents", "WITH tok AS (SELECT unnest(regexp_extract_all(lower(text), '" + _TOKEN + "')) AS term FROM documents),\n"
       + ",\n".join(stem_sql("tok")) + "\nSELECT term, stem FROM stems")
def stem_documents(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(tokens("text")).alias("term")).distinct()
    return words.select("term", stem("term").alias("stem"))


@query("search", with_logs(
    f"SELECT {_LOG}, rank FROM logs JOIN hits USING (id) ORDER BY rank DESC, log_ts DESC, id DESC LIMIT 50",
    *_hits("logs", ["gateway", "timeouts", "requested"])))
def search(spark, sf):
    return S.search(logs(spark, sf), "gateway TIMEOUTS for requested")


@query("search_all_matches", with_logs(
    "SELECT id, rank FROM logs JOIN hits USING (id)", *_hits("logs", ["connections", "refused"])))
def search_all_matches(spark, sf):
    return S.matching(logs(spark, sf), "connections refused").select("id", "rank")


@query("search_filtered", with_logs(
    f"SELECT {_LOG}, rank FROM logs JOIN hits USING (id) WHERE level IN ('ERROR','FATAL') AND environment='production' "
    "AND log_ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' ORDER BY log_ts ASC NULLS LAST, id LIMIT 100 OFFSET 100",
    *_hits("logs", ["auth", "service", "error"])))
def search_filtered(spark, sf):
    # page 2, oldest first within equal rank: every hit ranks alike here, so time decides
    rows = S.matching(logs(spark, sf), "auth-service error", levels="error,fatal", environment="production",
                      start_time="2024-01-05", end_time="2024-01-25T00:00:00Z")
    columns = [c for c in rows.columns if c != "rank"] + ["rank"]
    return rows.select(columns).orderBy(*S.sort_order("timestamp", "asc")).offset(100).limit(100)


@query("search_page", with_logs(
    _NO_RANK + " WHERE service_name='user-service' ORDER BY host DESC NULLS FIRST, id DESC LIMIT 500 OFFSET 500"))
def search_page(spark, sf):
    return S.search(logs(spark, sf), service_name="user-service", sort_by="host", page=2, page_size=500)


@query("search_after_host", with_logs(
    _NO_RANK + " WHERE service_name='user-service' AND (host > 'node-02.internal' OR host IS NULL OR host = 'node-02.internal' AND id > 4000) "
    "ORDER BY host NULLS LAST, id LIMIT 400"))
def search_after_host(spark, sf):
    return S.search(logs(spark, sf), service_name="user-service", sort_by="host", sort_order_="asc", page_size=400, after=("node-02.internal", 4000))


@query("search_after", with_logs(
    _NO_RANK + " WHERE level='INFO' AND (log_ts, id) < ((SELECT log_ts FROM logs ORDER BY log_ts DESC, id DESC LIMIT 1 OFFSET 99), 1000000000000) "
    "AND log_ts < TIMESTAMP '2024-01-20' ORDER BY log_ts DESC, id DESC LIMIT 50"))
def search_after(spark, sf):
    return S.search(logs(spark, sf), level="info", after=("2024-01-20T00:00:00", -1))


@query("search_index", with_logs(
    "SELECT id, rank FROM logs JOIN hits USING (id)", *_hits("logs", ["gateway", "timeouts", "requested"])))
def search_index(spark, sf):
    rows = logs(spark, sf)
    index = S.build_search_index(balanced(rows), _scratch(spark, "index"))
    return S.matching(rows, "gateway timeouts for requested", index=index).select("id", "rank")


def _documents(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("message"), F.col("source").alias("service_name"),
                       F.lit("INFO").alias("level"), F.col("lang").alias("host"))


_DOCS = "WITH logs AS (SELECT doc_id AS id, text AS message, source AS service_name, 'INFO' AS level, lang AS host FROM documents)"


@query("search_documents", _DOCS + ",\n" + ",\n".join(_hits("logs", ["rest", "ening", "thing"]))
       + "\nSELECT id, rank FROM hits")
def search_documents(spark, sf):
    return S.matching(_documents(spark, sf), "rest the ening things").select("id", "rank")


@query("count_search", with_logs(
    "SELECT count(*) AS total, greatest(ceil(count(*) / 50.0), 1)::BIGINT AS total_pages FROM logs JOIN hits USING (id)",
    *_hits("logs", ["memory"])))
def count_search(spark, sf):
    # "OutOfMemoryError" is one word, so only the notification of heap space matches by its own words
    return S.count_search(logs(spark, sf), "memory")


@query("count_search_heap", with_logs(
    "SELECT count(*) AS total, greatest(ceil(count(*) / 50.0), 1)::BIGINT AS total_pages FROM logs JOIN hits USING (id)",
    *_hits("logs", ["heap", "spaces"])))
def count_search_heap(spark, sf):
    return S.count_search(logs(spark, sf), "spaces heap the")


@query("build_search_index", with_logs(
    "SELECT term, id, CASE field WHEN 'message' THEN 'B' WHEN 'host' THEN 'C' ELSE 'A' END AS weight, stem, count(*) AS n "
    "FROM tok JOIN stems USING (term) GROUP BY ALL",
    _tok("logs", {"level": 10, "service_name": 10, "message": 4, "host": 2}), *stem_sql("tok")))
def build_search_index(spark, sf):
    postings, words = S.build_search_index(balanced(logs(spark, sf)))
    # counted by word and row first: after the join, all rows of a very common word would be one task's. Sizes of
    # exploded rows are unknown to the planner, which might broadcast them; a merge join's skew is split
    counts = postings.groupBy("term", "id", "weight").agg(F.count("*").alias("n"))
    return counts.join(words.hint("merge"), "term").select("term", "id", "weight", "stem", "n")


@query("search_rarest_term", with_logs(
    "SELECT min(n)::BIGINT AS rarest FROM (SELECT stem, count(*) AS n FROM tok JOIN stems USING (term) WHERE stem IN ('timeout', 'servic') GROUP BY 1)",
    _tok("logs", {"level": 10, "service_name": 10, "message": 4, "host": 2}), *stem_sql("tok")))
def search_rarest_term(spark, sf):
    _, words = S.build_search_index(logs(spark, sf))
    return S.rarest_term(words, "service timeout")


@query("trigram_index", with_logs(
    "SELECT gram, count(*) AS rows FROM (SELECT DISTINCT id, unnest(list_transform(range(1, length(message) - 1), lambda i: substr(lower(message), i, 3))) AS gram FROM logs) GROUP BY 1"))
def trigram_index(spark, sf):
    return S.trigram_index(logs(spark, sf)).groupBy("gram").agg(F.count("*").alias("rows"))


@query("trigram_search", with_logs("SELECT id, message FROM logs WHERE contains(lower(message), 'refused by 10.0.1')"))
def trigram_search(spark, sf):
    rows = logs(spark, sf).select("id", "message")
    return S.trigram_search(rows, S.trigram_index(rows), "Refused by 10.0.1")


@query("latest_per_prefix", with_logs(
    "SELECT prefix, arg_max(left(message, 120), {'t': log_ts, 'i': id}) AS newest FROM (SELECT *, left(message, 20) AS prefix FROM logs) GROUP BY 1"))
def latest_per_prefix(spark, sf):
    return S.latest_per_prefix(logs(spark, sf), prefix=20)


@query("suggest", with_logs(
    "SELECT suggestion, type FROM ("
    "(SELECT DISTINCT service_name AS suggestion, 'service' AS type FROM logs WHERE contains(lower(service_name), 'a') ORDER BY 1 LIMIT 50) UNION ALL "
    "(SELECT suggestion, 'message' FROM (SELECT left(message, 80) AS s, arg_max(left(message, 120), {'t': log_ts, 'i': id}) AS suggestion FROM logs "
    "WHERE contains(lower(message), 'a') GROUP BY 1) ORDER BY s LIMIT 50) UNION ALL "
    "(SELECT DISTINCT host, 'host' FROM logs WHERE contains(lower(host), 'a') ORDER BY 1 LIMIT 50)) ORDER BY type, suggestion LIMIT 50"))
def suggest(spark, sf):
    return S.suggest(logs(spark, sf), "A", 50, 80, 120)


@query("suggest_documents",
       "SELECT suggestion, type FROM ((SELECT DISTINCT source AS suggestion, 'service' AS type FROM documents WHERE contains(lower(source), 'the') ORDER BY 1 LIMIT 20) UNION ALL "
       "(SELECT suggestion, 'message' FROM (SELECT left(text, 80) AS s, arg_max(left(text, 120), doc_id) AS suggestion FROM documents WHERE contains(lower(text), 'the') GROUP BY 1) ORDER BY s LIMIT 20)) "
       "ORDER BY type, suggestion LIMIT 20")
def suggest_documents(spark, sf):
    docs = _documents(spark, sf).withColumn("timestamp", F.col("id")).withColumn("host", F.lit(None).cast("string"))
    return S.suggest(docs, "the", 20, 80, 120)


@query("highlight", with_logs(
    "SELECT id, regexp_replace(message, '(refused|connection)', '<b>\\1</b>', 'g') AS message FROM logs WHERE message LIKE '%connection refused%'"))
def highlight(spark, sf):
    rows = S.matching(logs(spark, sf), "connect refused").select("id", "message")
    return S.highlight(rows, "connection refuse")


def _scratch(spark, name):
    import uuid
    return f"{checkpoint_dir(spark)}/logweave-export/{name}-{uuid.uuid4().hex}"


@query("export_csv", with_logs(
    "SELECT strftime(log_ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, level, service_name, message, host, trace_id, environment FROM logs "
    "WHERE level='ERROR' ORDER BY log_ts DESC, id DESC LIMIT 1000"))
def export_csv(spark, sf):
    path = _scratch(spark, "csv")
    S.export_csv(logs(spark, sf), path, 1000, level="error")
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(F.translate("timestamp", "T", " ").alias("ts"), "level", "service_name", "message", "host", "trace_id", "environment")


@query("export_json", with_logs(
    "SELECT log_ts AS \"timestamp\", level, service_name, message, host, trace_id, environment, CAST(json_extract(metadata, '$.k') AS BIGINT) AS k FROM logs "
    "WHERE service_name='order-service' "))
def export_json(spark, sf):
    path = _scratch(spark, "json")
    S.export_json(logs(spark, sf), path, service_name="order-service")
    back = spark.read.json(f"{path}/logs", schema="timestamp timestamp_ntz, level string, service_name string, message string, host string, trace_id string, environment string, metadata struct<k:bigint>")
    return back.select("timestamp", "level", "service_name", "message", "host", "trace_id", "environment", "metadata.k")
