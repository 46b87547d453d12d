"""Checked queries: isolation forest, scores, message patterns."""

from pyspark.sql import functions as F

from logweave.functions.text import STOP_WORDS
from logweave.operators import analytics as A
from logweave.operators import anomaly as N
from logweave.operators import patterns as P
from logweave.operators import series as S
from logweave.operators import training as T
from logweave.operators.filters import filter_errors
from logweave.plans.alert_queries import _chain
from logweave.plans.base import logs, query, table, template_sql, with_logs
from logweave.session import materialize, spread


def features(spark, sf):
    return A.feature_matrix(logs(spark, sf))


def written_features(spark, sf):
    """For models: fitted on and scored, so aggregated once."""
    return materialize(features(spark, sf), "features")


# --- forest ------------------------------------------------------------------

@query("iforest_fit")
def iforest_fit(spark, sf):
    rows = features(spark, sf)
    return N.forest_info(spark, N.iforest_fit(rows))


@query("iforest_score")
def iforest_score(spark, sf):
    rows = written_features(spark, sf)
    return N.iforest_score(rows, N.iforest_fit(rows))


@query("iforest_laws", with_logs(
    "SELECT count(*) AS n, 0 AS wrong_labels, 0 AS out_of_range, true AS share_right, 100 AS trees, least(256, count(*))::BIGINT AS sample_rows "
    "FROM (SELECT DISTINCT date_trunc('hour', log_ts), service_name FROM logs)"))
def iforest_laws(spark, sf):
    """What holds for every forest: the label is the sign of the score, scores lie in (offset - 1, offset + 1), the
    share of -1 is the contamination up to ties and rounding, and each tree has drawn the rows it should."""
    rows = written_features(spark, sf)
    forest = N.iforest_fit(rows)
    score, label = F.col("if_score"), F.col("if_label")
    got = N.iforest_score(rows, forest).agg(
        F.count("*").alias("n"), F.count_if(label != F.when(score < 0, -1).otherwise(1)).cast("int").alias("wrong_labels"),
        F.count_if(F.abs(score) >= 1).cast("int").alias("out_of_range"), F.count_if(label == -1).alias("_out"))
    near = F.abs(F.col("_out") - forest.contamination * F.col("n")) <= 1 + 0.01 * F.col("n")
    return got.select("n", "wrong_labels", "out_of_range", near.alias("share_right"),
                      F.lit(len(forest.arrays)).alias("trees"), F.lit(forest.sample_rows).cast("long").alias("sample_rows"))


@query("score_laws", with_logs(
    "SELECT service_name, date_trunc('hour', log_ts)::TIMESTAMP AS \"window\", CASE WHEN 100.0 * count(*) FILTER (err) / count(*) > "
    "(SELECT avg(v) + 3 * stddev_pop(v) FROM (SELECT unnest([5.0, 8.0, 3.0, 6.0, 4.0]) AS v)) THEN 0.8 ELSE 0.1 END::DOUBLE AS statistical_spike, "
    "true AS score_in_range, true AS mean_right, true AS spike_is_anomaly FROM logs GROUP BY 1, 2"))
def score_laws(spark, sf):
    """Trained scores: the error-rate part against SQL, the forest's part by its range, their mean, and the flag."""
    rows = written_features(spark, sf)
    got = N.score_services(rows, N.iforest_fit(rows))
    part, spike = F.col("isolation_forest"), F.col("statistical_spike")
    return got.select("service_name", "window", "statistical_spike", part.between(0, 1).alias("score_in_range"),
                      (F.abs(F.col("combined_score") - (part + spike) / 2) <= 0.00051).alias("mean_right"),
                      ((spike < 0.5) | F.col("is_anomaly")).alias("spike_is_anomaly"))


@query("train_all_samples", with_logs(
    "SELECT 'isolation_forest' AS model, 'trained' AS status, (SELECT count(*) FROM (SELECT DISTINCT date_trunc('hour', log_ts), service_name FROM week)) AS samples "
    "UNION ALL SELECT 'pattern_detector', 'trained', (SELECT count(*) FROM week WHERE err OR level='WARN')",
    "week AS (SELECT logs.* FROM logs, nowt WHERE log_ts > now - INTERVAL 7 DAY)"))
def train_all_samples(spark, sf):
    return T.train_all(logs(spark, sf)).summary.select("model", "status", "samples")


_SCORED = [
    "f AS (SELECT service_name, date_trunc('hour', log_ts)::TIMESTAMP AS \"window\", count(*) AS n, 100.0 * count(*) FILTER (err) / count(*) AS rate FROM logs GROUP BY 1, 2)",
    "b AS (SELECT avg(v) + 3 * stddev_pop(v) AS lim FROM (SELECT unnest([5.0, 8.0, 3.0, 6.0, 4.0]) AS v))",
    "scored AS (SELECT service_name, \"window\", rate > lim AS is_anomaly, CASE WHEN rate > lim THEN 0.8 ELSE 0.1 END::DOUBLE AS combined_score FROM f, b)",
]


@query("score_services_untrained", with_logs(
    "SELECT service_name, \"window\", is_anomaly, combined_score FROM scored", *_SCORED))
def score_services_untrained(spark, sf):
    return N.score_services(features(spark, sf)).select("service_name", "window", "is_anomaly", "combined_score")


@query("score_services")
def score_services(spark, sf):
    rows = written_features(spark, sf)
    return N.score_services(rows, N.iforest_fit(rows)).select(
        "service_name", "window", "isolation_forest", "statistical_spike", "combined_score", "is_anomaly")


@query("realtime_features", with_logs(
    "SELECT date_trunc('minute', log_ts)::TIMESTAMP AS \"window\", service_name, count(*) AS log_count, count(*) FILTER (err) / count(*) * 100 AS error_rate, "
    "count(DISTINCT host) AS unique_hosts, sum(length(message))::BIGINT / count(*) AS avg_msg_length FROM logs GROUP BY 1, 2"))
def realtime_features(spark, sf):
    return A.feature_matrix(logs(spark, sf), "minute").select(
        "window", "service_name", "log_count", "error_rate", "unique_hosts", "avg_msg_length")


@query("record_anomalies", with_logs(
    "SELECT \"window\" AS detected_at, 'error_spike' AS anomaly_type, service_name, combined_score AS severity_score, "
    "printf('Anomaly detected on %s: combined score %.3f', service_name, combined_score) AS description "
    "FROM hot JOIN chain USING (service_name, sec)", *_SCORED,
    "hot AS (SELECT *, floor(epoch(\"window\"))::BIGINT AS sec FROM scored WHERE is_anomaly)",
    _chain("hot").replace("+ 300", "+ 7200"), recursive=True))
def record_anomalies(spark, sf):
    # hourly rows, so the cooldown is two hours here
    rows = N.record_anomalies(N.score_services(features(spark, sf)), cooldown_s=7200)
    return rows.select("detected_at", "anomaly_type", "service_name", "severity_score", "description")


@query("train_summary", with_logs(
    "SELECT 'isolation_forest' AS model, 'trained' AS status, (SELECT count(*) FROM (SELECT DISTINCT date_trunc('hour', log_ts), service_name FROM logs)) AS samples, NULL AS reason, NULL::BIGINT AS clusters "
    "UNION ALL SELECT 'pattern_detector', 'trained', (SELECT count(*) FROM logs WHERE err OR level='WARN'), NULL, NULL"))
def train_summary(spark, sf):
    rows = logs(spark, sf)
    return N.train_summary(A.feature_matrix(rows), filter_errors(rows, with_warnings=True))


@query("train_all")
def train_all(spark, sf):
    return T.train_all(logs(spark, sf)).summary


# --- patterns ----------------------------------------------------------------

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _pattern_ctes(source):
    """CTEs from messages ``(id, message)`` to unit vectors ``vec(id, n, term, w)``."""
    return [
        f"tmpl AS (SELECT {template_sql('message')} AS template, min(id) AS id, count(*) AS n, arg_min(message, id) AS sample FROM {source} GROUP BY 1)",
        f"words AS (SELECT id, n, list_filter(regexp_extract_all(template, '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOPS})) AS ws FROM tmpl)",
        "tc AS (SELECT id, n, term, count(*) AS tf FROM (SELECT id, n, unnest(ws) AS term FROM words UNION ALL "
        "SELECT id, n, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM words WHERE len(ws) > 1) GROUP BY 1, 2, 3)",
        "nd AS (SELECT sum(n)::BIGINT AS docs FROM tmpl)",
        "vocab AS (SELECT term, df, total, ln((docs + 1) / (df + 1)) + 1 AS idf FROM (SELECT term, sum(n)::BIGINT AS df, sum(n * tf)::BIGINT AS total FROM tc GROUP BY 1), nd "
        "WHERE df >= 2 AND df <= docs * 0.95::DOUBLE)",
        "raw_vec AS (SELECT id, n, term, tf * idf AS w FROM tc JOIN vocab USING (term))",
        "vec AS (SELECT id, n, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw_vec)",
    ]


_WARNINGS = "msgs AS (SELECT id, message FROM logs WHERE err OR level='WARN')"
_TEXTS = "WITH RECURSIVE msgs AS (SELECT doc_id AS id, text AS message FROM documents)"

_CLUSTERS = [
    "sims AS (SELECT a.id AS a, b.id AS b, any_value(b.n) AS nb, sum(a.w * b.w) AS s FROM vec a JOIN vec b ON a.term = b.term AND a.id <> b.id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.5 - 1e-9)",
    "ids AS (SELECT DISTINCT id, n FROM vec)",
    "core AS (SELECT id FROM ids LEFT JOIN (SELECT a AS id, sum(nb) AS near FROM sims GROUP BY 1) USING (id) WHERE n + coalesce(near, 0) >= 3)",
    "lab AS (SELECT id AS v, id AS label FROM core UNION SELECT s.b, lab.label FROM lab JOIN sims s ON s.a = lab.v JOIN core c ON c.id = s.b WHERE lab.label < s.b)",
    "core_label AS (SELECT v AS id, min(label) AS label FROM lab GROUP BY 1)",
    "border_label AS (SELECT s.a AS id, min(c.label) AS label FROM sims s JOIN core_label c ON c.id = s.b WHERE s.a NOT IN (SELECT id FROM core) GROUP BY 1)",
    "clustered AS (SELECT tmpl.id, tmpl.n, coalesce(c.label, b.label, -1) AS cluster_id FROM tmpl LEFT JOIN core_label c USING (id) LEFT JOIN border_label b USING (id))",
    "centers AS (SELECT cluster_id, term, sum(w * vec.n) / any_value(size) AS w FROM vec JOIN clustered USING (id) JOIN (SELECT cluster_id, sum(n) AS size FROM clustered GROUP BY 1) USING (cluster_id) WHERE cluster_id <> -1 GROUP BY 1, 2)",
    "unit AS (SELECT cluster_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY cluster_id)) AS c FROM centers)",
]


def _documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("message"))


def _warnings(spark, sf):
    return filter_errors(logs(spark, sf), with_warnings=True)


@query("templates", with_logs("SELECT template, id, n, sample FROM tmpl", _WARNINGS, *_pattern_ctes("msgs")[:1]))
def templates(spark, sf):
    return P.templates(_warnings(spark, sf)).select("template", "id", "n", "sample")


@query("tfidf_fit", with_logs("SELECT term, df, total, round(idf, 9) AS idf FROM vocab", _WARNINGS, *_pattern_ctes("msgs")))
def tfidf_fit(spark, sf):
    vocab = P.tfidf_fit(P.templates(_warnings(spark, sf))).vocabulary
    return vocab.select("term", "df", "total", F.round("idf", 9).alias("idf"))


@query("tfidf_fit_documents", _TEXTS + ",\n" + ",\n".join(_pattern_ctes("msgs")) + "\nSELECT term, df, total, round(idf, 9) AS idf FROM vocab")
def tfidf_fit_documents(spark, sf):
    # read twice, for the number of messages and for their terms
    tmpl = materialize(P.templates(_documents(spark, sf)).drop("sample"), "templates")
    vocab = P.tfidf_fit(spread(tmpl)).vocabulary
    return vocab.select("term", "df", "total", F.round("idf", 9).alias("idf"))


@query("tfidf_transform", with_logs("SELECT id, n, term, round(w, 9) AS w FROM vec", _WARNINGS, *_pattern_ctes("msgs")))
def tfidf_transform(spark, sf):
    tmpl = P.templates(_warnings(spark, sf))
    tfidf = P.tfidf_fit(tmpl)
    flat = P.vectorize(tmpl, tfidf).select("id", "n", F.inline("vec"))
    named = flat.join(tfidf.vocabulary.select("term", F.col("rank").alias("r")), "r")
    return named.select("id", "n", "term", F.round("w", 9).alias("w"))


@query("cluster_messages", with_logs("SELECT id, n, cluster_id FROM clustered", _WARNINGS, *_pattern_ctes("msgs"), *_CLUSTERS[:7], recursive=True))
def cluster_messages(spark, sf):
    return P.fit_patterns(_warnings(spark, sf)).clusters


@query("cluster_documents", _TEXTS + ",\n" + ",\n".join(_pattern_ctes("msgs") + _CLUSTERS[:7]) + "\nSELECT id, n, cluster_id FROM clustered")
def cluster_documents(spark, sf):
    return P.fit_patterns(_documents(spark, sf)).clusters


@query("cluster_centers", with_logs("SELECT cluster_id, term, round(w, 9) AS w FROM centers", _WARNINGS, *_pattern_ctes("msgs"), *_CLUSTERS, recursive=True))
def cluster_centers(spark, sf):
    model = P.fit_patterns(_warnings(spark, sf))
    named = model.centers.join(model.tfidf.vocabulary.select("term", F.col("rank").alias("r")), "r")
    return named.select("cluster_id", "term", F.round("w", 9).alias("w"))


@query("cluster_sizes", with_logs(
    "SELECT cluster_id, count, representative_message FROM (SELECT cluster_id, sum(n)::BIGINT AS count FROM clustered WHERE cluster_id <> -1 GROUP BY 1) JOIN "
    "(SELECT cluster_id, left(sample, 200) AS representative_message FROM (SELECT cluster_id, arg_max(id, {'s': s, 'i': -id}) AS id FROM "
    "(SELECT cluster_id, vec.id, round(sum(w * c), 9) AS s FROM vec JOIN clustered USING (id) JOIN unit USING (cluster_id, term) GROUP BY 1, 2) GROUP BY 1) JOIN tmpl USING (id)) USING (cluster_id)",
    _WARNINGS, *_pattern_ctes("msgs"), *_CLUSTERS, recursive=True))
def cluster_sizes(spark, sf):
    model = P.fit_patterns(_warnings(spark, sf))
    return P.cluster_sizes(model.clusters, model.representatives)


_NOVEL = [
    f"tm AS (SELECT id, service_name, log_ts, {template_sql('message')} AS template FROM logs)",
    "nw AS (SELECT template, list_filter(regexp_extract_all(template, '[\\p{L}\\p{N}_]{2,}'), lambda x: x NOT IN (" + _STOPS + ")) AS ws FROM (SELECT DISTINCT template FROM tm))",
    "nt AS (SELECT template, term, count(*) AS tf FROM (SELECT template, unnest(ws) AS term FROM nw UNION ALL "
    "SELECT template, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM nw WHERE len(ws) > 1) GROUP BY 1, 2)",
    "nv AS (SELECT template, term, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS w FROM (SELECT template, term, tf * idf AS w FROM nt JOIN vocab USING (term)))",
    "best AS (SELECT template, max(s) AS s FROM (SELECT template, cluster_id, sum(w * c) AS s FROM nv JOIN unit USING (term) GROUP BY 1, 2) GROUP BY 1)",
    "novel AS (SELECT tm.id, service_name, log_ts, coalesce(s, 0) AS s FROM tm LEFT JOIN best USING (template))",
]


def _novel(spark, sf):
    """Every message of the table against the patterns of its errors and warnings."""
    model = P.fit_patterns(_warnings(spark, sf))
    return P.novel_messages(logs(spark, sf), model.tfidf, model.centers)


@query("novel_messages", with_logs("SELECT id, round(s, 9)::DOUBLE AS similarity, round(s, 9) < 0.3 AS is_novel FROM novel",
                                   _WARNINGS, *_pattern_ctes("msgs"), *_CLUSTERS, *_NOVEL, recursive=True))
def novel_messages(spark, sf):
    return _novel(spark, sf).select("id", "similarity", "is_novel")


@query("pattern_anomaly", with_logs(
    "SELECT bucket, novel, total, coalesce(n = 10 AND 10 * sq > sv * sv AND (10 * novel - sv) * (10 * novel - sv) > 4 * (10 * sq - sv * sv), false) AS is_anomaly FROM "
    "(SELECT *, sum(novel) OVER w AS sv, sum(novel * novel) OVER w AS sq, count(*) OVER w AS n FROM "
    "(SELECT service_name, date_trunc('hour', log_ts)::TIMESTAMP AS bucket, count(*) FILTER (round(s, 9) < 0.3) AS novel, count(*) AS total FROM novel GROUP BY 1, 2) "
    "WINDOW w AS (PARTITION BY service_name ORDER BY bucket ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))",
    _WARNINGS, *_pattern_ctes("msgs"), *_CLUSTERS, *_NOVEL, recursive=True))
def pattern_anomaly(spark, sf):
    return P.pattern_anomaly(_novel(spark, sf)).drop("service_name")


@query("latency_anomaly", with_logs(
    "SELECT service_name, bucket, max_ms, coalesce(n > 0 AND CASE WHEN n = 1 THEN CASE WHEN m = 0 THEN max_ms > 0 ELSE max_ms > m * (1 + 0.1::DOUBLE * 1.5::DOUBLE) END WHEN sd = 0 THEN max_ms > m * 1.5::DOUBLE ELSE max_ms > m + 1.5::DOUBLE * sd END, false) AS is_anomaly FROM "
    "(SELECT *, avg(max_ms) OVER w AS m, stddev_pop(max_ms) OVER w AS sd, count(*) OVER w AS n FROM "
    "(SELECT service_name, date_trunc('hour', log_ts)::TIMESTAMP AS bucket, max(try_cast(regexp_extract(message, '(?:duration=|took )([0-9]+)ms', 1) AS DOUBLE)) AS max_ms FROM logs GROUP BY 1, 2) WHERE max_ms IS NOT NULL "
    "WINDOW w AS (PARTITION BY service_name ORDER BY bucket ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))"))
def latency_anomaly(spark, sf):
    return A.latency_anomaly(logs(spark, sf))
