"""Checked queries: filters, aggregates, top-k."""

from pyspark.sql import functions as F

from logweave.operators import analytics as A
from logweave.operators import filters as X
from logweave.plans.base import logs, query, table, with_logs

_RATE = "round(100.0 * {e} / greatest({n}, 1), 2)::DOUBLE"
_ALL = "id, log_ts AS \"timestamp\", level, service_name, message, trace_id, span_id, environment, host, metadata, error_fingerprint, ingested_at"


# --- scans and filters -------------------------------------------------------

@query("scan_logs", with_logs(
    "SELECT id, log_ts AS \"timestamp\", level, message FROM logs "
    "WHERE log_ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 12:00:00'"))
def scan_logs(spark, sf):
    return X.filter_time(logs(spark, sf), "2024-01-05", "2024-01-12T12:00:00Z").select(
        "id", "timestamp", "level", "message")


@query("filter_eq", with_logs(
    f"SELECT {_ALL} FROM logs WHERE service_name='payment-service' AND level='ERROR' "
    "AND environment='production' AND host='node-02.internal'"))
def filter_eq(spark, sf):
    return X.filter_eq(logs(spark, sf), service_name="payment-service", level="ERROR",
                       environment="production", host="node-02.internal")


@query("filter_levels", with_logs("SELECT id, level FROM logs WHERE level IN ('ERROR','FATAL','WARN')"))
def filter_levels(spark, sf):
    return X.filter_levels(logs(spark, sf), "error, Fatal,WARN").select("id", "level")


@query("filter_time", with_logs(
    "SELECT id, log_ts AS \"timestamp\" FROM logs WHERE log_ts >= TIMESTAMP '2024-01-10 06:00:00' AND log_ts <= TIMESTAMP '2024-01-20'"))
def filter_time(spark, sf):
    return X.filter_time(logs(spark, sf), "2024-01-10T06:00:00Z", "2024-01-20").select("id", "timestamp")


@query("parse_time_range", with_logs(
    "SELECT id, log_ts AS \"timestamp\" FROM logs WHERE log_ts BETWEEN TIMESTAMP '2024-01-14 10:00:00' AND TIMESTAMP '2024-01-15 10:00:00'"))
def parse_time_range(spark, sf):
    from logweave.functions.times import parse_time_range as ranged
    start, end = ranged(end="2024-01-15T10:00:00Z")
    return X.filter_time(logs(spark, sf), start, end).select("id", "timestamp")


@query("filter_last", with_logs(
    "SELECT id, log_ts AS \"timestamp\" FROM logs, nowt WHERE log_ts > now - INTERVAL 7 DAY"))
def filter_last(spark, sf):
    return X.filter_last(logs(spark, sf), "7 DAYS").select("id", "timestamp")


@query("ui_window", with_logs(
    "SELECT id, log_ts AS \"timestamp\" FROM logs, nowt WHERE log_ts >= now - INTERVAL 6 HOUR AND log_ts <= now"))
def ui_window(spark, sf):
    return X.ui_window(logs(spark, sf), "6h").select("id", "timestamp")


@query("filter_metadata", with_logs(
    "SELECT id, metadata FROM logs WHERE CAST(json_extract(metadata, '$.k') AS INTEGER) = 42"))
def filter_metadata(spark, sf):
    return X.filter_metadata(logs(spark, sf), '{"k": 42}').select("id", "metadata")


def _rich(spark, sf):
    """Rows whose metadata nests the other columns, so every kind of containment has hits."""
    rows = logs(spark, sf)
    context = F.struct(F.col("environment").alias("env"), "host")
    return rows.withColumn("metadata", F.to_json(F.struct("level", context.alias("ctx"), F.array("service_name", "level").alias("tags"))))


@query("filter_metadata_pairs", with_logs(
    "SELECT id FROM logs WHERE level='WARN'"))
def filter_metadata_pairs(spark, sf):
    return X.filter_metadata(_rich(spark, sf), "level=WARN").select("id")


@query("filter_metadata_nested", with_logs(
    "SELECT id FROM logs WHERE environment='staging' AND level='FATAL' AND service_name='auth-service'"))
def filter_metadata_nested(spark, sf):
    wanted = {"ctx": {"env": "staging"}, "tags": ["FATAL", "auth-service"]}
    return X.filter_metadata(_rich(spark, sf), wanted).select("id")


@query("filter_ilike", with_logs(
    "SELECT id, message FROM logs WHERE contains(lower(service_name), 'node-02') OR contains(lower(message), 'node-02') "
    "OR coalesce(contains(lower(host), 'node-02'), false)"))
def filter_ilike(spark, sf):
    return X.filter_ilike(logs(spark, sf), "NODE-02").select("id", "message")


@query("filter_errors", with_logs("SELECT id, level FROM logs WHERE level IN ('WARN','ERROR','FATAL')"))
def filter_errors(spark, sf):
    return X.filter_errors(logs(spark, sf), with_warnings=True).select("id", "level")


@query("filter_not_null", with_logs(
    "SELECT id, host, error_fingerprint FROM logs WHERE host IS NOT NULL AND error_fingerprint IS NOT NULL"))
def filter_not_null(spark, sf):
    return X.filter_not_null(logs(spark, sf), "host", "error_fingerprint").select("id", "host", "error_fingerprint")


@query("match_regex", with_logs(
    "SELECT id, message FROM logs WHERE regexp_matches(message, '(?i)outofmemory|connection +refused')"))
def match_regex(spark, sf):
    return X.match_regex(logs(spark, sf), r"outofmemory|connection\s+refused").select("id", "message")


@query("match_regex_documents",
       "SELECT doc_id, length(text) AS chars FROM documents WHERE regexp_matches(text, '(?i)the[a-z]+ [a-z]+ing')")
def match_regex_documents(spark, sf):
    docs = table(spark, sf, "documents")
    return X.match_regex(docs, "the[a-z]+ [a-z]+ing", "text").select(
        "doc_id", F.length("text").cast("bigint").alias("chars"))


@query("trace_lookup", with_logs(
    f"SELECT {_ALL} FROM logs WHERE trace_id = (SELECT max(trace_id) FROM logs)"))
def trace_lookup(spark, sf):
    rows = logs(spark, sf)
    return X.trace_lookup(rows, rows.agg(F.max("trace_id")).scalar())


# --- aggregates --------------------------------------------------------------

@query("hourly_stats", with_logs(
    "SELECT date_trunc('hour', log_ts)::TIMESTAMP AS hour, service_name, level, count(*) AS log_count, "
    "count(*) FILTER (err) AS error_count, count(DISTINCT trace_id) AS unique_traces, "
    "count(DISTINCT error_fingerprint) AS unique_errors FROM logs GROUP BY 1, 2, 3"))
def hourly_stats(spark, sf):
    return A.hourly_stats(logs(spark, sf))


_HEALTH = (
    "SELECT service_name, count(*) AS total_logs_24h, count(*) FILTER (level='ERROR') AS errors_24h, "
    "count(*) FILTER (level='FATAL') AS fatals_24h, count(*) FILTER (level='WARN') AS warns_24h, "
    + _RATE.format(e="count(*) FILTER (err)", n="count(*)") + " AS error_rate_pct, "
    "min(log_ts) AS first_log, max(log_ts) AS last_log, count(DISTINCT error_fingerprint) AS unique_errors "
    "FROM day GROUP BY service_name")


@query("service_health", with_logs(
    "SELECT *, CASE WHEN error_rate_pct > 30 THEN 'down' WHEN error_rate_pct > 10 THEN 'degraded' ELSE 'active' END AS status FROM h",
    f"h AS ({_HEALTH})"))
def service_health(spark, sf):
    return A.service_health(logs(spark, sf))


@query("health_status", with_logs(
    "SELECT service_name, error_rate_pct, CASE WHEN total_logs_24h = 0 OR error_rate_pct >= 25 THEN 'down' "
    "WHEN error_rate_pct >= 5 THEN 'degraded' ELSE 'active' END AS status FROM h", f"h AS ({_HEALTH})"))
def health_status(spark, sf):
    rows = A.service_health(logs(spark, sf), total="total_logs_24h", degraded=5, down=25, inclusive=True)
    return rows.select("service_name", "error_rate_pct", "status")


@query("dashboard_totals", with_logs(
    "SELECT count(*) AS total_logs_24h, count(*) FILTER (err) AS total_errors_24h, "
    + _RATE.format(e="count(*) FILTER (err)", n="count(*)") + " AS error_rate_pct FROM day"))
def dashboard_totals(spark, sf):
    return A.dashboard_totals(logs(spark, sf))


@query("active_services", with_logs(
    "SELECT count(DISTINCT service_name) AS active_services FROM logs, nowt WHERE log_ts > now - INTERVAL 1 HOUR"))
def active_services(spark, sf):
    return A.active_services(logs(spark, sf))


@query("top_error_services", with_logs(
    "SELECT service_name, count(*) AS error_count FROM day WHERE err GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"))
def top_error_services(spark, sf):
    return A.top_error_services(logs(spark, sf))


@query("logs_per_second", with_logs(
    "SELECT round(count(*) / greatest(extract(second FROM max(now)), 1), 1)::DOUBLE AS logs_per_second "
    "FROM logs, nowt WHERE log_ts >= date_trunc('minute', now) AND log_ts <= now"))
def logs_per_second(spark, sf):
    return A.logs_per_second(logs(spark, sf))


@query("log_volume", with_logs(
    "SELECT time_bucket(INTERVAL 5 MINUTE, log_ts, TIMESTAMP '1970-01-01') AS bucket, count(*) AS count FROM logs GROUP BY 1"))
def log_volume(spark, sf):
    return A.log_volume(logs(spark, sf), "5m")


@query("log_volume_origin", with_logs(
    "SELECT time_bucket(INTERVAL 6 HOUR, log_ts, TIMESTAMP '2024-01-03 00:03:07') AS bucket, count(*) AS count FROM logs "
    "WHERE service_name='auth-service' AND level='INFO' AND log_ts >= TIMESTAMP '2024-01-03 00:03:07' GROUP BY 1"))
def log_volume_origin(spark, sf):
    return A.log_volume(logs(spark, sf), "6h", service="auth-service", level="info",
                        start="2024-01-03T00:03:07", origin="2024-01-03T00:03:07")


@query("log_volume_trunc", with_logs(
    "SELECT date_trunc('minute', log_ts)::TIMESTAMP AS bucket, count(*) AS count FROM logs GROUP BY 1"))
def log_volume_trunc(spark, sf):
    return A.log_volume(logs(spark, sf), "15m", mode="trunc")


@query("log_volume_summary", with_logs(
    "SELECT sum(n)::DOUBLE AS total, round(avg(n), 2) AS average FROM "
    "(SELECT count(*) AS n FROM logs GROUP BY date_trunc('hour', log_ts))"))
def log_volume_summary(spark, sf):
    return A.series_summary(A.log_volume(logs(spark, sf), "1h"), "count")


_ERROR_RATE = (
    "SELECT date_trunc('hour', log_ts)::TIMESTAMP AS bucket, count(*) AS total, count(*) FILTER (err) AS errors, "
    + _RATE.format(e="count(*) FILTER (err)", n="count(*)") + " AS error_rate FROM logs GROUP BY 1")


@query("error_rate_series", with_logs(_ERROR_RATE))
def error_rate_series(spark, sf):
    return A.error_rate_series(logs(spark, sf), "1h")


@query("error_rate_points", with_logs(
    "SELECT bucket, error_rate AS value, concat(errors, '/', total) AS label FROM s", f"s AS ({_ERROR_RATE})"))
def error_rate_points(spark, sf):
    return A.series_points(A.error_rate_series(logs(spark, sf), "1h"), "error_rate", ("errors", "total"))


@query("service_volume_trend", with_logs(
    "SELECT service_name, date_trunc('hour', log_ts)::TIMESTAMP AS hour, count(*) AS count, count(*) FILTER (err) AS errors "
    "FROM day GROUP BY 1, 2"))
def service_volume_trend(spark, sf):
    return A.service_volume_trend(logs(spark, sf))


@query("top_error_patterns", with_logs(
    "SELECT service_name, error_fingerprint, min(message) AS sample_message, count(*) AS occurrences, max(log_ts) AS last_seen "
    "FROM day WHERE error_fingerprint IS NOT NULL GROUP BY 1, 2 "
    "QUALIFY row_number() OVER (PARTITION BY service_name ORDER BY count(*) DESC, error_fingerprint) <= 10"))
def top_error_patterns(spark, sf):
    return A.top_error_patterns(logs(spark, sf))


@query("top_errors_coalesced", with_logs(
    "SELECT service_name, coalesce(error_fingerprint, left(message, 100)) AS pattern, count(*) AS occurrences, "
    "min(log_ts) AS first_seen, max(log_ts) AS last_seen FROM day WHERE err GROUP BY 1, 2 "
    "QUALIFY row_number() OVER (PARTITION BY service_name ORDER BY count(*) DESC, coalesce(error_fingerprint, left(message, 100))) <= 10"))
def top_errors_coalesced(spark, sf):
    return A.top_errors_coalesced(logs(spark, sf), chars=100)


@query("recent_errors", with_logs(
    "SELECT service_name, log_ts AS \"timestamp\", id, left(message, 300) AS message, error_fingerprint FROM day WHERE err "
    "QUALIFY row_number() OVER (PARTITION BY service_name ORDER BY log_ts DESC, id DESC) <= 20"))
def recent_errors(spark, sf):
    return A.recent_errors(logs(spark, sf), chars=300)


@query("top_k_per_service", with_logs(
    "SELECT service_name, id, log_ts AS \"timestamp\" FROM logs "
    "QUALIFY row_number() OVER (PARTITION BY service_name ORDER BY log_ts DESC, id DESC) <= 50"))
def top_k_per_service(spark, sf):
    rows = logs(spark, sf).select("service_name", "id", "timestamp")
    return A.top_k_per_service(rows, [F.desc("timestamp"), F.desc("id")], 50)


_REGISTRY = (
    "SELECT service_name AS name, min(log_ts) AS first_seen_at, max(log_ts) AS last_seen_at, "
    "arg_min(environment, id) AS environment, 'active' AS status FROM logs GROUP BY 1")


@query("service_registry", with_logs(_REGISTRY))
def service_registry(spark, sf):
    return A.service_registry(logs(spark, sf))


@query("service_registry_merge", with_logs(_REGISTRY))
def service_registry_merge(spark, sf):
    rows = logs(spark, sf)
    old = A.service_registry(X.filter_time(rows, end="2024-01-15"))
    new = rows.where(F.col("timestamp") > F.lit("2024-01-15").cast("timestamp_ntz"))
    return A.service_registry(new, previous=old)


@query("last_seen", with_logs("SELECT service_name, max(log_ts) AS last_seen FROM logs GROUP BY 1"))
def last_seen(spark, sf):
    return A.last_seen(logs(spark, sf))


@query("active_by_hour", with_logs("SELECT DISTINCT date_trunc('hour', log_ts)::TIMESTAMP AS hour, service_name FROM logs"))
def active_by_hour(spark, sf):
    return A.active_by_hour(logs(spark, sf))


@query("level_distribution", with_logs(
    "SELECT service_name, date_trunc('hour', log_ts)::TIMESTAMP AS bucket, "
    + ", ".join(f"count(*) FILTER (level='{v}') AS {v}" for v in ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"])
    + " FROM logs GROUP BY 1, 2"))
def level_distribution(spark, sf):
    return A.level_distribution(logs(spark, sf))


@query("minute_counts", with_logs(
    "SELECT coalesce(service_name, '_global') AS service_name, minute, count(*) AS log_count, count(*) FILTER (err) AS error_count "
    "FROM (SELECT *, date_trunc('minute', log_ts)::TIMESTAMP AS minute FROM logs) "
    "GROUP BY GROUPING SETS ((service_name, minute), (minute))"))
def minute_counts(spark, sf):
    return A.minute_counts(logs(spark, sf), global_key="_global")


@query("recent_error_rate", with_logs(
    "SELECT a.service_name, a.minute, sum(b.n)::BIGINT AS logs, sum(b.e)::BIGINT AS errors, "
    + _RATE.format(e="sum(b.e)", n="sum(b.n)") + " AS error_rate "
    "FROM m a JOIN m b ON a.service_name = b.service_name AND b.minute BETWEEN a.minute - INTERVAL 4 MINUTE AND a.minute GROUP BY 1, 2",
    "m AS (SELECT service_name, date_trunc('minute', log_ts)::TIMESTAMP AS minute, count(*) AS n, count(*) FILTER (err) AS e FROM logs GROUP BY 1, 2)"))
def recent_error_rate(spark, sf):
    return A.recent_error_rate(logs(spark, sf))


_FEATURES = (
    "SELECT date_trunc('hour', log_ts)::TIMESTAMP AS \"window\", service_name, count(*) AS log_count, "
    "count(*) FILTER (level='ERROR') AS error_count, count(*) FILTER (level='FATAL') AS fatal_count, "
    "count(*) FILTER (level='WARN') AS warn_count, count(*) FILTER (err) / count(*) * 100 AS error_rate, "
    "count(DISTINCT error_fingerprint) AS unique_errors, sum(length(message))::BIGINT / count(*) AS avg_msg_length, "
    "count(DISTINCT host) AS unique_hosts FROM logs GROUP BY 1, 2")


@query("feature_matrix", with_logs(_FEATURES))
def feature_matrix(spark, sf):
    return A.feature_matrix(logs(spark, sf))


@query("normalize_features", with_logs(
    "SELECT \"window\", service_name, "
    "(log_count - (SELECT min(log_count) FROM f))::DOUBLE / (SELECT CASE WHEN max(log_count)=min(log_count) THEN 1 ELSE max(log_count)-min(log_count) END FROM f)::DOUBLE AS log_count, "
    "(avg_msg_length - (SELECT min(avg_msg_length) FROM f)) / (SELECT CASE WHEN max(avg_msg_length)=min(avg_msg_length) THEN 1 ELSE max(avg_msg_length)-min(avg_msg_length) END FROM f) AS avg_msg_length "
    "FROM f", f"f AS ({_FEATURES})"))
def normalize_features(spark, sf):
    f = A.feature_matrix(logs(spark, sf)).select("window", "service_name", "log_count", "avg_msg_length")
    return A.normalize_features(f, ["log_count", "avg_msg_length"])


@query("latency_trend", with_logs(
    "SELECT service_name, date_trunc('hour', log_ts)::TIMESTAMP AS bucket, count(*) AS samples, round(avg(ms), 6) AS avg_ms, max(ms) AS max_ms, "
    "quantile_disc(ms, 0.5) AS p50_ms, quantile_disc(ms, 0.95) AS p95_ms, quantile_disc(ms, 0.99) AS p99_ms "
    "FROM (SELECT *, try_cast(regexp_extract(message, '(?:duration=|took )([0-9]+)ms', 1) AS DOUBLE) AS ms FROM logs) WHERE ms IS NOT NULL GROUP BY 1, 2"))
def latency_trend(spark, sf):
    return A.latency_trend(logs(spark, sf), source="message")


@query("error_budget", with_logs(
    "SELECT service_name, count(*) AS logs, count(*) FILTER (err) AS errors, "
    "100 - " + _RATE.format(e="count(*) FILTER (err)", n="count(*)") + " AS health_score, "
    "round(1 - count(*) FILTER (err) / (count(*) * (1 - 0.95::DOUBLE)), 6) AS budget_left FROM day GROUP BY 1"))
def error_budget(spark, sf):
    return A.error_budget(logs(spark, sf), slo=0.95)


@query("sample_n", with_logs(
    "SELECT id, level, message FROM logs ORDER BY md5(concat(CAST(id AS VARCHAR), ':42')), id LIMIT 5000"))
def sample_n(spark, sf):
    return A.sample_n(logs(spark, sf).select("id", "level", "message"), 5000)
