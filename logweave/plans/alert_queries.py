"""Checked queries: series statistics, cooldowns, alerts."""

from pyspark.sql import functions as F

from logweave.operators import alerts as AL
from logweave.operators import analytics as A
from logweave.operators import series as S
from logweave.operators.cooldown import cooldown as cooldown_of
from logweave.plans.base import logs, query, table, with_logs

# --- series ------------------------------------------------------------------

_SERIES = ("s AS (SELECT service_name, date_trunc('hour', log_ts)::TIMESTAMP AS bucket, count(*) FILTER (err) AS value FROM logs GROUP BY 1, 2),\n"
           "h AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER w AS n, sum(value) OVER w AS sv, sum(value * value) OVER w AS sq FROM s "
           "WINDOW w AS (PARTITION BY service_name ORDER BY bucket ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))")


def error_buckets(spark, sf):
    trend = logs(spark, sf)
    return A.feature_matrix(trend).select("service_name", F.col("window").alias("bucket"),
                                          (F.col("error_count") + F.col("fatal_count")).alias("value"))


_ARGS = ("service_name", "bucket", "value")


@query("zscore_anomalies", with_logs(
    "SELECT service_name, bucket, value, coalesce(n >= 3 AND sd > 0 AND abs((value - m) / sd) > 3, false) AS is_anomaly FROM "
    "(SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY service_name))", _SERIES))
def zscore_anomalies(spark, sf):
    return S.zscore_anomalies(error_buckets(spark, sf), *_ARGS)


@query("moving_avg_anomalies", with_logs(
    "SELECT service_name, bucket, value, coalesce(n = 10 AND 10 * sq > sv * sv AND (10 * value - sv) * (10 * value - sv) > 4 * (10 * sq - sv * sv), false) AS is_anomaly FROM h", _SERIES))
def moving_avg_anomalies(spark, sf):
    return S.moving_avg_anomalies(error_buckets(spark, sf), *_ARGS)


@query("ewma_anomalies", with_logs(
    "SELECT service_name, bucket, value, total >= 3 AND i > 1 AND v > 0 AND abs(d) > 2.5 * sqrt(v) AS is_anomaly FROM e",
    _SERIES,
    "r AS (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY bucket) AS i, count(*) OVER (PARTITION BY service_name) AS total FROM s)",
    "e AS (SELECT service_name, bucket, value, i, total, value::DOUBLE AS m, 0::DOUBLE AS v, 0::DOUBLE AS d FROM r WHERE i = 1 UNION ALL "
    "SELECT r.service_name, r.bucket, r.value, r.i, r.total, 2.0::DOUBLE/11*r.value + (1-2.0::DOUBLE/11)*e.m, "
    "2.0::DOUBLE/11*(r.value-e.m)*(r.value-e.m) + (1-2.0::DOUBLE/11)*e.v, r.value - e.m "
    "FROM e JOIN r ON r.service_name = e.service_name AND r.i = e.i + 1)", recursive=True))
def ewma_anomalies(spark, sf):
    return S.ewma_anomalies(error_buckets(spark, sf), *_ARGS)


_SD = "CASE WHEN n > 1 THEN sd ELSE m * 0.1::DOUBLE END"


@query("spike", with_logs(
    f"SELECT service_name, bucket, value, coalesce(n > 0 AND CASE WHEN {_SD} = 0 THEN value > m * 2 ELSE value > m + 2 * {_SD} END, false) AS is_spike FROM h", _SERIES))
def spike(spark, sf):
    return S.spike(error_buckets(spark, sf), *_ARGS, multiplier=2.0)


@query("drop", with_logs(
    f"SELECT service_name, bucket, value, coalesce(n > 0 AND CASE WHEN {_SD} = 0 THEN value < m / 1.5::DOUBLE ELSE value < m - 1.5::DOUBLE * {_SD} END, false) AS is_drop FROM h", _SERIES))
def drop(spark, sf):
    return S.drop(error_buckets(spark, sf), *_ARGS, multiplier=1.5)


@query("anomaly_score", with_logs(
    "SELECT service_name, bucket, value, round(CASE WHEN n < 2 THEN 0 WHEN sd = 0 THEN CASE WHEN value = m THEN 0 ELSE least(abs(value - m) / greatest(m, 1), 1) END "
    "ELSE least(1 - 1 / (1 + 0.1::DOUBLE * pow(abs(value - m) / sd, 2)), 1) END, 6) AS anomaly_score FROM h", _SERIES))
def anomaly_score(spark, sf):
    return S.anomaly_score(error_buckets(spark, sf), *_ARGS).withColumn("anomaly_score", F.round("anomaly_score", 6))


@query("moving_avg_orders",
       "SELECT o_orderpriority, day, total, coalesce(n = 10 AND 10 * sq > sv * sv AND (10 * total - sv) * (10 * total - sv) > 4 * (10 * sq - sv * sv), false) AS is_anomaly FROM "
       "(SELECT *, sum(total) OVER w AS sv, sum(total * total) OVER w AS sq, count(*) OVER w AS n FROM "
       "(SELECT o_orderpriority, o_orderdate AS day, count(*) AS total FROM orders GROUP BY 1, 2) "
       "WINDOW w AS (PARTITION BY o_orderpriority ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))")
def moving_avg_orders(spark, sf):
    days = table(spark, sf, "orders").groupBy("o_orderpriority", F.col("o_orderdate").alias("day")).agg(F.count("*").alias("total"))
    return S.moving_avg_anomalies(days, "o_orderpriority", "day", "total")


# --- cooldown and alerts -----------------------------------------------------

def _chain(source, key="service_name"):
    """Recursive CTE ``chain(key, sec)``: the seconds at which a key fires."""
    return (f"chain AS (SELECT {key}, min(sec) AS sec FROM {source} GROUP BY 1 UNION ALL "
            f"SELECT chain.{key}, min(c.sec) FROM chain JOIN {source} c ON c.{key} = chain.{key} AND c.sec >= chain.sec + 300 GROUP BY chain.{key}, chain.sec)")


@query("cooldown", with_logs(
    "SELECT service_name, id, log_ts AS \"timestamp\" FROM cand JOIN chain USING (service_name, sec) "
    "QUALIFY row_number() OVER (PARTITION BY service_name, sec ORDER BY log_ts, id) = 1",
    "cand AS (SELECT *, floor(epoch(log_ts))::BIGINT AS sec FROM logs WHERE err)", _chain("cand"), recursive=True))
def cooldown(spark, sf):
    rows = logs(spark, sf).where(F.col("level").isin("ERROR", "FATAL")).select("service_name", "id", "timestamp")
    return cooldown_of(rows, "service_name")


_RATES = [
    "m AS (SELECT service_name, date_trunc('minute', log_ts)::TIMESTAMP AS minute, count(*) AS n, count(*) FILTER (err) AS e FROM logs GROUP BY 1, 2)",
    "rates AS (SELECT a.service_name, a.minute, floor(epoch(a.minute))::BIGINT AS sec, round(100.0 * sum(b.e) / sum(b.n), 2)::DOUBLE AS rate "
    "FROM m a JOIN m b ON a.service_name = b.service_name AND b.minute BETWEEN a.minute - INTERVAL 4 MINUTE AND a.minute GROUP BY 1, 2)",
    "over AS (SELECT * FROM rates WHERE rate > 15)",
]


@query("alert_threshold", with_logs(
    "SELECT concat('High error rate on ', service_name) AS title, printf('Error rate is %.1f%% (threshold: 15.0%%)', rate) AS description, "
    "CASE WHEN rate > 30 THEN 'critical' ELSE 'warning' END AS severity, service_name, 'threshold' AS rule_type, 'active' AS status, minute AS triggered_at "
    "FROM over JOIN chain USING (service_name, sec)", *_RATES, _chain("over"), recursive=True))
def alert_threshold(spark, sf):
    return AL.alert_threshold(logs(spark, sf)).select(
        "title", "description", "severity", "service_name", "rule_type", "status", "triggered_at")


_PATTERN_LIST = "['" + "', '".join(AL.CRITICAL_PATTERNS) + "']"


@query("alert_pattern", with_logs(
    "SELECT concat('Critical pattern detected on ', service_name) AS title, "
    f"concat('Pattern ''', {_PATTERN_LIST}[fired], ''' found: ', left(message, 200)) AS description, 'critical' AS severity, service_name, "
    "'pattern' AS rule_type, log_ts AS triggered_at FROM fold WHERE fired > 0",
    f"cand AS (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY log_ts, id) AS i FROM (SELECT service_name, id, log_ts, message, "
    f"floor(epoch(log_ts))::BIGINT AS sec, list_transform({_PATTERN_LIST}, lambda p: regexp_matches(message, '(?i)' || p)) AS hit FROM logs WHERE err) WHERE list_contains(hit, true))",
    "fold AS (SELECT service_name, i, id, log_ts, message, list_position(hit, true) AS fired, "
    "list_transform(range(1, 10), lambda k: CASE WHEN k = list_position(hit, true) THEN sec ELSE -1000000 END) AS last FROM cand WHERE i = 1 UNION ALL "
    "SELECT service_name, i, id, log_ts, message, fired, list_transform(range(1, 10), lambda k: CASE WHEN k = fired THEN sec ELSE last[k] END) FROM "
    "(SELECT c.*, f.last, coalesce(list_position(list_transform(range(1, 10), lambda k: c.hit[k] AND c.sec - f.last[k] >= 300), true), 0) AS fired "
    "FROM fold f JOIN cand c ON c.service_name = f.service_name AND c.i = f.i + 1))", recursive=True))
def alert_pattern(spark, sf):
    return AL.alert_pattern(logs(spark, sf), chars=200).select("title", "description", "severity", "service_name", "rule_type", "triggered_at")


@query("alert_spike", with_logs(
    "SELECT service_name, minute AS triggered_at, printf('Error rate jumped to %.1f%%', rate) AS description FROM spikes JOIN chain USING (service_name, sec)",
    _RATES[0],
    "r AS (SELECT service_name, minute, floor(epoch(minute))::BIGINT AS sec, round(100.0 * e / n, 2)::DOUBLE AS rate FROM m)",
    "h AS (SELECT *, avg(rate) OVER w AS m, stddev_pop(rate) OVER w AS sd, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY service_name ORDER BY minute ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))",
    f"spikes AS (SELECT * FROM h WHERE coalesce(n > 0 AND CASE WHEN {_SD} = 0 THEN rate > m * 2 ELSE rate > m + 2 * {_SD} END, false))",
    _chain("spikes"), recursive=True))
def alert_spike(spark, sf):
    return AL.alert_spike(logs(spark, sf), multiplier=2.0).select("service_name", "triggered_at", "description")


@query("alert_absence", with_logs(
    "SELECT concat('No logs from ', service_name) AS title, service_name, 'absence' AS rule_type, now AS triggered_at FROM "
    "(SELECT service_name, max(log_ts) AS seen FROM logs GROUP BY 1), nowt WHERE seen <= now - INTERVAL 3 MINUTE"))
def alert_absence(spark, sf):
    rows = logs(spark, sf)
    found = AL.alert_absence(rows, A.service_registry(rows), gap="3 MINUTES")
    return found.select("title", "service_name", "rule_type", "triggered_at")


def _alerts(spark, sf):
    """Alerts kept as plain facts of the log table: one per fatal row."""
    rows = logs(spark, sf).where("level = 'FATAL'")
    return rows.select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("Fatal on "), "service_name").alias("title"),
        F.col("message").alias("description"), F.expr("if(environment='staging', 'warning', 'critical')").alias("severity"),
        "service_name", F.lit("pattern").alias("rule_type"), F.col("metadata").alias("rule_config"),
        F.lit("active").alias("status"), F.col("timestamp").alias("triggered_at"))


_ALERTS = ("alerts AS (SELECT CAST(id AS VARCHAR) AS id, concat('Fatal on ', service_name) AS title, CASE WHEN environment='staging' THEN 'warning' ELSE 'critical' END AS severity, "
           "service_name, log_ts AS triggered_at FROM logs WHERE level='FATAL')")


@query("alert_record", with_logs("SELECT id, title, severity, service_name, triggered_at FROM alerts", _ALERTS))
def alert_record(spark, sf):
    rows = logs(spark, sf).where("level = 'FATAL'").withColumn("key", F.col("id").cast("string"))
    made = AL.alert_record(
        rows, F.concat(F.lit("Fatal on "), "service_name"), F.col("message"),
        F.expr("if(environment='staging', 'warning', 'critical')"), "pattern", F.struct("id"), "timestamp", key=["id"])
    return made.select(F.get_json_object("rule_config", "$.id").alias("id"), "title", "severity", "service_name", "triggered_at")


@query("filter_alerts", with_logs("SELECT id, title FROM alerts WHERE severity='warning' AND service_name='auth-service'", _ALERTS))
def filter_alerts(spark, sf):
    return AL.filter_alerts(_alerts(spark, sf), "active", "warning", "auth-service").select("id", "title")


@query("list_alerts", with_logs(
    "SELECT id, title, severity, triggered_at FROM alerts WHERE severity='critical' ORDER BY triggered_at DESC, id LIMIT 50", _ALERTS))
def list_alerts(spark, sf):
    return AL.list_alerts(_alerts(spark, sf), severity="critical").select("id", "title", "severity", "triggered_at")


@query("alert_state", with_logs(
    "SELECT id, CASE WHEN id::BIGINT % 3 = 0 THEN 'resolved' WHEN id::BIGINT % 2 = 0 THEN 'acknowledged' ELSE 'active' END AS status, "
    "CASE WHEN id::BIGINT % 2 = 0 THEN triggered_at + INTERVAL 5 MINUTE END AS acknowledged_at, "
    "CASE WHEN id::BIGINT % 3 = 0 THEN triggered_at + INTERVAL 30 MINUTE END AS resolved_at FROM alerts", _ALERTS))
def alert_state(spark, sf):
    alerts = _alerts(spark, sf)
    number = F.col("id").cast("bigint")
    seen = alerts.where(number % 2 == 0).select("id", F.lit("acknowledged").alias("status"), (F.col("triggered_at") + F.expr("INTERVAL 5 MINUTES")).alias("at"))
    done = alerts.where(number % 3 == 0).select("id", F.lit("resolved").alias("status"), (F.col("triggered_at") + F.expr("INTERVAL 30 MINUTES")).alias("at"))
    events = AL.alert_events(alerts).unionByName(seen).unionByName(done)
    return AL.alert_state(alerts, events).select("id", "status", "acknowledged_at", "resolved_at")


@query("active_alerts", with_logs("SELECT count(*) AS active_alerts FROM alerts WHERE id::BIGINT % 3 <> 0", _ALERTS))
def active_alerts(spark, sf):
    alerts = _alerts(spark, sf)
    done = alerts.where(F.col("id").cast("bigint") % 3 == 0).select("id", F.lit("resolved").alias("status"), (F.col("triggered_at") + F.expr("INTERVAL 1 SECOND")).alias("at"))
    return A.active_alerts(AL.alert_state(alerts, AL.alert_events(alerts).unionByName(done)))


def _anomalies(spark, sf):
    """Anomalies as z-scores of hourly errors: one row per flagged bucket."""
    flagged = S.zscore_anomalies(error_buckets(spark, sf), *_ARGS, threshold=2.0).where("is_anomaly")
    return flagged.select(
        F.concat_ws("|", "service_name", F.date_format("bucket", "yyyyMMddHH")).alias("id"), F.col("bucket").alias("detected_at"),
        F.lit("error_spike").alias("anomaly_type"), "service_name", (F.col("value") / 100.0).alias("severity_score"))


_ANOMALIES = ("anomalies AS (SELECT concat(service_name, '|', strftime(bucket, '%Y%m%d%H')) AS id, bucket AS detected_at, 'error_spike' AS anomaly_type, service_name, value / 100.0::DOUBLE AS severity_score FROM "
              "(SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM s WINDOW w AS (PARTITION BY service_name)) WHERE sd > 0 AND abs((value - m) / sd) > 2)")


@query("filter_anomalies", with_logs(
    "SELECT id, severity_score FROM anomalies WHERE service_name='user-service' AND detected_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28'", _SERIES, _ANOMALIES))
def filter_anomalies(spark, sf):
    return AL.filter_anomalies(_anomalies(spark, sf), "user-service", "error_spike", "2024-01-03", "2024-01-28").select("id", "severity_score")


@query("list_anomalies", with_logs(
    "SELECT id, detected_at, service_name, severity_score FROM anomalies ORDER BY detected_at DESC, id LIMIT 50", _SERIES, _ANOMALIES))
def list_anomalies(spark, sf):
    return AL.list_anomalies(_anomalies(spark, sf)).select("id", "detected_at", "service_name", "severity_score")


@query("anomaly_state", with_logs(
    "SELECT id, service_name = 'auth-service' AS is_acknowledged FROM anomalies", _SERIES, _ANOMALIES))
def anomaly_state(spark, sf):
    found = _anomalies(spark, sf)
    log = found.where("service_name = 'auth-service'").select("id")
    return AL.anomaly_state(found, log.unionByName(log)).select("id", "is_acknowledged")


@query("anomalies_24h", with_logs(
    "SELECT count(*) AS anomalies_detected FROM anomalies WHERE detected_at > (SELECT max(detected_at) FROM anomalies) - INTERVAL 24 HOUR", _SERIES, _ANOMALIES))
def anomalies_24h(spark, sf):
    return A.anomalies_24h(_anomalies(spark, sf))


@query("alert_feed", with_logs(
    "SELECT 'alert' AS type, id, title, severity, service_name, NULL::DOUBLE AS score, NULL AS anomaly_type, triggered_at AS at FROM alerts UNION ALL "
    "SELECT 'anomaly', id, NULL, NULL, service_name, severity_score, anomaly_type, detected_at FROM anomalies", _SERIES, _ALERTS, _ANOMALIES))
def alert_feed(spark, sf):
    return AL.alert_feed(_alerts(spark, sf), _anomalies(spark, sf))
