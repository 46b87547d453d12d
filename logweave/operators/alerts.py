"""Alert rules, alert records and their states."""

from pyspark.sql import functions as F

from logweave.functions.rates import rate_pct
from logweave.functions.times import as_of as _as_of, since
from logweave.model import ALERT_COLUMNS
from logweave.operators.analytics import minute_counts, recent_error_rate
from logweave.operators.cooldown import COOLDOWN_SECONDS, cooldown, pattern_cooldown
from logweave.operators.filters import filter_alerts, filter_anomalies, filter_errors, filter_last
from logweave.operators.series import spike

# Rule thresholds and the critical patterns in the order they are tried.
ERROR_RATE_THRESHOLD = 15.0
ERROR_RATE_CRITICAL = 30
SPIKE_MULTIPLIER = 3.0
MOST_PATTERNS = 63
CRITICAL_PATTERNS = [
    "OutOfMemoryError",
    "StackOverflowError",
    "FATAL",
    "segmentation fault",
    "kernel panic",
    "disk full",
    "connection refused",
    "database.*down",
    "OOM",
]


def alert_record(rows, title, description, severity, rule_type, rule_config, at, service="service_name", key=()):
    """Alert rows in the stored form. The id is a hash of rule, service and time, so a replay
    of the same data gives the same alerts."""
    def lit(v):
        return F.lit(v) if isinstance(v, str) else v
    ident = F.md5(F.concat_ws("|", lit(rule_type), F.col(service), F.col(at).cast("string"), *[F.col(k).cast("string") for k in key]))
    return rows.select(
        ident.alias("id"), lit(title).alias("title"), lit(description).alias("description"),
        lit(severity).alias("severity"), F.col(service).alias("service_name"), lit(rule_type).alias("rule_type"),
        F.to_json(rule_config).alias("rule_config"), F.lit("active").alias("status"), F.col(at).alias("triggered_at"),
    ).select(ALERT_COLUMNS)


def threshold_candidates(rates, threshold=ERROR_RATE_THRESHOLD):
    return rates.where(F.col("error_rate") > threshold)


# The wording of titles and descriptions in this module.
def threshold_alerts(fired, threshold=ERROR_RATE_THRESHOLD, critical=ERROR_RATE_CRITICAL):
    return alert_record(
        fired,
        F.concat(F.lit("High error rate on "), F.col("service_name")),
        F.format_string(f"Error rate is %.1f%% (threshold: {threshold}%%)", F.col("error_rate")),
        F.when(F.col("error_rate") > critical, "critical").otherwise("warning"),
        "threshold",
        F.struct(F.lit(float(threshold)).alias("threshold"), F.col("error_rate").alias("actual")),
        "minute",
    )


def alert_threshold(df, threshold=ERROR_RATE_THRESHOLD, critical=ERROR_RATE_CRITICAL, cooldown_s=COOLDOWN_SECONDS, minutes=5):
    """Five-minute error rate above the threshold, judged at every minute that has rows."""
    rates = recent_error_rate(df, minutes)
    fired = cooldown(threshold_candidates(rates, threshold), "service_name", "minute", cooldown_s, "minute")
    return threshold_alerts(fired, threshold, critical)


def pattern_mask(message="message", patterns=CRITICAL_PATTERNS):
    """One bit per matching pattern, the first pattern lowest; at most 63 patterns fit."""
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"{len(patterns)} patterns; at most {MOST_PATTERNS} can be tried at once")
    mask = F.lit(0).cast("bigint")
    for number, pattern in enumerate(patterns):
        hit = F.rlike(F.col(message), F.lit(f"(?i){pattern}"))
        mask = mask.bitwiseOR(F.when(hit, F.lit(1 << number)).otherwise(F.lit(0)).cast("bigint"))
    return mask


def pattern_candidates(df, patterns=CRITICAL_PATTERNS):
    """Error rows that match some pattern, with their ``_mask``."""
    return filter_errors(df).withColumn("_mask", pattern_mask(patterns=patterns)).where(F.col("_mask") != 0)


def pattern_alerts(rows, patterns=CRITICAL_PATTERNS, chars=None):
    """Records for rows with the number of their fired ``pattern``; ``chars`` cuts the message in the text."""
    message = F.col("message") if chars is None else F.substring("message", 1, chars)
    name = F.element_at(F.array(*map(F.lit, patterns)), F.col("pattern") + 1)
    rows = rows.withColumn("_name", name)
    return alert_record(
        rows,
        F.concat(F.lit("Critical pattern detected on "), F.col("service_name")),
        F.concat(F.lit("Pattern '"), F.col("_name"), F.lit("' found: "), message),
        "critical", "pattern", F.struct(F.col("_name").alias("pattern")), "timestamp", key=["id"],
    )


def alert_pattern(df, patterns=CRITICAL_PATTERNS, cooldown_s=COOLDOWN_SECONDS, chars=None):
    """Critical patterns in error messages; each pattern of a service cools down by itself, and a
    message fires the first of its patterns that is not cooling."""
    rows = pattern_candidates(df, patterns)
    fired = pattern_cooldown(rows, "service_name", seconds=cooldown_s)
    return pattern_alerts(rows.drop("_mask").join(fired, ["service_name", "id"]), patterns, chars)


def alert_spike(df, multiplier=SPIKE_MULTIPLIER, history=10, cooldown_s=COOLDOWN_SECONDS):
    """Minute error rates that rise against the minutes before them."""
    rates = minute_counts(df).withColumn("error_rate", rate_pct("error_count", "log_count"))
    found = spike(rates, "service_name", "minute", "error_rate", history, multiplier).where("is_spike")
    fired = cooldown(found, "service_name", "minute", cooldown_s, "minute")
    return alert_record(
        fired,
        F.concat(F.lit("Error rate spike on "), F.col("service_name")),
        F.format_string("Error rate jumped to %.1f%%", F.col("error_rate")),
        "warning", "anomaly",
        F.struct(F.lit(float(multiplier)).alias("multiplier"), F.col("error_rate").alias("actual")), "minute")


def alert_absence(df, registry, as_of=None, gap="1 HOUR"):
    """Known services without a row since ``as_of - gap``."""
    now = _as_of(df, as_of)
    alive = filter_last(df, gap, now).select(F.col("service_name").alias("name")).distinct()
    silent = registry.join(alive, "name", "left_anti").withColumn("_at", now)
    return alert_record(
        silent,
        F.concat(F.lit("No logs from "), F.col("name")),
        F.concat(F.lit("Last log at "), F.col("last_seen_at").cast("string")),
        "warning", "absence", F.struct(F.lit(gap).alias("gap")), "_at", service="name")


# --- stored alerts -----------------------------------------------------------

def list_alerts(alerts, status=None, severity=None, service_name=None, limit=50):
    found = filter_alerts(alerts, status, severity, service_name)
    return found.orderBy(F.desc("triggered_at"), "id").limit(limit)


def alert_events(alerts):
    """The creation event of each alert, to start an event log."""
    return alerts.select(F.col("id"), F.lit("active").alias("status"), F.col("triggered_at").alias("at"))


def alert_state(alerts, events):
    """Alerts with their latest state from an append-only log ``id, status, at``.

    Acknowledging and resolving append an event; nothing is updated in place.
    """
    latest = events.groupBy("id").agg(
        F.max_by("status", F.struct("at", "status")).alias("status"),
        F.max(F.when(F.col("status") == "acknowledged", F.col("at"))).alias("acknowledged_at"),
        F.max(F.when(F.col("status") == "resolved", F.col("at"))).alias("resolved_at"),
    ).withColumnRenamed("status", "_status")
    joined = alerts.join(latest, "id", "left")
    return joined.withColumn("status", F.coalesce("_status", "status")).drop("_status")


def list_anomalies(anomalies, service_name=None, anomaly_type=None, start=None, end=None, limit=50):
    found = filter_anomalies(anomalies, service_name, anomaly_type, start, end)
    return found.orderBy(F.desc("detected_at"), "id").limit(limit)


def anomaly_state(anomalies, acknowledged):
    """Anomalies with ``is_acknowledged`` set for the ids in the acknowledgement log."""
    marks = acknowledged.select("id").distinct().withColumn("_seen", F.lit(True))
    joined = anomalies.drop("is_acknowledged").join(marks, "id", "left")
    return joined.withColumn("is_acknowledged", F.coalesce("_seen", F.lit(False))).drop("_seen")


def alert_feed(alerts, anomalies):
    """Alerts and anomalies as one stream of notices; works on batches and streams alike."""
    text = F.lit(None).cast("string")
    a = alerts.select(F.lit("alert").alias("type"), "id", "title", "severity", "service_name",
                      F.lit(None).cast("double").alias("score"), text.alias("anomaly_type"), F.col("triggered_at").alias("at"))
    b = anomalies.select(F.lit("anomaly").alias("type"), "id", text.alias("title"), text.alias("severity"), "service_name",
                         F.col("severity_score").alias("score"), "anomaly_type", F.col("detected_at").alias("at"))
    return a.unionByName(b)
