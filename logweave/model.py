"""Schemas and enumerations of the log data model."""

from pyspark.sql import types as T

# The enumerations of the log data model.
LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
ERROR_LEVELS = ["ERROR", "FATAL"]
ALERT_SEVERITIES = ["info", "warning", "critical", "emergency"]
ALERT_STATUSES = ["active", "acknowledged", "resolved", "silenced"]
RULE_TYPES = ["threshold", "pattern", "anomaly", "absence"]
ANOMALY_TYPES = ["error_spike", "volume_anomaly", "latency_anomaly", "pattern_anomaly", "novel_error"]
SERVICE_STATUSES = ["active", "inactive", "degraded", "down"]
SORT_FIELDS = ["timestamp", "level", "service_name", "ingested_at", "id", "host", "environment"]

# ``metadata`` is JSON text: it survives CSV, JSON and streaming sinks unchanged and
# ``filter_metadata`` reads it as a variant.
LOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("level", T.StringType(), False),
    T.StructField("service_name", T.StringType(), False),
    T.StructField("message", T.StringType(), False),
    T.StructField("trace_id", T.StringType()),
    T.StructField("span_id", T.StringType()),
    T.StructField("environment", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("error_fingerprint", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
])
LOG_COLUMNS = LOG_SCHEMA.names

# What a client may send: everything is optional and untyped until normalised.
STRUCTURED_SCHEMA = T.StructType([
    T.StructField(n, T.LongType() if n == "id" else T.StringType())
    for n in ["id", "timestamp", "level", "service_name", "message", "trace_id",
              "span_id", "environment", "host", "metadata"]
])

ALERT_COLUMNS = ["id", "title", "description", "severity", "service_name", "rule_type",
                 "rule_config", "status", "triggered_at"]

FEATURES = ["log_count", "error_count", "fatal_count", "warn_count", "error_rate",
            "unique_errors", "avg_msg_length", "unique_hosts"]
