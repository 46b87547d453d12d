"""The ``events`` stream table seen as a log table.

One list of SQL expressions serves Spark and the DuckDB checks, so both start from the
same rows. The time column keeps its type (``timestamp_ntz`` in the given files).
"""

from pyspark.sql import functions as F

from logweave.functions.masking import error_fingerprint
from logweave.model import LOG_COLUMNS

EVENT_LOG_COLUMNS = {
    "id": "event_id",
    "log_ts": "ts",
    "level": """CASE WHEN event_type='error' AND event_id % 10 = 0 THEN 'FATAL' WHEN event_type='error' THEN 'ERROR'
      WHEN event_type='signup' THEN 'WARN' WHEN event_type='view' AND event_id % 25 = 0 THEN 'TRACE'
      WHEN event_type='click' THEN 'DEBUG' ELSE 'INFO' END""",
    "service_name": """CASE user_id % 5 WHEN 0 THEN 'auth-service' WHEN 1 THEN 'payment-service' WHEN 2 THEN 'order-service'
      WHEN 3 THEN 'user-service' ELSE 'notification-service' END""",
    "message": """CASE WHEN event_type='error' AND event_id % 4 = 0 THEN concat('connection refused by 10.0.', CAST(user_id % 256 AS STRING), '.', CAST(event_id % 256 AS STRING))
      WHEN event_type='error' AND event_id % 4 = 1 THEN concat('Gateway timeout for request ', CAST(event_id + 100000 AS STRING), ' duration=', CAST(CAST(floor(value) AS BIGINT) AS STRING), 'ms')
      WHEN event_type='error' AND event_id % 4 = 2 THEN concat('ValueError: invalid payload hash ', substr(md5(CAST(event_id AS STRING)),1,12))
      WHEN event_type='error' THEN 'OutOfMemoryError: Java heap space'
      WHEN event_type='signup' THEN concat('Retry for user_id=', CAST(user_id AS STRING), ' status_code=429')
      ELSE concat(event_type, ' GET /items/', CAST(event_id AS STRING), ' took ', CAST(CAST(floor(value) AS BIGINT) AS STRING), 'ms') END""",
    "trace_id": "md5(CAST(CAST(floor(event_id / 4) AS BIGINT) AS STRING))",
    "span_id": "substr(md5(concat('s', CAST(event_id AS STRING))),1,16)",
    "environment": "CASE WHEN event_id % 20 = 0 THEN 'staging' ELSE 'production' END",
    "host": "CASE WHEN event_id % 25 = 0 THEN NULL ELSE concat('node-0', CAST(user_id % 3 + 1 AS STRING), '.internal') END",
    "metadata": "props",
    "ingested_at": "ts + INTERVAL 2 SECOND",
}


def logs_from_events(events):
    """``events`` as a log table, error rows fingerprinted."""
    logs = events.selectExpr(*[f"{sql} AS {name}" for name, sql in EVENT_LOG_COLUMNS.items()])
    logs = logs.withColumnRenamed("log_ts", "timestamp")
    return logs.withColumn(
        "error_fingerprint",
        F.when(F.col("level").isin("ERROR", "FATAL"), error_fingerprint("message", "service_name")),
    ).select(LOG_COLUMNS)
