"""Structured Streaming jobs. Stateless steps are the batch operators themselves.

Event time rules: the watermark plays the part of a counter's lifetime, and rows later than it
still reach storage but no closed window.
"""

import hashlib

from pyspark.sql import functions as F

from logweave.functions.rates import is_error, rate_pct
from logweave.model import LEVELS, STRUCTURED_SCHEMA
from logweave.operators import ingest
from logweave.operators.enrich import process
from logweave.sources.tables import write_logs
from logweave.sources.versions import store_versions

# Lifetimes of the counters, rows of the live tail.
MINUTE_WATERMARK, HOUR_WATERMARK = "1 hour", "24 hours"
TAIL_ROWS = 10
TAIL_COLUMNS = ["id", "timestamp", "level", "service_name", "message", "host", "trace_id", "metadata"]


def read_log_stream(spark, path, fmt="text", max_files=None, schema=None):
    """New files of a folder as a stream; where it stopped is kept in the query's checkpoint."""
    reader = spark.readStream.format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if fmt != "text":
        reader = reader.schema(schema or STRUCTURED_SCHEMA)
    return reader.load(path)


def stream_ingest(lines, col="value", as_of=None, raw_env_null=False):
    """Raw lines to normalised rows. Lines without a trace of their own get one when they are stored."""
    return ingest.ingest_raw_lines(lines, col, as_of, raw_env_null)


def _watermarked(stream, time, delay):
    """Event time needs a zone; a column without one is UTC like everything here."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def stream_dedup(stream, watermark="10 minutes", key="id", time="timestamp"):
    """Drop redelivered rows."""
    return _watermarked(stream, time, watermark).dropDuplicatesWithinWatermark([key])


def minute_counters(stream, watermark=MINUTE_WATERMARK, time="timestamp"):
    """Count and errors per service and minute. Aggregate over services for the global series:
    a second stateful count here would double the state for a sum of a few rows per minute."""
    return (
        _watermarked(stream, time, watermark)
        .groupBy(F.window(time, "1 minute"), "service_name")
        .agg(F.count("*").alias("log_count"), F.count_if(is_error()).alias("error_count"))
        .select("service_name", F.col("window.start").alias("minute"), "log_count", "error_count")
    )


def level_counters(stream, watermark=HOUR_WATERMARK, time="timestamp"):
    """Count per level, service and hour, one column per level."""
    return (
        _watermarked(stream, time, watermark)
        .groupBy(F.window(time, "1 hour"), "service_name")
        .agg(*[F.count_if(F.col("level") == level).alias(level) for level in LEVELS])
        .select("service_name", F.col("window.start").alias("bucket"), *LEVELS)
    )


def stream_hourly_stats(stream, watermark=HOUR_WATERMARK, time="timestamp"):
    """The hourly statistics as they build up; distinct counts are sketches on a stream."""
    return (
        _watermarked(stream, time, watermark)
        .groupBy(F.window(time, "1 hour"), "service_name", "level")
        .agg(F.count("*").alias("log_count"), F.count_if(is_error()).alias("error_count"),
             F.approx_count_distinct("trace_id").alias("unique_traces"),
             F.approx_count_distinct("error_fingerprint").alias("unique_errors"))
        .select(F.col("window.start").alias("hour"), "service_name", "level",
                "log_count", "error_count", "unique_traces", "unique_errors")
    )


def sliding_error_rate(stream, watermark=MINUTE_WATERMARK, minutes=5, time="timestamp"):
    """Error rate of the last minutes at every minute that has rows.

    Each row counts in ``minutes`` windows; the window is kept when its last minute has rows.
    """
    last = F.col(time) >= F.col("window.end") - F.expr("INTERVAL 1 MINUTE")
    windowed = _watermarked(stream, time, watermark).withColumn("window", F.window(time, f"{minutes} minutes", "1 minute"))
    return (
        windowed.groupBy("window", "service_name")
        .agg(F.count("*").alias("logs"), F.count_if(is_error()).alias("errors"), F.count_if(last).alias("_now"))
        .where(F.col("_now") > 0)
        .withColumn("error_rate", rate_pct("errors", "logs"))
        .select("service_name", (F.col("window.end") - F.expr("INTERVAL 1 MINUTE")).alias("minute"),
                "logs", "errors", "error_rate")
    )


def tail_filter(stream, where=None):
    """The part of the tail a subscriber asks for."""
    return stream if where is None else stream.where(where)


def live_tail(batch, n=TAIL_ROWS, where=None):
    """Last ``n`` rows of a micro-batch in arrival order."""
    rows = tail_filter(batch, where)
    return rows.orderBy(F.desc("ingested_at"), F.desc("id")).limit(n).select(
        *[c for c in TAIL_COLUMNS if c in rows.columns])


def store_batch(path, rejects_path=None, now=None, tail=None, alerts=None, source="stream"):
    """``foreachBatch`` function: enrich, fingerprint, store, publish the tail, check alerts.

    Storage replaces what an earlier attempt of the same batch of the same ``source`` wrote. Rows without
    an id get one from source, batch and place, and rows without a trace one from their id. ``tail`` and ``alerts`` are
    called with a DataFrame and the batch id. Several steps read the batch, so it is cached; its
    size is set by the trigger (``max_files``), and lost blocks are computed again.
    """
    def run(batch, batch_id):
        rows = process(ingest.fill_traces(ingest.with_identity(batch, source, batch_id)), now).persist()
        try:
            write_logs(rows, path, rejects_path, cluster=False, batch_id=batch_id, stage=False, source=source)
            if tail:
                tail(live_tail(rows), batch_id)
            if alerts:
                alerts(rows, batch_id)
        finally:
            rows.unpersist()
    return run


def stream_process(stream, path, checkpoint, rejects_path=None, now=None, tail=None, alerts=None, **trigger):
    """Start the storing query; the checkpoint takes the place of acknowledgements.

    Batch numbers belong to a checkpoint, so its name is the source under which batches are stored:
    streams with checkpoints of their own share a table without touching each other's rows.
    """
    source = "s" + hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    return (
        stream.writeStream.foreachBatch(store_batch(path, rejects_path, now, tail, alerts, source))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def stream_scores(stream, forest, publish, checkpoint, cooldown_s=300, delay="1 minute", **trigger):
    """Start the scoring query: ``publish`` gets the anomalies each batch records, and the batch id.

    Minutes are judged once they are closed and cooldowns outlive batches, see :mod:`logweave.streaming.live`.
    """
    from logweave.streaming.live import live_anomalies
    return (
        live_anomalies(stream, forest, cooldown_s, delay).writeStream.foreachBatch(publish).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()
    )


def keep_current(counters, path, checkpoint, **trigger):
    """Start a query that keeps counters readable while their windows are still open.

    Every batch stores the new state of the windows it touched; :func:`logweave.sources.versions.read_current`
    returns the newest state of each.
    """
    return (
        counters.writeStream.foreachBatch(store_versions(path)).outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
