"""Checked queries: storage, models and streams.

A stream query reads the table as a stream, runs until the input is used up, writes to the shared
checkpoint folder and returns what it wrote.
"""

import uuid

from pyspark.sql import functions as F

from logweave.operators import alerts as AL
from logweave.operators import analytics as A
from logweave.operators import anomaly as N
from logweave.operators import ingest as I
from logweave.operators import search as S
from logweave.operators.enrich import process
import logweave.plans.report_queries  # noqa: F401  (its SQL texts are used below)
from logweave.plans.alert_queries import _RATES, _alerts, _anomalies, _chain
from logweave.plans.base import SQL, logs, query, with_logs
from logweave.plans.ingest_queries import NOW, rendered
from logweave.session import checkpoint_dir
from logweave.sources import snapshots as SN
from logweave.sources import tables as TB
from logweave.sources import versions as V
from logweave.sources.events import logs_from_events
from logweave.streaming import cooldown as SC
from logweave.streaming import jobs as J
from logweave.streaming import live as L


def scratch(spark, name):
    return f"{checkpoint_dir(spark)}/logweave/{name}-{uuid.uuid4().hex}"


def log_stream(spark, sf):
    """The log table as a stream."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return logs_from_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


def naive(df, *names):
    """Times as the given tables hold them: UTC without a zone."""
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


def run_append(stream, name):
    """Run an append-mode stream to the end of its input; what the file sink holds then."""
    spark = stream.sparkSession
    path = scratch(spark, name)
    (stream.writeStream.format("parquet").option("checkpointLocation", path + "-state").outputMode("append")
     .trigger(availableNow=True).start(path).awaitTermination())
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream, name, make, mode="append"):
    """Run a stream whose batches pass through ``make(batch, id)``; all that it returned."""
    spark = stream.sparkSession
    path = scratch(spark, name)

    def write(batch, batch_id):
        out = make(batch, batch_id)
        out.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_{batch_id}")
    (stream.writeStream.foreachBatch(write).option("checkpointLocation", path + "-state").outputMode(mode)
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{path}/batch_*")


# --- storage -----------------------------------------------------------------

def _mixed(spark, sf):
    """Log rows, one in thirteen with a level the table does not take."""
    rows = logs(spark, sf)
    return rows.withColumn("level", F.expr("if(id % 13 = 5, 'NOTICE', level)"))


@query("write_logs", with_logs(
    "SELECT id, log_ts AS \"timestamp\", level, service_name, message, trace_id, CAST(log_ts AS DATE) AS log_date FROM logs "
    "WHERE id % 13 <> 5 AND log_ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-16 12:00:00'"))
def write_logs(spark, sf):
    path = scratch(spark, "logs")
    TB.write_logs(_mixed(spark, sf), path, path + "-rejects")
    return TB.scan_logs(spark, path, "2024-01-08", "2024-01-16T12:00:00Z",
                        ["id", "timestamp", "level", "service_name", "message", "trace_id", "log_date"])


@query("dead_letter", with_logs(
    "SELECT CAST(id AS VARCHAR) AS original_id, 'invalid level' AS error, message FROM logs WHERE id % 13 = 5"))
def dead_letter(spark, sf):
    path = scratch(spark, "logs")
    TB.write_logs(_mixed(spark, sf), path, path + "-rejects")
    return spark.read.parquet(path + "-rejects").select(
        "original_id", "error", F.get_json_object("data", "$.message").alias("message"))


@query("dead_letter_newest", with_logs(
    "SELECT CAST(id AS VARCHAR) AS original_id FROM logs WHERE id % 13 = 5 ORDER BY log_ts DESC LIMIT 200"))
def dead_letter_newest(spark, sf):
    _, bad = TB.split_valid(_mixed(spark, sf))
    dead = TB.dead_letter(bad, F.col("timestamp"))
    return TB.keep_newest(dead, 200).select("original_id")


@query("compact", with_logs("SELECT id, log_ts AS \"timestamp\", level FROM logs"))
def compact(spark, sf):
    path = scratch(spark, "logs")
    TB.write_logs(logs(spark, sf), path, cluster=False, batch_id=0)
    TB.compact(spark, path, path + "-compact")
    return spark.read.parquet(path + "-compact").select("id", "timestamp", "level")


@query("commit_logs", with_logs(
    "SELECT id, log_ts AS \"timestamp\", level, service_name, message, CAST(log_ts AS DATE) AS log_date FROM logs "
    "WHERE id % 13 <> 5 AND log_ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-16 12:00:00'"))
def commit_logs(spark, sf):
    """Two commits, one of them a batch that is stored twice, and a compaction."""
    path = scratch(spark, "snapshot")
    rows = _mixed(spark, sf)
    SN.commit_logs(rows.where("id % 2 = 0"), path, rejects=True)
    for _ in range(2):
        SN.commit_logs(rows.where("id % 2 = 1"), path, source="stream", batch_id=3)
    SN.compact_snapshot(spark, path)
    return SN.scan_snapshot(spark, path, "2024-01-08", "2024-01-16T12:00:00Z",
                            ["id", "timestamp", "level", "service_name", "message", "log_date"])


@query("committed_rejects", with_logs(
    "SELECT CAST(id AS VARCHAR) AS original_id, 'invalid level' AS error FROM logs WHERE id % 13 = 5"))
def committed_rejects(spark, sf):
    path = scratch(spark, "snapshot")
    for _ in range(2):  # a repeated attempt
        SN.commit_logs(_mixed(spark, sf), path, rejects=True, source="stream", batch_id=0)
    return SN.read_rejects(spark, path).select("original_id", "error")


def _raw_folder(spark, sf):
    """The log rows as JSON lines in text files, the way a shipper would leave them."""
    folder = scratch(spark, "raw")
    rows = logs(spark, sf).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows.select(F.to_json(F.struct("timestamp", "level", "service_name", "message")).alias("value")).write.text(folder)
    return folder


_STORED = "SELECT level, service_name, message, count(*) AS n, count(*) AS ids, count(*) AS traces FROM logs GROUP BY ALL"


def _stored_groups(rows):
    return rows.groupBy("level", "service_name", "message").agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("trace_id").alias("traces"))


@query("raw_to_store", with_logs(_STORED))
def raw_to_store(spark, sf):
    path = scratch(spark, "logs")
    TB.write_logs(process(I.ingest_raw_lines(spark.read.text(_raw_folder(spark, sf)))), path, path + "-rejects")
    return _stored_groups(spark.read.parquet(path))


@query("raw_to_search", with_logs(
    "SELECT way, service_name, count(*) AS n FROM logs, (VALUES ('index'), ('scan')) w(way) WHERE contains(message, 'connection refused') GROUP BY ALL"))
def raw_to_search(spark, sf):
    path = scratch(spark, "logs")
    TB.write_logs(process(I.ingest_raw_lines(spark.read.text(_raw_folder(spark, sf)))), path)
    rows = TB.scan_logs(spark, path)
    ways = {"scan": None, "index": S.build_search_index(rows, path + "-index")}
    found = [S.matching(rows, "connection refused", index).select(F.lit(way).alias("way"), "service_name") for way, index in ways.items()]
    return found[0].unionByName(found[1]).groupBy("way", "service_name").agg(F.count("*").alias("n"))


def _put_file(lines, path):
    """``lines`` as the one text file ``path``, in place of what was there."""
    part = path + "-" + uuid.uuid4().hex
    lines.coalesce(1).write.text(part)
    jvm = lines.sparkSession._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(lines.sparkSession._jsc.hadoopConfiguration())
    written = fs.globStatus(at(part + "/part-*"))[0].getPath()
    fs.delete(at(path), False)
    fs.rename(written, at(path))


@query("raw_rotated_file", with_logs(
    "SELECT way, service_name, count(*) AS n, count(*) AS ids, count(*) AS traces FROM logs, (VALUES ('index'), ('scan')) w(way) "
    "WHERE contains(message, 'connection refused') GROUP BY ALL"))
def raw_rotated_file(spark, sf):
    path, log = scratch(spark, "logs"), scratch(spark, "rotated") + "/app.log"
    lines = logs(spark, sf).select("id", F.to_json(F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "level", "service_name", "message")).alias("value"))
    for half in (0, 1):  # the same name, rotated in between
        _put_file(lines.where(F.col("id") % 2 == half).select("value"), log)
        TB.write_logs(process(I.ingest_raw_lines(spark.read.text(log))), path)
    rows = TB.scan_logs(spark, path)
    ways = {"scan": None, "index": S.build_search_index(rows, path + "-index")}
    found = [S.matching(rows, "connection refused", index).select(F.lit(way).alias("way"), "service_name", "id", "trace_id") for way, index in ways.items()]
    return found[0].unionByName(found[1]).groupBy("way", "service_name").agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("trace_id").alias("traces"))


@query("raw_stream_equal_lines", with_logs("SELECT level, service_name, count(*) AS n, count(*) AS ids, count(*) AS traces FROM logs GROUP BY ALL"))
def raw_stream_equal_lines(spark, sf):
    folder, path = scratch(spark, "equal"), scratch(spark, "logs")
    same = F.to_json(F.struct("level", "service_name", F.lit("the same words again").alias("message")))
    logs(spark, sf).select(same.alias("value")).repartition(3).write.text(folder)
    lines = J.read_log_stream(spark, folder, max_files=1)
    J.stream_process(J.stream_ingest(lines), path, path + "-checkpoint", path + "-rejects").awaitTermination()
    return spark.read.parquet(path).groupBy("level", "service_name").agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("trace_id").alias("traces"))


@query("raw_stream_to_store", with_logs(_STORED))
def raw_stream_to_store(spark, sf):
    path, tails = scratch(spark, "logs"), []
    lines = J.read_log_stream(spark, _raw_folder(spark, sf), max_files=1)
    J.stream_process(J.stream_ingest(lines), path, path + "-checkpoint", path + "-rejects",
                     tail=lambda rows, i: tails.append(rows.count())).awaitTermination()
    return _stored_groups(spark.read.parquet(path))


@query("streams_share_a_table", with_logs("SELECT id, level, message FROM logs"))
def streams_share_a_table(spark, sf):
    path = scratch(spark, "logs")
    for half in (0, 1):
        folder = scratch(spark, "half")
        logs(spark, sf).where(F.col("id") % 2 == half).write.parquet(folder)
        stream = J.read_log_stream(spark, folder, "parquet", schema=spark.read.parquet(folder).schema)
        J.stream_process(stream, path, f"{path}-checkpoint-{half}").awaitTermination()
    return spark.read.parquet(path).select("id", "level", "message")


@query("poison_documents", with_logs(
    "SELECT CASE id % 3 WHEN 0 THEN 'stored' WHEN 1 THEN 'stored' ELSE 'json' END AS fate, CASE WHEN id % 3 > 1 THEN concat('{broken ', CAST(id AS VARCHAR)) END AS raw, "
    "CASE WHEN id % 3 = 1 THEN '2' END AS a, count(*) AS n FROM logs GROUP BY ALL"))
def poison_documents(spark, sf):
    rows = logs(spark, sf).withColumn("iso", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    whole = F.to_json(F.struct("id", F.col("iso").alias("timestamp"), "level", "service_name", "message"))
    doubled = F.concat(F.regexp_replace(whole, r"\}$", ',"metadata":'), F.lit('{"a":1,"a":2}}'))
    broken = F.concat(F.lit("{broken "), F.col("id").cast("string"))
    docs = rows.select(F.when(F.col("id") % 3 == 0, whole).when(F.col("id") % 3 == 1, doubled).otherwise(broken).alias("value"))
    done = process(I.ingest_structured(docs))
    fate = F.when(F.array_contains("rejected", "json"), "json").when(F.size("rejected") == 0, "stored").otherwise("other")
    return done.groupBy(fate.alias("fate"), "raw", F.get_json_object("metadata", "$.a").alias("a")).agg(F.count("*").alias("n"))


@query("insert_batch_unnest", with_logs("SELECT id, log_ts AS \"timestamp\", level, message FROM logs"))
def insert_batch_unnest(spark, sf):
    rows = logs(spark, sf).withColumn("_r", F.struct("id", "timestamp", "level", "message"))
    packed = rows.groupBy(F.floor(F.col("id") / 500).alias("part")).agg(F.collect_list("_r").alias("r"))
    arrays = packed.select(*[F.col(f"r.{c}").alias(f"{c}s") for c in ["id", "timestamp", "level", "message"]])
    return TB.rows_from_arrays(arrays, id="ids", timestamp="timestamps", level="levels", message="messages")


@query("refresh_views", SQL["hourly_stats"])
def refresh_views(spark, sf):
    return A.refresh_views(logs(spark, sf), scratch(spark, "views"))[0]


@query("refresh_views_by_day", SQL["hourly_stats"])
def refresh_views_by_day(spark, sf):
    """The last day arrives after the first refresh; the second counts that day alone."""
    rows, path = logs(spark, sf), scratch(spark, "views")
    last = rows.agg(F.max(F.to_date("timestamp"))).first()[0]
    A.refresh_views(rows.where(F.to_date("timestamp") < F.lit(last)), path)
    batch = rows.where(F.to_date("timestamp") >= F.lit(last))
    return A.refresh_views(rows, path, days=A.changed_days(batch))[0]


@query("refresh_views_health", SQL["service_health"])
def refresh_views_health(spark, sf):
    return A.refresh_views(logs(spark, sf), scratch(spark, "views"))[1]


@query("save_load_model", with_logs(
    "SELECT service_name, date_trunc('hour', log_ts)::TIMESTAMP AS \"window\", 0.0::DOUBLE AS difference FROM logs GROUP BY 1, 2"))
def save_load_model(spark, sf):
    features = A.feature_matrix(logs(spark, sf))
    forest = N.iforest_fit(features)
    path = scratch(spark, "model")
    TB.save_model(spark, forest, path)
    again = N.iforest_score(features, TB.load_model(spark, path)).withColumnRenamed("if_score", "second")
    both = N.iforest_score(again.drop("if_label"), forest)
    return both.select("service_name", "window", F.abs(F.col("if_score") - F.col("second")).alias("difference"))


@query("process", with_logs(
    "SELECT id, error_fingerprint, try_cast(regexp_extract(message, '(?:took |duration=)([0-9]+)ms', 1) AS DOUBLE) AS duration FROM logs"))
def process_rows(spark, sf):
    rows = process(logs(spark, sf).drop("error_fingerprint"))
    return rows.select("id", "error_fingerprint", F.get_json_object("metadata", "$.extracted.duration_ms").cast("double").alias("duration"))


# --- streams -----------------------------------------------------------------

@query("read_log_stream", with_logs("SELECT level, count(*) AS n FROM logs GROUP BY 1"))
def read_log_stream(spark, sf):
    path = scratch(spark, "raw")
    rendered(spark, sf, "plain").select("value").repartition(4).write.text(path)
    lines = J.read_log_stream(spark, path, max_files=1)
    return run_append(I.auto_parse(lines), "read").groupBy("level").agg(F.count("*").alias("n"))


@query("stream_ingest", SQL["ingest_raw_lines"])
def stream_ingest(spark, sf):
    path = scratch(spark, "raw")
    rendered(spark, sf).select("value").repartition(3).write.text(path)
    rows = run_append(J.stream_ingest(J.read_log_stream(spark, path, max_files=1), as_of=NOW), "ingest")
    return rows.groupBy("format", "level", "service_name", "message", "host", F.col("timestamp").cast("timestamp_ntz").alias("timestamp")).agg(
        F.count("*").alias("n"))


@query("stream_process", with_logs(
    "SELECT id, log_ts AS \"timestamp\", level, error_fingerprint, try_cast(regexp_extract(message, 'status_code=([0-9]+)', 1) AS INTEGER) AS status FROM logs"))
def stream_process(spark, sf):
    path = scratch(spark, "stored")
    J.stream_process(log_stream(spark, sf), path, path + "-state", path + "-rejects").awaitTermination()
    return spark.read.parquet(path).select("id", "timestamp", "level", "error_fingerprint",
                                           F.get_json_object("metadata", "$.extracted.status_code").cast("int").alias("status"))


def current(counters, name, keys):
    """Run counters to the end of their input; what a reader of the table sees then."""
    path = scratch(counters.sparkSession, name)
    J.keep_current(counters, path, path + "-state").awaitTermination()
    return V.read_current(counters.sparkSession, path, keys)


@query("stream_minute_counters", with_logs(
    "SELECT service_name, date_trunc('minute', log_ts)::TIMESTAMP AS minute, count(*) AS log_count, count(*) FILTER (err) AS error_count FROM logs GROUP BY 1, 2"))
def stream_minute_counters(spark, sf):
    return naive(current(J.minute_counters(log_stream(spark, sf)), "minutes", ["service_name", "minute"]), "minute")


@query("stream_level_counters", with_logs(
    "SELECT service_name, date_trunc('hour', log_ts)::TIMESTAMP AS bucket, "
    + ", ".join(f"count(*) FILTER (level='{v}') AS {v}" for v in ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]) + " FROM logs GROUP BY 1, 2"))
def stream_level_counters(spark, sf):
    return naive(current(J.level_counters(log_stream(spark, sf)), "levels", ["service_name", "bucket"]), "bucket")


@query("stream_hourly_stats", with_logs(
    "SELECT date_trunc('hour', log_ts)::TIMESTAMP AS hour, service_name, level, count(*) AS log_count, count(*) FILTER (err) AS error_count FROM logs GROUP BY 1, 2, 3"))
def stream_hourly_stats(spark, sf):
    # update mode: every batch carries the new state of the groups it touched, the last one counts
    rows = run_batches(J.stream_hourly_stats(log_stream(spark, sf)), "hours", lambda b, i: b, "update")
    newest = rows.groupBy("hour", "service_name", "level").agg(F.max_by(F.struct("log_count", "error_count"), "batch").alias("s"))
    return naive(newest.select("hour", "service_name", "level", "s.*"), "hour")


_SLIDING = ("r AS (SELECT a.service_name, a.minute, sum(b.n)::BIGINT AS n, sum(b.e)::BIGINT AS e, round(100.0 * sum(b.e) / sum(b.n), 2)::DOUBLE AS rate "
            "FROM m a JOIN m b ON a.service_name = b.service_name AND b.minute BETWEEN a.minute - INTERVAL 4 MINUTE AND a.minute GROUP BY 1, 2)")


@query("stream_sliding_error_rate", with_logs("SELECT service_name, minute, n AS logs, e AS errors, rate AS error_rate FROM r", _RATES[0], _SLIDING))
def stream_sliding_error_rate(spark, sf):
    return naive(current(J.sliding_error_rate(log_stream(spark, sf)), "rates", ["service_name", "minute"]), "minute")


LIVE_FILES = 6


def _live_stream(spark, sf):
    """The log table as a live stream: files in time order, one file a batch, the rows of a minute dealt over
    neighbouring files, and at last a heartbeat that closes the last minute.

    Rows come later than others by up to the time a file spans, which is the delay to allow for.
    """
    folder, rows = scratch(spark, "live"), logs(spark, sf)
    rows = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    first, last = rows.agg(F.min("timestamp"), F.max("timestamp")).first()
    span = (F.unix_seconds("timestamp") - F.unix_seconds(F.lit(first))) / F.greatest(F.lit(1), F.unix_seconds(F.lit(last)) - F.unix_seconds(F.lit(first)))
    dealt = rows.withColumn("_file", F.least(F.floor(span * (LIVE_FILES - 1)), F.lit(LIVE_FILES - 2)) + F.col("id") % 2)
    for number in range(LIVE_FILES):
        dealt.where(F.col("_file") == number).drop("_file").coalesce(1).write.mode("append").parquet(folder)
    silence = rows.limit(1).withColumns({"timestamp": F.lit(last) + F.expr("INTERVAL 60 DAYS"), "service_name": F.lit(None).cast("string")})
    silence.coalesce(1).write.mode("append").parquet(folder)
    return J.read_log_stream(spark, folder, "parquet", 1, rows.schema), f"{(last - first).days + 1} days"


@query("live_error_rate", with_logs("SELECT service_name, minute, n AS logs, e AS errors, rate AS error_rate FROM r", _RATES[0], _SLIDING))
def live_error_rate(spark, sf):
    stream, delay = _live_stream(spark, sf)
    return naive(run_append(L.live_error_rate(stream, delay=delay), "live-rates"), "minute")


@query("stream_alert_threshold", SQL["alert_threshold"])
def stream_alert_threshold(spark, sf):
    stream, delay = _live_stream(spark, sf)
    return naive(run_append(L.live_alert_threshold(stream, delay=delay), "live-alerts"), "triggered_at").select(
        "title", "description", "severity", "service_name", "rule_type", "status", "triggered_at")


@query("stream_cooldown", SQL["cooldown"])
def stream_cooldown(spark, sf):
    errors = log_stream(spark, sf).where("level IN ('ERROR', 'FATAL')").select("service_name", "id", "timestamp")
    return run_append(SC.stream_cooldown(errors, "service_name"), "cooldown")


@query("stream_alert_pattern", SQL["alert_pattern"])
def stream_alert_pattern(spark, sf):
    return run_append(SC.stream_alert_pattern(log_stream(spark, sf), chars=200), "alerts").select(
        "title", "description", "severity", "service_name", "rule_type", "triggered_at")


@query("stream_dedup", with_logs("SELECT id, level FROM logs"))
def stream_dedup(spark, sf):
    twice = log_stream(spark, sf).unionByName(log_stream(spark, sf))
    return run_append(J.stream_dedup(twice), "dedup").select("id", "level")


@query("live_tail", with_logs(
    "SELECT id, log_ts AS \"timestamp\", level, service_name, message, host, trace_id, metadata FROM logs ORDER BY ingested_at DESC, id DESC LIMIT 10"))
def live_tail(spark, sf):
    return run_batches(log_stream(spark, sf), "tail", lambda b, i: J.live_tail(b)).drop("batch")


@query("tail_filter", with_logs(
    "SELECT id, message FROM logs WHERE level='FATAL' AND service_name='order-service' ORDER BY ingested_at DESC, id DESC LIMIT 10"))
def tail_filter(spark, sf):
    wanted = "level = 'FATAL' AND service_name = 'order-service'"
    return run_batches(log_stream(spark, sf), "tail", lambda b, i: J.live_tail(b, where=wanted)).select("id", "message")


@query("stream_scores", with_logs(
    "SELECT service_name, minute AS detected_at, 0.8::DOUBLE AS severity_score FROM hot JOIN chain USING (service_name, sec)",
    _RATES[0], "hot AS (SELECT *, floor(epoch(minute))::BIGINT AS sec FROM m WHERE 100.0 * e / n > 5.2 + 3 * sqrt(2.96))",
    _chain("hot"), recursive=True))
def stream_scores(spark, sf):
    stream, delay = _live_stream(spark, sf)
    path = scratch(spark, "scores")
    J.stream_scores(stream, None, V.store_versions(path), path + "-state", delay=delay, availableNow=True).awaitTermination()
    return naive(spark.read.parquet(path), "detected_at").select("service_name", "detected_at", "severity_score")


@query("stream_alert_feed", SQL["alert_feed"])
def stream_alert_feed(spark, sf):
    path = scratch(spark, "feed")
    _alerts(spark, sf).write.parquet(path + "/alerts")
    _anomalies(spark, sf).write.parquet(path + "/anomalies")
    parts = [spark.readStream.schema(spark.read.parquet(f"{path}/{n}").schema).parquet(f"{path}/{n}") for n in ("alerts", "anomalies")]
    return run_append(AL.alert_feed(*parts), "feed")
