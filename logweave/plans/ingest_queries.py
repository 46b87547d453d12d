"""Checked queries: parsing, normalising, validating, enriching.

The log table is rendered back into raw lines, parsed again, and compared with the table
itself, so the SQL side needs no patterns.
"""

from pyspark.sql import functions as F

from logweave.functions import enrichment as E
from logweave.functions import parsing as P
from logweave.functions.levels import normalize_level as level_of, syslog_severity as severity_of
from logweave.functions.masking import error_fingerprint as fingerprint, template_message as template
from logweave.functions.timestamps import normalize_timestamp as time_of
from logweave.operators import ingest as I
from logweave.plans.base import fingerprint_sql, logs, query, table, template_sql, with_logs
from logweave.session import spread

NOW = "2024-06-01T00:00:00Z"

_PRIORITY = "128 + CASE level WHEN 'FATAL' THEN 2 WHEN 'ERROR' THEN 3 WHEN 'WARN' THEN 4 WHEN 'INFO' THEN 6 ELSE 7 END"
_STATUS = "CASE WHEN level IN ('ERROR','FATAL') THEN 503 WHEN level='WARN' THEN 404 ELSE 200 END"
RENDER = {
    "json": "to_json(named_struct('msg', message, 'severity', lower(level), 'ts', iso, 'app', service_name, "
            "'traceId', trace_id, 'hostname', host, 'k', id, 'nested', named_struct('env', environment)))",
    "syslog_5424": f"concat('<', {_PRIORITY}, '>1 ', iso, ' ', coalesce(host, '-'), ' ', service_name, ' ', id, "
                   "' - [meta x=\"1\"] ', message)",
    "syslog_3164": f"concat('<', {_PRIORITY}, '>', date_format(ts, 'MMM d HH:mm:ss'), ' ', coalesce(host, '-'), ' ', "
                   "service_name, '[', id, ']: ', message)",
    "access": "concat('10.1.', id % 256, '.7 - bob [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] \"GET /items/', id, "
              f"'?a=1 HTTP/1.1\" ', {_STATUS}, ' ', if(id % 3 = 0, '-', string(id)), ' \"-\" \"curl/8\"')",
    "plain": "concat(replace(iso, 'T', ' '), ' ', level, ' [', service_name, '] ', message)",
    "level": "concat('[', level, '] ', message)",
    "free": "concat('  ', message)",
}


def rendered(spark, sf, fmt=None):
    """``id, value``: every log row as a raw line, in one format or cycling through all."""
    rows = spread(logs(spark, sf)).withColumn("ts", F.col("timestamp").cast("timestamp"))
    rows = rows.withColumn("iso", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    if fmt:
        return rows.select("id", F.expr(RENDER[fmt]).alias("value"))
    cases = " ".join(f"WHEN {i} THEN {sql}" for i, sql in enumerate(RENDER.values()))
    return rows.select("id", F.expr(f"CASE id % 7 {cases} END").alias("value"))


def _ntz(c):
    return F.col(c).cast("timestamp_ntz") if isinstance(c, str) else c.cast("timestamp_ntz")


# --- one format at a time ----------------------------------------------------

@query("parse_json_lines", with_logs(
    "SELECT id, lower(level) AS level, service_name, message, trace_id, host, log_ts AS \"timestamp\", id AS k, environment AS env FROM logs"))
def parse_json_lines(spark, sf):
    rows = rendered(spark, sf, "json").select("id", P.parse_json_lines("value").alias("e"))
    return rows.select("id", "e.level", "e.service_name", "e.message", "e.trace_id", "e.host",
                       _ntz(time_of("e.timestamp", F.lit(NOW).cast("timestamp"))).alias("timestamp"),
                       F.get_json_object("e.metadata", "$.k").cast("bigint").alias("k"),
                       F.get_json_object("e.metadata", "$.nested.env").alias("env"))


@query("parse_syslog_5424", with_logs(
    "SELECT id, CASE level WHEN 'TRACE' THEN 'DEBUG' ELSE level END AS level, service_name, message, host, "
    "log_ts AS \"timestamp\", 16 AS facility, CAST(id AS VARCHAR) AS procid FROM logs"))
def parse_syslog_5424(spark, sf):
    rows = rendered(spark, sf, "syslog_5424").select("id", P.parse_syslog("value").alias("e"))
    return rows.select("id", "e.level", "e.service_name", "e.message", "e.host",
                       _ntz(time_of("e.timestamp", F.lit(NOW).cast("timestamp"))).alias("timestamp"),
                       F.get_json_object("e.metadata", "$.syslog_facility").cast("int").alias("facility"),
                       F.get_json_object("e.metadata", "$.syslog_procid").alias("procid"))


@query("parse_syslog_3164", with_logs(
    "SELECT id, CASE level WHEN 'TRACE' THEN 'DEBUG' ELSE level END AS level, service_name, message, host, "
    "date_trunc('second', log_ts)::TIMESTAMP AS \"timestamp\", CAST(id AS VARCHAR) AS pid FROM logs"))
def parse_syslog_3164(spark, sf):
    rows = rendered(spark, sf, "syslog_3164").select("id", P.parse_syslog("value").alias("e"))
    return rows.select("id", "e.level", "e.service_name", "e.message", "e.host",
                       _ntz(time_of("e.timestamp", F.lit(NOW).cast("timestamp"))).alias("timestamp"),
                       F.get_json_object("e.metadata", "$.pid").alias("pid"))


@query("parse_access_log", with_logs(
    f"SELECT id, CASE WHEN err THEN 'ERROR' WHEN level='WARN' THEN 'WARN' ELSE 'INFO' END AS level, 'httpd' AS service_name, "
    f"concat('GET /items/', id, '?a=1 HTTP/1.1 → ', {_STATUS}) AS message, concat('10.1.', id % 256, '.7') AS host, "
    "date_trunc('second', log_ts)::TIMESTAMP AS \"timestamp\", concat('/items/', id, '?a=1') AS path, "
    "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS sent FROM logs"))
def parse_access_log(spark, sf):
    rows = rendered(spark, sf, "access").select("id", P.parse_access_log("value").alias("e"))
    return rows.select("id", "e.level", "e.service_name", "e.message", "e.host",
                       _ntz(time_of("e.timestamp", F.lit(NOW).cast("timestamp"))).alias("timestamp"),
                       F.get_json_object("e.metadata", "$.http_path").alias("path"),
                       F.get_json_object("e.metadata", "$.bytes_sent").cast("bigint").alias("sent"))


@query("parse_plain_text", with_logs(
    "SELECT id, level, service_name, message, log_ts AS \"timestamp\" FROM logs"))
def parse_plain_text(spark, sf):
    rows = rendered(spark, sf, "plain").select("id", P.parse_plain_text("value").alias("e"))
    return rows.select("id", "e.level", "e.service_name", "e.message",
                       _ntz(time_of("e.timestamp", F.lit(NOW).cast("timestamp"))).alias("timestamp"))


@query("syslog_severity", with_logs(
    "SELECT id, CASE level WHEN 'TRACE' THEN 'DEBUG' ELSE level END AS level FROM logs"))
def syslog_severity(spark, sf):
    return logs(spark, sf).select("id", severity_of(F.expr(_PRIORITY)).alias("level"))


# --- all formats together ----------------------------------------------------

_BACK = """id, CASE id % 7 WHEN 0 THEN 'json' WHEN 1 THEN 'syslog' WHEN 2 THEN 'syslog' WHEN 3 THEN 'apache_combined'
  WHEN 4 THEN 'plain_text' WHEN 5 THEN 'plain_text' ELSE 'raw_fallback' END AS format,
 CASE id % 7 WHEN 1 THEN replace(level, 'TRACE', 'DEBUG') WHEN 2 THEN replace(level, 'TRACE', 'DEBUG')
  WHEN 3 THEN CASE WHEN err THEN 'ERROR' WHEN level='WARN' THEN 'WARN' ELSE 'INFO' END WHEN 6 THEN 'INFO' ELSE level END AS level,
 CASE WHEN id % 7 = 3 THEN 'httpd' WHEN id % 7 >= 5 THEN 'unknown' ELSE service_name END AS service_name,
 CASE WHEN id % 7 = 3 THEN concat('GET /items/', id, '?a=1 HTTP/1.1 → ', CASE WHEN err THEN 503 WHEN level='WARN' THEN 404 ELSE 200 END) ELSE message END AS message,
 CASE WHEN id % 7 = 3 THEN concat('10.1.', id % 256, '.7') WHEN id % 7 < 3 THEN host END AS host"""
_BACK_TIME = """CASE WHEN id % 7 IN (2, 3) THEN date_trunc('second', log_ts)::TIMESTAMP WHEN id % 7 >= 5 THEN TIMESTAMP '2024-06-01'
  ELSE log_ts END AS "timestamp" """


@query("auto_parse", with_logs(f"SELECT {_BACK.replace('ELSE level END AS level', 'WHEN 0 THEN lower(level) ELSE level END AS level')} FROM logs"))
def auto_parse(spark, sf):
    return I.auto_parse(rendered(spark, sf)).select("id", "format", "level", "service_name", "message", "host")


@query("normalize_entry", with_logs(
    f"SELECT {_BACK}, {_BACK_TIME}, 'production' AS environment, CASE WHEN id % 7 = 0 THEN trace_id END AS own_trace FROM logs"))
def normalize_entry(spark, sf):
    rows = I.normalize_entry(I.auto_parse(rendered(spark, sf)), NOW)
    return rows.select("id", "format", "level", "service_name", "message", "host",
                       _ntz("timestamp").alias("timestamp"), "environment",
                       F.when(F.col("format") == "json", F.col("trace_id")).alias("own_trace"))


@query("ingest_raw_lines", with_logs(
    f"SELECT format, level, service_name, message, host, \"timestamp\", count(*) AS n FROM (SELECT {_BACK}, {_BACK_TIME} FROM logs) GROUP BY ALL"))
def ingest_raw_lines(spark, sf):
    # blocks of lines with blank ones between, as a client would post them
    blocks = rendered(spark, sf).groupBy(F.floor(F.col("id") / 50).alias("block")).agg(
        F.concat_ws("\n \r\n", F.collect_list("value")).alias("value"))
    rows = I.ingest_raw_lines(blocks, as_of=NOW)
    return rows.groupBy("format", "level", "service_name", "message", "host", _ntz("timestamp").alias("timestamp")).agg(
        F.count("*").alias("n"))


@query("ingest_raw_documents",
       "SELECT doc_id, count(*) AS lines, sum(length(l))::BIGINT AS chars FROM (SELECT doc_id, trim(unnest(string_split_regex(text, '\\r\\n|\\n|\\r')), ' \t') AS l FROM documents) WHERE l <> '' GROUP BY 1")
def ingest_raw_documents(spark, sf):
    rows = I.ingest_raw_lines(spread(table(spark, sf, "documents").select("doc_id", "text")), "text", as_of=NOW)
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length(F.trim(F.regexp_replace("text", r"^[ \t]+|[ \t]+$", "")))).alias("chars"))


def _documents(spark, sf):
    """Structured JSON documents, some of them breaking one rule."""
    rows = logs(spark, sf).withColumn("iso", F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    level = F.expr("CASE WHEN id % 11 = 1 THEN lower(level) ELSE level END")
    service = F.expr("CASE WHEN id % 11 = 2 THEN repeat(service_name, 30) ELSE service_name END")
    message = F.expr("CASE WHEN id % 11 = 3 THEN '' WHEN id % 11 = 4 THEN '   ' ELSE message END")
    span = F.expr("CASE WHEN id % 11 = 5 THEN repeat(span_id, 3) ELSE span_id END")
    return rows.select(F.to_json(F.struct(
        "id", F.col("iso").alias("timestamp"), level.alias("level"), service.alias("service_name"),
        message.alias("message"), "trace_id", span.alias("span_id"), "host",
        F.struct(F.col("id").alias("n")).alias("metadata"))).alias("value"))


@query("ingest_structured", with_logs(
    "SELECT id, CASE id % 11 WHEN 1 THEN 'level' WHEN 2 THEN 'service_name' WHEN 3 THEN 'message' WHEN 5 THEN 'span_id' ELSE '' END AS rejected, "
    "level, CASE WHEN id % 11 IN (3, 4) THEN '(empty)' ELSE message END AS message, log_ts AS \"timestamp\", 'production' AS environment, id AS n FROM logs"))
def ingest_structured(spark, sf):
    rows = I.ingest_structured(_documents(spark, sf), as_of=NOW)
    return rows.select("id", F.concat_ws(",", "rejected").alias("rejected"), "level", "message",
                       _ntz("timestamp").alias("timestamp"), "environment",
                       F.get_json_object("metadata", "$.n").cast("bigint").alias("n"))


@query("validate_entries", with_logs(
    "SELECT id, CASE id % 7 WHEN 0 THEN 'level' WHEN 1 THEN 'service_name' WHEN 2 THEN 'service_name,message' WHEN 3 THEN 'trace_id' "
    "WHEN 4 THEN 'environment,host' ELSE '' END AS rejected FROM logs"))
def validate_entries(spark, sf):
    rows = logs(spark, sf).withColumns({
        "level": F.expr("if(id % 7 = 0, 'NOTICE', level)"),
        "service_name": F.expr("CASE id % 7 WHEN 1 THEN repeat('s', 256) WHEN 2 THEN '' ELSE service_name END"),
        "message": F.expr("if(id % 7 = 2, NULL, message)"),
        "trace_id": F.expr("if(id % 7 = 3, repeat('t', 65), trace_id)"),
        "environment": F.expr("if(id % 7 = 4, repeat('e', 51), environment)"),
        "host": F.expr("if(id % 7 = 4, repeat('h', 256), host)"),
    })
    return I.validate_entries(rows).select("id", F.concat_ws(",", "rejected").alias("rejected"))


@query("validate_raw", "SELECT doc_id, length(text) BETWEEN 1 AND 1048576 AS valid FROM documents")
def validate_raw(spark, sf):
    rows = I.validate_raw(table(spark, sf, "documents"), "text")
    return rows.select("doc_id", (F.size("rejected") == 0).alias("valid"))


# --- normalising -------------------------------------------------------------

@query("normalize_timestamp", with_logs(
    "SELECT id, CASE WHEN id % 9 IN (3, 4, 6, 7) THEN date_trunc('second', log_ts)::TIMESTAMP WHEN id % 9 = 1 THEN date_trunc('millisecond', log_ts)::TIMESTAMP "
    "WHEN id % 9 = 8 THEN TIMESTAMP '2024-06-01' ELSE log_ts END AS \"timestamp\" FROM logs"))
def normalize_timestamp(spark, sf):
    ts = F.col("timestamp").cast("timestamp")
    forms = {
        0: F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        1: F.unix_millis(ts).cast("string"),
        2: F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd HH:mm:ss.SSSSSS'+02:00'"),
        3: F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss' +0000'"),
        4: F.date_format(ts, "MMM d HH:mm:ss"),
        5: F.date_format(ts, "yyyy-MM-dd HH:mm:ss,SSSSSS"),
        6: F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss' +0000'"),
        7: F.unix_seconds(ts).cast("string"),
        8: F.lit("not a time"),
    }
    text = F
    for i, form in forms.items():
        text = text.when(F.col("id") % 9 == i, form)
    rows = logs(spark, sf).select("id", text.alias("text"))
    return rows.select("id", _ntz(time_of("text", F.lit(NOW).cast("timestamp"))).alias("timestamp"))


@query("normalize_level", with_logs(
    "SELECT id, CASE WHEN id % 4 = 3 THEN 'INFO' WHEN id % 4 = 1 AND level = 'TRACE' THEN 'INFO' ELSE level END AS level FROM logs"))
def normalize_level(spark, sf):
    word = F.expr("""CASE id % 4 WHEN 0 THEN concat(' ', lower(level), ' ')
      WHEN 1 THEN CASE level WHEN 'FATAL' THEN 'Panic' WHEN 'ERROR' THEN 'severe' WHEN 'WARN' THEN '4' WHEN 'INFO' THEN 'notice' WHEN 'DEBUG' THEN '7' ELSE 'finest' END
      WHEN 2 THEN level ELSE '30' END""")
    return logs(spark, sf).select("id", level_of(word).alias("level"))


# --- enriching ---------------------------------------------------------------

def _fields_sql(text):
    # The extraction patterns of ``functions.enrichment`` in SQL notation.
    return (
        f"try_cast(regexp_extract({text}, '\\b(status[_\\s]?(?:code)?|HTTP)[:\\s=]*(\\d{{3}})\\b', 2, 'i') AS INTEGER) AS status_code, "
        f"try_cast(regexp_extract({text}, '\\b(?:duration|elapsed|took|time|latency|response_time)[:\\s=]*(\\d+(?:\\.\\d+)?)\\s*(?:ms|milliseconds|s|seconds)?\\b', 1, 'i') AS DOUBLE) AS duration_ms, "
        f"nullif(regexp_extract({text}, '\\b(\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}})\\b', 1), '') AS ip_address, "
        f"nullif(regexp_extract({text}, '(?:GET|POST|PUT|DELETE|PATCH)\\s+(/[^\\s]*)', 1, 'i'), '') AS url_path, "
        f"nullif(trim(regexp_extract({text}, '(?:Exception|Error|Traceback|Caused by)[:\\s]+(.+?)(?:\\n|$)', 1, 'i')), '') AS exception_type, "
        f"nullif(regexp_extract({text}, '\\buser[_\\s]?(?:id)?[:\\s=]*([a-zA-Z0-9_-]+)\\b', 1, 'i'), '') AS user_id"
    )


@query("extract_fields", with_logs(f"SELECT id, {_fields_sql('message')} FROM logs"))
def extract_fields(spark, sf):
    return logs(spark, sf).select("id", E.extract_fields("message").alias("x")).select("id", "x.*")


@query("extract_fields_documents", f"SELECT doc_id, {_fields_sql('text')} FROM documents")
def extract_fields_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", E.extract_fields("text").alias("x")).select("doc_id", "x.*")


_TRACED = {
    "spark": "CASE WHEN level IN ('ERROR','FATAL') THEN concat('Traceback (most recent call last)\\n  File \"a.py\", line 1\\n', repeat('    at x.y(Z.java:7)\\n', cast(id % 5 as int)), 'Caused by: java.io.', message) ELSE message END",
    "duck": "CASE WHEN err THEN concat('Traceback (most recent call last)', chr(10), '  File \"a.py\", line 1', chr(10), repeat(concat('    at x.y(Z.java:7)', chr(10)), (id % 5)::INT), 'Caused by: java.io.', message) ELSE message END",
}


@query("extract_stack_trace", with_logs(
    "SELECT id, err AS marked, CASE WHEN err AND starts_with(message, 'ValueError: ') THEN 'java.io.ValueError' "
    "WHEN err AND starts_with(message, 'OutOfMemoryError: ') THEN 'java.io.OutOfMemoryError' END AS exception_type, "
    "CASE WHEN err AND contains(message, 'Error: ') THEN split_part(message, ': ', 2) END AS exception_message, "
    "CASE WHEN err THEN 1 + (id % 5)::INT END AS stack_depth FROM logs"))
def extract_stack_trace(spark, sf):
    rows = logs(spark, sf).select("id", E.extract_stack_trace(F.expr(_TRACED["spark"])).alias("t"))
    return rows.select("id", F.col("t").isNotNull().alias("marked"), "t.exception_type", "t.exception_message", "t.stack_depth")


@query("extract_stack_trace_documents",
       "SELECT doc_id, contains(text, 'at ') OR contains(text, 'Exception in thread') OR contains(text, 'Caused by:') OR contains(text, 'File \"') "
       "OR contains(text, 'Traceback (most recent call last)') AS marked, "
       "len(list_filter(string_split(text, chr(10)), lambda l: starts_with(trim(l), 'at ') OR starts_with(trim(l), 'File ')))::INT AS frames FROM documents")
def extract_stack_trace_documents(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text", E.extract_stack_trace("text").alias("t"))
    frames = F.regexp_count("text", F.lit(E._FRAME))
    return rows.select("doc_id", F.col("t").isNotNull().alias("marked"), frames.alias("frames"))


@query("enrich", with_logs(
    "SELECT id, try_cast(regexp_extract(message, 'status_code=([0-9]+)', 1) AS INTEGER) AS status, "
    "try_cast(regexp_extract(message, '(?:took |duration=)([0-9]+)ms', 1) AS DOUBLE) AS duration, "
    "CAST(json_extract(metadata, '$.k') AS BIGINT) AS k, '2024-06-01T00:00:00.000000' AS processed_at FROM logs"))
def enrich(spark, sf):
    rows = E.enrich(spread(logs(spark, sf)), now=F.lit(NOW).cast("timestamp"))
    get = lambda path: F.get_json_object("metadata", path)
    return rows.select("id", get("$.extracted.status_code").cast("int").alias("status"),
                       get("$.extracted.duration_ms").cast("double").alias("duration"),
                       get("$.k").cast("bigint").alias("k"), get("$.processed_at").alias("processed_at"))


@query("error_fingerprint", with_logs("SELECT id, error_fingerprint FROM logs"))
def error_fingerprint(spark, sf):
    return logs(spark, sf).select("id", "error_fingerprint")


@query("error_fingerprint_documents", f"SELECT doc_id, {fingerprint_sql('text', 'source')} AS fingerprint FROM documents")
def error_fingerprint_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fingerprint("text", "source").alias("fingerprint"))


@query("template_message", with_logs(f"SELECT id, {template_sql('message')} AS template FROM logs"))
def template_message(spark, sf):
    return logs(spark, sf).select("id", template("message").alias("template"))


@query("template_message_documents", f"SELECT doc_id, md5({template_sql('text')}) AS template FROM documents")
def template_message_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(template("text")).alias("template"))
