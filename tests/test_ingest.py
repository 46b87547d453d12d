"""Handmade lines with results worked out by hand."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from logweave.functions.enrichment import extract_fields, extract_stack_trace
from logweave.functions.masking import error_fingerprint
from logweave.functions.timestamps import normalize_timestamp
from logweave.operators.enrich import process
from logweave.operators.ingest import (auto_parse, ingest_raw_lines, ingest_structured, normalize_entry, validate_entries,
                                       validate_raw, with_overrides)

NOW = "2024-06-01T00:00:00Z"
NOON = datetime(2024, 1, 15, 10, 30)
JSON = '{"msg":"boom","severity":"warning","ts":%s,"app":"pay","traceId":"t1","env":"prod","hostname":"h1","k":1}'

LINES = [
    (JSON % "1705314600", "json", "WARN", "pay", "boom", NOON, "h1"),
    (JSON % "1705314600000", "json", "WARN", "pay", "boom", NOON, "h1"),
    ('{"msg":"x","level":0}', "json", "INFO", "unknown", "x", None, None),
    ('{"msg":"x","level":"0"}', "json", "FATAL", "unknown", "x", None, None),
    ('{"msg":"x","level":30}', "json", "INFO", "unknown", "x", None, None),
    ('{"msg":"a","msg":"b"}', "json", "INFO", "unknown", "b", None, None),
    ('{"msg":"","log":[],"text":false,"body":"last"}', "json", "INFO", "unknown", "last", None, None),
    ('{"msg":"x"} tail', "raw_fallback", "INFO", "unknown", '{"msg":"x"} tail', None, None),
    ('{"msg":"x"}] }', "raw_fallback", "INFO", "unknown", '{"msg":"x"}] }', None, None),
    ("{'msg':'x'}", "raw_fallback", "INFO", "unknown", "{'msg':'x'}", None, None),
    ('{"level":"ERROR"}', "raw_fallback", "INFO", "unknown", '{"level":"ERROR"}', None, None),
    ('<34>1 2024-01-15T10:30:00Z web1 nginx 123 ID47 [x y="1"] upstream failed', "syslog", "FATAL", "nginx",
     "upstream failed", NOON, "web1"),
    ("<13>Jan 15 10:30:00 host1 cron[99]: job done", "syslog", "INFO", "cron", "job done", NOON, "host1"),
    ("Jan 15 10:30:00 - cron: job done", "syslog", "INFO", "cron", "job done", NOON, None),
    ('10.0.0.9 - bob [15/Jan/2024:10:30:00 +0000] "GET /a?b=1 HTTP/1.1" 503 - "-" "curl/8"', "apache_combined", "ERROR",
     "httpd", "GET /a?b=1 HTTP/1.1 → 503", NOON, "10.0.0.9"),
    ('10.0.0.9 - bob [15/Jan/2024:12:30:00 +0200] "GET /a?b=1 HTTP/1.1" 404 7', "apache_combined", "WARN",
     "httpd", "GET /a?b=1 HTTP/1.1 → 404", NOON, "10.0.0.9"),
    ("2024-01-15 10:30:00 WARN [billing] slow", "plain_text", "WARN", "billing", "slow", NOON, None),
    ("2024-01-15T10:30:00Z ERROR disk full", "plain_text", "ERROR", "unknown", "disk full", NOON, None),
    ("[WARNING] low memory", "plain_text", "WARN", "unknown", "low memory", None, None),
    ("severe \u001f marked \u001f text", "plain_text", "ERROR", "unknown", "\u001f marked \u001f text", None, None),
    ("hello world", "raw_fallback", "INFO", "unknown", "hello world", None, None),
]


def test_lines(spark):
    df = spark.createDataFrame([(i, line) for i, (line, *_) in enumerate(LINES)], "n int, value string")
    got = {r["n"]: r for r in normalize_entry(auto_parse(df), NOW).collect()}
    for i, (line, fmt, level, service, message, at, host) in enumerate(LINES):
        r = got[i]
        expected = (fmt, level, service, message.strip(), at or datetime(2024, 6, 1), host)
        assert (r["format"], r["level"], r["service_name"], r["message"], r["timestamp"], r["host"]) == expected, line
        assert json.loads(r["metadata"])["_parsed_format"] == fmt


def test_metadata_of_formats(spark):
    df = spark.createDataFrame([(LINES[i][0],) for i in (0, 11, 12, 14)], "value string")
    got = [json.loads(r["metadata"]) for r in auto_parse(df).collect()]
    assert got[0] == {"k": 1, "_parsed_format": "json"}
    assert got[1] == {"syslog_facility": 4, "syslog_severity": 2, "syslog_version": 1, "syslog_procid": "123",
                      "syslog_msgid": "ID47", "_parsed_format": "syslog"}
    assert got[2] == {"syslog_facility": 1, "syslog_severity": 5, "pid": "99", "_parsed_format": "syslog"}
    assert got[3] == {"http_method": "GET", "http_path": "/a?b=1", "http_status": 503, "bytes_sent": 0, "referer": "-",
                      "user_agent": "curl/8", "client_ip": "10.0.0.9", "_parsed_format": "apache_combined"}


def test_blank_lines_and_breaks(spark):
    df = spark.createDataFrame([("a\r\n\n  \nb c\rd",)], "value string")
    assert [r["message"] for r in ingest_raw_lines(df, as_of=NOW).collect()] == ["a", "b", "c", "d"]
    assert auto_parse(spark.createDataFrame([("  ",)], "value string")).first()["format"] is None


def test_defaults(spark):
    df = spark.createDataFrame([("hello",), ("hello",), ("x",)], "value string")
    rows = normalize_entry(auto_parse(df), NOW).collect()
    assert {r["environment"] for r in rows} == {"production"}
    assert rows[0]["trace_id"] == rows[1]["trace_id"] != rows[2]["trace_id"]
    assert normalize_entry(auto_parse(df), NOW, raw_env_null=True).first()["environment"] is None
    over = with_overrides(auto_parse(df), service_name="svc", environment="dev", host="h").first()
    assert (over["service_name"], over["environment"], over["host"]) == ("svc", "dev", "h")


def test_structured(spark):
    docs = [{"service_name": "s" * 300, "message": "m"}, {"service_name": "a", "message": "   "},
            {"service_name": "a", "message": "m", "level": "warn"}, {"message": "m"}]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "value string")
    rows = ingest_structured(df, as_of=NOW).collect()
    assert [r["rejected"] for r in rows] == [["service_name"], [], ["level"], ["service_name"]]
    assert rows[1]["message"] == "(empty)" and rows[1]["level"] == "INFO"


def test_raw_length(spark):
    df = spark.createDataFrame([("",), ("x",), ("y" * 1_048_577,)], "value string")
    assert [len(r["rejected"]) for r in validate_raw(df).collect()] == [1, 0, 1]


@pytest.mark.parametrize("text,expected", [
    ("1705314600.25", datetime(2024, 1, 15, 10, 30, 0, 250000)),
    ("2024-01-15T12:30:00+02:00", NOON), ("2024/01/15 10:30:00", NOON), ("Mon, 15 Jan 2024 10:30:00 +0000", NOON),
    ("  2024-01-15 10:30:00,5 ", datetime(2024, 1, 15, 10, 30, 0, 500000)), ("Jan  5 10:30:00", datetime(2024, 1, 5, 10, 30)),
    ("01/15/2024 10:30:00 AM", NOON), ("01/15/2024 10:30:00 PM", datetime(2024, 1, 15, 22, 30)), ("15 Jan 2024 10:30", NOON), ("2024/01/15 10:30", NOON),
    ("2024.01.15 10:30:00", NOON), ("Jan 15, 2024 10:30:00 AM", NOON), ("15-01-2024 10:30:00", NOON), ("Monday, January 15, 2024", datetime(2024, 1, 15)),
    ("", datetime(2024, 6, 1)), ("soon", datetime(2024, 6, 1)), (None, datetime(2024, 6, 1)), ("1e300", datetime(2024, 6, 1)),
])
def test_timestamps(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(normalize_timestamp("t", F.lit(NOW).cast("timestamp"))).first()[0] == expected


@pytest.mark.parametrize("message,fingerprint", [
    ("Order 12345 failed from 10.0.0.1", "621b2824c154926b"), ("Order 98765 failed from 10.9.8.7", "621b2824c154926b"),
    ("job 550E8400-e29b-41d4-a716-446655440000 lost", "bf68c02d1f26a6dd"), ("at 2024-01-15T10:30:00Z ok", "9b6b6d2c285ba314"),
    ("x2024-01-15T10:30:00Z ok", "84db6970c825a9f9"), ("payload deadbeefcafe bad", "3b0d66845e100233"),
    ("é12345 x", "d82b340b196ff5aa"), (" é12345 x ", "d82b340b196ff5aa"),
])
def test_fingerprints(spark, message, fingerprint):
    df = spark.createDataFrame([(message,)], "m string")
    assert df.select(error_fingerprint("m", F.lit("payment-service"))).first()[0] == fingerprint


@pytest.mark.parametrize("message,expected", [
    ("status_code: 404 took 12.5ms", {"status_code": 404, "duration_ms": 12.5}), ("took 3s", {"duration_ms": 3.0}),
    ("GET /items/7 took 58ms", {"url_path": "/items/7", "duration_ms": 58.0}), ("username foo", {"user_id": "name"}),
    ("Retry for user_id=42 status_code=429", {"user_id": "42", "status_code": 429}),
    ("ValueError: bad thing", {"exception_type": "bad thing"}), ("HTTP/1.1 500", {}), ("HTTP 503 from upstream", {"status_code": 503}),
])
def test_fields(spark, message, expected):
    df = spark.createDataFrame([(message,)], "m string")
    got = df.select(extract_fields("m").alias("x")).first()["x"].asDict()
    assert {k: v for k, v in got.items() if v is not None} == expected


def test_units(spark):
    df = spark.createDataFrame([("took 3s",), ("took 3ms",), ("took 3 seconds",)], "m string")
    assert [r[0]["duration_ms"] for r in df.select(extract_fields("m", True)).collect()] == [3000.0, 3.0, 3000.0]


def test_stack_traces(spark):
    trace = "Caused by: java.io.IOException: x\nat a.b(C.java:1)"
    df = spark.createDataFrame([("Disk usage at 90% on /data",), (trace,), ("plain",)], "m string")
    loose = [r[0] for r in df.select(extract_stack_trace("m")).collect()]
    assert loose[0].asDict() == {"has_stack_trace": True, "exception_type": None, "exception_message": None, "stack_depth": 0}
    assert loose[1].asDict() == {"has_stack_trace": True, "exception_type": "java.io.IOException", "exception_message": "x", "stack_depth": 1}
    assert loose[2] is None
    strict = [r[0] is not None for r in df.select(extract_stack_trace("m", strict=True)).collect()]
    assert strict == [False, True, False]


def test_process_merges_metadata(spark):
    df = spark.createDataFrame([("ERROR", "svc", "Caused by: A.bError: user_id=9", '{"k":[1,2],"extracted":7}'), ("INFO", "svc", "fine", None)],
                               "level string, service_name string, message string, metadata string")
    first, second = process(df, F.lit(NOW).cast("timestamp")).collect()
    meta = json.loads(first["metadata"])
    assert meta["k"] == [1, 2] and meta["extracted"]["user_id"] == "9" and meta["stack_trace"]["exception_type"] == "A.bError"
    assert first["error_fingerprint"] and second["error_fingerprint"] is None
    assert list(json.loads(second["metadata"])) == ["processed_at"]


def test_validation_names_every_broken_rule(spark):
    df = spark.createDataFrame([("LOUD", None, "", "t" * 65)], "level string, timestamp timestamp, service_name string, trace_id string")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ["message", "span_id", "environment", "host"]})
    assert validate_entries(df).first()["rejected"] == ["level", "timestamp", "service_name", "message", "trace_id"]


def test_raw_lines_have_ids_and_traces_of_their_own(spark, tmp_path):
    from logweave.model import LOG_SCHEMA
    from logweave.operators.enrich import process
    from logweave.operators.search import build_search_index, search
    from logweave.sources.tables import scan_logs, write_logs
    for i in range(3):
        (tmp_path / f"in{i}.log").write_text("2024-01-15 10:30:00 ERROR [api] connection refused\n" * 20)
    lines = spark.read.text(str(tmp_path / "in*.log"))
    rows = process(ingest_raw_lines(lines))
    first, again = ({r.id for r in rows.select("id").collect()} for _ in range(2))
    assert len(first) == 60 and first == again and rows.select("trace_id").distinct().count() == 60
    write_logs(rows, str(tmp_path / "t"), str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "t")).select(*LOG_SCHEMA.names)
    assert [f.dataType for f in stored.schema] == [f.dataType for f in LOG_SCHEMA]
    logs = scan_logs(spark, str(tmp_path / "t"), start="2024-01-15", end="2024-01-16")
    assert search(logs, "connection refused", page_size=100).count() == 60
    assert search(logs, "connection refused", page_size=100, index=build_search_index(logs)).count() == 60


def test_blocks_of_lines_keep_the_given_id_first(spark):
    df = spark.createDataFrame([(5, "INFO a\nINFO b"), (6, "INFO c")], "id long, value string")
    ids = [r.id for r in ingest_raw_lines(df).orderBy("message").collect()]
    assert ids[0] == 5 and ids[2] == 6 and len(set(ids)) == 3


def test_poison_documents_keep_their_text(spark):
    from logweave.operators.enrich import process
    from logweave.sources.tables import dead_letter, split_valid
    docs = ['{"service_name":"a","message":"m","metadata":{"a":1,"a":2}}', "{broken", "[1]", '{"service_name":"a","message":"m","metadata":{"x":{"a":1,"a":2}}}', None]
    rows = process(ingest_structured(spark.createDataFrame([(d,) for d in docs], "value string"), as_of=NOW))
    good, bad = split_valid(rows)
    assert good.count() == 2 and good.where("id IS NULL").count() == 0
    dead = {r["data"]: r["error"] for r in dead_letter(bad).collect()}
    assert {"{broken", "[1]"} <= set(dead) and "json" in dead["{broken"]
    assert good.where("get_json_object(metadata, '$.a') = 2").count() == 1


def test_unreadable_times_are_marked(spark):
    df = spark.createDataFrame([("INFO x",), ("2024-01-15 10:30:00 INFO [a] y",)], "value string")
    assert sorted(r.time_replaced for r in ingest_raw_lines(df, as_of=NOW).collect()) == [False, True]


def test_a_file_that_grows_or_rotates_gives_new_ids(spark, tmp_path):
    import os
    log, table = tmp_path / "app.log", str(tmp_path / "table")
    for day, text in enumerate(["ERROR disk full\n" * 3, "ERROR disk full\n" * 3, "ERROR disk full\n" * 5]):
        log.write_text(text)
        os.utime(log, (1_700_000_000 + day, 1_700_000_000 + day))
        rows = ingest_raw_lines(spark.read.text(str(log)))
        again = ingest_raw_lines(spark.read.text(str(log)))
        assert sorted(r.id for r in rows.select("id").collect()) == sorted(r.id for r in again.select("id").collect())
        rows.select("id", "trace_id", "message").write.mode("append").parquet(table)
    stored = spark.read.parquet(table)
    assert stored.count() == stored.select("id").distinct().count() == stored.select("trace_id").distinct().count() == 11


def test_an_index_over_repeated_ids_is_refused(spark, tmp_path):
    from logweave.operators.search import build_search_index
    rows = spark.createDataFrame([(1, "a disk", "api", "INFO", "h"), (1, "a network", "api", "INFO", "h"), (2, "x", "db", "WARN", None)],
                                 "id long, message string, service_name string, level string, host string")
    with pytest.raises(ValueError, match="id 1 is on 2 rows"):
        build_search_index(rows, str(tmp_path / "i"))
    build_search_index(rows.where("message <> 'a disk'"), str(tmp_path / "i"))


def test_parsing_is_compiled_and_metadata_keeps_its_normal_form(spark):
    """Methods above 8,000 bytes are never compiled; parts spliced into short metadata equal those merged as maps."""
    from logweave.functions.enrichment import merge_metadata
    from logweave.operators import ingest
    from logweave.operators.enrich import process
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    lines = spark.createDataFrame([('{"message":"took 5 ms","level":"ERROR"}',)], "value string")
    assert process(ingest.ingest_raw_lines(lines)).count() == 1
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    x, y = '{"b":2.50,"a":"\\u00e9/"}', None
    want = {'{"k":"v w"}': '{"k":"v w","x":{"a":"é/","b":2.5}}', "{}": '{"x":{"a":"é/","b":2.5}}', None: '{"x":{"a":"é/","b":2.5}}', '{"x":"old"}': '{"x":{"a":"é/","b":2.5}}',
            '{"y":"old"}': '{"y":"old","x":{"a":"é/","b":2.5}}', '{ "k" : 1.0 }': '{"k":1,"x":{"a":"é/","b":2.5}}', '{"k":"v"}\n': '{"k":"v","x":{"a":"é/","b":2.5}}',
            '{"k":"1","k":"2"}': '{"k":"2","x":{"a":"é/","b":2.5}}'}
    df = spark.createDataFrame([(m, x, y) for m in want], "m string, x string, y string")
    assert {r.m: r.got for r in df.select("m", merge_metadata(df.m, x=df.x, y=df.y).alias("got")).collect()} == want


def test_fields_are_found_in_any_case_and_beyond_ascii(spark):
    texts = {"ſtatus 404": 404, "STATUS_CODE=503": 503, "Http: 200": 200, "nothing 404": None}
    df = spark.createDataFrame([(t,) for t in texts], "m string")
    assert {r.m: r.x["status_code"] for r in df.select("m", extract_fields("m").alias("x")).collect()} == texts
