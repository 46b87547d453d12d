"""Closed minutes on live streams: restarts, heartbeats, forests, ties; current counters."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logweave.operators import alerts as AL
from logweave.operators import analytics as A
from logweave.operators import anomaly as N
from logweave.plans.base import logs
from logweave.plans.stream_queries import run_append
from logweave.sources import versions as V
from logweave.streaming import jobs as J
from logweave.streaming import live as L

T0 = datetime(2024, 5, 1, 12)
COLS = "id long, timestamp timestamp, level string, service_name string, message string, error_fingerprint string, host string"


def row(i, seconds, level="INFO", service="api"):
    return i, T0 + timedelta(seconds=seconds), level, service, f"message {i}", "f" if level == "ERROR" else None, f"h{i % 3}"


def add_file(spark, folder, rows):
    spark.createDataFrame(rows, COLS).coalesce(1).write.mode("append").parquet(folder)


def busy(count=400, services=("api", "db")):
    """Rows of two services in bursts of errors, several a minute, with minutes left out."""
    return [row(i, i * 13 + 600 * (i // 70), "ERROR" if i // 40 % 3 == 0 and i % 3 else "INFO", services[i % 7 == 0]) for i in range(count)]


def alerts_of(df):
    return sorted((r.service_name, r.triggered_at, r.description) for r in df.collect())


def test_threshold_alerts_survive_a_restart(spark, tmp_path):
    rows, folder, out = busy(), str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], COLS).schema

    def resume():
        stream = J.read_log_stream(spark, folder, "parquet", 1, schema)
        (L.live_alert_threshold(stream, cooldown_s=600).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination())
    for part in (rows[:95], rows[95:100], rows[100:101], rows[101:]):  # a minute's rows fall on both sides of each stop
        add_file(spark, folder, part)
        resume()
    add_file(spark, folder, [row(-1, 10**6, service=None)])
    resume()
    want = AL.alert_threshold(spark.createDataFrame(rows, COLS), cooldown_s=600)
    assert want.count() > 3
    assert alerts_of(spark.read.parquet(out)) == alerts_of(want)


def test_heartbeats_close_minutes_and_count_nowhere(spark, tmp_path):
    add_file(spark, str(tmp_path), [row(1, 0, "ERROR"), row(2, 59), row(3, 60)])
    stream = lambda: J.read_log_stream(spark, str(tmp_path), "parquet", 1, spark.createDataFrame([], COLS).schema)
    assert run_append(L.closed_minutes(stream()), "t").count() == 0
    add_file(spark, str(tmp_path), [row(4, 121 + 60, service=None)])
    got = run_append(L.closed_minutes(stream()), "t").collect()
    assert sorted((r.service_name, r.minute, r.log_count, r.error_count) for r in got) == [
        ("api", T0, 2, 1), ("api", T0 + timedelta(minutes=1), 1, 0)]


@pytest.mark.parametrize("trained", [False, True])
def test_scores_of_closed_minutes_equal_the_batch(spark, tmp_path, trained):
    rows, folder = busy(), str(tmp_path / "in")
    table = spark.createDataFrame(rows, COLS)
    features = A.feature_matrix(table, "minute", approx=True)
    forest = N.iforest_fit(features) if trained else None
    for at in range(0, len(rows), 150):
        add_file(spark, folder, rows[at:at + 150])
    add_file(spark, folder, [row(-1, 10**6, service=None)])
    out, stream = str(tmp_path / "out"), J.read_log_stream(spark, folder, "parquet", 1, table.schema)
    J.stream_scores(stream, forest, V.store_versions(out), str(tmp_path / "state"), cooldown_s=240, availableNow=True).awaitTermination()
    want = N.record_anomalies(N.score_services(features, forest), cooldown_s=240)
    key = lambda df: sorted((r.id, r.detected_at, r.severity_score, r.anomaly_type) for r in df.collect())
    assert want.count() > 2 and key(spark.read.parquet(out)) == key(want)


def test_live_rates_equal_the_batch(spark, sf, tmp_path):
    rows = logs(spark, sf).withColumns({c: F.col(c).cast("timestamp") for c in ("timestamp", "ingested_at")})
    rows.coalesce(1).write.mode("append").parquet(str(tmp_path))
    rows.limit(1).withColumns({"timestamp": F.lit("2100-01-01").cast("timestamp"), "service_name": F.lit(None).cast("string")}).coalesce(1).write.mode("append").parquet(str(tmp_path))
    got = run_append(L.live_error_rate(J.read_log_stream(spark, str(tmp_path), "parquet", 1, rows.schema), minutes=90), "t")
    key = lambda df: sorted(tuple(r) for r in df.select("service_name", "minute", "logs", "errors", "error_rate").collect())
    assert key(got) == key(A.recent_error_rate(rows, 90))


def test_current_counters_and_folding(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["service_name", "minute"]
    folder = str(tmp_path / "in")
    for at in range(0, 300, 100):
        add_file(spark, folder, busy(300)[at:at + 100])
    stream = J.read_log_stream(spark, folder, "parquet", 1, spark.createDataFrame([], COLS).schema)
    J.keep_current(J.minute_counters(stream), path, str(tmp_path / "c")).awaitTermination()
    key = lambda df: sorted(tuple(r) for r in df.select(*keys, "log_count", "error_count").collect())
    want = key(A.minute_counts(spark.createDataFrame(busy(300), COLS)))
    assert key(V.read_current(spark, path, keys)) == want
    V.fold_versions(spark, path, path + "-folded", keys)
    assert key(V.read_current(spark, path + "-folded", keys)) == want
    V.write_version(spark.createDataFrame([("api", T0, 77, 7)], "service_name string, minute timestamp, log_count long, error_count long"), path + "-folded", 99)
    changed = {(r[0], r[1]): r[2:] for r in key(V.read_current(spark, path + "-folded", keys))}
    assert changed["api", T0] == (77, 7) and len(changed) == len(want)


def test_a_repeated_batch_replaces_its_version(spark, tmp_path):
    store, path = V.store_versions(str(tmp_path)), str(tmp_path)
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "k string, n int")
    store(rows, 0)
    store(rows.where("k = 'a'").withColumn("n", F.lit(5)), 1)
    store(rows.where("k = 'a'").withColumn("n", F.lit(6)), 1)
    assert sorted(map(tuple, V.read_current(spark, path, ["k"]).collect())) == [("a", 6), ("b", 1)]
