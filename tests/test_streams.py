"""Streams over several batches equal the batch operators; late rows; repeated batches."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from logweave.operators import alerts as AL
from logweave.operators import analytics as A
from logweave.operators.cooldown import cooldown
from logweave.plans.base import logs
from logweave.plans.stream_queries import run_append, run_batches
from logweave.sources import snapshots as SN
from logweave.sources import tables as TB
from logweave.streaming import cooldown as SC
from logweave.streaming import jobs as J


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The log table as four files in time order, with times that have a zone."""
    path = str(tmp_path_factory.mktemp("logs"))
    rows = logs(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn(
        "ingested_at", F.col("ingested_at").cast("timestamp"))
    for i in range(4):
        rows.where((F.col("id") >= 250 * i) & (F.col("id") < 250 * (i + 1))).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, folder):
    return J.read_log_stream(spark, folder, "parquet", 1, spark.read.parquet(folder).schema)


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_cooldown_across_batches(spark, folder):
    cols = ("service_name", "id")
    errors = spark.read.parquet(folder).where("level IN ('ERROR', 'FATAL')")
    live = stream(spark, folder).where("level IN ('ERROR', 'FATAL')")
    got = run_append(SC.stream_cooldown(live, "service_name", seconds=86400), "t")
    assert rows_of(got, *cols) == rows_of(cooldown(errors, "service_name", seconds=86400), *cols)


def test_pattern_alerts_across_batches(spark, folder):
    got = run_append(SC.stream_alert_pattern(stream(spark, folder), seconds=7200), "t")
    assert rows_of(got, "id", "title") == rows_of(AL.alert_pattern(spark.read.parquet(folder), cooldown_s=7200), "id", "title")


def test_minute_counters_in_update_mode(spark, folder):
    live = run_batches(J.minute_counters(stream(spark, folder), "30 days"), "t", lambda b, i: b, "update")
    newest = live.groupBy("service_name", "minute").agg(F.max_by("log_count", "batch").alias("log_count"))
    assert rows_of(newest, "service_name", "minute", "log_count") == rows_of(
        A.minute_counts(spark.read.parquet(folder)), "service_name", "minute", "log_count")


def test_late_rows_reach_no_closed_window(spark, tmp_path):
    # lateness is judged by the watermark one batch back, hence the batch in between
    t0 = datetime(2024, 1, 1, 12)
    cols = "id long, timestamp timestamp, level string, service_name string"
    for i, minutes in enumerate([0, 180, 181, 1]):
        spark.createDataFrame([(i, t0 + timedelta(minutes=minutes), "INFO", "s")], cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = J.read_log_stream(spark, str(tmp_path / "in"), "parquet", 1, spark.read.parquet(str(tmp_path / "in")).schema)
    got = run_append(J.minute_counters(live), "t").collect()
    assert [(r["minute"], r["log_count"]) for r in got] == [(t0, 1)]


def test_duplicates(spark, folder):
    twice = stream(spark, folder).unionByName(stream(spark, folder))
    got = run_append(J.stream_dedup(twice, "40 days"), "t")
    assert got.count() == got.select("id").distinct().count() == 1000


def test_a_repeated_batch_is_stored_once(spark, folder, tmp_path):
    rows = spark.read.parquet(folder).withColumn("level", F.expr("if(id = 7, 'LOUD', level)"))
    seen = []
    store = J.store_batch(str(tmp_path / "t"), str(tmp_path / "r"), tail=lambda df, i: seen.extend(df.collect()))
    for batch in (0, 1, 1, 0):
        store(rows.where(F.col("id") % 2 == batch), batch)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 999
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1
    assert len(seen) == 40 and seen[0]["id"] in (998, 999)


def test_storing_stream_checks_alerts(spark, folder, tmp_path):
    found = []
    query = J.stream_process(stream(spark, folder), str(tmp_path / "t"), str(tmp_path / "c"), str(tmp_path / "r"),
                             alerts=lambda rows, i: found.extend(AL.alert_pattern(rows).collect()))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1000 and found


def test_write_and_scan(spark, sf, tmp_path):
    path = str(tmp_path / "t")
    rows = logs(spark, sf)
    TB.write_logs(rows, path, path + "-r")
    got = TB.scan_logs(spark, path, "2024-01-10", "2024-01-10T23:59:59.999999")
    assert got.count() == rows.where("to_date(timestamp) = '2024-01-10'").count()
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan
    TB.compact(spark, path, path + "-c")
    assert spark.read.parquet(path + "-c").count() == 1000


def test_streams_with_checkpoints_of_their_own_share_a_table(spark, folder, tmp_path):
    for name in ("c1", "c2"):
        J.stream_process(stream(spark, folder), str(tmp_path / "t"), str(tmp_path / name), str(tmp_path / "r")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2000
    TB.write_logs(spark.read.parquet(folder), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3000


def test_a_repeated_batch_replaces_all_of_its_days(spark, folder, tmp_path):
    rows = spark.read.parquet(folder)
    store = J.store_batch(str(tmp_path / "t"))
    store(rows, 0)
    store(rows.where("id < 10"), 0)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10


def test_readers_see_whole_commits(spark, sf, tmp_path):
    from pyspark.errors import AnalysisException
    path = str(tmp_path / "t")
    rows = logs(spark, sf)
    SN.commit_logs(rows.where("id % 2 = 0"), path)
    before = SN.scan_snapshot(spark, path)
    even = before.count()
    # rows that are written but not committed do not show
    part = SN.manifest.write_part(SN._laid_out(SN.stored_form(rows)), path, "logs")
    assert SN.scan_snapshot(spark, path).count() == even == before.count()
    SN.manifest.publish(spark, path, [part], F.lit(False))
    assert SN.scan_snapshot(spark, path).count() == even + 1000
    during = SN.scan_snapshot(spark, path)
    SN.compact_snapshot(spark, path)
    assert before.count() == even and during.count() == even + 1000 == SN.scan_snapshot(spark, path).count()
    # of two commits that want one version, one fails
    with pytest.raises(AnalysisException):
        spark.range(1).write.parquet(f"{path}/manifest/version={SN.manifest.newest_version(spark, path)}")
    day = SN.scan_snapshot(spark, path, "2024-01-10", "2024-01-10T23:59:59.999999")
    assert "PartitionFilters: [isnotnull(log_date" in day._jdf.queryExecution().toString()


def test_commits_of_a_stream_replace_earlier_attempts(spark, sf, tmp_path):
    path = str(tmp_path / "t")
    rows = logs(spark, sf)
    for batch, some in ((0, rows), (1, rows.where("id < 5")), (0, rows.where("id < 10")), (11, rows.where("id < 3"))):
        SN.commit_logs(some, path, source="s", batch_id=batch)
    SN.commit_logs(rows.where("id < 0"), path)  # no rows
    assert SN.scan_snapshot(spark, path).count() == 10 + 5 + 3
    SN.compact_snapshot(spark, path, [date(2024, 1, 1)])
    assert SN.scan_snapshot(spark, path).count() == 10 + 5 + 3
