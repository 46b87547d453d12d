"""Views that are refreshed day by day, and the public anomaly operators."""

import datetime as dt

import pytest
from compare import spark_rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from logweave.operators import analytics as A
from logweave.plans.base import logs
from logweave.sources import manifest as M


def _day(n):
    return F.to_date("timestamp") == F.lit(n)


def test_only_named_days_are_counted_again(spark, sf, tmp_path):
    rows, path = logs(spark, sf), str(tmp_path)
    days = sorted(A.changed_days(rows))
    first, _ = A.refresh_views(rows, path)
    assert spark_rows(first) == spark_rows(A.hourly_stats(rows))
    # other days of the input are gone, yet stay as stored; the named day loses half of its rows
    half = rows.where(_day(days[1]) & (F.col("id") % 2 == 0))
    second, health = A.refresh_views(half, path, days=[days[1]])
    assert spark_rows(second) == spark_rows(A.hourly_stats(rows.where(~_day(days[1])).unionByName(half)))
    assert spark_rows(health) == spark_rows(A.service_health(half))
    # the first reader still sees what it saw
    assert spark_rows(first) == spark_rows(A.hourly_stats(rows))
    # a day without rows goes
    third, _ = A.refresh_views(half, path, days=[days[2]])
    assert third.where(F.to_date("hour") == F.lit(days[2])).count() == 0 and M.newest_version(spark, path) == 3


def test_a_stored_table_is_read_for_the_changed_day_only(spark, sf, tmp_path):
    table, path = f"{tmp_path}/logs", f"{tmp_path}/views"
    logs(spark, sf).withColumn("log_date", F.to_date("timestamp")).write.partitionBy("log_date").parquet(table)
    rows = spark.read.parquet(table)
    day = sorted(A.changed_days(rows))[-1]
    A.refresh_views(rows, path)
    one = A.hourly_stats(rows.where(F.col("log_date").isin([day])).where(F.to_date("timestamp").isin([day])))
    assert "log_date" in one._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]
    hourly, _ = A.refresh_views(rows, path, days=[day])
    assert spark_rows(hourly) == spark_rows(A.hourly_stats(rows))
    held = {r.log_date for r in spark.read.parquet(f"{path}/hourly_stats").where(
        F.col("refresh").isin([r.refresh for r in M._at(spark, path, 2).where(F.col("log_date") == F.lit(day)).collect()])).select("log_date").distinct().collect()}
    assert held == {day}


def test_refreshes_of_nothing_and_clashes(spark, sf, tmp_path):
    path = str(tmp_path)
    hourly, health = A.refresh_views(logs(spark, sf).limit(0), path)
    assert hourly.count() == 0 and health.count() == 0
    part = spark.createDataFrame([("v", dt.date(2024, 1, 1), "r")], "view string, log_date date, refresh string")
    part.write.parquet(f"{path}/manifest/version=2")
    with pytest.raises(AnalysisException):  # somebody else has ended first
        part.write.parquet(f"{path}/manifest/version=2")


def test_latency_anomaly_marks_the_odd_hour(spark):
    start = dt.datetime(2024, 1, 1)
    took = [100, 105, 100, 105, 102, 900]
    rows = [(start + dt.timedelta(hours=h), "s", f"request took {ms}ms") for h, ms in enumerate(took)]
    got = A.latency_anomaly(spark.createDataFrame(rows, "timestamp timestamp_ntz, service_name string, message string")).orderBy("bucket").collect()
    assert [r.is_anomaly for r in got] == [False, False, False, False, False, True]
