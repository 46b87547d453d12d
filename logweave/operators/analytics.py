"""Aggregates over the log table.

Shuffle notes. Counts and minima are combined on the map side, so a service holding a third
of all rows sends one row per task. Exact distinct counts are planned by Spark on
``(group, value)`` first and on ``group`` second, which spreads a hot group over its values.
``approx=True`` swaps them for sketches when the distinct values themselves are too many.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions.rates import is_error, rate_pct
from logweave.functions.times import as_of as _as_of, bucket, check_interval, time_type, trunc
from logweave.operators.filters import filter_eq, filter_errors, filter_last, filter_time
from logweave.model import LEVELS
from logweave.operators.series import spike
from logweave.sources.manifest import publish, read_view, write_part

# Look-back in hours per interval when a series has no start.


def _distinct(name, approx):
    return F.approx_count_distinct(name) if approx else F.count_distinct(name)


def _errors():
    return F.count_if(is_error())


def hourly_stats(df, approx=False):
    return df.groupBy(trunc(df, "hour").alias("hour"), "service_name", "level").agg(
        F.count("*").alias("log_count"),
        _errors().alias("error_count"),
        _distinct("trace_id", approx).alias("unique_traces"),
        _distinct("error_fingerprint", approx).alias("unique_errors"),
    )


def health_status(rate="error_rate_pct", total=None, degraded=10, down=30, inclusive=False):
    """``active``, ``degraded`` or ``down`` from an error rate.

    The served rule is strict with 10 and 30; ``degraded=5, down=25, inclusive=True`` and a
    ``total`` column give the second rule, where a silent service is down.
    """
    rate = F.col(rate)
    over = (lambda limit: rate >= limit) if inclusive else (lambda limit: rate > limit)
    status = F.when(over(down), "down").when(over(degraded), "degraded").otherwise("active")
    if total is not None:
        status = F.when(F.col(total) == 0, "down").otherwise(status)
    return status


def service_health(df, as_of=None, hours=24, approx=False, **rule):
    recent = filter_last(df, f"{hours} HOURS", as_of)
    return (
        recent.groupBy("service_name")
        .agg(
            F.count("*").alias("total_logs_24h"),
            F.count_if(F.col("level") == "ERROR").alias("errors_24h"),
            F.count_if(F.col("level") == "FATAL").alias("fatals_24h"),
            F.count_if(F.col("level") == "WARN").alias("warns_24h"),
            F.min("timestamp").alias("first_log"),
            F.max("timestamp").alias("last_log"),
            _distinct("error_fingerprint", approx).alias("unique_errors"),
        )
        .withColumn("error_rate_pct", rate_pct("(errors_24h + fatals_24h)", "total_logs_24h"))
        .withColumn("status", health_status(**rule))
        .select("service_name", "total_logs_24h", "errors_24h", "fatals_24h", "warns_24h",
                "error_rate_pct", "first_log", "last_log", "unique_errors", "status")
    )


def dashboard_totals(df, as_of=None):
    recent = filter_last(df, "24 HOURS", as_of)
    return (
        recent.agg(F.count("*").alias("total_logs_24h"), _errors().alias("total_errors_24h"))
        .withColumn("error_rate_pct", rate_pct("total_errors_24h", "total_logs_24h"))
    )


def active_services(df, as_of=None):
    return filter_last(df, "1 HOUR", as_of).agg(F.count_distinct("service_name").alias("active_services"))


def active_alerts(alerts):
    return alerts.where(F.col("status") == "active").agg(F.count("*").alias("active_alerts"))


def anomalies_24h(anomalies, as_of=None):
    return filter_last(anomalies, "24 HOURS", as_of, "detected_at").agg(F.count("*").alias("anomalies_detected"))


def top_error_services(df, as_of=None, k=5):
    recent = filter_errors(filter_last(df, "24 HOURS", as_of))
    return (
        recent.groupBy("service_name").agg(F.count("*").alias("error_count"))
        .orderBy(F.desc("error_count"), "service_name").limit(k)
    )


def logs_per_second(df, as_of=None, decimals=1, service=None):
    """Rows of the current minute over the seconds of it that have passed."""
    now = _as_of(df, as_of)
    minute = F.date_trunc("minute", now).cast(time_type(df))
    current = filter_time(filter_eq(df, service_name=service), minute, now)
    rate = F.col("n") / F.greatest(F.second(now), F.lit(1))
    return current.agg(F.count("*").alias("n")).select(
        (F.round(rate, decimals) if decimals is not None else rate).alias("logs_per_second"))


def _series_rows(df, service=None, level=None, start=None, end=None):
    df = filter_eq(df, service_name=service, level=level.upper() if level else None)
    return filter_time(df, start, end)


def log_volume(df, interval="1h", service=None, level=None, start=None, end=None, mode="bin", origin=None):
    check_interval(interval)
    rows = _series_rows(df, service, level, start, end)
    return rows.groupBy(bucket(rows, interval, mode=mode, origin=origin).alias("bucket")).agg(
        F.count("*").alias("count")).orderBy("bucket")


def error_rate_series(df, interval="1h", service=None, start=None, end=None, mode="bin", origin=None):
    check_interval(interval)
    rows = _series_rows(df, service, None, start, end)
    return (
        rows.groupBy(bucket(rows, interval, mode=mode, origin=origin).alias("bucket"))
        .agg(F.count("*").alias("total"), _errors().alias("errors"))
        .withColumn("error_rate", rate_pct("errors", "total"))
        .orderBy("bucket")
    )


def series_points(series, value, label=None):
    """A series in the exchange form ``(bucket, value, label)``."""
    text = F.lit(None).cast("string") if label is None else F.format_string("%d/%d", *map(F.col, label))
    return series.select("bucket", F.col(value).cast("double").alias("value"), text.alias("label"))


def series_summary(series, value):
    """Total and mean over the buckets that have rows, two decimals."""
    return series.agg(
        F.round(F.coalesce(F.sum(value), F.lit(0)).cast("double"), 2).alias("total"),
        F.round(F.coalesce(F.avg(value), F.lit(0.0)), 2).alias("average"),
    )


def service_volume_trend(df, as_of=None, service=None):
    recent = filter_eq(filter_last(df, "24 HOURS", as_of), service_name=service)
    return recent.groupBy("service_name", trunc(df, "hour").alias("hour")).agg(
        F.count("*").alias("count"), _errors().alias("errors"))


def top_k_per_service(df, order, k, key="service_name"):
    """First ``k`` rows of each service; Spark cuts each task to ``k`` rows before the shuffle."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def top_error_patterns(df, as_of=None, k=10, service=None):
    recent = filter_eq(filter_last(df, "24 HOURS", as_of), service_name=service)
    groups = recent.where(F.col("error_fingerprint").isNotNull()).groupBy("service_name", "error_fingerprint").agg(
        F.min("message").alias("sample_message"),
        F.count("*").alias("occurrences"),
        F.max("timestamp").alias("last_seen"),
    )
    return top_k_per_service(groups, [F.desc("occurrences"), "error_fingerprint"], k)


def top_errors_coalesced(df, as_of=None, k=10, service=None, chars=None):
    """Errors by fingerprint; those without one by their text, or its first ``chars`` characters."""
    recent = filter_errors(filter_eq(filter_last(df, "24 HOURS", as_of), service_name=service))
    pattern = F.coalesce("error_fingerprint", "message" if chars is None else F.substring("message", 1, chars))
    groups = recent.groupBy("service_name", pattern.alias("pattern")).agg(
        F.count("*").alias("occurrences"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )
    return top_k_per_service(groups, [F.desc("occurrences"), "pattern"], k)


def recent_errors(df, as_of=None, k=20, service=None, chars=None):
    recent = filter_errors(filter_eq(filter_last(df, "24 HOURS", as_of), service_name=service))
    rows = top_k_per_service(
        recent.select("service_name", "timestamp", "id", "message", "error_fingerprint"),
        [F.desc("timestamp"), F.desc("id")], k)
    return rows if chars is None else rows.withColumn("message", F.substring("message", 1, chars))


def service_registry(df, previous=None, order="id"):
    """One row per service; ``previous`` is merged by aggregating both tables again."""
    seen = df.groupBy("service_name").agg(
        F.min("timestamp").alias("first_seen_at"),
        F.max("timestamp").alias("last_seen_at"),
        F.min_by("environment", order).alias("environment"),
    ).withColumnRenamed("service_name", "name")
    if previous is not None:
        old = previous.select("name", "first_seen_at", "last_seen_at", "environment", F.lit(0).alias("_turn"))
        both = old.unionByName(seen.withColumn("_turn", F.lit(1)))
        seen = both.groupBy("name").agg(
            F.min("first_seen_at").alias("first_seen_at"),
            F.max("last_seen_at").alias("last_seen_at"),
            F.min_by("environment", "_turn").alias("environment"),
        )
    return seen.withColumn("status", F.lit("active"))


def last_seen(df):
    return df.groupBy("service_name").agg(F.max("timestamp").alias("last_seen"))


def active_by_hour(df):
    """The set of services seen in each hour, one row per member."""
    return df.select(trunc(df, "hour").alias("hour"), "service_name").distinct()


def level_distribution(df, grain="hour", service=None):
    rows = filter_eq(df, service_name=service)
    counts = rows.groupBy("service_name", trunc(rows, grain).alias("bucket")).agg(
        *[F.count_if(F.col("level") == level).alias(level) for level in LEVELS])
    return counts


def minute_counts(df, name="timestamp", global_key=None):
    """Count and errors per service and minute; ``global_key`` adds a series over all services."""
    counts = df.groupBy("service_name", trunc(df, "minute", name).alias("minute")).agg(
        F.count("*").alias("log_count"), _errors().alias("error_count"))
    if global_key is not None:
        total = counts.groupBy("minute").agg(
            F.sum("log_count").alias("log_count"), F.sum("error_count").alias("error_count"))
        counts = counts.unionByName(total.withColumn("service_name", F.lit(global_key)))
    return counts


def recent_error_rate(df, minutes=5, name="timestamp"):
    """Error rate over the minute and the ``minutes - 1`` before it, for every minute with rows.

    The frame slides over minute counts, never over raw rows.
    """
    counts = minute_counts(df, name)
    span = (minutes - 1) * 60
    w = W.partitionBy("service_name").orderBy("_sec").rangeBetween(-span, 0)
    return (
        counts.withColumn("_sec", F.unix_seconds(F.col("minute").cast("timestamp")))
        .select("service_name", "minute",
                F.sum("log_count").over(w).alias("logs"), F.sum("error_count").over(w).alias("errors"))
        .withColumn("error_rate", rate_pct("errors", "logs"))
    )


def feature_aggregates(approx=False):
    """The aggregates that the model features are made of."""
    return [
        F.count("*").alias("log_count"),
        F.count_if(F.col("level") == "ERROR").alias("error_count"),
        F.count_if(F.col("level") == "FATAL").alias("fatal_count"),
        F.count_if(F.col("level") == "WARN").alias("warn_count"),
        _distinct("error_fingerprint", approx).alias("unique_errors"),
        F.coalesce(F.sum(F.length("message")), F.lit(0)).alias("_chars"),
        _distinct("host", approx).alias("unique_hosts"),
    ]


def feature_columns(rows):
    """The eight features from ``window``, ``service_name`` and :func:`feature_aggregates`."""
    return rows.select(
        "window", "service_name", "log_count", "error_count", "fatal_count", "warn_count",
        ((F.col("error_count") + F.col("fatal_count")) / F.greatest("log_count", F.lit(1)) * 100).alias("error_rate"),
        "unique_errors",
        (F.col("_chars") / F.greatest("log_count", F.lit(1))).alias("avg_msg_length"),
        "unique_hosts",
    )


def feature_matrix(df, grain="hour", approx=False):
    """The eight model features per service and hour (or minute)."""
    return feature_columns(df.groupBy(trunc(df, grain).alias("window"), "service_name").agg(*feature_aggregates(approx)))


def normalize_features(df, cols):
    """Min-max scale; a constant column becomes 0. The bounds arrive as scalar subqueries."""
    low = {c: df.agg(F.min(c)).scalar() for c in cols}
    span = {c: df.agg(F.max(c) - F.min(c)).scalar() for c in cols}
    scaled = {
        c: (F.col(c) - low[c]).cast("double") / F.when(span[c] == 0, F.lit(1)).otherwise(span[c]).cast("double")
        for c in cols
    }
    return df.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def latency_trend(df, interval="1h", service=None, source="metadata", key="duration_ms", accuracy=10000):
    """Latency percentiles per bucket, from a metadata number or from the message text."""
    from logweave.functions.enrichment import duration_ms

    rows = filter_eq(df, service_name=service)
    if source == "metadata":
        value = F.try_variant_get(F.try_parse_json("metadata"), f"$.{key}", "double")
    else:
        value = duration_ms("message")
    rows = rows.withColumn("_ms", value).where(F.col("_ms").isNotNull())
    p = F.percentile_approx("_ms", [0.5, 0.95, 0.99], accuracy)
    return (
        rows.groupBy("service_name", bucket(rows, interval).alias("bucket"))
        .agg(F.count("*").alias("samples"), F.round(F.avg("_ms"), 6).alias("avg_ms"),
             F.max("_ms").alias("max_ms"), p.alias("_p"))
        .select("service_name", "bucket", "samples", "avg_ms", "max_ms",
                F.col("_p")[0].alias("p50_ms"), F.col("_p")[1].alias("p95_ms"), F.col("_p")[2].alias("p99_ms"))
    )


def error_budget(df, slo=0.99, as_of=None, hours=24):
    """Share of the error budget left per service: 1 is untouched, below 0 is overspent."""
    recent = filter_last(df, f"{hours} HOURS", as_of)
    return (
        recent.groupBy("service_name").agg(F.count("*").alias("logs"), _errors().alias("errors"))
        .withColumn("health_score", 100 - rate_pct("errors", "logs"))
        .withColumn("budget_left", F.round(1 - F.col("errors") / (F.col("logs") * (1 - slo)), 6))
    )


def sample_n(df, n=5000, seed=42, key="id"):
    """Repeatable random sample: the ``n`` rows with the smallest hash of key and seed."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def changed_days(batch):
    """The days that the rows of ``batch`` touch, as dates."""
    return [r[0] for r in batch.select(F.to_date("timestamp").alias("day")).distinct().collect()]


def refresh_views(df, path, as_of=None, days=None):
    """Refresh the hourly and the health tables and return them as read back.

    ``days``: the dates whose rows have changed (see :func:`changed_days`); only they are read and counted
    again, all others stay as stored. Without it every day is counted. An hour lies in one day, so exact distinct
    counts need no other day's rows; health needs the last 24 hours alone. Readers see the old or the new state.
    """
    spark = df.sparkSession
    day = F.to_date("timestamp")
    changed = df
    if days is not None:
        if "log_date" in df.columns:  # stored tables: prunes folders
            changed = changed.where(F.col("log_date").isin(days))
        changed = changed.where(day.isin(days))
    hourly, health = hourly_stats(changed), service_health(df, as_of)
    parts = [write_part(hourly.withColumn("log_date", F.to_date("hour")), path, "hourly_stats"), write_part(health, path, "service_health")]
    again = F.lit(True) if days is None else (F.col("view") == "service_health") | F.col("log_date").isin(days)
    publish(spark, path, parts, again)
    return read_view(spark, path, "hourly_stats", hourly.schema), read_view(spark, path, "service_health", health.schema, daily=False)


def latency_anomaly(df, source="message", multiplier=1.5, by="service_name"):
    """Hours whose largest latency stands out from the hours before, per service."""
    trend = latency_trend(df, source=source).select(by, "bucket", "max_ms")
    return spike(trend, by, "bucket", "max_ms", multiplier=multiplier, name="is_anomaly")
