"""Series statistics, cooldowns and alerts on small inputs; injected faults on the log table."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from logweave.operators import alerts as AL
from logweave.operators import series as S
from logweave.operators.analytics import minute_counts
from logweave.operators.anomaly import score_services
from logweave.operators.cooldown import cooldown, fires
from logweave.plans.base import logs

T0 = datetime(2024, 1, 1)


def series(spark, values, kind="long"):
    return spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], f"k string, i int, v {kind}")


def flags(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("kind,cast", [("long", int), ("double", float)])
def test_series_rules(spark, kind, cast):
    def run(fn, values, name, **kw):
        return flags(fn(series(spark, [cast(v) for v in values], kind), "k", "i", "v", **kw), name)
    assert run(S.zscore_anomalies, [1, 9], "is_anomaly") == [False, False]
    assert run(S.zscore_anomalies, [4] * 5, "is_anomaly") == [False] * 5
    assert run(S.zscore_anomalies, [1] * 20 + [50], "is_anomaly") == [False] * 20 + [True]
    assert run(S.moving_avg_anomalies, [5] * 10 + [99], "is_anomaly") == [False] * 11
    assert run(S.moving_avg_anomalies, [1, 2] * 5 + [9], "is_anomaly") == [False] * 10 + [True]
    assert run(S.spike, [5, 8, 3, 6, 4, 11], "is_spike")[-1] is True
    assert run(S.spike, [5, 8, 3, 6, 4, 10], "is_spike")[-1] is False
    assert run(S.spike, [7], "is_spike") == [False]
    assert run(S.spike, [10, 13, 14], "is_spike") == [False, False, False]
    assert run(S.spike, [10, 14], "is_spike") == [False, True]
    assert run(S.drop, [10, 10, 3], "is_drop") == [False, False, True]
    assert run(S.ewma_anomalies, [1, 50], "is_anomaly") == [False, False]
    score = run(S.anomaly_score, [0, 2, 4], "anomaly_score")
    assert score[:2] == [0.0, 0.0] and score[2] == pytest.approx(1 - 1 / 1.9)


def test_ewma_follows_the_recurrence(spark):
    values = [float(v) for v in (5, 6, 5, 7, 5, 30, 6, 5, 5, 4, 6)]
    mean, var, expected = values[0], 0.0, [False]
    for v in values[1:]:
        diff = v - mean
        mean = 2 / 11 * v + 9 / 11 * mean
        var = 2 / 11 * diff ** 2 + 9 / 11 * var
        expected.append(var > 0 and abs(diff) > 2.5 * var ** 0.5)
    assert flags(S.ewma_anomalies(series(spark, values, "double"), "k", "i", "v", threshold=2.5), "is_anomaly") == expected


def test_jumping_equals_walking():
    import random
    import numpy as np
    rng = random.Random(3)
    seconds = sorted({rng.randrange(20_000) for _ in range(900)})
    walked, last = [], -10**9
    for i, s in enumerate(seconds):
        if s - last >= 300:
            walked.append(i)
            last = s
    assert fires(np.array(seconds), 300) == walked


def test_cooldown_of_a_hot_key(spark):
    # one service with a thousand candidates each second for twenty minutes
    rows = spark.range(1_200_000).select(
        "id", F.lit("hot").alias("service_name"),
        F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 1000).alias("timestamp"))
    got = [r["timestamp"] for r in cooldown(rows, "service_name").orderBy("timestamp").collect()]
    assert got == [T0 + timedelta(seconds=300 * i) for i in range(4)]


PATTERN_ROWS = [
    (1, 0, "a", "OutOfMemoryError"), (2, 10, "a", "OutOfMemoryError"), (3, 20, "a", "OOM after OutOfMemoryError"),
    (4, 310, "a", "OutOfMemoryError"), (5, 311, "b", "OutOfMemoryError"), (6, 312, "b", "nothing here"),
    (7, 313, "c", "disk full, connection refused"), (8, 313, "c", "disk full, connection refused"), (9, 313, "c", "disk full, connection refused"),
]


def pattern_rows(spark):
    rows = [(i, T0 + timedelta(seconds=s), "ERROR", svc, m) for i, s, svc, m in PATTERN_ROWS]
    return spark.createDataFrame(rows, "id long, timestamp timestamp, level string, service_name string, message string")


def test_pattern_alerts(spark):
    got = sorted((r["triggered_at"], r["service_name"], F_pattern(r)) for r in AL.alert_pattern(pattern_rows(spark)).collect())
    at = lambda s: T0 + timedelta(seconds=s)
    assert got == [(at(0), "a", "OutOfMemoryError"), (at(20), "a", "OOM"), (at(310), "a", "OutOfMemoryError"),
                   (at(311), "b", "OutOfMemoryError"), (at(313), "c", "connection refused"), (at(313), "c", "disk full")]


def F_pattern(row):
    import json
    return json.loads(row["rule_config"])["pattern"]


def test_ids_repeat(spark):
    ids = [sorted(r["id"] for r in AL.alert_pattern(pattern_rows(spark)).collect()) for _ in range(2)]
    assert ids[0] == ids[1] and len(set(ids[0])) == len(ids[0])


def test_injected_fault_is_found(spark, sf):
    """Seven rows in ten of one service become errors for an hour."""
    hour = F.lit("2024-01-10 05:00:00").cast("timestamp_ntz")
    rows = logs(spark, "/root/testdata/sf0.01").where("level NOT IN ('ERROR', 'FATAL')")
    hit = (F.col("service_name") == "order-service") & (F.col("timestamp") >= hour) & (F.col("timestamp") < hour + F.expr("INTERVAL 1 HOUR"))
    faulty = rows.withColumn("level", F.when(hit & (F.col("id") % 10 < 7), "ERROR").otherwise(F.col("level")))
    alerts = AL.alert_threshold(faulty).collect()
    assert alerts and {a["service_name"] for a in alerts} == {"order-service"}
    assert all(datetime(2024, 1, 10, 5) <= a["triggered_at"] < datetime(2024, 1, 10, 6, 5) for a in alerts)
    from logweave.operators.analytics import feature_matrix
    bad = score_services(feature_matrix(faulty)).where("is_anomaly").collect()
    assert [(r["service_name"], r["window"]) for r in bad] == [("order-service", datetime(2024, 1, 10, 5))]


def test_global_series_is_the_sum(spark, sf):
    counts = minute_counts(logs(spark, sf), global_key="_global")
    total = counts.groupBy((F.col("service_name") == "_global").alias("g")).agg(F.sum("log_count").alias("n")).collect()
    assert {r["n"] for r in total} == {1000}


def test_more_patterns_than_bits_are_refused(spark):
    import pytest
    from logweave.operators.alerts import pattern_mask
    with pytest.raises(ValueError, match="63"):
        pattern_mask(patterns=[f"p{i}" for i in range(64)])
    rows = spark.createDataFrame([("p0 and p62",)], "message string")
    mask = rows.select(pattern_mask(patterns=[f"p{i}$|p{i} " for i in range(63)])).first()[0]
    assert mask == (1 << 62) | 1


def test_alert_texts_are_whole_unless_cut(spark):
    from datetime import datetime
    from logweave.operators.alerts import alert_pattern
    text = "kernel panic " + "x" * 500
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1), "ERROR", "api", text)], "id long, timestamp timestamp, level string, service_name string, message string")
    assert alert_pattern(rows).first()["description"] == f"Pattern 'kernel panic' found: {text}"
    assert alert_pattern(rows, chars=200).first()["description"] == f"Pattern 'kernel panic' found: {text[:200]}"


@pytest.mark.parametrize("seconds", [1, 7, 40, 300])
def test_cooldown_blocks_pass_their_state_on(spark, monkeypatch, seconds):
    import random
    from datetime import datetime, timedelta
    from logweave.operators import cooldown as C
    monkeypatch.setattr(C, "BLOCK_SECONDS", 50)
    rng, t0 = random.Random(seconds), datetime(2024, 1, 1)
    rows = [(i, ["a", "b", None][rng.choice([0, 0, 0, 1, 2])], t0 + timedelta(seconds=rng.choice([rng.randrange(2000), rng.randrange(2000, 60_000)])))
            for i in range(1500)]
    want, last = [], {}
    for i, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        if key is not None and (key not in last or (at - last[key]).total_seconds() >= seconds):
            want.append(i)
            last[key] = at
    df = spark.createDataFrame(rows, "id long, service_name string, timestamp timestamp").where("service_name IS NOT NULL")
    assert sorted(r.id for r in C.cooldown(df, "service_name", seconds=seconds).collect()) == sorted(want)
