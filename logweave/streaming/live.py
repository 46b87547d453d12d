"""Judging closed minutes of a live stream: anomaly scores, sliding error rates, threshold alerts.

A minute is counted by Spark's own windowed aggregation, with partial counts in every task, so a busy
service is no single task. It is judged once, when the watermark passes its end, however many batches
its rows came in. What follows holds one small state per service: the counts of its last minutes and
its last alert. Minutes of a service close in order, so results equal the batch operators over the same rows.

The watermark moves with the rows. A heartbeat, a row whose ``service_name`` is null, only moves it; a
clock that sends one now and then closes the last minute of a stream that has fallen silent.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logweave.functions.rates import is_error, rate_pct
from logweave.functions.times import epoch_seconds
from logweave.operators.alerts import ERROR_RATE_CRITICAL, ERROR_RATE_THRESHOLD, threshold_alerts
from logweave.operators.analytics import feature_aggregates, feature_columns
from logweave.operators.anomaly import anomaly_records, score_services
from logweave.operators.cooldown import COOLDOWN_SECONDS
from logweave.streaming.cooldown import stream_cooldown, use_rocksdb

DELAY = "1 minute"


def _minutes(stream, delay, time, *measures):
    """``measures`` per service and closed minute; heartbeats pass the watermark and count nowhere."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    # naming the time keeps this filter behind the watermark, which heartbeats have to reach
    rows = rows.where(F.col("service_name").isNotNull() | F.col(time).isNull())
    return rows.groupBy(F.window(time, "1 minute"), "service_name").agg(*measures)


def closed_minutes(stream, delay=DELAY, time="timestamp"):
    """Count and errors per service and minute, once the minute is closed."""
    counts = _minutes(stream, delay, time, F.count("*").alias("log_count"), F.count_if(is_error()).alias("error_count"))
    return counts.select("service_name", F.col("window.start").alias("minute"), "log_count", "error_count")


def live_features(stream, delay=DELAY, time="timestamp"):
    """The model features of every closed minute. Distinct counts are sketches on a stream and equal
    ``feature_matrix(..., "minute", approx=True)``."""
    rows = _minutes(stream, delay, time, *feature_aggregates(approx=True))
    return feature_columns(rows.withColumn("window", F.col("window.start")))


def live_anomalies(stream, forest=None, cooldown_s=COOLDOWN_SECONDS, delay=DELAY, time="timestamp"):
    """Anomalies of a stream as they are recorded: every closed minute is scored once, and a service
    stays silent for ``cooldown_s`` after a record, over all batches and restarts."""
    scores = score_services(live_features(stream, delay, time), forest).where("is_anomaly")
    return anomaly_records(stream_cooldown(scores, "service_name", "window", cooldown_s, "window"))


class _Rates(StatefulProcessor):
    """Keeps the counts of a service's last minutes and, with a threshold, its last alert.

    Yields each minute's sliding counts; with a threshold only those of minutes that alert.
    """

    def __init__(self, minutes, threshold=None, cooldown_s=0):
        self.span, self.threshold, self.cooldown_s = (minutes - 1) * 60, threshold, cooldown_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getMapState("ring", "sec long", "n long, e long")
        self.last = handle.getValueState("last", "sec long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([pdf for pdf in rows]).sort_values("sec").reset_index(drop=True)
        ring = {k[0]: tuple(v) for k, v in self.ring.iterator()}
        known = set(ring)
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for at, (sec, n, e) in enumerate(zip(new["sec"].tolist(), new["n"].tolist(), new["e"].tolist())):
            ring = {s: c for s, c in ring.items() if s >= sec - self.span} | {sec: (n, e)}
            logs, errors = sum(c[0] for c in ring.values()), sum(c[1] for c in ring.values())
            if self.threshold is not None:
                high = _rate(errors, logs) > self.threshold
                if not high or last is not None and sec - last < self.cooldown_s:
                    continue
                last = sec
            out.append((at, logs, errors))
        for sec in known - set(ring):
            self.ring.removeKey((sec,))
        for sec in set(ring) - known:
            self.ring.updateValue((sec,), ring[sec])
        if self.threshold is not None and last is not None:
            self.last.update((last,))
        if out:
            yield new.iloc[[o[0] for o in out]].assign(logs=[o[1] for o in out], errors=[o[2] for o in out])

    def close(self) -> None:
        pass


def _rate(errors, logs):
    """Percentage with two decimals, as ``rate_pct`` rounds: half up, in whole numbers."""
    return (20_000 * errors + logs) // (2 * logs) / 100


def _sliding(stream, minutes, delay, time, threshold=None, cooldown_s=0):
    use_rocksdb(stream.sparkSession)
    counts = closed_minutes(stream, delay, time)
    rows = counts.select("service_name", "minute", epoch_seconds(counts, "minute").alias("sec"), F.col("log_count").alias("n"), F.col("error_count").alias("e"))
    schema = T.StructType(rows.schema.fields + [T.StructField("logs", T.LongType()), T.StructField("errors", T.LongType())])
    found = rows.groupBy("service_name").transformWithStateInPandas(
        statefulProcessor=_Rates(minutes, threshold, cooldown_s), outputStructType=schema, outputMode="append", timeMode="none")
    return found.select("service_name", "minute", "logs", "errors", rate_pct("errors", "logs").alias("error_rate"))


def live_error_rate(stream, minutes=5, delay=DELAY, time="timestamp"):
    """Error rate over each closed minute and the ``minutes - 1`` before it; a row counts once, not once
    for each window it lies in."""
    return _sliding(stream, minutes, delay, time)


def live_alert_threshold(stream, threshold=ERROR_RATE_THRESHOLD, critical=ERROR_RATE_CRITICAL, cooldown_s=COOLDOWN_SECONDS, minutes=5,
                         delay=DELAY, time="timestamp"):
    """Error-rate alerts of a stream, judged at every closed minute, with a cooldown that outlives batches
    and restarts."""
    return threshold_alerts(_sliding(stream, minutes, delay, time, threshold, cooldown_s), threshold, critical)
