"""Cooldowns on streams: keyed state holds the last fire.

Only candidates reach the state, and each key's rows are cut to those that can still fire while
they stream through, so memory follows the seconds of a batch and not its rows. (Helper columns
have no leading underscore: the state API drops such names.)
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logweave.functions.times import epoch_seconds
from logweave.operators.alerts import CRITICAL_PATTERNS, pattern_alerts, pattern_candidates
from logweave.operators.cooldown import COOLDOWN_SECONDS, fires, pattern_fold

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark):
    """Keyed state with several values needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Cooldown(StatefulProcessor):
    """Fires the first candidate of a key, then the first at least ``seconds`` later."""

    def __init__(self, seconds):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sec long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        firsts = None
        for pdf in rows:
            if len(pdf):
                both = pdf if firsts is None else pd.concat([firsts, pdf])
                firsts = both.sort_values(["cd_sec", "cd_time", "cd_order"]).drop_duplicates("cd_sec")
        if firsts is None:
            return
        firsts = firsts.reset_index(drop=True)
        last = self.last.get()[0] if self.last.exists() else None
        fired = fires(firsts["cd_sec"].to_numpy(), self.seconds, last)
        if fired:
            self.last.update((int(firsts["cd_sec"].iloc[fired[-1]]),))
            yield firsts.iloc[fired]

    def close(self) -> None:
        pass


class _PatternCooldown(StatefulProcessor):
    """The pattern form: a last fire per pattern of a service."""

    def __init__(self, seconds):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "pattern int", "sec long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = None
        for pdf in rows:
            if len(pdf):
                both = (pdf if kept is None else pd.concat([kept, pdf])).sort_values(["cd_time", "cd_order"])
                bits = both["cd_mask"].map(lambda m: int(m).bit_count())
                kept = both[both.groupby(["cd_sec", "cd_mask"]).cumcount() < bits]
        if kept is None:
            return
        kept = kept.reset_index(drop=True)
        last = {k[0]: v[0] for k, v in self.last.iterator()}
        fired = pattern_fold(kept["cd_sec"], kept["cd_mask"], self.seconds, last)
        if fired:
            for pattern in {p for _, p in fired}:
                self.last.updateValue((pattern,), (last[pattern],))
            yield kept.iloc[[i for i, _ in fired]].assign(pattern=np.array([p for _, p in fired], dtype="int32"))

    def close(self) -> None:
        pass


def _run(rows, key, processor, schema):
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="none")


def stream_cooldown(stream, key, time="timestamp", seconds=COOLDOWN_SECONDS, order="id"):
    """Candidates that fire, in arrival order of the batches; rows of one batch go by time."""
    use_rocksdb(stream.sparkSession)
    rows = stream.select("*", epoch_seconds(stream, time).alias("cd_sec"), F.col(time).alias("cd_time"), F.col(order).alias("cd_order"))
    return _run(rows, key, _Cooldown(seconds), rows.schema).select(stream.columns)


def stream_alert_pattern(stream, patterns=CRITICAL_PATTERNS, seconds=COOLDOWN_SECONDS, chars=None):
    """Pattern alerts of a log stream."""
    use_rocksdb(stream.sparkSession)
    rows = pattern_candidates(stream.select("id", "timestamp", "level", "service_name", "message"), patterns)
    rows = rows.select("id", "timestamp", "service_name", "message", F.col("_mask").alias("cd_mask"), epoch_seconds(stream).alias("cd_sec"),
                       F.col("timestamp").alias("cd_time"), F.col("id").alias("cd_order"))
    schema = T.StructType(rows.schema.fields + [T.StructField("pattern", T.IntegerType())])
    return pattern_alerts(_run(rows, "service_name", _PatternCooldown(seconds), schema), patterns, chars)
