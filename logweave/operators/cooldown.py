"""Cooldowns: after an alert its repeats stay silent for a while.

Whether a candidate fires depends on the one before it, so the fold over a key is sequential.
Time counts in whole seconds, which bounds what reaches the fold: within one second only the
first candidate of a key can fire (or, with several patterns, the first few of each pattern
set), so the rest is cut by a windowed rank that every task applies before the shuffle. A key
that holds a third of all rows therefore costs at most one row per second and pattern set. The plain
cooldown is then folded in blocks that are independent once each has told how it passes a cooldown on;
with patterns, gaps of at least the cooldown split a key into independent stretches.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.functions.times import epoch_seconds

COOLDOWN_SECONDS = 300


def fires(seconds, cooldown, last=None):
    """Positions that fire in an ascending array of seconds, jumping from fire to fire."""
    out, i = [], 0
    if last is not None:
        i = int(np.searchsorted(seconds, last + cooldown))
    while i < len(seconds):
        out.append(i)
        i = int(np.searchsorted(seconds, seconds[i] + cooldown))
    return out


def _stretches(df, keys, seconds, chunk=50_000):
    """Add ``_stretch``, which only changes at a gap of at least the cooldown.

    Several short stretches share a number, so that a group holds about ``chunk`` rows.
    """
    w = W.partitionBy(*keys).orderBy("_sec")
    gap = F.col("_sec") - F.lag("_sec").over(w)
    start = F.when(F.coalesce(gap >= seconds, F.lit(True)), F.row_number().over(w))
    return df.withColumn("_start", start).withColumn(
        "_stretch", F.floor(F.max("_start").over(w) / chunk)).drop("_start")


BLOCK_SECONDS = 86_400


def transfer(times, cooldown, begin):
    """How a block of ascending seconds passes a cooldown on: ``(starts, ready)``.

    A key is ready ``cooldown`` seconds after its last fire. Ready at ``r`` when the block begins, it fires first
    at the first candidate from ``r`` on, and ``ready`` of that candidate tells when it is ready behind the
    block. A fire before the block leaves ``r`` below ``begin + cooldown``, so later candidates but one
    cannot be the first.
    """
    follow = np.searchsorted(times, times + cooldown)
    last = np.arange(len(times))
    for i in range(len(times) - 1, -1, -1):
        if follow[i] < len(times):
            last[i] = last[follow[i]]
    some = int(np.searchsorted(times, begin + cooldown)) + 1
    return times[:some], times[last[:some]] + cooldown


def _ready(blocks, seconds):
    """When a key is ready at the start of each of its blocks: one look-up a block."""
    out, ready = [], None
    for starts, after in zip(blocks["_starts"], blocks["_after"]):
        out.append(ready)
        at = 0 if ready is None else int(np.searchsorted(starts, ready))
        if at < len(starts):
            ready = int(after[at])
    return out


def cooldown(df, key, time="timestamp", seconds=COOLDOWN_SECONDS, order="id"):
    """Candidates that fire: the first of a key, then the first at least ``seconds`` later.

    The seconds of a key are cut into blocks of a day or more. Each block reports how it passes a cooldown
    on, one row per block; from these a key's state before each block follows, and the blocks are then
    folded independently. A busy key is thus as many tasks as it has days.
    """
    keys = [key] if isinstance(key, str) else list(key)
    first = W.partitionBy(*keys, "_sec").orderBy(time, order)
    rows = df.withColumn("_sec", epoch_seconds(df, time))
    rows = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n")
    # the folds see only keys and seconds; the rows are joined back
    size = max(BLOCK_SECONDS, seconds)
    times = rows.select(*keys, "_sec", F.floor(F.col("_sec") / size).alias("_block"))
    own = [times.schema[k] for k in keys]
    block, array = T.StructField("_block", T.LongType()), T.ArrayType(T.LongType())

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        starts, after = transfer(np.sort(pdf["_sec"].to_numpy()), seconds, int(pdf["_block"].iloc[0]) * size)
        return pdf[[*keys, "_block"]].head(1).assign(_starts=[starts], _after=[after])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block").reset_index(drop=True)
        return pdf[[*keys, "_block"]].assign(_ready=pd.array(_ready(pdf, seconds), dtype="Int64"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_sec").reset_index(drop=True)
        ready = pdf["_ready"].iloc[0]
        return pdf.iloc[fires(pdf["_sec"].to_numpy(), seconds, None if pd.isna(ready) else int(ready) - seconds)][[*keys, "_sec"]]

    passed = times.groupBy(*keys, "_block").applyInPandas(report, T.StructType([*own, block, T.StructField("_starts", array), T.StructField("_after", array)]))
    ready = passed.groupBy(*keys).applyInPandas(walk, T.StructType([*own, block, T.StructField("_ready", T.LongType())]))
    same = [times[c].eqNullSafe(ready[c]) for c in [*keys, "_block"]]
    known = times.join(ready, same).select(*[times[k] for k in keys], times["_block"], times["_sec"], ready["_ready"])
    fired = known.groupBy(*keys, "_block").applyInPandas(fold, T.StructType([*own, T.StructField("_sec", T.LongType())]))
    return rows.join(fired, [*keys, "_sec"], "left_semi").drop("_sec").select(df.columns)


def pattern_fold(times, masks, seconds, last):
    """Fold rows of times and pattern masks in order; ``last`` maps pattern number to its last fire.

    Of the patterns a row matches, the first one not cooling down fires. Returns ``[(row, pattern)]``.
    """
    out = []
    for i, (sec, mask) in enumerate(zip(times.to_numpy(), masks.to_numpy())):
        mask, number = int(mask), 0
        while mask:
            if mask & 1 and sec - last.get(number, -seconds * 2) >= seconds:
                last[number] = int(sec)
                out.append((i, number))
                break
            mask >>= 1
            number += 1
    return out


def first_of_each_second(df, key, time="timestamp", order="id", mask="_mask"):
    """Rows that can still fire: of each key, second and pattern set as many as it has patterns."""
    w = W.partitionBy(key, "_sec", mask).orderBy(time, order)
    most = df.withColumn("_sec", epoch_seconds(df, time)).withColumn("_n", F.row_number().over(w))
    # a constant bound lets each task cut its rows before the shuffle; the exact one follows
    most = most.where(F.col("_n") <= 64)
    return most.where(F.col("_n") <= F.bit_count(mask)).drop("_n")


def pattern_cooldown(df, key, time="timestamp", order="id", seconds=COOLDOWN_SECONDS, mask="_mask"):
    """``key, id, pattern``: the pattern each firing row fires. ``mask`` has one bit per pattern."""
    rows = first_of_each_second(df.select(key, time, order, mask), key, time, order, mask)
    rows = _stretches(rows.select(key, time, "_sec", order, F.col(mask).alias("_mask")), [key], seconds)
    schema = T.StructType([rows.schema[key], rows.schema[order], T.StructField("pattern", T.IntegerType())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([time, order]).reset_index(drop=True)
        fired = pattern_fold(pdf["_sec"], pdf["_mask"], seconds, {})
        picked = pdf.iloc[[i for i, _ in fired]][[key, order]]
        return picked.assign(pattern=np.array([p for _, p in fired], dtype="int32"))

    return rows.groupBy(key, "_stretch").applyInPandas(fold, schema)
