"""Statistics over bucketed series.

Every function takes a table of buckets ``(key, order, value)`` and adds a column. The windows
run over buckets, so one task holds at most the buckets of one series: a month of minutes is
43,200 rows however many log rows they count.
"""

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _keys(key):
    return [key] if isinstance(key, str) else list(key)


def _flag(cond):
    return F.coalesce(cond, F.lit(False))


class _Spread:
    """Mean and population deviation of the points in a frame, and tests against them.

    Counts are whole numbers, and a count often lies exactly on a bound. So whole numbers are
    tested without division: ``(n v - sum)^2 > k^2 (n sum of squares - sum^2)``.
    """

    def __init__(self, series, value, over):
        self.value = F.col(value)
        self.exact = isinstance(series.schema[value].dataType, T.IntegralType)
        self.n = over(F.count("*"))
        self.mean = over(F.avg(value))
        if self.exact:
            v = self.value.cast("decimal(18,0)")
            total, squares = over(F.sum(v)), over(F.sum(v * v))
            self._off = self.n * v - total
            self._var = self.n * squares - total * total
            self.flat = self._var == 0
        else:
            self.std = over(F.stddev_pop(value))
            self.flat = self.std == 0

    def above(self, k):
        if self.exact:
            return (self._off > 0) & (self._off * self._off > self._var * F.lit(Decimal(str(k)) ** 2))
        return self.value > self.mean + k * self.std

    def below(self, k):
        if self.exact:
            return (self._off < 0) & (self._off * self._off > self._var * F.lit(Decimal(str(k)) ** 2))
        return self.value < self.mean - k * self.std

    def outside(self, k):
        return ~self.flat & (self.above(k) | self.below(k))


def _history(key, order, size):
    return W.partitionBy(*_keys(key)).orderBy(order).rowsBetween(-size, -1)


def zscore_anomalies(series, key, order, value, threshold=3.0, name="is_anomaly"):
    """Values further than ``threshold`` population deviations from the mean of their series.

    Series of fewer than three points or without spread have no anomalies.
    """
    w = W.partitionBy(*_keys(key))
    s = _Spread(series, value, lambda a: a.over(w))
    return series.withColumn(name, _flag((s.n >= 3) & s.outside(threshold)))


def moving_avg_anomalies(series, key, order, value, window=10, threshold=2.0, name="is_anomaly"):
    """Values off the mean of the previous ``window`` points; the first ``window`` never count."""
    w = _history(key, order, window)
    s = _Spread(series, value, lambda a: a.over(w))
    return series.withColumn(name, _flag((s.n == window) & s.outside(threshold)))


def ewma_anomalies(series, key, order, value, span=10, threshold=2.5, name="is_anomaly"):
    """Values off the exponentially weighted mean before them.

    The deviation includes the tested point. A running mean is inherently ordered, so each
    series is one group of buckets.
    """
    alpha = 2.0 / (span + 1)
    schema = T.StructType(series.schema.fields + [T.StructField(name, T.BooleanType())])

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        x = pdf[value].astype(float)
        mean = x.ewm(alpha=alpha, adjust=False).mean()
        diff = (x - mean.shift(1)).fillna(0.0)
        std = np.sqrt((diff ** 2).ewm(alpha=alpha, adjust=False).mean())
        flags = (std > 0) & (diff.abs() > threshold * std) & (len(x) >= 3)
        return pdf.assign(**{name: flags.to_numpy()})

    return series.groupBy(*_keys(key)).applyInPandas(mark, schema)


def spike(series, key, order, value, history=10, multiplier=3.0, name="is_spike"):
    """Sudden rises against the previous ``history`` points.

    One point of history counts as a tenth of itself of deviation; without deviation the value
    must exceed the mean ``multiplier`` times.
    """
    w = _history(key, order, history)
    s = _Spread(series, value, lambda a: a.over(w))
    one = F.when(s.mean == 0, s.value > 0).otherwise(s.value > s.mean * (1 + 0.1 * multiplier))
    high = F.when(s.n == 1, one).when(s.flat, s.value > s.mean * multiplier).otherwise(s.above(multiplier))
    return series.withColumn(name, _flag((s.n > 0) & high))


def drop(series, key, order, value, history=10, multiplier=3.0, name="is_drop"):
    """Sudden falls against the previous ``history`` points."""
    w = _history(key, order, history)
    s = _Spread(series, value, lambda a: a.over(w))
    one = F.when(s.mean == 0, s.value < 0).otherwise(s.value < s.mean * (1 - 0.1 * multiplier))
    flat = s.value < s.mean / max(multiplier, 1)
    low = F.when(s.n == 1, one).when(s.flat, flat).otherwise(s.below(multiplier))
    return series.withColumn(name, _flag((s.n > 0) & low))


def anomaly_score(series, key, order, value, history=10, name="anomaly_score"):
    """0 (normal) to 1 from the distance to the previous ``history`` points."""
    w = _history(key, order, history)
    n, avg, std = F.count("*").over(w), F.avg(value).over(w), F.stddev_pop(value).over(w)
    off = F.abs(F.col(value) - avg)
    flat = F.when(F.col(value) == avg, 0.0).otherwise(F.least(off / F.greatest(avg, F.lit(1.0)), F.lit(1.0)))
    z = off / std
    score = F.when(n < 2, 0.0).when(std == 0, flat).otherwise(F.least(1 - 1 / (1 + 0.1 * z * z), F.lit(1.0)))
    return series.withColumn(name, score)
