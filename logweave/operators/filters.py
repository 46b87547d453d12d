"""Row filters. All are column predicates, so equality, ``IN`` and time bounds reach Parquet."""

import json
from decimal import Decimal

from pyspark.sql import functions as F

from logweave.functions.times import PRESETS, as_of as _as_of, since, time_lit
from logweave.model import ERROR_LEVELS, LEVELS


def filter_eq(df, **equals):
    """Keep rows whose columns equal the given values; ``None`` values are ignored."""
    for name, value in equals.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def parse_levels(levels):
    """A list or comma list of level names, upper-cased and checked."""
    if not levels:
        return []
    parts = levels.split(",") if isinstance(levels, str) else levels
    names = [p.strip().upper() for p in parts if p.strip()]
    unknown = [n for n in names if n not in LEVELS]
    if unknown:
        raise ValueError(f"unknown log level {unknown[0]!r}, use one of {', '.join(LEVELS)}")
    return names


def filter_levels(df, levels):
    names = parse_levels(levels)
    return df.where(F.col("level").isin(names)) if names else df


def filter_time(df, start=None, end=None, name="timestamp"):
    """Closed range. Stored tables are also pruned by their ``log_date`` partition."""
    if start is not None:
        low = time_lit(df, start, name)
        df = df.where(F.col(name) >= low)
        if "log_date" in df.columns:
            df = df.where(F.col("log_date") >= low.cast("date"))
    if end is not None:
        high = time_lit(df, end, name)
        df = df.where(F.col(name) <= high)
        if "log_date" in df.columns:
            df = df.where(F.col("log_date") <= high.cast("date"))
    return df


def filter_last(df, interval, as_of=None, name="timestamp"):
    """Rows newer than ``as_of - interval`` (open bound)."""
    low = since(_as_of(df, as_of, name), interval)
    if "log_date" in df.columns:
        df = df.where(F.col("log_date") >= low.cast("date"))
    return df.where(F.col(name) > low)


def ui_window(df, preset, as_of=None):
    """The relative ranges of the log browser: closed at both ends."""
    end = _as_of(df, as_of)
    return filter_time(df, since(end, PRESETS[preset]), end)


def filter_errors(df, with_warnings=False):
    return df.where(F.col("level").isin(ERROR_LEVELS + (["WARN"] if with_warnings else [])))


def filter_not_null(df, *names):
    for name in names:
        df = df.where(F.col(name).isNotNull())
    return df


def ilike(column, term):
    """Case-blind substring test that takes ``%`` and ``_`` literally."""
    return F.contains(F.lower(F.col(column)), F.lower(F.lit(term)))


def filter_ilike(df, term, columns=("service_name", "message", "host")):
    cond = F.lit(False)
    for name in columns:
        cond = cond | F.coalesce(ilike(name, term), F.lit(False))
    return df.where(cond)


def match_regex(df, pattern, column="message"):
    """Case-blind regular expression search."""
    return df.where(F.rlike(F.col(column), F.lit("(?i)" + pattern)))


def filter_alerts(alerts, status=None, severity=None, service_name=None):
    return filter_eq(alerts, status=status, severity=severity, service_name=service_name)


def filter_anomalies(anomalies, service_name=None, anomaly_type=None, start=None, end=None):
    anomalies = filter_eq(anomalies, service_name=service_name, anomaly_type=anomaly_type)
    return filter_time(anomalies, start, end, "detected_at")


def trace_lookup(df, trace_id):
    """All spans of a trace in time order; one day of spans at most, so the sort is small."""
    return df.where(F.col("trace_id") == trace_id).orderBy("timestamp", "id")


def parse_metadata_filter(text):
    """JSON object text or ``k=v,k=v`` pairs to a dict; ``None`` when nothing is asked."""
    if not text or isinstance(text, dict):
        return text or None
    text = text.strip()
    if text.startswith("{"):
        try:
            return json.loads(text)
        except json.JSONDecodeError:
            pass
    pairs = (p.partition("=") for p in text.split(",") if "=" in p)
    return {k.strip(): v.strip() for k, _, v in pairs if k.strip()} or None


def _path(key):
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _contains(value, wanted):
    """Containment of a plain Python value in a variant column, unrolled into expressions."""
    kind = F.schema_of_variant(value)
    if isinstance(wanted, dict):
        cond = F.startswith(kind, F.lit("OBJECT"))
        for key, inner in wanted.items():
            cond = cond & _contains(F.try_variant_get(value, _path(key), "variant"), inner)
        return F.coalesce(cond, F.lit(False))
    if isinstance(wanted, list):
        items = F.try_variant_get(value, "$", "array<variant>")
        cond = F.startswith(kind, F.lit("ARRAY"))
        for inner in wanted:
            cond = cond & F.exists(items, lambda item: _contains(item, inner))
        return F.coalesce(cond, F.lit(False))
    if wanted is None:
        return F.coalesce(kind == "VOID", F.lit(False))
    if isinstance(wanted, bool):
        same = (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == F.lit(wanted))
    elif isinstance(wanted, (int, float)):
        number = F.try_variant_get(value, "$", "decimal(38,12)")
        same = ~kind.isin("STRING", "BOOLEAN") & (number == F.lit(Decimal(str(wanted))).cast("decimal(38,12)"))
    else:
        same = (kind == "STRING") & (F.try_variant_get(value, "$", "string") == F.lit(str(wanted)))
    return F.coalesce(same, F.lit(False))


def filter_metadata(df, wanted, col="metadata"):
    """Rows whose JSON metadata contains the given object (nested objects and lists too)."""
    wanted = parse_metadata_filter(wanted)
    if not wanted:
        return df
    value = F.col(col)
    if df.schema[col].dataType.simpleString() != "variant":
        value = F.try_parse_json(value)
    return df.where(_contains(value, wanted))
