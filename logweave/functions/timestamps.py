"""Any time notation to a UTC timestamp."""

from pyspark.sql import functions as F

from logweave.functions.masking import strip

# Above this an epoch number counts milliseconds.
EPOCH_MS_FROM = 1e12

# Notations tried one after the other once ISO, epoch, access-log and syslog forms are ruled out.
FORMATS = [
    "yyyy/M/d H:mm:ss", "yyyy/M/d'T'H:mm:ss", "yyyy/M/d", "M/d/yyyy H:mm:ss", "M/d/yyyy",
    "d MMM yyyy H:mm:ss xx", "d MMM yyyy H:mm:ss z", "d MMM yyyy H:mm:ss", "d MMM yyyy",
    "MMM d, yyyy H:mm:ss", "MMM d, yyyy", "MMM d yyyy H:mm:ss", "MMM d H:mm:ss yyyy",
    "yyyyMMdd'T'HHmmss", "yyyyMMdd'T'HHmmssX",
    "yyyy/M/d H:mm", "yyyy.M.d H:mm:ss", "yyyy.M.d H:mm", "yyyy.M.d", "M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a", "M/d/yyyy H:mm",
    "d MMM yyyy H:mm", "MMM d, yyyy h:mm:ss a", "MMM d, yyyy h:mm a", "MMM d, yyyy H:mm", "MMMM d, yyyy H:mm:ss", "MMMM d, yyyy",
    "d MMMM yyyy H:mm:ss", "d MMMM yyyy", "d-M-yyyy H:mm:ss", "d-M-yyyy H:mm", "d-M-yyyy",
]


def _column(c):
    return F.col(c) if isinstance(c, str) else c


def _try(text, fmt):
    return F.try_to_timestamp(text, F.lit(fmt))


def read_timestamp(ts, as_of):
    """UTC timestamp of a text or epoch value, null when there is none or it cannot be read.

    Times without a zone are UTC; syslog times get the year of ``as_of``. Of two numbers before the year
    the one behind a slash is the day, the one before a dash too.
    """
    text = F.regexp_replace(strip(_column(ts).cast("string")), r"(?U)\s+", " ")
    number = F.when(F.rlike(text, F.lit(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$")), text.try_cast("double"))
    seconds = F.when(number > EPOCH_MS_FROM, number / 1000).otherwise(number)
    # a double keeps whole microseconds for any year below 2200
    epoch = F.when(F.abs(seconds) < 253402300800, F.timestamp_micros(F.round(seconds * 1000000).cast("bigint")))
    iso_text = F.regexp_replace(text, r"(\d),(\d)", "$1.$2")
    iso = F.when(F.rlike(text, F.lit(r"^\d{4}-\d")), iso_text.try_cast("timestamp"))
    access = F.when(F.rlike(text, F.lit(r"^\d{2}/[A-Za-z]{3}/\d{4}:")), F.coalesce(
        _try(text, "dd/MMM/yyyy:HH:mm:ss xx"), _try(text, "dd/MMM/yyyy:HH:mm:ssxx")))
    syslog = F.when(F.rlike(text, F.lit(r"^[A-Za-z]{3} \d{1,2} \d{2}:\d{2}:\d{2}$")), _try(
        F.concat(F.year(as_of).cast("string"), F.lit(" "), text), "yyyy MMM d HH:mm:ss"))
    dated = F.regexp_replace(iso_text, r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? ", "")
    others = F.coalesce(*[_try(dated, fmt) for fmt in FORMATS], _try(dated, "yyyy/M/d H:mm:ss.SSSSSS"),
                        _try(dated, "yyyy/M/d H:mm:ss.SSS"))
    return F.when(number.isNotNull(), epoch).otherwise(F.coalesce(iso, access, syslog, others))


def normalize_timestamp(ts, as_of):
    """As :func:`read_timestamp`, with ``as_of`` for what cannot be read."""
    return F.coalesce(read_timestamp(ts, as_of), as_of)
