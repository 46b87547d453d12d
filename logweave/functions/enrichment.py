"""Fields, stack traces and metadata drawn from the message text."""

from pyspark.sql import functions as F

from logweave.functions.masking import strip

# Extraction patterns, and the substrings that mark a stack trace.
STATUS_CODE = r"(?iU)\b(status[_\s]?(?:code)?|HTTP)[:\s=]*(\d{3})\b"
DURATION = r"(?iU)\b(?:duration|elapsed|took|time|latency|response_time)[:\s=]*(\d+(?:\.\d+)?)\s*(?:ms|milliseconds|s|seconds)?\b"
IP_ADDRESS = r"(?U)\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
URL_PATH = r"(?iU)(?:GET|POST|PUT|DELETE|PATCH)\s+(/[^\s]*)"
EXCEPTION = r"(?iU)(?:Exception|Error|Traceback|Caused by)[:\s]+(.+?)(?:\n|$)"
USER_ID = r"(?iU)\buser[_\s]?(?:id)?[:\s=]*([a-zA-Z0-9_-]+)\b"
STACK_TRACE_MARKS = ["Traceback (most recent call last)", "at ", "Exception in thread", "Caused by:", "    at ", 'File "']


def _column(c):
    return F.col(c) if isinstance(c, str) else c


def _may(c, *words):
    """Whether a pattern that needs one of ``words``, in any case, can match: a cheap test before it runs. Texts
    beyond ASCII always pass, as some of their letters equal ASCII ones of the other case."""
    found = F.octet_length(c) != F.length(c)
    for word in words:
        found = found | F.contains(F.lower(c), F.lit(word))
    return found


def duration_ms(message, convert_units=False):
    """First duration in the text. Units are ignored unless ``convert_units`` is set."""
    c = _column(message)
    may = _may(c, "duration", "elapsed", "took", "time", "latency")
    value = F.when(may, F.nullif(F.regexp_extract(c, DURATION, 1), F.lit(""))).cast("double")
    if convert_units:
        seconds = r"(?iU)\b(?:duration|elapsed|took|time|latency|response_time)[:\s=]*\d+(?:\.\d+)?\s*(?:s|seconds)\b"
        first = F.when(may, F.regexp_extract(c, DURATION, 0))
        value = F.when(F.rlike(first, F.lit(seconds)), value * 1000).otherwise(value)
    return value


def _hit(c, pattern, group):
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def extract_fields(message, convert_units=False, chars=None):
    """First hit of each pattern as a struct; fields without a hit are null. ``chars`` cuts the exception."""
    c = _column(message)
    status = F.when(_may(c, "status", "http"), _hit(c, STATUS_CODE, 2)).cast("int")
    # the mandatory literal characters are tested first: most lines skip these patterns
    ip = F.when(F.contains(c, F.lit(".")), _hit(c, IP_ADDRESS, 1))
    path = F.when(F.contains(c, F.lit("/")), _hit(c, URL_PATH, 1))
    kind = strip(F.regexp_extract(c, EXCEPTION, 1))
    kind = F.when(_may(c, "exception", "error", "traceback", "caused by") & F.rlike(c, F.lit(EXCEPTION)), kind if chars is None else F.substring(kind, 1, chars))
    return F.struct(
        status.alias("status_code"),
        duration_ms(c, convert_units).alias("duration_ms"),
        ip.alias("ip_address"),
        path.alias("url_path"),
        kind.alias("exception_type"),
        F.when(_may(c, "user"), _hit(c, USER_ID, 1)).alias("user_id"),
    )


# One line of a trace: ``Type: text``, with ``Caused by:`` allowed before an exception or error.
# ``(?d)`` ends lines at newlines only; ``[^\S\n]`` is white space within a line.
_NAME = r"\w+(?:\.\w+)*"
_TRACE_LINE = (
    r"(?Udm)^[^\S\n]*(?:(" + _NAME + r"(?:Error|Exception|Warning))|Caused by:[^\S\n]*(" + _NAME +
    r"(?:Exception|Error))):[^\S\n]*(\S[^\n]*?)?[^\S\n]*$"
)
_FRAME = r"(?Udm)^[^\S\n]*(?:at|File) (?=[^\n]*\S)"
_FRAME_STRICT = r'(?Udm)^[^\S\n]*(?:at [\w$.<>/]+\(|File "|Caused by:|Traceback \(most recent call last\)|Exception in thread)'


def extract_stack_trace(message, strict=False):
    """Stack trace facts, or null when the text holds no mark of one.

    The mark ``"at "`` also occurs in prose ("usage at 90%"); ``strict`` asks for a line that
    starts like a frame or a trace header instead.
    """
    c = _column(message)
    if strict:
        marked = F.rlike(c, F.lit(_FRAME_STRICT))
    else:
        marked = F.lit(False)
        for mark in STACK_TRACE_MARKS:
            marked = marked | F.contains(c, F.lit(mark))
    kind = F.coalesce(_hit(c, _TRACE_LINE, 1), _hit(c, _TRACE_LINE, 2))
    return F.when(marked, F.struct(
        F.lit(True).alias("has_stack_trace"),
        kind.alias("exception_type"),
        _hit(c, _TRACE_LINE, 3).alias("exception_message"),
        F.regexp_count(c, F.lit(_FRAME)).alias("stack_depth"),
    ))


def last_keys(fields):
    """A map as read from JSON with the last entry of each repeated key."""
    keys = F.map_keys(fields)
    last = F.map_from_entries(F.filter(
        F.map_entries(fields), lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"])))
    return F.when(F.size(keys) == F.size(F.array_distinct(keys)), fields).otherwise(last)


def merge_metadata(metadata, **parts):
    """JSON object text with extra keys; a null part leaves the key as it was. Of a repeated key the last
    one counts; an object that cannot be read for repeated keys within is replaced by an empty one. An object of
    at most one key, with a plain text, is its own normal form: the parts are put behind it as texts."""
    old = F.coalesce(metadata, F.lit("{}"))
    simple = F.rlike(old, F.lit(rf'^\{{(?:"(?!(?:{"|".join(parts)})")[A-Za-z0-9_]+":"[A-Za-z0-9_ .:-]*")?\}}\z'))
    own = F.nullif(F.substring(old, F.lit(2), F.length(old) - 2), F.lit(""))
    texts = [F.concat(F.lit(f'"{k}":'), F.to_json(F.parse_json(v))) for k, v in parts.items()]
    spliced = F.concat(F.lit("{"), F.concat_ws(",", own, *texts), F.lit("}"))
    base = last_keys(F.from_json(F.coalesce(metadata, F.lit("{}")), "map<string,variant>"))
    base = F.coalesce(base, F.from_json(F.lit("{}"), "map<string,variant>"))
    keys = F.array_compact(F.array(*[F.when(v.isNotNull(), F.lit(k)) for k, v in parts.items()]))
    extra = F.map_from_entries(F.array_compact(F.array(*[
        F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), F.parse_json(v).alias("value")))
        for k, v in parts.items()
    ])))
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(keys, k))
    return F.when(simple, spliced).otherwise(F.to_json(F.map_concat(kept, extra)))


def enrich(df, strict=False, convert_units=False, now=None):
    """Add ``extracted``, ``stack_trace`` and ``processed_at`` to the metadata.

    The facts also stay as columns ``extracted`` and ``stack_trace`` for use without JSON.
    """
    now = F.current_timestamp() if now is None else now
    found = df.withColumn("extracted", extract_fields("message", convert_units)).withColumn(
        "stack_trace", extract_stack_trace("message", strict))
    parts = {
        "extracted": F.when(F.to_json("extracted") != "{}", F.to_json("extracted")),
        "stack_trace": F.to_json("stack_trace", {"ignoreNullFields": "false"}),
        "processed_at": F.concat(F.lit('"'), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('"')),
    }
    staged = found.withColumns({f"_{k}": v for k, v in parts.items()})
    merged = merge_metadata(F.col("metadata"), **{k: F.col(f"_{k}") for k in parts})
    return staged.withColumn("metadata", merged).drop(*[f"_{k}" for k in parts])
