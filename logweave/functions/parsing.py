"""Log line parsers as column expressions.

Each ``parse_x`` maps a line to a struct ``ENTRY`` or null when the format does not match.
A pattern runs once per line: its groups are rewritten into one delimited text and split, and
the few lines that already hold its first character are read group by group instead.
"""

from pyspark.sql import functions as F

from logweave.functions.levels import syslog_severity
from logweave.functions.enrichment import last_keys
from logweave.functions.masking import strip

# Line patterns.
SYSLOG_3164 = (
    r"^(?:<(\d{1,3})>)?\s*([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.+)$"
)
SYSLOG_5424 = r"^<(\d{1,3})>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s*(?:\[.*?\]\s*)?(.*)$"
ACCESS_LOG = (
    r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*?)"\s+(\d{3})\s+(\d+|-)\s*(?:"([^"]*?)"\s*)?(?:"([^"]*?)")?'
)
PLAIN_TEXT = (
    r"^(\d{4}[-/]\d{2}[-/]\d{2}[T\s]\d{2}:\d{2}:\d{2}[.,]?\d*(?:Z|[+-]\d{2}:?\d{2})?)\s+(\w+)(?:\s+\[([^\]]+)\])?\s+(.+)$"
)
LEVEL_PREFIX = r"^\[?(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|ERR|FATAL|CRITICAL|SEVERE)\]?\s+(.+)$"

# JSON key names of each field, first non-empty one wins.
JSON_KEYS = {
    "message": ["message", "msg", "log", "text", "body"],
    "level": ["level", "severity", "log_level", "loglevel"],
    "timestamp": ["timestamp", "time", "ts", "@timestamp", "datetime"],
    "service_name": ["service_name", "service", "app", "application", "logger", "name"],
    "trace_id": ["trace_id", "traceId", "traceID"],
    "span_id": ["span_id", "spanId", "spanID"],
    "environment": ["environment", "env"],
    "host": ["host", "hostname", "server"],
}
FORMAT_KEY = "_parsed_format"
FALLBACK = "raw_fallback"

_MARK = "\u001f\u001e\u001f"
_FLAGS = "(?Us)"


def _column(c):
    return F.col(c) if isinstance(c, str) else c


def capture_groups(line, pattern, n, tail=".*"):
    """Array of the ``n`` groups of an anchored pattern, or null. A group left out is ''."""
    replacement = _MARK + _MARK.join(f"${i}" for i in range(1, n + 1))
    rewritten = F.regexp_replace(line, pattern + ("" if pattern.endswith("$") else tail), replacement)
    split = F.when(F.startswith(rewritten, F.lit(_MARK)),
                   F.slice(F.split(rewritten, _MARK), 2, n))
    one_by_one = F.when(F.rlike(line, F.lit(pattern)),
                        F.array(*[F.regexp_extract(line, pattern, i) for i in range(1, n + 1)]))
    return F.when(F.contains(line, F.lit(_MARK[0])), one_by_one).otherwise(split)


def _entry(timestamp=None, level=None, service=None, message=None, host=None, trace=None, span=None,
           environment=None, metadata=None, fmt=None):
    text = F.lit(None).cast("string")
    return F.struct(
        (text if timestamp is None else timestamp).alias("timestamp"),
        level.alias("level"), service.alias("service_name"), message.alias("message"),
        (text if trace is None else trace).alias("trace_id"),
        (text if span is None else span).alias("span_id"),
        (text if environment is None else environment).alias("environment"),
        (text if host is None else host).alias("host"),
        metadata.alias("metadata"),
        fmt.alias("format"),
    )


def _let(value, build):
    """``build(value)`` with ``value`` computed once; null stays null."""
    return F.transform(F.array(value), lambda v: F.when(v.isNotNull(), build(v)))[0]


def _dash(c):
    return F.when(c != "-", c)


def _meta(fmt, *fields, keep_null=True):
    columns = [*fields, F.lit(fmt).alias(FORMAT_KEY)]
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false" if keep_null else "true"})


# --- JSON --------------------------------------------------------------------

_OPTIONS = {"allowSingleQuotes": "false"}


def json_wrapped(line):
    """The line read as the only element of an array of objects, else null.

    The map reader ignores text after an object; inside the brackets it does not.
    """
    text = strip(line)
    found = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,variant>>", _OPTIONS)
    sealed = F.from_json(F.concat(F.lit('{"o":'), text, F.lit("}")), "map<string,variant>", _OPTIONS)
    # "}]" can close the wrapping array early, so such lines must also pass the other wrapping
    broken = F.rlike(text, F.lit(r"\}\s*\]")) & sealed.isNull()
    return F.when(F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}")) & ~broken, found)


def json_fields(wrapped):
    """Top-level keys as ``map<string, variant>``; of a repeated key the last one counts."""
    return F.when(F.size(wrapped) == 1, last_keys(F.get(wrapped, F.lit(0))))


def json_values(fields):
    """Known keys with a value, as text. Empty are null, false, 0, "", [] and {}."""
    known = [key for keys in JSON_KEYS.values() for key in keys]
    forms = F.transform_values(
        F.map_filter(fields, lambda k, v: k.isin(known)),
        lambda k, v: F.struct(F.to_json(v).alias("json"), v.cast("string").alias("text")))
    filled = F.map_filter(forms, lambda k, e: ~(
        e["json"].isin("null", "false", '""', "[]", "{}") | F.rlike(e["json"], F.lit(r"^-?0(?:\.0*)?(?:[eE].*)?$"))))
    return F.transform_values(filled, lambda k, e: F.when(e["json"] == "true", F.lit("True")).otherwise(e["text"]))


def json_entry(fields, values):
    """``ENTRY`` from the key maps; null when no message key has a value."""
    first = {
        name: F.coalesce(*[F.try_element_at(values, F.lit(key)) for key in keys])
        for name, keys in JSON_KEYS.items()
    }
    known = [key for keys in JSON_KEYS.values() for key in keys] + [FORMAT_KEY]
    rest = F.map_filter(fields, lambda k, v: ~k.isin(known))
    metadata = F.to_json(F.map_concat(rest, F.create_map(F.lit(FORMAT_KEY), F.parse_json(F.lit('"json"')))))
    return F.when(first["message"].isNotNull(), _entry(
        first["timestamp"], F.coalesce(first["level"], F.lit("INFO")),
        F.coalesce(first["service_name"], F.lit("unknown")), first["message"], first["host"],
        first["trace_id"], first["span_id"], first["environment"], metadata, F.lit("json")))


def parse_json_lines(line):
    def with_values(fields):
        return _let(json_values(fields), lambda values: json_entry(fields, values))
    return _let(json_wrapped(_column(line)), lambda wrapped: _let(json_fields(wrapped), with_values))


# --- syslog ------------------------------------------------------------------

def syslog_5424_groups(line):
    text = strip(line)
    return F.when(F.startswith(text, F.lit("<")), capture_groups(text, _FLAGS + SYSLOG_5424, 8))


def syslog_5424_entry(g):
    priority = g[0].cast("int")
    return _entry(
        g[2], syslog_severity(priority), F.coalesce(_dash(g[4]), F.lit("unknown")), g[7], _dash(g[3]),
        metadata=_meta(
            "syslog",
            F.shiftright(priority, 3).alias("syslog_facility"),
            priority.bitwiseAND(7).alias("syslog_severity"),
            g[1].try_cast("decimal(38,0)").alias("syslog_version"),
            _dash(g[5]).alias("syslog_procid"),
            _dash(g[6]).alias("syslog_msgid"),
        ), fmt=F.lit("syslog"))


def syslog_3164_groups(line):
    return capture_groups(strip(line), _FLAGS + SYSLOG_3164, 6)


def syslog_3164_entry(g):
    priority = F.nullif(g[0], F.lit("")).cast("int")
    return _entry(
        g[1], F.coalesce(F.when(priority.isNotNull(), syslog_severity(priority)), F.lit("INFO")),
        g[3], g[5], _dash(g[2]),
        metadata=_meta(
            "syslog",
            F.shiftright(priority, 3).alias("syslog_facility"),
            priority.bitwiseAND(7).alias("syslog_severity"),
            F.nullif(g[4], F.lit("")).alias("pid"),
            keep_null=False,
        ), fmt=F.lit("syslog"))


def parse_syslog_5424(line):
    return _let(syslog_5424_groups(_column(line)), syslog_5424_entry)


def parse_syslog_3164(line):
    return _let(syslog_3164_groups(_column(line)), syslog_3164_entry)


def parse_syslog(line):
    return F.coalesce(parse_syslog_5424(line), parse_syslog_3164(line))


# --- access log --------------------------------------------------------------

def access_log_groups(line):
    text = strip(line)
    groups = capture_groups(text, _FLAGS + ACCESS_LOG, 9)
    return F.when(F.contains(text, F.lit('"')), groups)


def access_log_entry(g):
    status, request = g[5].cast("int"), g[4]
    words = F.split(strip(request), r"(?U)\s+")
    level = F.when(status >= 500, "ERROR").when(status >= 400, "WARN").otherwise("INFO")
    sent = F.when(g[6] == "-", F.lit(0)).otherwise(g[6]).cast("decimal(38,0)")
    entry = _entry(
        g[3], level, F.lit("httpd"), F.concat(request, F.lit(" → "), status.cast("string")), g[0],
        metadata=_meta(
            "apache_combined",
            F.when(request != "", F.get(words, F.lit(0))).alias("http_method"),
            F.get(words, F.lit(1)).alias("http_path"),
            status.alias("http_status"),
            sent.alias("bytes_sent"),
            F.nullif(g[7], F.lit("")).alias("referer"),
            F.nullif(g[8], F.lit("")).alias("user_agent"),
            g[0].alias("client_ip"),
        ), fmt=F.lit("apache_combined"))
    # a request of blanks only is no request line
    return F.when((request == "") | (strip(request) != ""), entry)


def parse_access_log(line):
    return _let(access_log_groups(_column(line)), access_log_entry)


# --- plain text --------------------------------------------------------------

def plain_text_groups(line):
    return capture_groups(strip(line), _FLAGS + PLAIN_TEXT, 4)


def plain_text_entry(g):
    return _entry(g[0], F.upper(g[1]), F.coalesce(F.nullif(g[2], F.lit("")), F.lit("unknown")), g[3],
                  metadata=_meta("plain_text"), fmt=F.lit("plain_text"))


def level_prefix_groups(line):
    return capture_groups(strip(line), "(?Uis)" + LEVEL_PREFIX, 2)


def level_prefix_entry(g):
    return _entry(None, F.upper(g[0]), F.lit("unknown"), g[1],
                  metadata=_meta("plain_text"), fmt=F.lit("plain_text"))


def parse_plain_text(line):
    line = _column(line)
    return F.coalesce(_let(plain_text_groups(line), plain_text_entry),
                      _let(level_prefix_groups(line), level_prefix_entry))


def fallback_entry(line):
    text = strip(line)
    blank = F.coalesce(text, F.lit("")) == ""
    return _entry(None, F.lit("INFO"), F.lit("unknown"), F.when(blank, F.coalesce(line, F.lit(""))).otherwise(text),
                  metadata=F.when(blank, F.lit("{}")).otherwise(_meta(FALLBACK)),
                  fmt=F.when(~blank, F.lit(FALLBACK)))
