"""From raw lines or structured documents to normalised, validated log rows.

All steps are projections: a whole ingest run has no shuffle.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from logweave.functions import parsing as P
from logweave.functions.levels import normalize_level
from logweave.functions.masking import strip
from logweave.functions.timestamps import read_timestamp
from logweave.model import LEVELS, STRUCTURED_SCHEMA
from logweave.session import small_methods

_STRICT = {"allowSingleQuotes": "false"}

_STEPS = [
    ("_s5424", P.syslog_5424_groups, P.syslog_5424_entry),
    ("_s3164", P.syslog_3164_groups, P.syslog_3164_entry),
    ("_access", P.access_log_groups, P.access_log_entry),
    ("_plain", P.plain_text_groups, P.plain_text_entry),
    ("_level", P.level_prefix_groups, P.level_prefix_entry),
]


def auto_parse(df, col="value"):
    """Detect the format of each line and add the parsed fields.

    The formats are tried in a fixed order; a later pattern only runs on lines the earlier
    ones left over. Each step is its own projection, so no pattern is evaluated twice.
    """
    keep = df.columns
    df = df.withColumn("_wrapped", P.json_wrapped(F.col(col)))
    df = df.withColumn("_fields", P.json_fields(F.col("_wrapped")))
    df = df.withColumn("_values", P.json_values(F.col("_fields")))
    df = df.withColumn("_entry", F.when(F.col("_fields").isNotNull(), P.json_entry(F.col("_fields"), F.col("_values"))))
    for name, match, build in _STEPS:
        df = df.withColumn(name, F.when(F.col("_entry").isNull(), match(F.col(col))))
        built = F.when(F.col(name).isNotNull(), build(F.col(name)))
        df = df.withColumn("_entry", F.coalesce(F.col("_entry"), built))
    df = df.withColumn("_entry", F.coalesce(F.col("_entry"), P.fallback_entry(F.col(col))))
    return df.select(*keep, "_entry.*")


def normalize_entry(df, as_of=None, raw_env_null=False, key=None):
    """Fill defaults and bring every field to its final form.

    A missing trace id becomes the md5 of the row key (``key`` column, else ``id`` if there is one and it
    is set, else the row itself), so a replay gives the same id. On streams without a key it stays null
    until the row has its id (``fill_traces``), as equal lines are still the same row. ``raw_env_null`` keeps
    the environment of parsed lines null. ``time_replaced`` tells that the time could not be read and is ``as_of``.
    """
    now = F.current_timestamp() if as_of is None else (F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of)
    service, message = strip("service_name"), strip("message")
    trace, env = F.nullif("trace_id", F.lit("")), F.col("environment")
    own = F.to_json(F.struct("timestamp", "level", "service_name", "message", "host", "metadata"))
    if key or "id" in df.columns:
        own = F.coalesce(F.col(key or "id").cast("string"), own)
    if not raw_env_null:
        env = F.coalesce(env, F.lit("production"))
    fields = {
        "timestamp": F.coalesce("_read", now),
        "time_replaced": F.col("_read").isNull(),
        "level": normalize_level("level"),
        "service_name": F.coalesce(F.nullif(service, F.lit("")), F.lit("unknown")),
        "message": F.coalesce(F.nullif(message, F.lit("")), F.lit("(empty)")),
        "trace_id": trace if df.isStreaming and not (key or "id" in df.columns) else F.coalesce(trace, F.md5(own)),
        "environment": env,
        # repeated keys are no variant, but can be read as a map
        "metadata": F.when(F.startswith(F.trim("metadata"), F.lit("{")) & (F.is_variant_null(F.try_parse_json("metadata")).isNotNull()
                           | F.from_json("metadata", "map<string,variant>", _STRICT).isNotNull()),
                           F.col("metadata")).otherwise("{}"),
    }
    return df.withColumn("_read", read_timestamp("timestamp", now)).withColumns(fields).drop("_read")


# Field limits of the log table.
LIMITS = {"service_name": 255, "trace_id": 64, "span_id": 32, "environment": 50, "host": 255}
RAW_CHARS = 1_048_576

# Every line break of Unicode text, not only newlines.
LINE_BREAK = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


def validate_entries(df, need_time=True):
    """Add ``rejected``: the names of the rules the row breaks; empty means storable.

    ``need_time=False`` leaves out the time rule, for rows whose time is still to be filled in.
    """
    rules = {
        "level": ~F.coalesce(F.col("level").isin(LEVELS), F.lit(False)),
        "timestamp": F.col("timestamp").isNull() if need_time else F.lit(False),
        "service_name": ~F.coalesce(F.length("service_name"), F.lit(0)).between(1, LIMITS["service_name"]),
        "message": F.coalesce(F.length("message"), F.lit(0)) < 1,
    }
    for name in ["trace_id", "span_id", "environment", "host"]:
        rules[name] = F.coalesce(F.length(name) > LIMITS[name], F.lit(False))
    return df.withColumn("rejected", F.array_compact(F.array(*[
        F.when(broken, F.lit(name)) for name, broken in rules.items()])))


def validate_raw(df, col="value"):
    """Raw texts of allowed length; the others carry ``rejected = ['raw']``."""
    size = F.coalesce(F.length(col), F.lit(0))
    return df.withColumn("rejected", F.when(size.between(1, RAW_CHARS), F.array().cast("array<string>"))
                         .otherwise(F.array(F.lit("raw"))))


def with_overrides(df, service_name=None, environment=None, host=None):
    """Sender-supplied values for fields the parser could not find."""
    fields = {}
    if service_name:
        fields["service_name"] = F.when(F.col("service_name") == "unknown", F.lit(service_name)).otherwise(F.col("service_name"))
    if environment:
        fields["environment"] = F.coalesce("environment", F.lit(environment))
    if host:
        fields["host"] = F.coalesce("host", F.lit(host))
    return df.withColumns(fields) if fields else df


def _generation(df):
    """What tells one content of a file from the next under the same name: time of change and size.
    Rows that are not read from files have none."""
    columns = ["_metadata.file_modification_time", "_metadata.file_size"]
    try:
        df.select(*columns)
    except AnalysisException:
        return []
    return [F.col(c) for c in columns]


def own_trace(key="id"):
    """The trace id of a row that brings none."""
    return F.md5(F.col(key).cast("string"))


def fill_traces(df):
    """Rows without a trace get that of their ``id``."""
    return df.withColumn("trace_id", F.coalesce("trace_id", own_trace()))


def with_identity(df, *salt):
    """Add ``id`` and ``ingested_at`` where they are missing (not for streams, see ``store_batch``).

    The id is a hash of the source file, its generation, the block's start and the row's place in its
    partition, so a task that runs again gives the same ids, and a file of the same name with other
    content (a rotated or grown log) gives new ones. ``salt`` tells apart what is read in several goes.
    """
    place = [F.input_file_name(), *_generation(df), F.expr("input_file_block_start()"), F.monotonically_increasing_id()]
    own = F.xxhash64(*place, *[F.lit(s) for s in salt])
    df = df.withColumn("id", F.coalesce(F.col("id").cast("long"), own) if "id" in df.columns else own)
    return df if "ingested_at" in df.columns else df.withColumn("ingested_at", F.current_timestamp())


def ingest_raw_lines(df, col="value", as_of=None, raw_env_null=False, **overrides):
    """Text (one line or a block per row) to normalised rows with ``id`` and ``ingested_at``; blank lines
    are dropped. Rows that bring an ``id`` keep it for their first line. ``overrides`` are the sender's
    values of :func:`with_overrides`."""
    df = small_methods(df)
    if not df.isStreaming:
        df = with_identity(df)
    lines = df.select("*", F.posexplode(F.split(col, LINE_BREAK)).alias("_line", "_text")).withColumn(col, F.col("_text")).drop("_text")
    if "id" in df.columns:
        lines = lines.withColumn("id", F.when(F.col("_line") == 0, F.col("id").cast("long")).otherwise(F.xxhash64("id", "_line")))
    lines = lines.drop("_line").where(strip(col) != "")
    return normalize_entry(with_overrides(auto_parse(lines, col), **overrides), as_of, raw_env_null)


def ingest_structured(df, col="value", as_of=None):
    """JSON documents of the structured schema to validated rows.

    Values that break a rule are reported in ``rejected``; nothing is dropped here. A text that is no
    JSON object is rejected for rule ``json``; ``raw`` keeps the text of every rejected row.
    """
    keep = [c for c in df.columns if c != col and c not in STRUCTURED_SCHEMA.names]
    text = F.col(col)
    rows = df.select(*keep, F.from_json(col, STRUCTURED_SCHEMA).alias("_doc"), text.alias("_raw"))
    broken = F.from_json("_raw", "map<string,string>", _STRICT).isNull() | ~F.coalesce(F.startswith(strip("_raw"), F.lit("{")), F.lit(False))
    rows = rows.withColumn("_broken", broken).select(*keep, "_doc.*", "_raw", "_broken")
    rows = rows.withColumns({"level": F.coalesce("level", F.lit("INFO")),
                             "environment": F.coalesce("environment", F.lit("production"))})
    checked = validate_entries(rows if df.isStreaming else with_identity(rows), need_time=False)
    reasons = F.when(F.col("_broken"), F.array_append("rejected", F.lit("json"))).otherwise(F.col("rejected"))
    checked = checked.withColumn("rejected", reasons).withColumn("raw", F.when(F.size("rejected") > 0, F.col("_raw")))
    return normalize_entry(checked.drop("_raw", "_broken"), as_of)
