"""Registry of the checked queries: a Spark callable and, where SQL can say it, its SQL twin."""

from logweave.sources.events import EVENT_LOG_COLUMNS, logs_from_events

QUERIES = {}
SQL = {}


def query(name, sql=None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark, sf_dir):
    """The log table the checks run on: every row of ``events``."""
    return logs_from_events(table(spark, sf_dir, "events"))


_COLUMNS = ",\n ".join(f"{sql} AS {name}" for name, sql in EVENT_LOG_COLUMNS.items())


def fingerprint_sql(message, service):
    # The masks of ``functions.masking`` in SQL notation.
    masked = f"trim({message})"
    for pattern, tag, flags in [
        ("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>", "gi"),
        (r"\b\d{4,}\b", "<ID>", "g"),
        (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>", "g"),
        (r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<TS>", "g"),
        (r"\b[0-9a-f]{8,}\b", "<HEX>", "gi"),
    ]:
        masked = f"regexp_replace({masked}, '{pattern}', '{tag}', '{flags}')"
    return f"substr(md5(concat({service}, ':', {masked})), 1, 16)"


def template_sql(message):
    # The masks of ``functions.masking`` in SQL notation.
    masked = f"lower({message})"
    for pattern, tag in [
        ("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"),
        (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<ip>"),
        (r"\b\d{4,}\b", "<num>"),
        (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", "<ts>"),
        ("[0-9a-f]{8,}", "<hex>"),
    ]:
        masked = f"regexp_replace({masked}, '{pattern}', '{tag}', 'g')"
    return f"trim({masked})"


# ``logs`` for DuckDB; ``err`` and ``now`` are shorthands the query texts use.
LOGS_CTE = f"""raw AS (SELECT {_COLUMNS} FROM events),
logs AS (SELECT *, CASE WHEN level IN ('ERROR','FATAL') THEN {fingerprint_sql('message', 'service_name')} END
 AS error_fingerprint, level IN ('ERROR','FATAL') AS err FROM raw),
nowt AS (SELECT max(log_ts) AS now FROM logs),
day AS (SELECT logs.* FROM logs, nowt WHERE log_ts > now - INTERVAL 24 HOUR)"""


def with_logs(body, *ctes, recursive=False):
    """SQL text with the ``logs`` tables in front of ``body``."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join([LOGS_CTE, *ctes]) + "\n" + body
