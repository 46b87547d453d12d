"""Reading and writing the stored log table, rejects and models."""

import json

from pyspark.sql import functions as F

from logweave.functions.times import time_type
from logweave.model import LOG_COLUMNS, LOG_SCHEMA
from logweave.operators.anomaly import Forest
from logweave.operators.filters import filter_time
from logweave.operators.ingest import validate_entries
from logweave.operators.patterns import Tfidf
from logweave.session import materialize


def scan_logs(spark, path, start=None, end=None, cols=None):
    """Rows of a stored table in a closed time range; whole days outside it are not opened."""
    rows = filter_time(spark.read.parquet(path), start, end)
    return rows.select(*(cols or [c for c in LOG_COLUMNS if c in rows.columns]))


def split_valid(df):
    """(storable rows, rejected rows with ``rejected``)."""
    checked = df if "rejected" in df.columns else validate_entries(df)
    ok = F.size("rejected") == 0
    return checked.where(ok).drop("rejected"), checked.where(~ok)


def stored_form(df):
    """Columns of the table in their stored types, missing ones null, plus the partition column ``log_date``."""
    have = set(df.columns)
    if "id" not in have:
        raise ValueError("rows need an id to be stored; see ingest.with_identity")
    rows = df.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA])
    rows = rows.withColumn("id", F.col("id").cast("long"))
    if "ingested_at" not in have:
        rows = rows.withColumn("ingested_at", F.current_timestamp().cast(time_type(df)))
    return rows.withColumn("log_date", F.to_date("timestamp"))


def dead_letter(rejected, at=None):
    """Rejected rows as ``original_id, data, error, failed_at``; ``data`` is the text that came in where it
    is known, else the row as JSON."""
    body = F.to_json(F.struct(*[c for c in rejected.columns if c not in ("rejected", "raw")]))
    if "raw" in rejected.columns:
        body = F.coalesce("raw", body)
    own = F.col("id").cast("string") if "id" in rejected.columns else F.lit(None).cast("string")
    return rejected.select(
        own.alias("original_id"), body.alias("data"),
        F.concat(F.lit("invalid "), F.concat_ws(", ", "rejected")).alias("error"),
        (F.current_timestamp() if at is None else at).alias("failed_at"))


def keep_newest(dead, n):
    """Retention of the reject table: the newest ``n``."""
    return dead.orderBy(F.desc("failed_at"), F.desc("original_id")).limit(n)


def write_logs(df, path, rejects_path=None, mode="append", cluster=True, batch_id=None, stage=True,
               source="batch"):
    """Store valid rows by day, rejected rows as dead letters.

    ``cluster`` sorts by range of day, service and time before writing. The ranges come from a
    sample of the data, so one busy day or service becomes many files and not one task; within
    files the order gives narrow row-group bounds. Trace ids get a bloom filter.

    Sorting by range and the rejects read the rows again, and parsing costs more than writing, so
    the checked rows are staged once in the checkpoint folder; pass ``stage=False`` for rows that
    are cheap or cached.

    The table's folders are ``source``, ``batch`` and ``log_date``, for batches and streams alike. A
    streaming micro-batch (``source`` and ``batch_id``) owns its folder: a repeated attempt replaces the
    whole of it, and other sources are never touched. Other writes append to source ``batch``; mode
    ``overwrite`` replaces that source alone.
    """
    checked = df if "rejected" in df.columns else validate_entries(df)
    if stage and (cluster or rejects_path is not None):
        checked = materialize(checked, "staged")
    good, bad = split_valid(checked)
    rows = stored_form(good)
    if cluster:
        rows = rows.repartitionByRange("log_date", "service_name", "timestamp", "id")
    rows = rows.sortWithinPartitions("log_date", "service_name", "timestamp")
    place, mode = (f"source={source}/batch=-1", mode) if batch_id is None else (f"source={source}/batch={batch_id}", "overwrite")
    rows.write.mode(mode).option("parquet.bloom.filter.enabled#trace_id", "true").partitionBy("log_date").parquet(f"{path}/{place}")
    if rejects_path is not None:
        dead_letter(bad).write.mode(mode).parquet(f"{rejects_path}/{place}")


def compact(spark, path, out):
    """Rewrite a table of many small micro-batch files clustered by day, service and time."""
    rows = spark.read.parquet(path).drop("source", "batch")
    (rows.repartitionByRange("log_date", "service_name", "timestamp", "id")
     .sortWithinPartitions("log_date", "service_name", "timestamp")
     .write.mode("overwrite").partitionBy("log_date").parquet(f"{out}/source=batch/batch=-1"))


def rows_from_arrays(df, **arrays):
    """Rows from parallel arrays: ``rows_from_arrays(batches, id="ids", level="levels")``."""
    zipped = F.arrays_zip(*[F.col(source).alias(name) for name, source in arrays.items()])
    rest = [c for c in df.columns if c not in arrays.values()]
    return df.select(*rest, F.inline(zipped))


# --- models ------------------------------------------------------------------

def save_model(spark, model, path):
    """Forest or vocabulary as Parquet, with one row of settings beside it."""
    if isinstance(model, Forest):
        table = spark.createDataFrame(model.nodes)
        meta = {"kind": "forest", "features": model.features, "sample_rows": model.sample_rows, "rows": model.rows,
                "contamination": model.contamination, "offset": model.offset, "version": model.version,
                "trained_at": model.trained_at}
    else:
        table = model.vocabulary
        meta = {"kind": "tfidf", "stop_words": model.stop_words, "max_features": model.max_features}
    table.write.mode("overwrite").parquet(f"{path}/table")
    spark.createDataFrame([(json.dumps(meta),)], "settings string").write.mode("overwrite").json(f"{path}/settings")


def load_model(spark, path):
    meta = json.loads(spark.read.schema("settings string").json(f"{path}/settings").first()[0])
    table = spark.read.parquet(f"{path}/table")
    if meta.pop("kind") == "forest":
        return Forest(table.toPandas(), **meta)
    return Tfidf(table, **meta)
