"""Stored views whose days are recomputed one by one.

A refresh writes its rows to a folder of its own and then one new manifest version, a table that names for
every view and day the refresh that holds it. Nothing is overwritten: a reader resolves the newest manifest
once and sees the state before or after a refresh, never a mix. Two refreshes that end at once want the same
version number; the second fails and leaves the first one's state. Folders that no manifest in use names may be deleted.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructType

_SCHEMA = "view string, log_date date, refresh string, version int"


def _manifests(spark, path):
    try:
        return spark.read.schema(_SCHEMA).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SCHEMA)


def newest_version(spark, path):
    """Number of the newest manifest, 0 before the first."""
    return _manifests(spark, path).agg(F.max("version")).first()[0] or 0


def _at(spark, path, version):
    return _manifests(spark, path).where(F.col("version") == version).drop("version")


def write_part(rows, path, view, owner=None):
    """Write ``rows``, split by ``log_date`` where they have one; returns their manifest rows. The name of the
    refresh starts with ``owner`` and a dot, if given."""
    refresh = uuid.uuid4().hex if owner is None else f"{owner}.{uuid.uuid4().hex}"
    daily = "log_date" in rows.columns
    where = f"{path}/{view}/refresh={refresh}"
    writer = rows.write.partitionBy("log_date") if daily else rows.write
    writer.parquet(where)
    if daily:  # partition values only
        held = rows.sparkSession.read.schema(rows.schema).parquet(where).select("log_date").distinct()
    else:
        held = rows.sparkSession.range(1).select(F.lit(None).cast("date").alias("log_date"))
    return held.select(F.lit(view).alias("view"), "log_date", F.lit(refresh).alias("refresh"))


def publish(spark, path, parts, gone):
    """Make the manifest rows ``parts`` current; ``gone`` is the condition on older rows that no longer hold."""
    version = newest_version(spark, path)
    state = _at(spark, path, version).where(~F.coalesce(gone, F.lit(False)))
    for part in parts:
        state = state.unionByName(part)
    state.coalesce(1).write.parquet(f"{path}/manifest/version={version + 1}")  # a row per view and day


def read_view(spark, path, view, schema, daily=True, keep_day=False):
    """The rows of ``view`` in the newest manifest; ``keep_day`` keeps the column ``log_date``."""
    full = StructType(list(schema.fields))
    if daily and "log_date" not in full.names:
        full = full.add("log_date", DateType())
    rows = spark.read.schema(full.add("refresh", "string")).parquet(f"{path}/{view}")
    now = _at(spark, path, newest_version(spark, path)).where(F.col("view") == view).select(
        F.col("refresh").alias("_refresh"), F.col("log_date").alias("_day"))
    same = F.col("refresh") == F.col("_refresh")
    if daily:
        same = same & F.col("log_date").eqNullSafe(F.col("_day"))
    return rows.join(now, same, "left_semi").select(*dict.fromkeys([*schema.names, *(["log_date"] if keep_day else [])]))
