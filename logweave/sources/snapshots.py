"""Log tables with a commit record.

Every write puts its rows into a folder of its own and then adds one manifest version that names the
writes which make up the table, day by day (see ``manifest``). Nothing is changed in place: a reader
resolves the newest version once and sees a whole write or nothing of it, also while the table is
compacted. A micro-batch of a stream replaces what an earlier attempt of it committed. Two commits that
end at once want the same version; the second fails and may be repeated.

Nulls and edges: a write without valid rows commits nothing but its version; rows without a timestamp
are rejected as elsewhere; rows without rejects are checked and stored in one pass.
"""

from pyspark.sql import functions as F

from logweave.model import LOG_COLUMNS, LOG_SCHEMA
from logweave.operators.filters import filter_time
from logweave.operators.ingest import validate_entries
from logweave.session import materialize
from logweave.sources import manifest
from logweave.sources.tables import dead_letter, split_valid, stored_form

_LOGS, _REJECTS = "logs", "rejects"
SALTS = 8  # files of one day and service, where adaptive execution does not merge them


def _laid_out(rows):
    """Rows by day and service, each dealt over ``SALTS`` tasks by id, and in order of time within a task."""
    return rows.repartition("log_date", "service_name", F.pmod(F.xxhash64("id"), F.lit(SALTS))).sortWithinPartitions("log_date", "service_name", "timestamp")


def commit_logs(df, path, rejects=False, source=None, batch_id=None):
    """Add the valid rows of ``df`` to the table at ``path`` in one commit.

    ``rejects`` also stores invalid rows as dead letters under the same commit; the checked rows are then
    staged once, as two tables come from them. With ``source`` and ``batch_id`` the rows are that batch of
    that stream, whose earlier attempts they replace.
    """
    checked = df if "rejected" in df.columns else validate_entries(df)
    if rejects:
        checked = materialize(checked, "staged")
    good, bad = split_valid(checked)
    owner = None if batch_id is None else f"{source}.{int(batch_id)}"
    parts = [manifest.write_part(_laid_out(stored_form(good)), path, _LOGS, owner)]
    if rejects:
        parts.append(manifest.write_part(dead_letter(bad), path, _REJECTS, owner))
    gone = F.lit(False) if owner is None else F.col("refresh").startswith(f"{owner}.")
    manifest.publish(df.sparkSession, path, parts, gone)


def scan_snapshot(spark, path, start=None, end=None, cols=None):
    """Rows of the newest commit in a closed time range; days outside it are not opened."""
    rows = filter_time(manifest.read_view(spark, path, _LOGS, LOG_SCHEMA, keep_day=True), start, end)
    return rows.select(*(cols or LOG_COLUMNS))


def read_rejects(spark, path):
    """Dead letters of the newest commit."""
    from pyspark.sql.types import StringType, StructField, StructType, TimestampType
    names = [("original_id", StringType()), ("data", StringType()), ("error", StringType()), ("failed_at", TimestampType())]
    return manifest.read_view(spark, path, _REJECTS, StructType([StructField(n, t) for n, t in names]), daily=False)


def compact_snapshot(spark, path, days=None):
    """Rewrite the table, or only the given ``days`` (dates), into as few files as its size asks for, in one
    commit. Batches of streams lose their owner with it: they can't be replaced afterwards."""
    wanted = F.lit(True) if days is None else F.col("log_date").isin(list(days))
    rows = manifest.read_view(spark, path, _LOGS, LOG_SCHEMA, keep_day=True).where(wanted)
    part = manifest.write_part(_laid_out(rows), path, _LOGS)
    manifest.publish(spark, path, [part], (F.col("view") == _LOGS) & wanted)
