"""Tables of versioned rows: a batch appends the new state of the keys it touched, readers take the newest.

Nothing is updated in place. A batch owns its folder ``version=<number>``, which a repeated attempt
replaces; a reader meanwhile sees the older versions. Folding old versions together keeps reading cheap.
"""

from pyspark.sql import functions as F


def store_versions(path):
    """``foreachBatch`` function for update-mode queries: batch n is version n."""
    def run(batch, batch_id):
        write_version(batch, path, batch_id)
    return run


def write_version(rows, path, version):
    """Store ``rows``, complete new states of their keys, as one version."""
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_current(spark, path, keys):
    """The newest state of every key. Rows combine on the map side; versions never meet row by row."""
    rows = spark.read.parquet(path)
    state = [c for c in rows.columns if c not in (*keys, "version")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*state), "version").alias("_state"))
    return newest.select(*keys, *[F.col(f"_state.{c}").alias(c) for c in state])


def fold_versions(spark, path, out, keys, where=None):
    """Write the current state to ``out`` as a single version, numbered as the newest one read.

    ``where`` drops keys whose lifetime is over. Later versions may then be written to ``out``.
    """
    last = spark.read.parquet(path).agg(F.max("version")).first()[0]
    current = read_current(spark, path, keys)
    write_version(current if where is None else current.where(where), out, last)
