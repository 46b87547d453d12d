"""Session set-up and the shared checkpoint folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def build_session(app="logweave", master=None, **conf):
    """A session with the settings every operator here relies on.

    On a cluster, pass only what differs from the submitted configuration; ``master``
    is for local runs.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark):
    """The shared folder named by ``spark.checkpoint.dir``; also where streams keep state.

    A session in one process without one gets a scratch folder. A session with executors of its own
    without one is an error: a folder on one machine does not survive that machine.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        path = sc.getCheckpointDir()
        if not path:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            path = tempfile.mkdtemp(prefix="logweave-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def materialize(df, name, **options):
    """Write ``df`` once to the shared checkpoint folder and return it as read back; ``options`` are the writer's.

    For results that several later steps read, and to cut the lineage of iterations: the table
    survives lost executors, and later plans start from its files and their statistics.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/logweave/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df):
    """``df`` in enough partitions for work that costs far more than reading.

    Changes nothing for inputs that already have a partition per core. It is for one compressed
    file or one row group, which Spark cannot split and would parse in a single task.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)


def small_methods(df):
    """``df``, in a session that gives up fused code of more than 8,000 bytes a method: the JVM never compiles such a
    method, so the long projections of parsing would be interpreted row by row. Results are the same."""
    df.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return df


TASK_ROWS = 1 << 18


def balanced(df, rows=TASK_ROWS):
    """``df`` in partitions of at most about ``rows`` rows, and enough of them as in :func:`spread`, so that what a
    task holds does not grow with the input. For short rows that can be counted cheaply and make many others."""
    want = -(-df.count() // rows)
    return df.repartition(want) if want > max(df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism) else spread(df)


SMALL_BYTES = 64 * 1024 * 1024


def small_side(df, text, max_bytes=SMALL_BYTES):
    """``df`` marked for broadcast if its measured size allows, else unchanged for a shuffle join.

    ``text`` is its only wide column; the others count sixteen bytes each.
    """
    width = F.coalesce(F.octet_length(text), F.lit(0)) + 16 * len(df.columns)
    size = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df
