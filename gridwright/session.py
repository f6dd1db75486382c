"""Session settings and the lineage cut used by iterative or plan-splitting operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
HUGE_METHOD_KEY = "spark.sql.codegen.hugeMethodLimit"
HUGE_METHOD_BYTES = 8000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local master may fall back to /tmp."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")


def keep_compiled(spark: SparkSession) -> None:
    """Plan no generated method that the JVM will not compile; a session setting that stays.

    HotSpot interprets a method of more than 8,000 bytes for ever, and Spark's own limit is 65,535: a join on several
    null-safe strings with an aggregate above it took 15 microseconds a row.  Beyond the limit Spark runs the operators one by one.
    """
    if int(spark.conf.get(HUGE_METHOD_KEY)) > HUGE_METHOD_BYTES:
        spark.conf.set(HUGE_METHOD_KEY, str(HUGE_METHOD_BYTES))


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the checkpoint folder and continue from the files.

    Used where two later plans must see one and the same physical layout (row positions after a
    range exchange, block identifiers) and where a loop would otherwise grow its lineage.  The files survive
    lost executors, unlike executor-local storage; a later plan reads only the columns it needs, knows the
    table's size (so small ones are broadcast), and starts from a plain scan instead of the old plan's constraints.
    They stay below ``spark.checkpoint.dir`` until its owner clears the folder.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keep_compiled(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def spread(df: DataFrame, key: str, rows: int = 20_000) -> DataFrame:
    """Narrow rows that are about to grow, ``rows`` to a task by the unique ``key``.

    A small file is one scan task however many rows an ``explode`` makes of it, and all that follows up to the next
    exchange (partial aggregates above all) is done in that one task.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, key)


def release(*tables: DataFrame) -> None:
    """Delete settled tables that no later action reads; loops call it so that their rounds do not pile up."""
    for table in tables:
        path = getattr(table, "settled_at", None)
        if path:
            context = table.sparkSession.sparkContext
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
