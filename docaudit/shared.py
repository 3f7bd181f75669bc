"""Session-level helpers: the shared folder and written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_CONF = "spark.checkpoint.dir"

# Settings the jobs count on. Joins carry no broadcast hints: adaptive execution picks a
# broadcast by the measured size of a side and splits skewed partitions of the others,
# also where that costs one more shuffle.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Keys compress to some bytes a row: the default of 64 MB puts five million rows into the hash table of one task.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the settings of this library to a session builder."""
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    return builder


def prepare(spark: SparkSession) -> SparkSession:
    """Set the same on a session that somebody else built; the registered queries start with it."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read, named by ``spark.checkpoint.dir``.

    A session without the setting may have set its checkpoint folder in code. Without either, a session on one
    machine gets a folder below its warehouse; on a cluster a machine-local folder would lose data with the executor.
    """
    configured = spark.conf.get(SHARED_DIR_CONF, None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SHARED_DIR_CONF} to a folder shared by the cluster")
    spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables, below the shared one."""
    return f"{shared_dir(spark)}/docaudit-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has written yet."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that still read them are void."""
    jvm, path = spark._jvm, run_dir(spark)
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage of iterative jobs, survives lost executors and stays columnar. The tables stay until
    :func:`discard` or :func:`clean_up`.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` returned and that no plan reads any more."""
    for table in tables:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(table._written_at)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
