"""Session settings that the jobs rely on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def attach(spark: SparkSession) -> SparkSession:
    """Lets the Python workers of ``spark`` import this package; returns ``spark``.

    Enough where executors see the driver's files (local mode). On a cluster
    give the package to spark-submit with ``--py-files`` as usual.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; removed when the application ends.

    Only a local master may go without that setting: it gets a temporary folder.
    Elsewhere executors could not see it, so a session that names none is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomspan-"))
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a written table."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that several readers don't compute it again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, name: str, limit: int = 32 << 20) -> DataFrame:
    """``df`` written to the shared folder and read back, with the join hint its size allows: broadcast up to ``limit`` bytes, else merge."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("broadcast" if written_bytes(df.sparkSession, path) <= limit else "merge")


#: Bytes of an Arrow batch that is sent to a Python worker.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Lowers the session's bound on bytes of an Arrow batch to ``BATCH_BYTES``; returns ``spark``.

    Rows of long texts would else fill batches of many times that, in the JVM and in the worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def spread(table: DataFrame) -> DataFrame:
    """A stored table's rows dealt over all cores if it is too small to fill them: a small file may be one row group, so one task's.

    The shuffle is of less than ``spark.sql.files.maxPartitionBytes`` for each core. Larger tables are many splits and come as they are.
    """
    spark, plan = table.sparkSession, table._jdf.queryExecution().optimizedPlan()
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if int(str(plan.stats().sizeInBytes())) < cores * split else table


def local_session(name: str = "loomspan", cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with UTC times and adaptive execution, for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return attach(spark)
