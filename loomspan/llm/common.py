"""Shared storage and small DataFrame helpers for the operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes as stored, that an operator sends to every executor.
BROADCAST_BYTES = 32 << 20
#: Most bytes of an Arrow batch on its way to Python, unless the session sets fewer.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may go without: it gets a temporary folder. Elsewhere
    executors could not see it, so a session that names none is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomspan-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Lowers the session's bound on bytes of an Arrow batch to ``BATCH_BYTES``; returns ``spark``.

    Rows of long texts or lists would else fill batches of many times that, once in the JVM and once in the worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files are removed when it ends, and not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


class Stage:
    """Written tables that cut lineage: each is Parquet in the shared folder.

    Lost executors cost a reread, not a recomputation. The folder is removed
    when the application ends; ``drop`` removes a table that is no longer read.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = bounded_batches(spark)
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._fs(self.root).deleteOnExit(self._path(self.root))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Writes ``df`` and returns the written table."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path, compression=compression)
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")

    def size(self, name: str) -> int:
        """Bytes of a written table."""
        path = f"{self.root}/{name}"
        return self._fs(path).getContentSummary(self._path(path)).getLength()

    def drop(self, *names: str) -> None:
        for name in names:
            path = f"{self.root}/{name}"
            self._fs(path).delete(self._path(path), True)

    def small(self, df: DataFrame, name: str, limit: int = BROADCAST_BYTES) -> DataFrame:
        """A written table, or one with as many rows made from it, with the join hint its size allows: broadcast up to ``limit`` bytes, else merge."""
        return df.hint("broadcast" if self.size(name) <= limit else "merge")


def clash_free(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the given names, so that other columns of any name do no harm."""
    return df.select([F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def uniform_key(*columns: Column | str, seed: int = 0) -> Column:
    """A reproducible pseudo-random long in [0, 2^62) from the given columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 2)
