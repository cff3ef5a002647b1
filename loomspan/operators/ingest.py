"""Incremental ingestion: integrity checks, change detection and chunk tables on Parquet."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, extension
from ..session import sized

#: Least sizes in bytes by extension, and the archives among them. Fixed values.
MIN_SIZES = {".pdf": 200, ".docx": 2000, ".pptx": 5000, ".xlsx": 2000, ".eml": 100}
ARCHIVES = (".docx", ".pptx", ".xlsx")
SAMPLE, NULL_SHARE = 16_384, 0.20


def _archive_faults(content: pd.Series) -> pd.Series:
    def fault(data: bytes) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                bad = z.testzip()
        except zipfile.BadZipFile:
            return "not an archive"
        except Exception as e:  # a damaged member may raise anything
            return f"unreadable archive: {type(e).__name__}"
        return f"damaged archive member {bad}" if bad else None

    return content.map(fault)


def archive_fault(content: str) -> Column:
    """What is wrong with a zip archive; null if nothing."""
    return F.pandas_udf(_archive_faults, "string")(content)


def _latin(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def null_share(content: Column, length: Column) -> Column:
    """Share of zero bytes in 16 KB, from the middle of contents of over 32 KB."""
    start = F.when(length > 2 * SAMPLE, F.floor(length / 2) - SAMPLE // 2).otherwise(0)
    part = _latin(F.substring(content, (start + 1).cast("int"), F.lit(SAMPLE)))
    return (F.char_length(part) - F.char_length(F.replace(part, F.lit("\0"), F.lit("")))) / F.char_length(part)


def preflight_reason(xref: bool = False) -> Column:
    """The first fault of a file of ``(path, length, content, archive_fault)``; null if it looks whole."""
    name, ext, n, content = base_name(F.col("path")), extension(F.col("path")), F.col("length"), F.col("content")
    tail = lambda k: _latin(F.substring(content, F.greatest(n - k + 1, F.lit(1)).cast("int"), F.lit(k)))
    least = F.create_map(*(F.lit(x) for kv in MIN_SIZES.items() for x in kv))
    rule = F.when(name.startswith("~$"), "temporary lock file").when(n == 0, "empty file").when(F.col("archive_fault").isNotNull(), F.col("archive_fault"))
    rule = rule.when((ext == ".pdf") & ~F.coalesce(_latin(F.substring(content, 1, 10)).startswith("%PDF"), F.lit(False)), "no PDF header")
    rule = rule.when((ext == ".pdf") & ~F.contains(tail(1024), F.lit("%%EOF")), "truncated PDF")
    if xref:
        rule = rule.when((ext == ".pdf") & ~F.contains(tail(4096), F.lit("xref")), "PDF without cross references")
    rule = rule.when((n > 1000) & (null_share(content, n) > NULL_SHARE), "too many zero bytes")
    return rule.when(n < F.try_element_at(least, ext), "too small for its type")


def preflight(files: DataFrame, xref: bool = False) -> DataFrame:
    """Adds ``reason``. Archives alone go through Python, as a branch of their own."""
    archive = extension(F.col("path")).isin(*ARCHIVES) & (F.col("length") > 0) & ~base_name(F.col("path")).startswith("~$")
    checked = files.where(archive).withColumn("archive_fault", archive_fault("content"))
    both = checked.unionByName(files.where(~F.coalesce(archive, F.lit(False))).withColumn("archive_fault", F.lit(None).cast("string")))
    return both.withColumn("reason", preflight_reason(xref)).drop("archive_fault")


def findings(files: DataFrame) -> DataFrame:
    """One finding per faulty file: path, severity, reason and size."""
    bad = preflight(files, xref=True).where("reason IS NOT NULL")
    critical = F.col("reason").isin("empty file", "no PDF header", "truncated PDF", "too many zero bytes", "not an archive") | F.col("reason").contains("archive")
    return bad.select("path", F.when(critical, "CRITICAL").otherwise("WARNING").alias("severity"), "reason", F.col("length").alias("file_size"))


def discover(files: DataFrame, extensions: Sequence[str], excluded: Sequence[str]) -> DataFrame:
    """Files of ``(path, ...)`` with a listed extension and no excluded directory on their path, whatever the case."""
    parts = F.split(F.lower("path"), "/")
    return files.where(extension(F.col("path")).isin(*extensions) & ~F.arrays_overlap(parts, F.array(*(F.lit(x.lower()) for x in excluded))))


def changes(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds ``change_type`` (new, modified, unchanged) by the fingerprints ``file_hash`` of ``source_path``."""
    known = stored.groupBy("source_path").agg(F.max("file_hash").alias("stored_hash"))
    kind = F.when(F.col("stored_hash").isNull(), "new").when(F.col("stored_hash") == F.col("file_hash"), "unchanged").otherwise("modified")
    return files.join(known, "source_path", "left").withColumn("change_type", kind)


def new_chunks(new: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of ``new`` to append: one for each chunk id that the table lacks."""
    return new.dropDuplicates(["chunk_id"]).join(table.select("chunk_id").hint("merge"), "chunk_id", "left_anti")


def append_chunks(new: DataFrame, path: str, sources: DataFrame | None = None, buckets: int = 256) -> None:
    """Appends the rows of ``new(chunk_id, source_path, ...)`` whose chunk id the table at ``path`` lacks, each id once.

    The table lies in folders by a hash of the source. A chunk's id follows from
    its source, so only the folders of the new rows' sources are read, and of these
    the ids. ``sources(source_path)`` may name them where that takes less than
    making ``new``. A call that is repeated appends nothing.
    """
    spark = new.sparkSession
    bucket = F.pmod(F.xxhash64("source_path"), F.lit(buckets)).cast("int")
    hit = sorted(r.bucket for r in (new if sources is None else sources).select(bucket.alias("bucket")).distinct().collect())  # at most ``buckets``
    if not hit:
        return
    fresh = new.dropDuplicates(["chunk_id"]).withColumn("bucket", bucket)
    try:
        stored = spark.read.parquet(path).where(F.col("bucket").isin(hit))
        fresh = fresh.join(stored.select("chunk_id").hint("merge"), "chunk_id", "left_anti").select(fresh.columns)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def replace_sources(table: DataFrame, new: DataFrame) -> DataFrame:
    """The table with all chunks of the sources in ``new`` replaced."""
    return table.join(new.select("source_path").distinct(), "source_path", "left_anti").unionByName(new)


def write_replaced(spark: SparkSession, path: str, new: DataFrame, buckets: int = 64) -> None:
    """Replaces sources in a bucketed Parquet table, rewriting only the buckets they are in.

    The new content is written beside the table first, so nothing is read and
    overwritten in one job, and a failed job leaves the table as it was.
    """
    keyed = new.withColumn("bucket", F.pmod(F.xxhash64("source_path"), F.lit(buckets)).cast("int"))
    hit = keyed.select("bucket").distinct()
    try:
        table = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        keyed.write.partitionBy("bucket").parquet(path)
        return
    next_ = replace_sources(table.join(F.broadcast(hit), "bucket"), keyed)  # at most one row for each bucket
    side = path.rstrip("/") + "__next"
    next_.write.mode("overwrite").partitionBy("bucket").parquet(side)
    spark.read.parquet(side).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def split_quarantine(files: DataFrame) -> DataFrame:
    """Adds ``disposition``, the partition column of the quarantine sink."""
    return files.withColumn("disposition", F.when(F.col("reason").isNull(), "accepted").otherwise("quarantined"))


def write_quarantine(files: DataFrame, path: str) -> None:
    """Writes files ``(path, reason, ...)`` into folders by disposition and reason; a folder that gets rows is replaced, others stay."""
    split_quarantine(files).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("disposition", "reason").parquet(path)


def move_quarantined(spark: SparkSession, path: str, reasons: Sequence[str], back: bool = False) -> None:
    """Accepts all quarantined files of some reasons or, with ``back``, puts those that were accepted so into quarantine again.

    The files keep their reason. Only folders of these reasons are touched: the rows
    are written beside the table, put in their new folder together with what it
    holds, one for each path, and then taken from the old one. A call that failed
    may be repeated; no row is lost in between.
    """
    old, new = ("accepted", "quarantined") if back else ("quarantined", "accepted")
    rows = spark.read.parquet(path).where(F.col("reason").isin(*reasons))
    rows = rows.dropDuplicates(["path"]).withColumn("disposition", F.lit(new))
    side = path.rstrip("/") + "__next"
    rows.write.mode("overwrite").parquet(side)
    spark.read.parquet(side).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("disposition", "reason").parquet(path)
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for reason in reasons:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/disposition={old}/reason={names.escapePathName(reason)}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def consistency(chunks: DataFrame, postings: DataFrame, embeddings: DataFrame, drift: int = 10) -> DataFrame:
    """Counts of chunks without postings, chunks without embedding and embeddings without chunk, each with a status."""
    ids, words, vectors = chunks.select("chunk_id"), postings.select("chunk_id").distinct(), embeddings.select("chunk_id")
    cases = (("chunks_without_postings", ids, words), ("chunks_without_embedding", ids, vectors), ("embeddings_without_chunk", vectors, ids))
    rows = [a.join(b, "chunk_id", "left_anti").agg(F.lit(name).alias("check"), F.count("*").alias("n")) for name, a, b in cases]
    return rows[0].union(rows[1]).union(rows[2]).withColumn("status", F.when(F.col("n") == 0, "PASS").when(F.col("n") > drift, "FAIL").otherwise("WARN"))


def route(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``tier`` from a registry ``(ext, tier)``; unknown extensions are unknown."""
    return files.join(sized(registry, "registry"), extension(F.col("path")) == F.col("ext"), "left").withColumn("tier", F.coalesce("tier", F.lit("unknown"))).drop("ext")
