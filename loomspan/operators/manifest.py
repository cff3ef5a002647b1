"""File manifests: decisions, deltas, deduplication, verification and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extension
from ..session import written
from . import scan

#: Size limits in bytes and the longest path. Fixed values.
MIN_SIZE, MAX_SIZE, LONGEST_PATH = 100, 500_000_000, 260


def skip_reason(extensions: Sequence[str], done: Column | None = None) -> Column:
    """The first rule that keeps a file of ``(path, size, accessible, symlink, hidden, bad_encoding)`` from being taken; null if none."""
    ext = extension(F.col("path"))
    return (
        F.when(~F.col("accessible"), "inaccessible").when(F.col("symlink"), "symlink").when(F.col("hidden"), "hidden_or_system")
        .when(F.col("bad_encoding"), "encoding_issue").when(F.char_length("path") > LONGEST_PATH, "path_too_long")
        .when(~ext.isin(*extensions), "unsupported_extension").when(F.col("size") < MIN_SIZE, "too_small").when(F.col("size") > MAX_SIZE, "too_large")
        .when(done if done is not None else F.lit(False), "already_transferred")
    )


def not_transferred(files: DataFrame, transfers: DataFrame) -> DataFrame:
    """Files that no run has transferred with success."""
    return files.join(transfers.where("result = 'success'").select("source_path"), "source_path", "left_anti")


def decide(files: DataFrame, extensions: Sequence[str], transfers: DataFrame | None = None) -> DataFrame:
    """Adds ``action`` (transfer or skip) and ``reason``."""
    if transfers is None:
        df = files.withColumn("reason", skip_reason(extensions))
    else:
        done = transfers.where("result = 'success'").select(F.col("source_path").alias("path"), F.lit(True).alias("__done")).distinct()
        df = files.join(done, "path", "left").withColumn("reason", skip_reason(extensions, F.coalesce("__done", F.lit(False)))).drop("__done")
    return df.withColumn("action", F.when(F.col("reason").isNull(), "transfer").otherwise("skip"))


def delta(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``(source_path, change, renamed_from)`` between two manifests ``(source_path, content_hash)``.

    Changes are new, deleted, modified, unchanged and renamed: a new and a
    deleted path of one hash, paired one to one in path order. The snapshots are
    compared once; paths of one hash are numbered by ranges, so a content that
    very many files share is no single task's. A file without a hash is told by
    its path alone and never renamed.
    """
    both = previous.select("source_path", F.col("content_hash").alias("old"), F.lit(True).alias("was")).join(current.select("source_path", F.col("content_hash").alias("new"), F.lit(True).alias("is")), "source_path", "full")
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "modified").otherwise("unchanged")
    kinds = written(both.withColumn("change", change), "kinds")
    moved = kinds.where("change IN ('deleted', 'new')").select("change", F.coalesce("old", "new").alias("hash"), "source_path").where("hash IS NOT NULL")
    dealt = scan.deal(moved, ["change", "hash"], ["source_path"])
    numbered = scan.running(dealt, ["change", "hash"], ["source_path"], nth=F.lit(1))
    gone = numbered.where("change = 'deleted'").select(F.col("source_path").alias("renamed_from"), "hash", "nth")
    came = numbered.where("change = 'new'").select("source_path", "hash", "nth")
    pairs = written(came.join(gone.hint("merge"), ["hash", "nth"]).select("source_path", "renamed_from"), "renamed")
    left = kinds.join(pairs.select(F.col("renamed_from").alias("source_path")), "source_path", "left_anti").join(pairs, "source_path", "left")
    return left.select("source_path", F.when(F.col("renamed_from").isNotNull(), "renamed").otherwise(F.col("change")).alias("change"), "renamed_from")


def first_copies(files: DataFrame) -> DataFrame:
    """Adds ``outcome`` to ``(source_path, content_hash)``: the first path of a hash is copied, later ones name it as ``copy_of``."""
    first = files.groupBy("content_hash").agg(F.min("source_path").alias("__first"))
    df = files.join(first.withColumnRenamed("content_hash", "__hash").hint("merge"), F.col("content_hash").eqNullSafe(F.col("__hash")))
    own = F.col("source_path") == F.col("__first")
    return df.withColumn("outcome", F.when(own, "copied").otherwise("skipped_duplicate")).withColumn("copy_of", F.when(~own, F.col("__first"))).drop("__first", "__hash")


def known_content(files: DataFrame, transfers: DataFrame) -> DataFrame:
    """Adds ``existing``: the earliest destination that history has for the content."""
    history = transfers.where("result = 'success'").groupBy("content_hash").agg(F.min_by("dest_path", F.struct("ts", "dest_path")).alias("existing"))
    return files.join(history, "content_hash", "left")


def safe_names(files: DataFrame, column: str = "target") -> DataFrame:
    """Adds ``name``: repeated targets get _1, _2 and so on before the extension, in path order; no two names are equal.

    The first file of a target keeps it. A number is left out where some
    target has that name itself. Case counts. A null target keeps a null name.
    """
    order = ([column], ["source_path"])
    numbered = scan.running(scan.deal(files, *order), *order, __nth=F.lit(1)).withColumn("__nth", F.col("__nth") - 1)  # a target of very many files is many ranges'
    stem, ext = F.regexp_extract(column, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(column, r"^(.*?)(\.[^./]*)?$", 2)
    asked = numbered.withColumn("__stem", stem).withColumn("__ext", ext)
    # numbers that targets already have, as "stem_number.ext"
    number = F.regexp_extract("__stem", r"^(.*)_([1-9][0-9]{0,8})$", 2).try_cast("int")
    taken = asked.where("__nth = 0").select(F.regexp_extract("__stem", r"^(.*)_([1-9][0-9]{0,8})$", 1).alias("__stem"), "__ext", number.alias("taken")).where("taken IS NOT NULL")
    taken = taken.groupBy("__stem", "__ext").agg(F.array_sort(F.collect_set("taken")).alias("__taken"))
    # the n-th free number, found by stepping over each taken one that is not beyond it
    free = F.aggregate(F.coalesce("__taken", F.array().cast("array<int>")), F.col("__nth").cast("int"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    named = asked.join(taken.hint("merge"), ["__stem", "__ext"], "left").withColumn("__free", free)
    name = F.when(F.col("__nth") == 0, F.col(column)).otherwise(F.concat("__stem", F.lit("_"), F.col("__free").cast("string"), "__ext"))
    return named.select(*files.columns, name.alias("name"))


def verify(source: DataFrame, destination: DataFrame) -> DataFrame:
    """``(path, result)``: success, hash_mismatch or missing for each source file."""
    there = destination.select("path", F.col("content_hash").alias("got"))
    result = F.when(F.col("got").isNull(), "missing").when(F.col("got") == F.col("content_hash"), "success").otherwise("hash_mismatch")
    return source.join(there, "path", "left").select("path", result.alias("result"))


def unaccounted(files: DataFrame, transfers: DataFrame, skips: DataFrame) -> DataFrame:
    """Paths with ``problem`` missing (in neither log) or counted_twice (in both)."""
    paths, sent, left = (x.select("source_path") for x in (files, transfers, skips))
    return paths.subtract(sent.union(left)).withColumn("problem", F.lit("missing")).union(sent.intersect(left).withColumn("problem", F.lit("counted_twice")))


def reconcile(files: DataFrame, transfers: DataFrame, skips: DataFrame, samples: int = 5) -> DataFrame:
    """``(section, key, n, bytes, samples)``: totals, transfers by result, skips by reason, and the gap."""
    none = F.array().cast("array<string>")
    total = files.agg(F.lit("manifest").alias("section"), F.lit("all").alias("key"), F.count("*").alias("n"), F.sum("size").alias("bytes"), none.alias("samples"))
    sent = transfers.groupBy(F.col("result").alias("key")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    rank = F.row_number().over(Window.partitionBy("reason").orderBy("source_path"))
    shown = skips.select("reason", "source_path").withColumn("rank", rank).where(F.col("rank") <= samples)  # each task passes on so many of a reason
    shown = shown.groupBy(F.col("reason").alias("key")).agg(F.array_sort(F.collect_list("source_path")).alias("samples"))
    left = skips.groupBy(F.col("reason").alias("key")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).join(shown, "key", "left")
    gap = files.agg(F.count("*").alias("a")).crossJoin(transfers.agg(F.count("*").alias("b"))).crossJoin(skips.agg(F.count("*").alias("c")))
    return (
        total.union(sent.select(F.lit("transfer"), "key", "n", "bytes", none)).union(left.select(F.lit("skip"), "key", "n", "bytes", "samples"))
        .union(gap.select(F.lit("gap"), F.lit("all"), F.col("a") - F.col("b") - F.col("c"), F.lit(None).cast("long"), none))
    )


def failures(transfers: DataFrame, most: int = 20) -> DataFrame:
    """``(source_path, size, error, failed_total)``: the first failed transfers by path, and how many there are in all."""
    failed = transfers.where("result = 'failed'")
    total = failed.agg(F.count("*").alias("failed_total"))
    return failed.select("source_path", "size", "error").orderBy("source_path").limit(most).crossJoin(F.broadcast(total))  # one row


def transfer_outcomes(transfers: DataFrame, skips: DataFrame) -> DataFrame:
    """``(outcome, n, bytes, bytes_per_second)``: transfers by result, skips by reason, and the run ``all`` with its average speed.

    The speed is the bytes of successful transfers over the seconds from the
    first transfer's ``ts`` to the last one's, at least 0.1.
    """
    none = F.lit(None).cast("double").alias("bytes_per_second")
    sent = transfers.groupBy(F.col("result").alias("outcome")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).select("*", none)
    left = skips.groupBy(F.concat(F.lit("skipped: "), F.coalesce("reason", F.lit("unknown"))).alias("outcome")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).select("*", none)
    good = F.coalesce(F.sum(F.when(F.col("result") == "success", F.col("size"))), F.lit(0))
    speed = good / F.greatest((F.max("ts") - F.min("ts")).cast("double"), F.lit(0.1))
    whole = transfers.agg(F.lit("all").alias("outcome"), F.count("*").alias("n"), good.alias("bytes"), F.round(F.coalesce(speed, F.lit(0.0)), 6).alias("bytes_per_second"))
    return sent.union(left).union(whole)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str = "ts") -> DataFrame:
    """Rows of both; for a key the row with the latest ``order`` wins, nulls in it filled from the other."""
    value = [c for c in old.columns if c not in keys]
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    latest = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.desc("__new")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = both.select(*keys, *(F.first(c, ignorenulls=True).over(latest).alias(c) for c in value), F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.desc("__new"))).alias("__n"))
    return filled.where("__n = 1").drop("__n")


def run_log(events: DataFrame) -> DataFrame:
    """One row per run of ``(run_id, ts, status, files)``: start, last status, duration and files."""
    return events.groupBy("run_id").agg(F.min("ts").alias("started"), F.max_by("status", F.struct("ts", "status")).alias("status"), (F.max("ts").cast("long") - F.min("ts").cast("long")).alias("seconds"), F.sum("files").alias("files"))


def previous_completed(runs: DataFrame) -> DataFrame:
    """Adds ``previous``: the latest completed run before each run, by start; ties by id.

    Runs are dealt into ranges of their start; each range looks back in itself,
    and from one range to the next goes its last completed run.
    """
    dealt = scan.deal(runs, [], ["started", "run_id"])
    return scan.last_before(dealt, [], ["started", "run_id"], previous=F.when(F.col("status") == "completed", F.col("run_id"))).drop(scan.RANGE)
