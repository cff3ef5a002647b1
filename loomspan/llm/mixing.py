"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document stands in its source's queue twice (two epochs), each epoch in a
reproducible random order. A copy's virtual finish time is the number of words
queued up to its end over the source's target, so a clock that runs through the
merged queues serves every source in proportion to its target and has spent the
whole budget at time 1. The queue is cut there. A document that would end later
is passed over, and what it leaves unspent goes to later ones that fit, by the
same clock, in two more rounds.

Running sums never need a source, or the rows of one id, in one task: the
queues are range-sorted by source, random order and row, the ranges' totals are
summed per source, and only a range is summed row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, clash_free, uniform_key

WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Weights dealt to the sources in turn, words wanted per word there is, most epochs, rounds, seed and the rows from which a range is worth a task."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    epochs: int = 2
    rounds: int = 3
    seed: int = 17
    slot_rows: int = 2_000


def targets(sizes: DataFrame, config: Mix) -> DataFrame:
    """``(source, source_size, target)``: shares by weight, each at most ``epochs`` times the source.

    Sources come in code point order, null last. The level that fills the
    budget is found on the list of sources, which is one short row for each.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*(F.lit(float(w)) for w in config.weights))
    ranked = totals.withColumn("place", place).withColumn("weight", F.get(weights, F.col("place") % len(config.weights)))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(config.epochs))).withColumn("full_at", F.col("most") / F.col("weight"))
    before = Window.orderBy("full_at", "place").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("full_at", "place").rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(Window.partitionBy()) * F.lit(config.share)
    level = (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    leveled = ranked.withColumn("level", level).withColumn("open_level", F.when(F.col("level") < F.col("full_at"), F.col("level")))
    found = F.first("open_level", ignorenulls=True).over(Window.orderBy("full_at", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return leveled.select("source", "place", "source_size", F.least("most", F.coalesce(F.col("weight") * found, F.col("most"))).alias("target"))


def _round(queue: DataFrame, sources: DataFrame, ranges: int, stage: Stage) -> DataFrame:
    """Gives finish times to the copies that this round takes.

    Ranges are written before their totals are taken, so both readings see the same cuts.
    """
    spent = queue.where("finish IS NOT NULL").groupBy("place").agg(F.sum("size").alias("spent"))
    left = sources.select("place", "target").join(spent.hint("merge"), "place", "left").select("place", "target", F.coalesce("spent", F.lit(0)).alias("spent"))
    open_ = queue.join(stage.small(left, "sources"), "place").withColumn("fits", F.col("finish").isNull() & (F.col("size") > 0) & (F.col("size") <= F.col("target") - F.col("spent")))
    order = ["epoch", "u", "id", "size", "row"]
    dealt = open_.where("fits").repartitionByRange(ranges, "place", *order).withColumn("range", F.spark_partition_id())
    waiting = stage.put(dealt, "dealt")
    sums = waiting.groupBy("place", "range").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("place", "range", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("place", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    queued = waiting.join(sums.hint("merge"), ["place", "range"]).withColumn("queued", F.col("ahead") + F.sum("size").over(inside))
    finish = (F.col("spent") + F.col("queued")) / F.col("target")
    taken = queued.withColumn("finish", F.when(F.col("spent") + F.col("queued") <= F.col("target"), finish))
    columns = queue.columns
    return open_.where("NOT fits").select(columns).union(taken.select(columns))


def _run(docs: DataFrame, config: Mix, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """The queue ``(row, id, place, size, u, epoch, finish)`` after all rounds, and the sources; rows are numbered if ``docs`` has no ``row``."""
    sizes = docs.select("id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), F.col("row") if "row" in docs.columns else F.monotonically_increasing_id().alias("row"))
    sizes = stage.put(sizes, "sizes")
    sources = stage.put(targets(sizes, config), "sources")
    named = sizes.join(stage.small(sources.select("source", "place"), "sources"), sizes["source"].eqNullSafe(sources["source"])).select("row", "id", "place", "size")
    copies = named.withColumn("epoch", F.explode(F.array(*(F.lit(k) for k in range(config.epochs)))))
    queue = copies.withColumn("u", uniform_key("id", "epoch", seed=config.seed)).withColumn("finish", F.lit(None).cast("double"))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(width, sizes.count() * config.epochs // config.slot_rows))
    for k in range(config.rounds):
        queue = stage.put(_round(queue, sources, ranges, stage), f"queue-{k}")
        if k:
            stage.drop(f"queue-{k - 1}")
    return queue, sources


def plan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", config: Mix = Mix()) -> DataFrame:
    """One row per document: ``id_column``, ``size``, ``source_size``, ``target``, ``taken``, ``copies``.

    ``size`` counts runs of anything but ASCII blanks; ``taken`` is the words
    the mix takes from the document, ``copies`` times its size.

    * a null or blank text has size 0 and is never taken; a null source is one
      source, after all others;
    * repeated rows and rows with one id are documents of their own; ties in
      the random order go by id, size and row;
    * other columns are ignored; an empty table gives no rows; reruns agree.
    """
    stage = Stage(docs.sparkSession, "mixing")
    queue, sources = _run(clash_free(docs, id=id_column, text=text_column, source=source_column), config, stage)
    each = queue.groupBy("row", "id", "place", "size").agg(F.count("finish").alias("copies"))
    return each.join(stage.small(sources, "sources"), "place").select(F.col("id").alias(id_column), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("copies").cast("int").alias("copies"))


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", config: Mix = Mix(), row_column: str | None = None) -> DataFrame:
    """The mix itself: ``docs`` rows, each as often as it is taken, range-sorted by virtual finish time.

    The queue's copies are matched by a key of each row, so ids may be null or
    stand for several rows: ``row_column`` if there is one that every reading
    of ``docs`` repeats, else rows are written with a new one.
    """
    stage = Stage(docs.sparkSession, "mixing")
    rows = docs.withColumnRenamed(row_column, "__row") if row_column else stage.put(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    queue, _ = _run(clash_free(rows, id=id_column, text=text_column, source=source_column, row="__row"), config, stage)
    order = queue.where("finish IS NOT NULL").groupBy(F.col("row").alias("__row")).agg(F.collect_list("finish").alias("__finish"))
    rows = rows.join(order.hint("merge"), "__row").drop("__row")
    rows = rows.withColumn("__finish", F.explode("__finish"))
    return rows.repartitionByRange("__finish", f"`{id_column}`").sortWithinPartitions("__finish", f"`{id_column}`").drop("__finish")
