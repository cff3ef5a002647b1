"""A corpus pipeline: each stage works on all its predecessor kept and returns a table.

Stages decide by row, so ids may be null, repeated or stand for different texts.
Other columns of any name but ``__row``, ``__file``, ``__at`` and ``__number`` pass
through; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm import minhash, mixing, subword, toxicity
from loomspan.llm.common import Stage
from loomspan.session import attach


def numbered(docs: DataFrame, stage: Stage) -> DataFrame:
    """The rows with ``__row``, a key of their own that every reading repeats, as ids may be null or stand for several rows.

    Rows read from files are named by file and place in it; other rows are written first.
    """
    try:
        at = docs.metadataColumn("_metadata")
        placed = docs.select("*", at["file_path"].alias("__file"), at["row_index"].alias("__at"))
    except AnalysisException:
        return numbered(stage.put(docs, "rows"), stage)
    number = (F.row_number().over(Window.orderBy("__file")) - 1).cast("long")  # one row for each file
    files = stage.put(placed.select("__file").distinct().withColumn("__number", number), "files")
    return placed.join(stage.small(files, "files"), "__file").withColumn("__row", F.col("__number") * F.lit(1 << 36) + F.col("__at")).drop("__file", "__at", "__number")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labels table, does not reject.

    Null and empty texts have the lowest score and stay; repeated rows share their fate.
    """
    stage = Stage(spark, "toxic")
    rows = numbered(docs, stage)
    marks = toxicity.toxicity(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), row_column="__row")
    bad = stage.put(marks.where("predicted = 1").select("__row"), "bad")
    return rows.join(stage.small(bad, "bad"), "__row", "left_anti").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (five-word shingles, similarity 0.8): the least id, null last.

    Rows are compared by their texts alone, so rows that share an id stay if their texts differ, and of
    repeated rows one stays. Null and empty texts are like nothing and all stay.
    """
    stage = Stage(spark, "near")
    rows = numbered(docs, stage)
    marks = minhash.near_duplicates(rows, id_column="__row").select("__row", "component_id", "kept")
    marks = stage.put(marks.join(rows.select("__row", "doc_id").hint("merge"), "__row"), "marks")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col("__row").alias("row")))
    best = marks.groupBy("component_id").agg(first.alias("first")).select("component_id", F.col("first.row").alias("row"))
    best = stage.put(best.where("row <> component_id"), "best")  # where the least row hasn't the least id
    gone = marks.where("NOT kept").select("__row").join(stage.small(best.select(F.col("row").alias("__row")), "best"), "__row", "left_anti")
    gone = stage.put(gone.union(best.select("component_id")), "gone")
    return rows.join(stage.small(gone, "gone"), "__row", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weighted 5, 2, 1 in turn, 150% of all words.

    A null source is a source; texts without words are never taken; repeated rows are taken for themselves.
    """
    return mixing.mixed(numbered(docs, Stage(spark, "mix")), row_column="__row").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and the text they decode to; a null or empty text has none and decodes to an empty one."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = subword.encode(docs.select("doc_id", "source", "text"), model, decoded_column="text")
    return both.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", near_dedup), ("mixing", mix_sources), ("sentencepiece", encode)]

#: The stages learn from labels and merge components, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table; each stage's rows are written and reread."""
    stage = Stage(attach(spark), "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage.put(docs, name)
    return docs
