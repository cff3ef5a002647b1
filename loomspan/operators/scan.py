"""Scans over ordered rows of few, large keys: by ranges, then over the ranges.

A window over a key is one task's work. Here rows are first dealt into ranges of
key and order, so a large key lies in many ranges. Each range is scanned by
itself, one row for each key and range carries its outcome, and the carried rows,
at most one for each range of a key, are scanned in turn.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path

RANGE = "__range"


def deal(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``__range``, written to the shared folder: ranges follow each other in the order of ``keys`` and ``order``.

    ``ranges`` is by default ``spark.sql.shuffle.partitions``. Nulls come first.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "ranges")
    df.repartitionByRange(ranges, *keys, *order).withColumn(RANGE, F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def _carried(keys: Sequence[str]) -> Window:
    """The earlier ranges of a key, of rows that are one for each key and range."""
    return Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def _join(dealt: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Carried rows for key and range; null keys meet."""
    marked = carried.select(*(F.col(k).alias(f"__key_{k}") for k in keys), F.col(RANGE).alias("__at"), *(c for c in carried.columns if c not in (*keys, RANGE)))
    same = F.col(RANGE) == F.col("__at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    return dealt.join(marked.hint("merge"), same, "left").drop("__at", *(f"__key_{k}" for k in keys))


def last_before(dealt: DataFrame, keys: Sequence[str], order: Sequence[str], **values: Column) -> DataFrame:
    """Adds for each name the last value that isn't null among the earlier rows of the key; null if there is none.

    ``dealt`` comes from ``deal`` with the same keys and order, which must tell all rows of a key apart.
    """
    held = dealt.withColumns({f"__v_{name}": v for name, v in values.items()})
    row = F.struct(*order)
    ends = held.groupBy(*keys, RANGE).agg(*(F.max_by(f"__v_{name}", F.when(F.col(f"__v_{name}").isNotNull(), row)).alias(f"__c_{name}") for name in values))
    before = ends.select(*keys, RANGE, *(F.last(f"__c_{name}", ignorenulls=True).over(_carried(keys)).alias(f"__c_{name}") for name in values))
    own = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = {name: F.last(f"__v_{name}", ignorenulls=True).over(own) for name in values}
    joined = _join(held.withColumns(near), before, keys)
    return joined.withColumns({name: F.coalesce(name, f"__c_{name}") for name in values}).drop(*(f"__{x}_{name}" for name in values for x in "vc"))


def running(dealt: DataFrame, keys: Sequence[str], order: Sequence[str], **values: Column) -> DataFrame:
    """Adds for each name the sum of the value over the key's rows up to and with this one; nulls count as 0."""
    held = dealt.withColumns({f"__v_{name}": F.coalesce(v, F.lit(0)) for name, v in values.items()})
    ends = held.groupBy(*keys, RANGE).agg(*(F.sum(f"__v_{name}").alias(f"__c_{name}") for name in values))
    before = ends.select(*keys, RANGE, *(F.sum(f"__c_{name}").over(_carried(keys)).alias(f"__c_{name}") for name in values))
    own = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = _join(held.withColumns({name: F.sum(f"__v_{name}").over(own) for name in values}), before, keys)
    return joined.withColumns({name: F.col(name) + F.coalesce(f"__c_{name}", F.lit(0)) for name in values}).drop(*(f"__{x}_{name}" for name in values for x in "vc"))


def compose(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes of the steps ``s -> a s + b`` composed from each place that ``first`` marks on, by doubling."""
    a, b = a.astype(np.float64).copy(), b.astype(np.float64).copy()
    begin = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0)) if len(a) else np.zeros(0, int)
    wide, depth = 1, np.arange(len(a)) - begin  # earlier steps of the same stretch that are still to come in
    while (depth >= wide).any():
        at = np.flatnonzero(depth >= wide)
        b[at] += a[at] * b[at - wide]
        a[at] *= a[at - wide]
        wide *= 2
    return a, b


def _steps(names: Sequence[str]):
    """Adds composed steps ``__a`` and ``__b`` to rows sorted by ``names``, anew where these change; the rows may come in any number of frames."""
    def run(frames):
        last, a0, b0 = None, 1.0, 0.0
        for frame in frames:
            if not len(frame):
                continue
            codes = frame[list(names)].astype(object).where(frame[list(names)].notna(), None)
            first = (codes != codes.shift()).to_numpy() & ~(codes.isna() & codes.shift().isna()).to_numpy()
            first = first.any(axis=1)
            now = tuple(codes.iloc[0])
            first[0] = now != last
            start = first.copy()
            start[0] = True
            a, b = compose(frame["__a"].to_numpy(float), frame["__b"].to_numpy(float), start)
            if not first[0]:  # goes on from the frame before
                until = int(np.argmax(first)) if first.any() else len(frame)
                b[:until] += a[:until] * b0
                a[:until] *= a0
            last, a0, b0 = tuple(codes.iloc[-1]), a[-1], b[-1]
            yield frame.assign(__a=a, __b=b)

    return run


def affine(dealt: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, a: Column, b: Column, seed: Column) -> DataFrame:
    """Adds ``name``: ``s`` after the key's rows up to this one, each of which makes ``a * s + b`` of it; before the key's first row it is that row's ``seed``.

    Steps are composed within each range, and the composed steps of the ranges
    are composed again, so no task has a key's rows all.
    """
    spark = dealt.sparkSession
    held = dealt.withColumns({"__a": a.cast("double"), "__b": b.cast("double"), "__seed": seed.cast("double")})
    held = held.repartition(*keys, RANGE).sortWithinPartitions(*keys, RANGE, *order)
    path = shared_path(spark, "steps")
    held.mapInPandas(_steps([*keys, RANGE]), held.schema).write.parquet(path)
    held = spark.read.schema(held.schema).parquet(path)
    row = F.struct(*order)
    ends = held.groupBy(*keys, RANGE).agg(F.max_by("__a", row).alias("__a"), F.max_by("__b", row).alias("__b"), F.min_by("__seed", row).alias("__seed"))
    ends = ends.repartition(*keys).sortWithinPartitions(*keys, RANGE)
    done = ends.mapInPandas(_steps(keys), ends.schema)
    one = Window.partitionBy(*keys).orderBy(RANGE)
    before = done.select(*keys, RANGE, F.lag("__a", 1, 1.0).over(one).alias("__a0"), F.lag("__b", 1, 0.0).over(one).alias("__b0"), F.first("__seed").over(one).alias("__s0"))
    s = F.col("__a") * (F.col("__a0") * F.col("__s0") + F.col("__b0")) + F.col("__b")
    return _join(held, before, keys).withColumn(name, s).drop("__a", "__b", "__seed", "__a0", "__b0", "__s0")
