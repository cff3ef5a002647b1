"""SimHash document fingerprints, and all pairs within a Hamming radius by permuted block tables.

Each distinct five-word shingle of a text votes on every bit of the fingerprint
with its hash, weighted by one plus the log of its count. Fingerprints are cut
into equal blocks; two that differ in at most ``radius`` bits agree in all but
``radius`` blocks. One table for each choice of the other blocks, with those
blocks in front as its key, therefore finds every pair.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import Stage, clash_free
from .words import flat_words, mix, shingle_hashes, text_slices, utf8

#: Bits of a fingerprint, kept as two longs and shown as 32 hexadecimal digits.
BITS = 128


@dataclass(frozen=True)
class SimHash:
    """Words in a shingle, bits within which fingerprints are near, and blocks of the tables."""

    width: int = 5
    radius: int = 6
    blocks: int = 8

    def tables(self) -> list[tuple[int, ...]]:
        """The blocks in front of each table."""
        if not 0 <= self.radius < self.blocks or BITS % self.blocks or 64 % (BITS // self.blocks):
            raise ValueError("blocks must divide 64-bit words evenly and outnumber the radius")
        return list(combinations(range(self.blocks), self.blocks - self.radius))


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """Two 64-bit words for the shingles of one text, repeats included; all zero for none."""
    values, counts = np.unique(shingles, return_counts=True)
    weights = (1 + np.log(counts)).astype(np.float32)
    votes = np.zeros(BITS, np.float32)
    for k in range(0, len(values), 4096):
        v = values[k : k + 4096]
        bits = np.unpackbits(np.stack([v, mix(v + np.uint64(0x9E3779B97F4A7C15))], 1).view(np.uint8), axis=1)
        votes += 2 * (weights[k : k + 4096] @ bits.astype(np.float32)) - weights[k : k + 4096].sum()
    return np.packbits(votes > 0).view(np.uint64)


def _run(config: SimHash, columns: list[str], kept: list[str]):
    def run(batches):
        for batch in text_slices(batches, columns[0]):
            out = []
            for column in columns:
                values, offsets = shingle_hashes(*flat_words(utf8(batch.column(column))), config.width)
                prints = np.array([fingerprint(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64).reshape(-1, 2)
                out += [pa.array(prints[:, 0].view(np.int64)), pa.array(prints[:, 1].view(np.int64))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *out], [*kept, *(f"{c}_{w}" for c in columns for w in ("hi", "lo"))])
    return run


def fingerprints(docs: DataFrame, columns: list[str], config: SimHash = SimHash(), keep: bool = False) -> DataFrame:
    """Replaces each text column (or, to ``keep`` it, adds) by ``<column>_hi`` and ``<column>_lo``, the words of its fingerprint.

    Words are runs of anything but ASCII blanks, with A-Z lower-cased. Equal
    texts have equal fingerprints; a null, empty or blank text has all zeros.
    Other columns pass through.
    """
    rest = [f for f in docs.schema.fields if keep or f.name not in columns]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), *(f"`{c}_{w}` long" for c in columns for w in ("hi", "lo"))])
    return docs.mapInArrow(_run(config, columns, [f.name for f in rest]), schema)


def shown(hi: str, lo: str) -> Column:
    """A fingerprint as 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(a_hi: str, a_lo: str, b_hi: str, b_lo: str) -> Column:
    """Bits in which two fingerprints differ."""
    return F.bit_count(F.col(a_hi).bitwiseXOR(F.col(b_hi))) + F.bit_count(F.col(a_lo).bitwiseXOR(F.col(b_lo)))


def likeness(a_hi: str, a_lo: str, b_hi: str, b_lo: str) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - distance(a_hi, a_lo, b_hi, b_lo) / F.lit(float(BITS))


def _keys(config: SimHash) -> Column:
    """One struct (table, key) for each permuted table."""
    size = BITS // config.blocks
    per_word = 64 // size
    block = [F.shiftrightunsigned(F.shiftleft("hi" if b < per_word else "lo", size * (b % per_word)), 64 - size) for b in range(config.blocks)]
    return F.array(*(F.struct(F.lit(t).alias("table"), F.xxhash64(*(block[b] for b in front)).alias("key")) for t, front in enumerate(config.tables())))


def within_radius(queries: DataFrame, prints: DataFrame, config: SimHash = SimHash()) -> DataFrame:
    """``(query, id, bits)``: for every query fingerprint all others within the radius.

    Both tables are ``(id, hi, lo)``. Rows with one fingerprint are searched as
    one and expanded at the end, so many copies don't multiply in the tables; a
    query does not find its own id. Null ids find and are found like others.
    """
    def classes(df):
        return df.select("hi", "lo").distinct().select("hi", "lo", F.explode(_keys(config)).alias("k")).select("k.*", "hi", "lo")
    one = classes(queries).select("table", "key", F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"))
    near = one.join(classes(prints).hint("merge"), ["table", "key"]).where(distance("q_hi", "q_lo", "hi", "lo") <= config.radius).select("q_hi", "q_lo", "hi", "lo").distinct()
    asked = queries.select(F.col("id").alias("query"), F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"))
    found = asked.join(near.hint("merge"), ["q_hi", "q_lo"]).join(prints.select("id", "hi", "lo").hint("merge"), ["hi", "lo"])
    return found.where(~F.col("query").eqNullSafe(F.col("id"))).select("query", "id", distance("q_hi", "q_lo", "hi", "lo").alias("bits"))


def with_next(docs: DataFrame, stage: Stage, config: SimHash = SimHash(), rows: int = 500) -> DataFrame:
    """``docs(id, text)`` with fingerprints, and text and fingerprint of the next row in ascending id (after the last: the first).

    Adds ``text_hi``, ``text_lo`` and the same columns with ``next_`` before
    their names. Ids are cut into ranges, at most two for each shuffle
    partition. The first row of each range is also sent to the range before,
    so a range is a window of its own. Rows with one id follow each other in
    the order of their texts; null ids come first. Ids are numbers. An empty
    table gives no rows; a single row is its own next.
    """
    if not isinstance(docs.schema["id"].dataType, NumericType):
        raise TypeError("ids must be numbers")
    ids = docs.select("id")
    parts = max(1, min(ids.count() // rows, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = sorted(set(ids.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], 10 * parts)).first()[0] or [])) if parts > 1 else []
    first_cut = F.array_position(F.transform(F.lit(cuts) if cuts else F.array().cast("array<bigint>"), lambda c: c >= F.col("id")), True)
    part = F.when(F.col("id").isNull(), 1).when(first_cut > 0, first_cut).otherwise(len(cuts) + 1).cast("long")
    heads = ids.withColumn("part", part).groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull(), "id")).alias("head"))
    order = Window.orderBy("part")  # one row for each range
    last = F.max("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = stage.put(heads.select(F.col("head.id").alias("head"), F.coalesce(F.lag("part").over(order), last).alias("part"), F.lag("part").over(order).isNull().alias("wraps")), "heads")
    lead = docs.join(stage.small(heads, "heads"), F.col("id").eqNullSafe(F.col("head")))
    lead = lead.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(F.col("text").asc_nulls_first()))).where("nth = 1")
    own = docs.select("id", "text", part.alias("part"), F.lit(False).alias("extra"), F.lit(False).alias("wraps"))
    both = fingerprints(own, ["text"], config, keep=True).union(fingerprints(lead.select("id", "text", "part", F.lit(True).alias("extra"), "wraps"), ["text"], config, keep=True))
    inside = Window.partitionBy("part").orderBy("wraps", F.col("id").asc_nulls_first(), "extra", F.col("text").asc_nulls_first())
    columns = ["text", "text_hi", "text_lo"]
    return both.select("id", "extra", *columns, *(F.lead(c).over(inside).alias(f"next_{c}") for c in columns)).where("NOT extra").drop("extra")
