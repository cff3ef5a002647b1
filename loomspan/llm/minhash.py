"""MinHash near-duplicates by an inverted join over signature coordinates.

1. One pass over the texts gives each document its set of word shingles as
   64-bit hashes, a signature of ``coordinates`` minima and a key of the whole
   set. Documents with equal sets form a class, of which only the least id goes on.
2. Each (coordinate, value) pair is a posting list. Two signatures that agree
   in ``matches`` coordinates share one of their ``coordinates - matches + 1``
   rarest lists (prefix filter), so only those lists are merged; the others,
   which hold boilerplate and hot passages, are skipped and only counted for
   pairs that the prefix found.
3. Shingles that no other candidate has can't be shared, and shingles marked in
   one set's bit field but not in another's aren't. Both bound the similarity of
   a pair from above: members that can't reach the threshold leave their lists,
   and pairs that can't are not made.
4. Lists are merged leader by leader: the pairs of a few leaders with members
   of other components are confirmed on signatures and full sets, components
   are contracted, and only lists that still join different components go on.
   A list whose members are all linked costs one pair for each member; a pair
   is left out only if it is already connected or can't reach the threshold.

A pair at similarity s is found if at least ``matches`` of its coordinates
agree, which are binomial with probability s. At 0.8 with 64 coordinates and 36
matches a pair is missed 4 times in a million, at 0.85 once in 10^8. ``MinHash(matches=20)``
merges 45 lists of a document instead of 29 and misses a pair at 0.8 less often
than two shingles share a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, clash_free
from .components import connected_components
from .words import flat_words, mix, shingle_hashes, text_slices, utf8

#: Ranks of the leaders of each round of merging; the last round takes all that are left.
ROUNDS = ((1, 1), (2, 8), (9, 256), (257, 1 << 62))
#: Words of 64 bits on which a set's shingles are marked; each mark of one set that another lacks is a shingle that it lacks.
MARKS = 16
#: Members of a list that are compared with as many others at once, and that are ranked by one task.
TILE, SHARE = 1024, 4096


@dataclass(frozen=True)
class MinHash:
    """Parameters: words in a shingle, coordinates, matches needed, and similarity in hundredths."""

    width: int = 5
    coordinates: int = 64
    matches: int = 36
    percent: int = 80

    def multipliers(self) -> np.ndarray:
        return mix(np.arange(7, 7 + self.coordinates, dtype=np.uint64)) | np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Least value of each hash function over one set (which isn't empty)."""
        best = np.full(self.coordinates, np.uint64(2**64 - 1))
        for k in range(0, len(shingles), 4096):
            best = np.minimum(best, (shingles[k : k + 4096, None] * self.multipliers()[None, :]).min(axis=0))
        return (best >> np.uint64(32)).astype(np.uint32).view(np.int32)


def marks(shingles: np.ndarray) -> bytes:
    """The bit field of a set: one bit for each value of its shingles' low bits."""
    bits = np.zeros(64 * MARKS, np.uint8)
    bits[(shingles & np.uint64(64 * MARKS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def shingle_sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text of column ``text``."""
    values, offsets = shingle_hashes(*flat_words(utf8(batch.column("text"))), width)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield np.unique(values[a:b])


def _sign(config: MinHash):
    def run(batches):
        for batch in text_slices(batches, "text"):
            sets = list(shingle_sets(batch, config.width))
            yield pa.RecordBatch.from_arrays([
                batch.column("id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([config.signature(s) if len(s) else None for s in sets], pa.list_(pa.int32())),
            ], ["id", "n", "set_key", "signature"])
    return run


def _profile(config: MinHash):
    def run(batches):
        for batch in text_slices(batches, "text"):
            sets = list(shingle_sets(batch, config.width))
            yield pa.RecordBatch.from_arrays([
                batch.column("id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([config.signature(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                pa.array([s.tobytes() for s in sets], pa.binary()),
                pa.array([marks(s) for s in sets], pa.binary()),
            ], ["id", "n", "signature", "shingles", "marks"])
    return run


def _spread(batches):
    for batch in text_slices(batches, "shingles"):
        sets = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
        index = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(index)), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))], ["id", "shingle"])


def _confirm(config: MinHash):
    def run(batches):
        for batch in text_slices(batches, "shingles_a"):
            keep = []
            for sa, sb, a, b in zip(*(batch.column(c).to_pylist() for c in ("signature_a", "signature_b", "shingles_a", "shingles_b")), strict=True):
                if (np.frombuffer(sa, np.int32) == np.frombuffer(sb, np.int32)).sum() < config.matches:
                    keep.append(False)
                    continue
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= config.percent * (len(a) + len(b) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def signatures(docs: DataFrame, config: MinHash) -> DataFrame:
    """``(id, n, set_key, signature)`` of ``docs(id, text)``; key and signature are null for a text without words."""
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(_sign(config), f"id {kind}, n long, set_key binary, signature array<int>")


def _prefix(reps: DataFrame, config: MinHash, stage: Stage) -> DataFrame:
    """Lists that the prefix filter merges: ``(key, id, size)``, each key with at least two ids."""
    keys = F.transform("signature", lambda v, i: i.cast("long") * F.lit(1 << 32) + v.cast("long"))
    reps = stage.put(reps, "reps")
    by_doc = Window.partitionBy("id")
    shared = _shared_lists(reps.select("id", F.explode(keys).alias("key")))
    kept = (
        shared.withColumn("shared", F.count("*").over(by_doc)).withColumn("rank", F.row_number().over(by_doc.orderBy("size", "key")))
        .where(F.col("rank") <= F.col("shared") - F.lit(config.matches - 1)).select("key", "id")
    )
    return _shared_lists(stage.put(kept, "prefix"))


def _shared_lists(members: DataFrame) -> DataFrame:
    """Adds ``size`` and drops the lists that have one member.

    Sizes are combined before their shuffle and joined back by a merge join, of
    which Spark deals out a hot list's side anew.
    """
    return members.join(members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").hint("merge"), "key")


def _bounded(members: DataFrame, profiles: DataFrame, config: MinHash, stage: Stage) -> DataFrame:
    """Adds each member's set size, how much of it others have, and its marks; ranks the members of each list, the most common first.

    A long list is ranked in shares, whose ranks are dealt in turn: they are
    distinct and the first ones are the firsts of the shares.
    """
    spread = profiles.mapInArrow(_spread, f"id {profiles.schema['id'].dataType.simpleString()}, shingle long")
    alone = spread.groupBy("shingle").agg(F.count("*").alias("df"), F.min("id").alias("id")).where("df = 1").groupBy("id").agg(F.count("*").alias("alone"))
    facts = profiles.select("id", "n", "marks").join(alone.hint("merge"), "id", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0)))
    facts = facts.select("id", "n", "common", "marks")
    facts = stage.put(facts.where(F.lit(100) * F.col("common") >= F.lit(config.percent) * F.col("n")), "facts")
    known = _shared_lists(stage.put(members.drop("size").join(facts.select("id", "n", "common").hint("merge"), "id"), "known"))
    shares = F.ceil(F.col("size") / SHARE)
    known = known.withColumn("shares", shares).withColumn("share", F.pmod(F.xxhash64("id"), shares))
    order = Window.partitionBy("key", "share").orderBy((F.lit(1) - F.col("common") / F.col("n")), "id")
    ranked = known.withColumn("rank", (F.row_number().over(order) - 1) * F.col("shares") + F.col("share") + 1)
    return ranked.select("key", "id", "n", "common", "rank").join(facts.select("id", "marks").hint("merge"), "id")


def _candidates(config: MinHash, low: int, high: int):
    """Pairs of a leader with a later member of another component that both bounds let through, for rows sorted by list and tile."""
    def pairs(rank, component, n, common, bits, lead_tile, other_tile, tile):
        for k in np.flatnonzero((rank >= low) & (rank <= high) & (tile == lead_tile)):
            other = np.flatnonzero((rank > rank[k]) & (component != component[k]) & (tile == other_tile))
            top = np.minimum(common[other], common[k])
            other = other[100 * top >= config.percent * (n[other] + n[k] - top)]
            if len(other):
                lacks, misses = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (bits[k] & ~bits[other], bits[other] & ~bits[k]))
                top = np.minimum(n[k] - lacks, n[other] - misses)
                for m in other[100 * top >= config.percent * (n[other] + n[k] - top)]:
                    yield k, m

    def found(table):
        columns = {c: table.column(c).to_numpy() for c in ("key", "rank", "n", "common", "lead_tile", "other_tile")}
        component = pd.factorize(table.column("component").to_pandas())[0]
        bits = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint64).reshape(-1, MARKS)
        tile = (columns["rank"] - 1) // TILE
        same = np.ones(table.num_rows, bool)
        for c in ("key", "lead_tile", "other_tile"):
            same[1:] &= columns[c][1:] == columns[c][:-1]
        bounds = np.append(np.flatnonzero(~same[1:]) + 1, table.num_rows)
        start, out = 0, []
        for stop in bounds.tolist():
            g = slice(start, stop)
            out += [(start + k, start + m) for k, m in pairs(columns["rank"][g], component[g], columns["n"][g], columns["common"][g], bits[g], columns["lead_tile"][g], columns["other_tile"][g], tile[g])]
            start = stop
        first, second = (pa.array(x, pa.int64()) for x in zip(*out, strict=True)) if out else (pa.array([], pa.int64()),) * 2
        ids = table.column("id").combine_chunks()
        return pa.RecordBatch.from_arrays([ids.take(first), ids.take(second)], ["a", "b"])

    def run(batches):
        waiting = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            waiting = table if waiting is None else pa.concat_tables([waiting, table])
            keys = [waiting.column(c).to_numpy() for c in ("key", "lead_tile", "other_tile")]
            ended = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
            if len(ended):
                yield found(waiting.slice(0, int(ended[-1]) + 1))
                waiting = waiting.slice(int(ended[-1]) + 1)
        if waiting is not None and waiting.num_rows:
            yield found(waiting)

    return run


def _pairs(members: DataFrame, config: MinHash, low: int, high: int) -> DataFrame:
    """Distinct candidate pairs of one round; a list is dealt out as pairs of tiles, so that no task needs more than two tiles at once.

    Every member goes to the tiles of the round's leaders, and only a leader to all later tiles.
    """
    spark = members.sparkSession
    # the work is in the pairs, not in the bytes: a few tasks for each core, even if the bytes need less; a task of its own costs as much as thousands of rows
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    lowest, highest = (low - 1) // TILE, (high - 1) // TILE
    at, last = F.floor((F.col("rank") - 1) / TILE), F.floor((F.col("last") - 1) / TILE)

    def upto(first, end):
        return F.filter(F.sequence(first, F.greatest(first, end)), lambda s: s <= end)

    under = F.transform(upto(F.lit(lowest).cast("long"), F.least(at, F.lit(highest))), lambda s: F.struct(s.alias("lead_tile"), at.alias("other_tile")))
    ahead = F.transform(upto(at + 1, last), lambda s: F.struct(at.alias("lead_tile"), s.alias("other_tile")))
    tiles = F.when(F.col("rank").between(low, high), F.concat(under, ahead)).otherwise(under)
    dealt = members.withColumn("t", F.explode(tiles)).select("key", "t.*", "rank", "id", "component", "n", "common", "marks")
    dealt = dealt.repartition(parts, "key", "lead_tile", "other_tile").sortWithinPartitions("key", "lead_tile", "other_tile", "rank")
    kind = members.schema["id"].dataType.simpleString()
    found = dealt.mapInArrow(_candidates(config, low, high), f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _links(pairs: DataFrame, profiles: DataFrame, config: MinHash) -> DataFrame:
    """The pairs that agree in enough coordinates and reach the similarity on their full sets."""
    def side(x):
        return profiles.select(F.col("id").alias(x), F.col("signature").alias(f"signature_{x}"), F.col("shingles").alias(f"shingles_{x}"))
    full = pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")
    kind = profiles.schema["id"].dataType.simpleString()
    return full.select("a", "b", "signature_a", "signature_b", "shingles_a", "shingles_b").mapInArrow(_confirm(config), f"a {kind}, b {kind}")


def _merge(members: DataFrame, profiles: DataFrame, config: MinHash, stage: Stage) -> DataFrame:
    """``(id, component)`` of all members, merging the lists round by round.

    Components only grow, so a list that isn't open in one round isn't in the next, which reads the open ones alone.
    """
    components = stage.put(members.select("id").distinct().withColumn("component", F.col("id")), "components")
    for k, (low, high) in enumerate(ROUNDS):
        now = members.join(components, "id")
        open_lists = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("rank").alias("last")).where(f"x <> y AND last > {low}")
        now = stage.put(now.join(open_lists.select("key", "last").hint("merge"), "key"), f"open-{k}")
        stage.drop(f"open-{k - 1}")
        members = now.drop("component", "last")
        if now.isEmpty():
            break
        links = stage.put(_links(_pairs(now, config, low, high), profiles, config), f"links-{k}")
        if links.isEmpty():
            continue
        named = links.join(components.toDF("a", "x"), "a").join(components.toDF("b", "y"), "b")
        merged = connected_components(named.select(F.col("x").alias("a"), F.col("y").alias("b")), stage, f"merged-{k}")
        merged = components.join(merged.withColumnRenamed("component", "least"), F.col("component") == F.col("node"), "left")
        components = stage.put(merged.select("id", F.coalesce("least", "component").alias("component")), f"components-{k}")
    stage.drop(*(f"open-{k}" for k in range(len(ROUNDS))))
    return components


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", config: MinHash = MinHash()) -> DataFrame:
    """One row per input row: ``id_column``, ``n_shingles``, ``component_id``, ``kept``.

    Words are runs of anything but ASCII blanks, with A-Z lower-cased; a text
    with fewer words than a shingle is one shingle of them all. Documents link
    at Jaccard similarity ``percent`` / 100 or more of their full sets;
    ``component_id`` is the least id reachable and ``kept`` marks that document.

    * null, empty or blank text: ``n_shingles`` 0, linked with nothing, kept;
    * rows with one id count as one node and share its component (if their texts
      differ, the one with the least set stands for the id);
    * a null id links with nothing: null component, kept;
    * repeated texts share a class; ties go to the least id;
    * other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "minhash")
    ids = clash_free(docs, id=id_column, text=text_column)
    signed = stage.put(signatures(ids, config), "signed")
    classes = signed.where("set_key IS NOT NULL AND id IS NOT NULL").groupBy("set_key").agg(F.min("id").alias("rep"))
    classes = stage.put(classes, "classes")
    reps = signed.join(classes.select("set_key", F.col("rep").alias("id")).hint("merge"), ["set_key", "id"])
    members = stage.put(_prefix(reps.select("id", "signature"), config, stage), "members")
    wanted = stage.put(members.select("id").distinct(), "wanted")
    texts = ids.join(stage.small(wanted, "wanted"), "id", "left_semi").mapInArrow(_profile(config), f"id {ids.schema['id'].dataType.simpleString()}, n long, signature binary, shingles binary, marks binary")
    if _repeats(ids):
        texts = texts.groupBy("id").agg(F.min(F.struct("n", "signature", "shingles", "marks")).alias("p")).select("id", "p.*")
    profiles = stage.put(texts, "profiles")
    lists = stage.put(_bounded(members, profiles, config, stage), "lists")
    stage.drop("prefix", "members", "reps")
    components = _merge(lists, profiles, config, stage)
    stage.drop("profiles", "lists", "known")
    named = classes.join(components.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = signed.select("id", "n", "set_key").join(named.hint("merge"), "set_key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _repeats(ids: DataFrame) -> bool:
    """Whether an id occurs in more than one row."""
    return not ids.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty()
