"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors at cosine c are 2 - 2c apart in squared distance. A random
rotation spreads that distance evenly over blocks of coordinates, and however
it is spread, at least one block holds no more than its proportional share. So
every pair within the bound is within the share of some block, and a range join
in each low-dimensional block, on a grid over its first coordinates, finds it.

Rotated vectors are kept as whole steps, so every task reckons the same
distances exactly. Of the two cells of a pair it is met in the lesser, and it
counts in the first block whose share it keeps, so it counts once. Steps decide
all pairs but those within their rounding of the bound, which are confirmed on
whole vectors in double precision. What leaves a task is not pairs, but for each
vector of a cell how many it links with and one that it reaches, so what is
stored grows with the vectors and not with the pairs.

Equal vectors are one class with a count: copies are neither joined nor paired.
A crowded grid cell is dealt out as pairs of tiles, so no task holds more than
two tiles of it. Cells are dealt out in rounds of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import Stage, clash_free, shuffles_removed
from .components import connected_components
from .words import text_slices

#: Most members of a grid cell in one tile, and how many are one tile even if an even share of a task is less.
TILE, LEAST_TILE = 1 << 15, 512
#: Steps of a coordinate of a rotated unit vector, from 0 to 1.
STEPS = 32767
#: Bytes of vectors dealt out in one round, or as many as the cleaned input takes, if that is more.
ROUND_BYTES = 256 << 20
#: Factors that deal cells out to rounds.
MIX = np.random.default_rng(0).integers(1 << 20, 1 << 40, 64)
#: Entries of vectors that are subtracted at once.
ENTRIES = 1 << 22


@dataclass(frozen=True)
class Subspace:
    """Least cosine, blocks, coordinates of a block that the grid uses, and seed of the rotation."""

    cosine: float = 0.93
    blocks: int = 8
    grid: int = 3
    seed: int = 11

    def rotation(self, dim: int) -> np.ndarray:
        q, r = np.linalg.qr(np.random.default_rng(self.seed).standard_normal((dim, dim)))
        return q * np.sign(np.diag(r))

    def slices(self, dim: int) -> list[slice]:
        edges = np.linspace(0, dim, min(self.blocks, dim) + 1).round().astype(int)
        return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def radius(self, width: int, dim: int) -> float:
        """Distance a block of ``width`` coordinates may have, with room for rounding."""
        return float(np.sqrt(max(0.0, 2 - 2 * self.cosine) * width / dim)) + 1e-6

    def reach(self, width: int, dim: int) -> int:
        """The largest square, in steps, of that distance; each end of it is rounded by up to half a step a coordinate."""
        return int((self.radius(width, dim) * STEPS + np.sqrt(width)) ** 2)

    def cell(self, width: int, dim: int) -> int:
        """Steps of a grid cell's side: a ball is no wider."""
        return 2 * (isqrt(self.reach(width, dim)) + 1)

    def bounds(self, dim: int) -> tuple[float, float]:
        """Squares, in steps, of the distance that surely links and of the one that may."""
        away, slack = float(np.sqrt(max(0.0, 2 - 2 * self.cosine))) * STEPS, float(np.sqrt(dim))
        return max(0.0, away - slack - 1e-4) ** 2 if away > slack + 1e-4 else -1.0, (away + slack + 1e-6 * STEPS) ** 2


def _clean(kind: str):
    """Valid vectors as bytes of ``kind``, with a key of the whole vector; null for the rest."""
    def run(batches):
        for batch in batches:
            data, keys = [], []
            for v in batch.column("embedding"):
                x = None if not v.is_valid else v.values
                good = x is not None and len(x) and not x.null_count
                x = x.to_numpy(zero_copy_only=False).astype(kind) if good else None
                if good and (not np.isfinite(x).all() or not x.any()):
                    x = None
                data.append(x.tobytes() if x is not None else None)
                keys.append(xxhash.xxh3_128_digest((x + x.dtype.type(0)).tobytes()) if x is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(data, pa.binary()), pa.array(keys, pa.binary())], ["id", "label", "vector", "vector_key"])
    return run


def _unit(vectors: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length at unit length, one in each row; scaled first, so that no square over- or underflows."""
    x = np.frombuffer(b"".join(vectors), kind).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(vectors: list[bytes]) -> list[np.ndarray]:
    """Places of the vectors of each length."""
    length = np.array([len(v) for v in vectors], np.int64)
    return [np.flatnonzero(length == n) for n in np.unique(length)]


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as its bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _turned(config: Subspace, kind: str):
    """Each vector at unit length, rotated, in whole steps."""
    def run(batches):
        turn = {}
        for batch in text_slices(batches, "vector", 1 << 19):
            vectors = batch.column("vector").to_pylist()
            for at in _by_length(vectors):
                x = _unit([vectors[k] for k in at], kind)
                dim = x.shape[1]
                if dim not in turn:
                    turn[dim] = config.rotation(dim)
                steps = np.rint(x @ turn[dim].T * STEPS).astype(np.int16)
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("node", "label", "copies")), _binary(steps)], ["node", "label", "copies", "part"])
    return run


def _cells(config: Subspace, blocks: list[int], part: int = 0, parts: int = 1, whole: bool = True):
    """For each vector and block: its home cell and the lesser ones of the other cells its ball touches, of one part of the cells; with ``whole`` also the vector."""
    def placed(batch, at, steps, b, s):
        dim = steps.shape[1]
        g, wide = steps[:, s][:, : config.grid].astype(np.int32), config.cell(s.stop - s.start, dim)
        low, own = (g - wide // 2) // wide, g // wide
        weight = 3 ** np.arange(g.shape[1])[::-1]
        rows, cells, home = [], [], []
        for step in product((0, 1), repeat=g.shape[1]):  # a ball is as wide as a cell
            cell = low + np.array(step, np.int32)
            turn = (cell - own) @ weight  # of the cells' order: entries are -1, 0 and 1
            hit = np.flatnonzero(turn <= 0)
            rows.append(hit), cells.append(cell[hit]), home.append(turn[hit] == 0)
        rows, cells, home = (np.concatenate(x) for x in (rows, cells, home))
        if parts > 1:
            mine = (((cells.astype(np.int64) @ MIX[: cells.shape[1]]) >> 7) % parts) == part
            rows, cells, home = rows[mine], cells[mine], home[mine]
        n, take = len(rows), pa.array(at[rows])
        columns = {"label": batch.column("label").take(take), "dim": pa.array(np.full(n, dim, np.int32)), "block": pa.array(np.full(n, b, np.int32)), "cell": _binary(cells), "home": pa.array(home)}
        if whole:
            columns |= {"node": batch.column("node").take(take), "copies": batch.column("copies").take(take), "part": batch.column("part").take(take)}
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def run(batches):
        for batch in text_slices(batches, "part", 1 << 19):
            parts = batch.column("part").to_pylist()
            for at in _by_length(parts):
                steps = np.frombuffer(b"".join(parts[k] for k in at), np.int16).reshape(len(at), -1)
                for b, s in enumerate(config.slices(steps.shape[1])):
                    if b in blocks:
                        yield placed(batch, at, steps, b, s)
    return run


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = parent[x]
    while not np.array_equal(up := parent[x], x):
        x = up
    return x


def _merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of each ``i`` and ``j``; every tree then is a star around its least place."""
    merged = False
    while True:
        i, j = _roots(parent, i), _roots(parent, j)
        apart = i != j
        if not apart.any():
            break
        i, j, merged = i[apart], j[apart], True
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))
    if merged:
        parent[:] = _roots(parent, np.arange(len(parent)))


def _meetings(role: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """Places to be compared with others, and whether they are the same; ``role`` has the tile (0, 1; 2 if there is one only) and whether at home."""
    side, home = role >> 1, (role & 1).astype(bool)
    if side[0] == 2:
        own = np.flatnonzero(home)
        return [(own, own, True), (own, np.flatnonzero(~home), False)]
    return [(np.flatnonzero((side == 0) & home), np.flatnonzero(side == 1), False), (np.flatnonzero((side == 0) & ~home), np.flatnonzero((side == 1) & home), False)]


def _apart(y: np.ndarray, i: np.ndarray, j: np.ndarray, s: slice) -> np.ndarray:
    """Exact squared distances, in steps, of rows ``i`` and ``j`` over some coordinates."""
    away = (y[i, s].astype(np.int32) - y[j, s]).astype(np.float64)
    return np.einsum("ij,ij->i", away, away)


def _within(config: Subspace, y: np.ndarray, role: np.ndarray, block: int):
    """Places ``(i, j)`` of pairs that a cell's block is the first to hold, and whether they surely link; the others may."""
    dim = y.shape[1]
    slices = config.slices(dim)
    most, (sure, may) = [config.reach(s.stop - s.start, dim) for s in slices], config.bounds(dim)
    s = slices[block]
    x = y[:, s].astype(np.float32)
    square, far = (x * x).sum(axis=1), isqrt(most[block]) + 1
    slack = 2.5e-7 * (x.shape[1] + 2) * float(square.max()) * 2
    along = y[:, min(s.start + config.grid, s.stop - 1)].astype(np.int32)  # the grid has not used it, if the block is wide enough
    for left, right, same in _meetings(role):
        if not len(left) or not len(right):
            continue
        left, right = left[np.argsort(along[left], kind="stable")], right[np.argsort(along[right], kind="stable")]
        for k in range(0, len(left), 256):
            l_ = left[k : k + 256]
            first = k if same else int(np.searchsorted(along[right], along[l_[0]] - far))
            last = int(np.searchsorted(along[right], along[l_[-1]] + far, side="right"))
            for m in range(first, last, 4096):
                r_ = right[m : min(m + 4096, last)]
                away = x[l_] @ (-2 * x[r_].T)
                away += square[l_, None]
                away += square[None, r_]
                hit = np.flatnonzero(away <= most[block] + slack)
                i, j = np.divmod(hit, len(r_))
                if same:  # places in the same order: each pair once
                    later = j + m > i + k
                    i, j = i[later], j[later]
                for t in range(0, len(i), max(1, ENTRIES // dim)):
                    a, b = (z[t : t + max(1, ENTRIES // dim)] for z in (i, j))
                    a, b = l_[a], r_[b]
                    for held, z in [(True, block), *((False, z) for z in range(block))]:
                        keep = (_apart(y, a, b, slices[z]) <= most[z]) == held
                        a, b = a[keep], b[keep]
                    away_all = _apart(y, a, b, slice(0, dim))
                    keep = away_all <= may
                    yield a[keep], b[keep], away_all[keep] <= sure


def _near(config: Subspace):
    """For rows sorted by group: ``(a, b, n)``, each node ``a`` that surely links, a node ``b`` it reaches (or itself) and rows it links with; n = 0 for a pair that may link."""
    def found(table):
        table = table.combine_chunks()
        node, copies, group, also, block, role = (table.column(c).to_numpy() for c in ("node", "copies", "group", "also", "block", "role"))
        parts = table.column("part").to_pylist()
        bounds = np.concatenate(([0], np.flatnonzero((group[1:] != group[:-1]) | (also[1:] != also[:-1])) + 1, [len(group)]))
        out = [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a == 1 or not (role[a:b] & 1).any():
                continue
            y = np.frombuffer(b"".join(parts[a:b]), np.int16).reshape(b - a, -1)
            ids, copy, parent, linked = node[a:b], copies[a:b], np.arange(b - a), np.zeros(b - a, np.int64)
            for i, j, sure in _within(config, y, role[a:b], int(block[a])):
                if not sure.all():
                    for columns, x in zip(out, (ids[i[~sure]], ids[j[~sure]], np.zeros((~sure).sum(), np.int64)), strict=True):
                        columns.append(x)
                    i, j = i[sure], j[sure]
                if len(i):
                    np.add.at(linked, i, copy[j])
                    np.add.at(linked, j, copy[i])
                    _merge(parent, i, j)
            at = np.flatnonzero(linked)
            for columns, x in zip(out, (ids[at], ids[parent[at]], linked[at]), strict=True):
                columns.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in out], ["a", "b", "n"])

    def run(batches):
        waiting = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            waiting = table if waiting is None else pa.concat_tables([waiting, table])
            group, also = (waiting.column(c).to_numpy() for c in ("group", "also"))
            ended = np.flatnonzero((group[1:] != group[:-1]) | (also[1:] != also[:-1]))
            if len(ended):
                yield found(waiting.slice(0, int(ended[-1]) + 1))
                waiting = waiting.slice(int(ended[-1]) + 1)
        if waiting is not None and waiting.num_rows:
            yield found(waiting)

    return run


def _confirm(config: Subspace, kind: str):
    def run(batches):
        for batch in text_slices(batches, "va"):
            va, vb = batch.column("va").to_pylist(), batch.column("vb").to_pylist()
            keep = np.zeros(batch.num_rows, bool)
            for at in _by_length(va):
                keep[at] = (_unit([va[k] for k in at], kind) * _unit([vb[k] for k in at], kind)).sum(axis=1) >= config.cosine
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return run


def _rounds(blocks: int, n: int) -> list[tuple[list[int], int, int]]:
    """About ``n`` rounds: the blocks of each, and which part of how many."""
    parts = max(1, round(n / blocks))
    return [(at.tolist(), k, parts) for at in np.array_split(np.arange(blocks), min(n, blocks)) for k in range(parts)]


def links(turned: DataFrame, config: Subspace, stage: Stage, most: int) -> DataFrame:
    """``(a, b, n)`` of all grid cells, as ``_near`` has them, for ``turned(node, label, copies, part)``; about ``most`` bytes are dealt out in one round."""
    spark = turned.sparkSession
    labels = turned.schema["label"].dataType.simpleString()
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # the work is in the pairs, not in the bytes
    group = ["label", "dim", "block", "cell"]
    place = f"label {labels}, dim int, block int, cell binary, home boolean"
    every = turned.mapInArrow(_cells(config, list(range(config.blocks)), whole=False), place)
    sizes = turned.agg(F.count("*").alias("n"), F.sum(64 + F.octet_length("part")).alias("bytes")).first()
    copies = config.blocks * (2**config.grid + 1) / 2  # cells of a vector, on average
    tile = min(TILE, max(LEAST_TILE, int(sizes["n"] * copies / tasks)))
    crowded = every.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > tile).withColumn("tiles", F.ceil(F.col("n") / tile))
    crowded = stage.put(crowded, "crowded")
    size = 64 + 2 * F.col("dim")  # of a row that is dealt out
    more = crowded.agg(F.sum(F.col("n") * (F.col("tiles") - 1) * size)).first()[0] or 0
    rounds = _rounds(config.blocks, max(1, -(-int((sizes["bytes"] or 0) * copies + more) // most)))
    kinds = "a long, b long, n long"
    for k, (blocks, part, parts) in enumerate(rounds):
        cells = turned.mapInArrow(_cells(config, blocks, part, parts), f"{place}, node long, copies long, part binary")
        cells = cells.join(stage.small(crowded.select(*group, "tiles"), "crowded"), group, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        cells = cells.withColumn("tile", F.pmod(F.xxhash64("node"), "tiles")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        pair = [*group, F.least("tile", "other"), F.greatest("tile", "other")]
        side = F.when(F.col("tile") == F.col("other"), 2).when(F.col("tile") < F.col("other"), 0).otherwise(1)
        names = [F.xxhash64(F.lit(seed), *pair).alias(name) for seed, name in ((0, "group"), (1, "also"))]  # 128 bits, as a vector's key has
        dealt = cells.select(*names, "node", "copies", "block", (2 * side + F.col("home").cast("int")).alias("role"), "part")
        dealt = dealt.repartition(tasks, "group").sortWithinPartitions("group", "also")
        stage.put(dealt.mapInArrow(_near(config), kinds), f"links/round={k}")
    return spark.read.schema(kinds).parquet(*(f"{stage.root}/links/round={k}" for k in range(len(rounds))))


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", config: Subspace = Subspace()) -> DataFrame:
    """One row per input row: ``id_column``, ``n_links``, ``component_id``, ``kept``.

    Rows link if their labels are equal and their cosine is at least
    ``cosine``. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the least id reachable, ``kept`` marks that row.

    * a vector that is null, empty, all zero or holds a null or non-finite
      component, a null label and a null id link with nothing: the row is its
      own component (null for a null id) and kept;
    * vectors of different length never link;
    * repeated rows link with each other like any equal vectors;
    * rows with one id are rows of their own: each has the links of its own
      vector and label, and only those make it reachable;
    * other columns are ignored; an empty table gives no rows.
    """
    stage = Stage(vectors.sparkSession, "subspace")
    rows = clash_free(vectors, id=id_column, embedding=vector_column, label=label_column)
    with shuffles_removed(stage.spark):
        return _linked(rows, config, stage).toDF(id_column, "n_links", "component_id", "kept")


def _linked(rows: DataFrame, config: Subspace, stage: Stage) -> DataFrame:
    """The rows ``(id, n_links, component_id, kept)`` for ``rows(id, embedding, label)``."""
    ids, labels = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    kind = "<f4" if rows.schema["embedding"].dataType.elementType == FloatType() else "<f8"
    clean = stage.put(rows.select("id", "label", "embedding").mapInArrow(_clean(kind), f"id {ids}, label {labels}, vector binary, vector_key binary"), "clean")
    good = clean.where("vector_key IS NOT NULL AND label IS NOT NULL AND id IS NOT NULL")
    classes = good.groupBy("label", "vector_key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min("vector").alias("vector"))
    classes = stage.put(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    rows, most = stage.put(clean.select("id", "label", "vector_key"), "rows"), max(ROUND_BYTES, stage.size("clean"))
    stage.drop("clean")
    turned = stage.put(classes.select("node", "label", "copies", "vector").mapInArrow(_turned(config, kind), f"node long, label {labels}, copies long, part binary"), "turned")
    met = links(turned, config, stage, most)
    stage.drop("turned")
    side = [classes.select(F.col("node").alias(c), F.col("vector").alias(f"v{c}"), F.col("copies").alias(f"c{c}")).hint("merge") for c in "ab"]
    full = met.where("n = 0").select("a", "b").join(side[1].drop("cb"), "b").join(side[0].drop("ca"), "a")
    close = stage.put(full.select("a", "b", "va", "vb").mapInArrow(_confirm(config, kind), "a long, b long"), "close")
    counted = close.join(side[1].select("b", "cb"), "b").select(F.col("a").alias("node"), F.col("cb").alias("n")).union(close.join(side[0].select("a", "ca"), "a").select("b", "ca"))
    linked = met.where("n > 0").select(F.col("a").alias("node"), "n").union(counted).groupBy("node").agg(F.sum("n").alias("others"))
    reached = connected_components(met.where("n > 0 AND a <> b").select("a", "b").union(close), stage, "component")
    reached = stage.put(reached.join(classes.select("node", "id").hint("merge"), "node"), "reached")
    least = stage.put(reached.groupBy("component").agg(F.min("id").alias("least")), "least")
    named = reached.join(stage.small(least, "least"), "component").select("node", "least")
    facts = classes.select("label", "vector_key", "node", "id", "copies").join(linked.hint("merge"), "node", "left").join(named.hint("merge"), "node", "left")
    facts = facts.select("label", "vector_key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("least", "id").alias("component"))
    usable = F.col("id").isNotNull()
    out = rows.select("id", "label", F.when(usable, F.col("vector_key")).alias("vector_key")).join(facts.hint("merge"), ["label", "vector_key"], "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n", F.lit(0)).cast("long"), component, F.coalesce(component == F.col("id"), F.lit(True)))
