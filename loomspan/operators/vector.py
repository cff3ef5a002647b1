"""Vectors: normalisation, checks, quantisation, text embedding and exact cosine search."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import shared_path, written_bytes
from .keyword import words


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    """Divided by the norm; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_quality(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """One row of counts: vectors, null, of another size, with NaN, of zero norm."""
    v = F.col(column)
    return vectors.agg(
        F.count("*").alias("vectors"), F.count_if(v.isNull()).alias("nulls"), F.count_if(F.size(v) != dim).alias("wrong_size"),
        F.count_if(F.exists(v, lambda x: F.isnan(x))).alias("with_nan"), F.count_if(v.isNotNull() & ~F.exists(v, lambda x: x != 0)).alias("zero_norm"))


def quantize_f16(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Adds ``f16``, the vector after a round trip through 16 bits, and ``f16_error``, its largest error."""
    schema = vectors.withColumns({"f16": F.lit(None).cast("array<float>"), "f16_error": F.lit(None).cast("double")}).schema

    def run(batches):
        for batch in batches:
            values = batch.column(column)
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            small = flat.astype(np.float16).astype(np.float32)
            offsets = np.concatenate(([0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(values), 0).to_numpy())))
            error = np.abs(flat - small).astype(float)
            worst = [float(error[a:b].max()) if b > a else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(small))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(worst, pa.float64())], [*batch.schema.names, "f16", "f16_error"])

    return vectors.mapInArrow(run, schema)


def embed(df: DataFrame, text_column: str = "text", dim: int = 384, embedder: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds ``vector``: by default hashed words weighted by inverse document frequency, at unit length.

    ``embedder`` replaces that: it takes the DataFrame and adds ``vector``
    itself, usually by an iterator pandas UDF that loads its model once.
    """
    if embedder:
        return embedder(df)
    tokens = df.withColumn("__words", words(F.coalesce(F.col(text_column), F.lit(""))))
    counted = HashingTF(numFeatures=dim, inputCol="__words", outputCol="__tf").transform(tokens)
    weighted = IDF(inputCol="__tf", outputCol="__idf").fit(counted).transform(counted)
    unit = Normalizer(inputCol="__idf", outputCol="__unit").transform(weighted)
    return unit.withColumn("vector", vector_to_array("__unit")).drop("__words", "__tf", "__idf", "__unit")


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame, key: str = "chunk_id", text_column: str | None = "chunk") -> DataFrame:
    """Chunks with text that have no embedding yet; without ``text_column`` all that have none, also those without text."""
    asked = chunks.where(F.char_length(text_column) > 0) if text_column else chunks
    return asked.join(embeddings.select(key), key, "left_anti")


def backfill(chunks: DataFrame, embeddings: DataFrame, key: str = "chunk_id", text_column: str = "chunk", dim: int = 384, embedder=None) -> DataFrame:
    """Rows ``(key, vector)`` to append to ``embeddings``."""
    return embed(missing_embeddings(chunks, embeddings, key, text_column), text_column, dim, embedder).select(key, "vector")


def rebuild(chunks: DataFrame, path: str, key: str = "chunk_id", text_column: str = "chunk", dim: int = 384, embedder=None, blank: bool = False) -> DataFrame:
    """Embeds all ``chunks`` with text again (with ``blank`` also those without), writes ``(key, vector)`` over what is at ``path`` and returns it."""
    made = embed(chunks if blank else chunks.where(F.char_length(text_column) > 0), text_column, dim, embedder).select(key, "vector")
    made.write.mode("overwrite").parquet(path)
    return chunks.sparkSession.read.parquet(path)


#: Vectors of a packed row.
PACK = 1024
#: Largest written table of packed queries, in bytes, that is sent to all executors at once.
SENT_BYTES = 32 << 20


def _packed(df: DataFrame, key: str, kind: str, pack: int) -> DataFrame:
    """Rows ``(dim, keys, data)`` of up to ``pack`` vectors of one length laid end to end; null entries become NaN."""
    def run(batches):
        for batch in batches:
            vectors = batch.column(1)
            sizes = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == dim)
                for k in range(0, len(at), pack):
                    rows = pa.array(at[k : k + pack])
                    data = vectors.take(rows).flatten().cast(pa.float64())
                    keys = batch.column(0).take(rows)
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (keys, data)]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *lists], ["dim", "keys", "data"])

    told = df.select(key, "vector").where(F.col(key).isNotNull() & F.col("vector").isNotNull())  # lengths are told in the kernel, as a filter here would make the vectors twice
    return told.mapInArrow(run, f"dim int, keys array<{kind}>, data array<double>")


class _Best:
    """The best ``k`` of each query of one packed row, over all packed rows of the corpus that it meets."""

    def __init__(self, keys: np.ndarray, k: int) -> None:
        self.keys, self.k = keys, k
        self.ask, self.id, self.score = np.zeros(0, np.int64), keys[:0], np.zeros(0)

    def add(self, ids: np.ndarray, score: np.ndarray) -> None:
        k = self.k
        least = np.partition(score, -k, axis=1)[:, -k, None] if score.shape[1] > k else -np.inf
        ask, at = np.nonzero((score >= least) & (score > -np.inf))
        both = ids[at] if not len(self.id) else np.concatenate((self.id, ids[at]))
        self.ask, self.score = np.concatenate((self.ask, ask)), np.concatenate((self.score, score[ask, at]))
        order = np.lexsort((both, -self.score, self.ask))
        self.ask, self.id, self.score = self.ask[order], both[order], self.score[order]
        keep = np.arange(len(self.ask)) - np.searchsorted(self.ask, self.ask) < k
        self.ask, self.id, self.score = self.ask[keep], self.id[keep], self.score[keep]


def _unit(data: pa.Array, dim: int) -> np.ndarray:
    matrix = data.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length == 0, 1, length)


def _keys(values: pa.Array) -> np.ndarray:
    found = values.to_numpy(zero_copy_only=False)
    return found.astype(str) if found.dtype == object else found


def _multiplied(k: int, kinds: tuple[pa.DataType, pa.DataType]):
    def run(batches):
        best: dict[tuple, _Best] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                dim, number = batch.column("dim")[row].as_py(), (batch.column("dim")[row].as_py(), batch.column("number")[row].as_py())
                asks, ids = _keys(batch.column("asks")[row].values), _keys(batch.column("keys")[row].values)
                with np.errstate(invalid="ignore", over="ignore"):
                    score = np.round(_unit(batch.column("asked")[row].values, dim) @ _unit(batch.column("data")[row].values, dim).T, 9)
                own = asks[:, None] == ids[None, :] if asks.dtype.kind == ids.dtype.kind else asks.astype(str)[:, None] == ids.astype(str)[None, :]
                score[~np.isfinite(score) | own] = -np.inf
                if number not in best:
                    best[number] = _Best(asks, k)
                    best[number].id = ids[:0]
                best[number].add(ids, score)
        for found in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(found.keys[found.ask].tolist(), kinds[0]), pa.array(found.id.tolist(), kinds[1]), pa.array(found.score)], ["query_id", "id", "score"])

    return run


def vector_topk(corpus: DataFrame, queries: DataFrame, k: int = 8, block: int = PACK) -> DataFrame:
    """``(query_id, rank, id, score)``: exact cosine search of ``corpus(id, vector)`` for ``queries(query_id, vector)``.

    Vectors are packed ``block`` to a row; packed queries are sent to the corpus, in
    so many rounds that each is of a checked size, and every task keeps the best
    ``k`` of each query over all its rows. Nothing passes through the driver.

    * a query meets vectors of its own length only, and does not find its own id
      (ids of different types are compared as text);
    * null ids, null or empty vectors, and scores that aren't finite are not found;
    * ties go to the lesser id, after rounding to nine places;
    * a query id that stands twice is refused, as its ranks would be mixed.
    """
    spark = corpus.sparkSession
    twice = queries.where("query_id IS NOT NULL").groupBy("query_id").count().where("count > 1").select("query_id").head(1)
    if twice:
        raise ValueError(f"query_id {twice[0].query_id!r} stands twice")
    ask_kind, id_kind = queries.schema["query_id"].dataType, corpus.schema["id"].dataType
    path = shared_path(spark, "queries")
    number = F.monotonically_increasing_id().alias("number")
    _packed(queries, "query_id", ask_kind.simpleString(), block).select("dim", number, F.col("keys").alias("asks"), F.col("data").alias("asked")).write.parquet(path)
    asked = spark.read.parquet(path)
    rounds = -(-written_bytes(spark, path) // SENT_BYTES)
    stored = _packed(corpus, "id", id_kind.simpleString(), block)
    schema = f"query_id {ask_kind.simpleString()}, id {id_kind.simpleString()}, score double"
    kinds = (to_arrow_type(ask_kind), to_arrow_type(id_kind))
    parts = [asked.where(F.pmod(F.xxhash64("number"), F.lit(rounds)) == n) if rounds > 1 else asked for n in range(max(1, rounds))]
    found = reduce(DataFrame.union, [stored.join(p.hint("broadcast"), "dim").mapInArrow(_multiplied(k, kinds), schema) for p in parts])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


#: Earlier name of the same search, when queries were asked in blocks.
vector_topk_kernel = vector_topk
