"""Token-id files: frequency-ranked ids in byte-aligned variable-length blocks.

An id is stored as its rank by frequency over the whole corpus, in as few whole
bytes as the rank needs. The byte counts are kept apart as control bytes, two
bits for each of four ids, so a block is decoded without branches: one table
lookup by control byte gives four lengths, their running sum the places, and
masked gathers the ranks.

A written folder holds Parquet tables, which any store that Spark writes to can
keep and which task retries can't damage:

* ``vocabulary``: rank, id, count;
* ``blocks``: shard, block, before (ids of the shard before the block), doc_ids,
  sizes, control, data. Shards and blocks follow the document ids;
* ``shards``: shard, before (ids of all shards before it), n_ids.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, clash_free
from .words import BLANKS, UnitCache, text_slices, utf8

#: A block is closed once it holds this many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 16
#: Lengths of four ids by control byte.
LENGTHS = np.array([[(b >> s & 3) + 1 for s in (0, 2, 4, 6)] for b in range(256)], np.int64)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks below 2^32."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    fours = np.zeros(-len(ranks) % 4 + len(ranks), np.uint8)
    fours[: len(ranks)] = extra
    control = (fours.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4)[None, :] <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of a block."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(length) - length
    stored = np.frombuffer(data + b"\0\0\0", np.uint8)
    ranks = stored[start].astype(np.uint32)
    for k in range(1, int(length.max(initial=1))):
        wide = length > k
        ranks[wide] |= stored[start[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_MARK = np.array([b < 128 and not chr(b).isalpha() and b > 32 and chr(b) != "|" for b in range(256)])


class Tokenizer:
    """The tokenizers library over whole texts, each distinct stretch encoded once.

    Texts are cut at ASCII blanks and, inside words, between an ASCII letter
    and a following digit or mark (but for ``|``, which special tokens hold).
    Holds for tokenizers that lower-case, drop white space and split letters
    from marks: there no token and no normalisation reaches across a cut.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        trial = [[e.ids for e in self.library.encode_batch([a + b + c, a, c], add_special_tokens=False)] for a, b, c in (("Ab,", " ", "'s é"), ("x", "\n", "́y"), ("1", "\t ", "2"), ("it", "", "'sa"), ("x", "", "<|endoftext|>"), ("Abc", "", ",.D"), ("a", "", "1b"))]
        if any(whole != left + right for whole, left, right in trial):
            raise ValueError("only tokenizers that drop white space are supported")
        self.cache = UnitCache(self._encode, most_units=1_000_000)

    def _encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[int] = []
        sizes: list[int] = []
        for k in range(0, len(units), 4096):  # the library's results are large
            for e in self.library.encode_batch_fast([u.decode() for u in units[k : k + 4096]], add_special_tokens=False):
                ids += e.ids
                sizes.append(len(e))
        return np.array(ids, np.int32), np.array(sizes, np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and ``len(texts) + 1`` offsets."""
        whole = b" ".join(texts)
        blob = np.frombuffer(whole if b"<|" in whole else whole.lower(), np.uint8)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        first = np.zeros(len(blob) + 1, bool)
        blank = np.concatenate(([True], BLANKS[blob], [True]))
        first[:-1] = blank[:-2] & ~blank[1:-1]
        first[1:-1] |= _LETTER[blob[:-1]] & _MARK[blob[1:]]
        last = first.copy()
        last[:] = False
        last[:-1] = first[:-1] & ~blank[:-2]  # a stretch also ends where the next begins inside a word
        last[1:] |= ~blank[1:-1] & blank[2:]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last)
        rows, which = self.cache.find(blob[~blank[1:-1]], ends - starts)
        ids, sizes = self.cache.tokens(rows[which])
        return ids, np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(starts, begins)]


@lru_cache(maxsize=1)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def _encode(path: str, end_id: int):
    def run(batches):
        for batch in text_slices(batches, "text"):
            ids, offsets = tokenizer(path).encode(utf8(batch.column("text")))
            ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
            ends = np.cumsum(np.diff(offsets) + 1)
            wide = ids if tokenizer(path).size > 1 << 16 or end_id >> 16 else ids.astype("<u2")
            lists = [wide[a:b].tobytes() for a, b in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("nth"), pa.array(np.diff(offsets) + 1), pa.array(lists, pa.binary())], ["id", "nth", "size", "ids"])
    return run


def _ids(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def _count(batches):
    counts = np.zeros(0, np.int64)
    for batch in batches:
        for data, n in zip(batch.column("ids").to_pylist(), batch.column("size").to_pylist(), strict=True):
            found = np.bincount(_ids(data, n))
            if len(found) > len(counts):
                counts = np.concatenate((counts, np.zeros(len(found) - len(counts), np.int64)))
            counts[: len(found)] += found
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["token", "n"])


def _blocks(shared) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of the documents of one sorted partition; each document's ranks are filled up to whole control bytes with rank 0."""
    def run(batches):
        rank_of, shard, block, before = shared.value, TaskContext.get().partitionId(), 0, 0
        docs, sizes, lists, held, kind = [], [], [], 0, None

        def close() -> pa.RecordBatch:
            stored = np.array(sizes, np.int64)
            filled = stored + -stored % 4
            ranks = np.zeros(int(filled.sum()), np.int64)
            spare = np.repeat(np.cumsum(filled) - filled - (np.cumsum(stored) - stored), stored)
            ranks[spare + np.arange(len(spare))] = rank_of[np.concatenate(lists)]
            control, data = pack(ranks)
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([block]), pa.array([before]), pa.array([docs], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())], ["shard", "block", "before", "doc_ids", "sizes", "control", "data"])

        for batch in batches:
            kind = batch.column("id").type
            for doc, n, data in zip(*(batch.column(x).to_pylist() for x in ("id", "size", "ids")), strict=True):
                docs.append(doc), sizes.append(n), lists.append(_ids(data, n))
                held += n
                if held >= BLOCK_IDS:
                    yield close()
                    block, before = block + 1, before + held
                    docs, sizes, lists, held = [], [], [], 0
        if docs:
            yield close()

    return run


def _read(shared):
    def run(batches):
        ids_of = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], np.int64)
                stored = sizes + -sizes % 4
                ids = ids_of[unpack(row["control"], row["data"], int(stored.sum()))].astype("<u4")
                ends, at = np.cumsum(sizes), np.cumsum(stored) - stored
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                    pa.array(ends - sizes + row["before"] + row["shard_before"]),
                    pa.array(sizes),
                    pa.array([ids[k : k + n].tobytes() for k, n in zip(at, sizes, strict=True)], pa.binary()),
                ], ["id", "start", "n_tokens", "ids"])
    return run


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encodes every whole text, appends ``end_id`` to each, and writes the folder in ascending id order.

    * a null or empty text is its end id alone; a null id comes first;
    * rows with one id stay apart, in the order of their texts' hashes;
    * other columns are ignored; an empty table gives a folder without blocks.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "encoded")
    ids = clash_free(docs, id=id_column, text=text_column).withColumn("nth", F.xxhash64("text"))
    kind = ids.schema["id"].dataType.simpleString()
    encoded = ids.mapInArrow(_encode(tokenizer_path, end_id), f"id {kind}, nth long, size long, ids binary")
    encoded = stage.put(encoded, "encoded", compression="zstd")
    counts = encoded.select("size", "ids").mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("count"))
    found = counts.orderBy(F.desc("count"), "token").toPandas()  # at most one row for each id of the vocabulary
    rank = np.zeros(int(found.token.max()) + 1 if len(found) else 1, np.int64)
    rank[found.token.to_numpy(np.int64)] = np.arange(len(found))
    vocabulary = spark.createDataFrame(found.assign(rank=range(len(found)))[["rank", "token", "count"]].astype("int64"), "rank long, id long, count long")
    vocabulary.coalesce(1).write.mode("overwrite").parquet(f"{folder}/vocabulary")
    ordered = encoded.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").sortWithinPartitions("id", "nth")
    blocks = ordered.mapInArrow(_blocks(spark.sparkContext.broadcast(rank)), f"shard long, block long, before long, doc_ids array<{kind}>, sizes array<bigint>, control binary, data binary")
    blocks.write.mode("overwrite").parquet(f"{folder}/blocks")
    stage.drop("encoded")
    sums = spark.read.parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda x, n: x + n)).alias("n_ids"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    sums.select("shard", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("before"), "n_ids").coalesce(1).write.mode("overwrite").parquet(f"{folder}/shards")


def read(spark, folder: str) -> DataFrame:
    """``(id, start, n_tokens, ids)`` of every document of a written folder; ``ids`` is little-endian 32-bit."""
    vocabulary = spark.read.parquet(f"{folder}/vocabulary").toPandas()
    ids_of = np.zeros(len(vocabulary), np.int64)
    ids_of[vocabulary["rank"].to_numpy()] = vocabulary["id"].to_numpy()
    blocks = spark.read.parquet(f"{folder}/blocks")
    shards = spark.read.parquet(f"{folder}/shards").select("shard", F.col("before").alias("shard_before"))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    placed = blocks.join(F.broadcast(shards), "shard")  # one row for each write task
    return placed.mapInArrow(_read(spark.sparkContext.broadcast(ids_of)), f"id {kind}, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes ``docs(doc_id, text)`` to a folder of their own and reads them back."""
    stage = Stage(docs.sparkSession, "tokens")
    write(docs, tokenizer_path, stage.root, end_id)
    return read(docs.sparkSession, stage.root)
