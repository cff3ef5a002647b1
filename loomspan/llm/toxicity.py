"""Toxic passages as maximum-scoring segments over token log-odds.

* Learning: every training document, of at most about ``most_rows`` labelled
  rows, counts once for each of its words and for their first four and five bytes. Forms are told apart by 62 bits of their
  hash, and those seen too seldom to be used are left out of the model, which
  takes 16 bytes for each of the others; their number is bounded by the words
  of ``most_rows`` rows. A token's score is the
  log-odds of toxic documents given its longest form that was seen often
  enough, under a Dirichlet prior at the base rate, less one standard error and
  a drift that makes ordinary text score below zero.
* Scanning: one linear pass finds all maximal-scoring segments of a text.
* Calibration: the scores of segments of clean training documents, each scored
  without its own counts, have an exponential tail; it gives the rate and scale
  by which a segment of a text of n tokens has an expected number of chance
  peers. A document's evidence is the sum of the log of one over that number
  over its significant segments, and one logistic curve turns it into a chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, clash_free, uniform_key
from .words import NOT_ALNUM, find_words, hash_words, mix, text_slices, utf8

#: Forms that a task counts before it gives them out.
WAITING = 1 << 20
#: Bytes of the prefixes, from general to special; the whole word comes last.
PREFIXES = (4, 5)
#: Documents in which a form must occur to be used.
SEEN = 3
#: Weight of the prior, in documents, and what each token's score is lowered by.
PRIOR, DRIFT = 5.0, 0.5
#: Labelled rows that a model learns from, about: all if there are no more, else a share drawn by a hash of id, text and place.
MOST_ROWS = 250_000
#: Evidence beyond this counts as this much in the calibration.
MOST_EVIDENCE = 60.0


class Tokens:
    """Tokens of a batch of texts: places, owners and the key of each form."""

    def __init__(self, texts: Sequence[bytes]) -> None:
        blob = np.frombuffer(b" ".join(texts), np.uint8)
        self.starts, self.ends = find_words(blob, NOT_ALNUM)
        self.begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.offsets = np.searchsorted(self.starts, self.begins)
        self.counts = np.diff(self.offsets)
        self.owner = np.repeat(np.arange(len(texts)), self.counts)
        forms = [hash_words(blob, self.starts, np.minimum(self.ends, self.starts + p)) for p in PREFIXES]
        forms.append(hash_words(blob, self.starts, self.ends))
        self.keys = np.stack([(h & ~np.uint64(3) | np.uint64(form)).view(np.int64) for form, h in enumerate(forms)])


@dataclass
class Model:
    """Counts of documents by form, and what the calibration found."""

    keys: np.ndarray  # of all forms, ascending
    seen: np.ndarray  # documents
    toxic: np.ndarray  # toxic ones
    base: float  # share of toxic documents
    rate: float = 1.0
    scale: float = 1.0
    slope: float = 1.0
    level: float = 0.0

    def counts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and toxic documents of each key; 0 for one that the model lacks."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys))
        which, listed = pd.factorize(keys)
        at = np.minimum(np.searchsorted(self.keys, listed), len(self.keys) - 1)
        known = self.keys[at] == listed
        return np.where(known, self.seen[at], 0).astype(float)[which], np.where(known, self.toxic[at], 0).astype(float)[which]

    def scores(self, keys: np.ndarray, without: np.ndarray | None = None, label: np.ndarray | None = None) -> np.ndarray:
        """Token scores. ``without`` marks tokens whose own document (of ``label``) is left out of the counts."""
        out = np.full(keys.shape[1], -DRIFT)
        for form in keys:
            n, t = self.counts(form)
            if without is not None:
                n, t = n - without, t - without * label
            a, b = t + PRIOR * self.base, n - t + PRIOR * (1 - self.base)
            odds = np.log(a / b) - math.log(self.base / (1 - self.base)) - np.sqrt(1 / a + 1 / b) - DRIFT
            out = np.where(n >= SEEN, odds, out)
        return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(first, end, score)`` of a sequence, in one linear scan."""
    total = np.concatenate(([0.0], np.cumsum(scores)))
    low, high, first, end, back = [], [], [], [], []
    for i in np.flatnonzero(scores > 0).tolist():
        lo, hi, start = total[i], total[i + 1], i
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= lo:
                j = back[j]
            if j < 0 or high[j] >= hi:
                break
            lo, start = low[j], first[j]
            del low[j:], high[j:], first[j:], end[j:], back[j:]
        low.append(lo), high.append(hi), first.append(start), end.append(i + 1), back.append(j)
    return [(a, b, h - lo) for a, b, lo, h in zip(first, end, low, high, strict=True)]


def held_out(id_column: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _added(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of several lists as one, by ascending key."""
    keys, seen, toxic = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys, which = np.unique(keys, return_inverse=True)
    return keys, np.bincount(which, seen, len(keys)).astype(np.int64), np.bincount(which, toxic, len(keys)).astype(np.int64)


def _count(batches) -> Iterator[pa.RecordBatch]:
    """Partial ``(key, seen, toxic)``; a key may come more than once."""
    def told(counts):
        for k in range(0, len(counts[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in counts], ["key", "seen", "toxic"])

    held, fresh = [], 0
    for batch in text_slices(batches, "text"):
        tokens = Tokens(utf8(batch.column("text")))
        label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)[tokens.owner]
        apart = mix(tokens.owner.astype(np.uint64) + np.uint64(1))
        for keys in tokens.keys:
            once = ~pd.Series(mix(keys.view(np.uint64) ^ apart)).duplicated().to_numpy()
            held.append(_added([(keys[once], np.ones(once.sum(), np.int64), label[once])]))
            fresh += len(held[-1][0])
        if fresh > WAITING:
            held = [_added(held)]
            fresh = 0
            if len(held[0][0]) > WAITING:
                yield from told(held.pop())
    if held:
        yield from told(_added(held))


def _scan(shared, leave_out: bool):
    def run(batches):
        model: Model = shared.value
        for batch in text_slices(batches, "text"):
            texts = utf8(batch.column("text"))
            tokens = Tokens(texts)
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(float)[tokens.owner] if leave_out else None
            scores = model.scores(tokens.keys, np.ones(len(tokens.owner)) if leave_out else None, label)
            found: list[list[tuple]] = [[] for _ in texts]
            for k in np.unique(tokens.owner[scores > 0]).tolist():
                a, begin = tokens.offsets[k], tokens.begins[k]
                for i, j, s in maximal_segments(scores[a : tokens.offsets[k + 1]]):
                    x, y = tokens.starts[a + i] - begin, tokens.ends[a + j - 1] - begin
                    found[k].append((int(x), int(y), s))
            if not leave_out:
                found = [_significant(model, n, f) for n, f in zip(tokens.counts.tolist(), found, strict=True)]
            spans = [[{"start": len(t[:x].decode()), "length": len(t[x:y].decode()), "score": s} for x, y, s in f] for t, f in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.select([c for c in batch.schema.names if c != "text"]).columns, pa.array(tokens.counts), pa.array(spans, _SPANS)], [*(c for c in batch.schema.names if c != "text"), "n_tokens", "passages"])
    return run


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))
_PASSAGES = "passages array<struct<start:int,length:int,score:double>>"


def _significant(model: Model, n: int, found: list) -> list:
    """The segments that fewer than one chance peer is expected for."""
    return [f for f in found if model.rate * f[2] > math.log(max(model.scale * n, 1e-9))]


def logistic(x: np.ndarray, positive: np.ndarray, count: np.ndarray) -> tuple[float, float]:
    """Slope and level of a logistic curve fitted to grouped counts, with a weak pull of the slope to 0."""
    beta, design = np.zeros(2), np.stack([x, np.ones_like(x)], 1)

    def likelihood(b: np.ndarray) -> float:
        z = design @ b
        return -(positive @ np.logaddexp(0, -z) + (count - positive) @ np.logaddexp(0, z)) - 5e-4 * (b @ b)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        gradient = design.T @ (positive - count * p) - 1e-3 * beta
        hessian = (design * (count * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        now = likelihood(beta)
        while np.abs(step).max() > 1e-9 and likelihood(beta + step) < now:  # a full step may overshoot
            step = step / 2
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, stage: Stage, most_rows: int = MOST_ROWS) -> Model:
    """Learns from labelled ``docs(id, text)`` that aren't held out; ``labels(id, label)``.

    Of more than ``most_rows`` such rows a share is drawn, of about that size.
    Rows are drawn one by one, so an id that many rows have can't exceed it.

    A null label counts as none; an id labelled more than once takes its
    highest label. Without any labelled row the model scores everything alike.
    """
    spark = docs.sparkSession
    known = labels.where("label IS NOT NULL AND id IS NOT NULL").where(~held_out(F.col("id"))).groupBy("id").agg((F.max("label") == 1).alias("label"))
    known = stage.put(known, "known")
    placed = docs.withColumn("place", F.monotonically_increasing_id())
    rows = placed.join(stage.small(known, "known"), "id")
    n = rows.count()
    if n > most_rows:
        rows = rows.where(uniform_key("id", "text", "place", seed=29) < int(most_rows / n * (1 << 62)))
    rows = rows.select("id", "text", "label")
    counts = rows.select("text", "label").mapInArrow(_count, "key long, seen long, toxic long").groupBy("key").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))
    table = counts.where(F.col("seen") >= SEEN).toArrow().sort_by("key")  # others are never used
    keys, seen, toxic = table["key"].to_numpy(), table["seen"].to_numpy().astype(np.int32), table["toxic"].to_numpy().astype(np.int32)
    n, t = known.agg(F.count("*"), F.count_if("label")).first()
    model = Model(keys, seen, toxic, (t + 0.5) / (n + 1) if n else 0.05)
    kind = docs.schema["id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)
    scanned = rows.mapInArrow(_scan(shared, True), f"id {kind}, label boolean, n_tokens long, {_PASSAGES}")
    scanned = stage.put(scanned.select("label", "n_tokens", "passages"), "scanned")
    shared.unpersist()
    clean = scanned.where("NOT label")
    tail = clean.select(F.explode("passages.score").alias("score")).agg(F.count("*"), F.avg("score")).first()
    tokens = clean.agg(F.sum("n_tokens")).first()[0] or 0
    if tail[0]:
        model.rate = min(1 / tail[1], 20.0)
        model.scale = tail[0] / max(tokens, 1)
    elif tokens:
        model.scale = 1 / tokens
    bins = scanned.select(F.round(evidence(model) * 4).alias("bin"), "label").groupBy("bin").agg(F.count("*").alias("n"), F.count_if("label").alias("t")).toPandas()
    if len(bins):
        model.slope, model.level = logistic(bins.bin.to_numpy(float) / 4, bins.t.to_numpy(float), bins.n.to_numpy(float))
    else:
        model.slope, model.level = 0.0, math.log(model.base / (1 - model.base))
    return model


def evidence(model: Model) -> Column:
    """Sum over the passages of the log of one over the chance peers expected, where that is below one."""
    peers = F.log(F.greatest(F.lit(model.scale) * F.col("n_tokens"), F.lit(1e-9)))
    total = F.aggregate("passages", F.lit(0.0), lambda s, p: s + F.greatest(F.lit(0.0), F.lit(model.rate) * p["score"] - peers))
    return F.least(F.lit(MOST_EVIDENCE), total)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(id, text)``, and ``row`` if there, as ``(id, row, n_tokens, passages, score)``; passages are the significant segments, by code points."""
    told = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in told)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scanned = docs.select(*told, "text").mapInArrow(_scan(shared, False), f"{kinds}, n_tokens long, {_PASSAGES}")
    curve = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(model.slope) * evidence(model) + F.lit(model.level))))
    return scanned.withColumn("score", curve)


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", threshold: float = 0.3, row_column: str | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """One row per input row: ``id_column``, ``held_out``, ``score`` (0 to 1), ``predicted``, ``passages``.

    Only the text enters a score. The model learns from about ``most_rows``
    labelled rows at most; every row is scored. ``passages`` lists the significant segments
    as start and length in code points, with their segment score. A
    ``row_column`` comes along, as rows may share an id.

    * a null, empty or wordless text has no passage and the lowest score;
    * a null id is scored and is not held out; equal texts score alike;
    * repeated rows stay; other columns of either table are ignored;
    * an empty table gives no rows; without labels all rows score alike.
    """
    stage = Stage(docs.sparkSession, "toxicity")
    ids = clash_free(docs, id=id_column, text=text_column, **({"row": row_column} if row_column else {}))
    model = train(ids, clash_free(labels, id=id_column, label=label_column), stage, most_rows)
    out = score(ids, model)
    row = [F.col("row").alias(row_column)] if row_column else []
    return out.select(*row, F.col("id").alias(id_column), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages", "n_tokens")
