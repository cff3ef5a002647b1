"""Hybrid search for tables of queries: fusion, boosts, re-ranking, context, prompts and answers."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_terms, sigmoid
from ..session import sized
from . import keyword, vector


@dataclass(frozen=True)
class SearchConfig:
    """Rows shown, least score, candidates when re-ranking, fusion constant, and whether both searches run."""

    top_k: int = 8
    min_score: float = 0.20
    candidates: int = 20
    rrf_k: int = 60
    hybrid: bool = True
    rerank: bool = False


def ranked(hits: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The best ``k`` hits of each query, ranked from 1; ties go to the lesser id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "id")).cast("long")
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def fuse(by_vector: DataFrame, by_keyword: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists ``(query_id, rank, id, score)``.

    Gives ``fused``, the order, and ``score``, what is shown: the vector side's
    score or else the other's, raised to 30 times the fused value, at most 1.
    """
    both = by_vector.select("query_id", "id", "rank", "score", F.lit(0).alias("side")).unionByName(by_keyword.select("query_id", "id", "rank", F.col("shown").alias("score"), F.lit(1).alias("side")))
    fused = both.groupBy("query_id", "id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 9).alias("fused"), F.min_by("score", "side").alias("side_score"))
    return fused.select("query_id", "id", "fused", F.least(F.lit(1.0), F.greatest("side_score", F.lit(30.0) * F.col("fused"))).alias("score"))


def lexical_boost(query: Column, text: Column, head: int = 250, each: float = 0.02, most: float = 0.06) -> Column:
    """What a hit gains for query terms in its first characters."""
    start = F.lower(F.left(text, F.lit(head)))
    return F.least(F.lit(most), F.lit(each) * F.size(F.filter(F.array_distinct(query_terms(query)), lambda t: F.contains(start, t))))


def overlap_scorer(query: Column, text: Column) -> Column:
    """Default pair scorer: how many query terms a text holds, centred at half of them."""
    terms, low = F.array_distinct(query_terms(query)), F.lower(text)
    return F.size(F.filter(terms, lambda t: F.contains(low, t))) - F.size(terms) / 2


def with_texts(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """Hits with the columns of ``texts(id, ...)``: few hits are sent to the texts, which are then not shuffled."""
    return texts.join(sized(hits, "hits"), "id")


def boosted(by_vector: DataFrame, queries: DataFrame, texts: DataFrame) -> DataFrame:
    """Vector hits with the lexical boost, ranked again; texts are joined to the winners only."""
    full = with_texts(by_vector.join(queries.hint("merge"), "query_id"), texts)
    gain = full.withColumn("score", F.round(F.col("score") + lexical_boost(F.col("query"), F.col("text")), 9)).drop("rank")
    return gain.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("long")).select("query_id", "rank", "id", "score")


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column] = overlap_scorer) -> DataFrame:
    """Scores hits ``(query_id, id, query, text)`` by a pair scorer, through a sigmoid, and ranks them again.

    ``scorer`` may call a pandas UDF. A null score keeps the row, behind all others.
    """
    scored = hits.withColumn("score", F.round(sigmoid(scorer(F.col("query"), F.col("text")).cast("double")), 9)).drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long"))


def search(queries: DataFrame, corpus: DataFrame, index: keyword.KeywordIndex, config: SearchConfig = SearchConfig()) -> DataFrame:
    """``(query_id, rank, id, score)`` for ``queries(query_id, query, vector)`` on ``corpus(id, text, vector)``."""
    k = config.candidates if config.rerank else config.top_k
    near = vector.vector_topk(corpus.select("id", "vector"), queries.select("query_id", "vector"), k)
    texts = corpus.select("id", "text")
    if config.hybrid:
        found = fuse(near, keyword.bm25_topk(index, queries.select("query_id", "query"), 20), config.rrf_k)
        found = ranked(found, k, "fused")
    else:
        found = boosted(near, queries.select("query_id", "query"), texts)
    if config.rerank:
        found = rerank(with_texts(found.join(queries.select("query_id", "query").hint("merge"), "query_id"), texts))
    kept = found.where(F.col("score") >= config.min_score).withColumn("place", -F.col("rank")).drop("rank")
    return ranked(kept, config.top_k, "place").select("query_id", "rank", "id", "score")


def context(hits: DataFrame, separator: str = "\n\n---\n\n") -> DataFrame:
    """One row per query: hits ``(query_id, rank, source_path, text)`` joined under numbered headers."""
    part = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] "), "source_path", F.lit("\n"), "text")
    each = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(each, lambda x: x["part"]), separator).alias("context"), F.count("*").alias("chunks_used"))


def source_summary(hits: DataFrame) -> DataFrame:
    """Chunks and average relevance of each source per query."""
    return hits.groupBy("query_id", "source_path").agg(F.count("*").alias("chunks"), F.round(F.avg("score"), 6).alias("avg_relevance"))


#: Rules, context and question of a prompt.
TEMPLATE = "Answer from the sources only and name those you use. Say so if they hold no answer.\n\nSources:\n%s\n\nQuestion: %s\nAnswer:"


def build_prompts(df: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Adds ``prompt`` to ``(query, context)``."""
    return df.withColumn("prompt", F.format_string(template, F.coalesce("context", F.lit("")), F.coalesce("query", F.lit(""))))


def best_sentence(query: Column, text: Column) -> Column:
    """Default responder: the sentence of a text that holds most query terms, the first of equals."""
    terms = F.array_distinct(query_terms(query))
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s, k: F.struct((-F.size(F.filter(terms, lambda t: F.contains(F.lower(s), t)))).alias("n"), k.alias("k"), s.alias("s")))
    return F.array_min(parts)["s"]


def answer_batch(df: DataFrame, responder: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds ``answer``: from the best hit's text ``top_text``, or by a responder given as a DataFrame function."""
    return responder(df) if responder else df.withColumn("answer", best_sentence(F.col("query"), F.col("top_text")))


def answer_by_mode(df: DataFrame, backends: Mapping[str, Callable[[DataFrame], DataFrame]], mode: str = "mode") -> DataFrame:
    """Adds ``answer`` by the backend that each row's mode names; a mode without one, and a null mode, have no answer.

    A backend takes its rows and adds ``answer``; it never sees those of another mode.
    """
    known = F.coalesce(F.col(mode).isin(*backends), F.lit(False))
    parts = [df.where(~known).withColumn("answer", F.lit(None).cast("string"))] if backends else [df.withColumn("answer", F.lit(None).cast("string"))]
    parts += [backend(df.where(F.col(mode) == name)).select(*df.columns, "answer") for name, backend in backends.items()]
    return reduce(DataFrame.union, parts)


def cost(tokens_in: Column, tokens_out: Column, mode: Column, rate_in: float = 0.0015, rate_out: float = 0.002) -> Column:
    """Price of a response by tokens per thousand; nothing offline."""
    return F.when(mode == "offline", F.lit(0.0)).otherwise(tokens_in / 1000 * F.lit(rate_in) + tokens_out / 1000 * F.lit(rate_out))


def outcome(df: DataFrame) -> DataFrame:
    """Adds ``error`` and ``message`` to ``(hits, context, answer, failure)``; the first case that holds."""
    error = F.when(F.col("failure").isNotNull(), "exception").when(F.coalesce("hits", F.lit(0)) == 0, "no_results").when(F.trim(F.coalesce("context", F.lit(""))) == "", "empty_context").when(F.col("answer").isNull(), "model_failure")
    message = F.when(error == "exception", F.concat(F.lit("Error: "), "failure")).when(error == "no_results", "No relevant information was found.").when(error == "empty_context", "The documents found hold no text.").when(error == "model_failure", "No answer could be made.").otherwise(F.col("answer"))
    return df.withColumn("error", error).withColumn("message", message)
