"""Registered queries on search, answers and their evaluation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate, keyword, search, vector
from ..session import spread
from .retrieval import BM25, benchmark_queries, docs_index, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


#: Stand-in vectors that both engines can make: letter counts of the text.
LETTERS = "etaoinshrdlu"
_VEC = "[" + ", ".join(f"(length(text) - length(replace(text, '{c}', '')))::DOUBLE" for c in LETTERS) + "]"


def letters(text):
    return F.array(*((F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in LETTERS))


def _corpus(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents"))
    return d.select(F.col("doc_id").alias("id"), "text", letters(F.col("text")).alias("vector"), F.concat_ws("/", "source", "doc_id").alias("source_path"))


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", F.concat_ws("/", "source", "doc_id").alias("source_path"))


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("query_id"), F.col("text").alias("query"), letters(F.col("text")).alias("vector"))


HYBRID = f"""
{BM25.replace("item_id AS query_id", "-1 - item_id AS query_id")},
c AS (SELECT doc_id AS id, text, {_VEC} AS v, source || '/' || doc_id AS source_path FROM documents),
q AS (SELECT -1 - item_id AS query_id, text AS query, {_VEC} AS v FROM benchmark),
sim AS (SELECT query_id, id, round(coalesce(CASE WHEN list_sum(c.v) = 0 OR list_sum(q.v) = 0 THEN 0 ELSE list_cosine_similarity(c.v, q.v) END, 0), 9) AS score FROM c, q),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sim) WHERE rank <= 8),
both_sides AS (SELECT query_id, id, rank, score, 0 AS side FROM near UNION ALL SELECT query_id, id, rank, shown, 1 FROM bm25),
fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, arg_min(score, side) AS side_score FROM both_sides GROUP BY ALL),
shown AS (SELECT query_id, id, fused, least(1.0::DOUBLE, greatest(side_score, 30.0::DOUBLE * fused)) AS score FROM fused),
hits AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS rank FROM shown),
best AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM hits WHERE rank <= 8 AND score >= 0.2)"""


def hits(spark, sf_dir):
    return search.search(_asked(spark, sf_dir), _corpus(spark, sf_dir), docs_index(spark, sf_dir))


@query("T4_hybrid_search", f"WITH {HYBRID} SELECT query_id, rank, id, round(score, 6) AS score FROM best")
def t4(spark, sf_dir):
    """Fused vector and keyword search of every benchmark text."""
    return hits(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("T3_boosted_vector_search", f"""WITH {HYBRID}, gained AS (SELECT near.query_id, near.id, round(near.score + least(0.06::DOUBLE, 0.02::DOUBLE * len(list_filter(list_distinct(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda t: length(t) >= 3)), lambda t: contains(lower(left(c.text, 250)), t)))), 9) AS score
  FROM near JOIN q USING (query_id) JOIN c USING (id))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, round(score, 6) AS score FROM gained""")
def t3(spark, sf_dir):
    """Vector search with the lexical boost."""
    corpus, asked = _corpus(spark, sf_dir), _asked(spark, sf_dir)
    near = vector.vector_topk(corpus.select("id", "vector"), asked.select("query_id", "vector"))
    return search.boosted(near, asked.select("query_id", "query"), corpus.select("id", "text")).withColumn("score", F.round("score", 6))


_WIDE = HYBRID.replace("WHERE rank <= 8)", "WHERE rank <= 20)").replace("rank <= 8 AND score", "rank <= 20 AND score")


@query("T5_rerank", f"""WITH {_WIDE}, wanted AS (SELECT query_id, list_distinct(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda t: length(t) >= 3)) AS ts FROM q),
judged AS (SELECT hits.query_id, hits.id, round(1 / (1 + exp(-(len(list_filter(ts, lambda t: contains(lower(c.text), t))) - len(ts) / 2.0::DOUBLE))), 9) AS score FROM hits JOIN wanted USING (query_id) JOIN c USING (id) WHERE rank <= 20),
again AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM judged WHERE score >= 0.2)
SELECT query_id, rank, id, round(score, 6) AS score FROM again WHERE rank <= 8""")
def t5(spark, sf_dir):
    """Twenty candidates ranked again by term overlap."""
    return search.search(_asked(spark, sf_dir), _corpus(spark, sf_dir), docs_index(spark, sf_dir), search.SearchConfig(rerank=True)).withColumn("score", F.round("score", 6))


@query("A4_source_summary", f"WITH {HYBRID} SELECT query_id, source AS source_path, count(*) AS chunks, round(avg(round(score, 9)), 6) AS avg_relevance FROM best JOIN documents ON id = doc_id GROUP BY ALL")
def a4(spark, sf_dir):
    """Chunks and average relevance per query and source."""
    full = search.with_texts(hits(spark, sf_dir).withColumn("score", F.round("score", 9)), _texts(spark, sf_dir).select("id", F.col("source").alias("source_path")))
    return search.source_summary(full)


@query("A20_context", f"""WITH {HYBRID} SELECT query_id, string_agg('[Source ' || rank || '] ' || source_path || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS chunks_used FROM best JOIN c USING (id) GROUP BY query_id""")
def a20(spark, sf_dir):
    """Numbered context of every query."""
    return search.context(search.with_texts(hits(spark, sf_dir), _texts(spark, sf_dir).select("id", "text", "source_path")))


_CONTEXT = "string_agg('[Source ' || rank || '] ' || source_path || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)"
_PROMPT = "'" + search.TEMPLATE.replace("\n", "' || chr(10) || '").replace("%s", "' || {} || '") + "'"


@query("T8_prompts", f"""WITH {HYBRID}, told AS (SELECT query_id, {_CONTEXT} AS context FROM best JOIN c USING (id) GROUP BY query_id)
SELECT query_id, sha256({_PROMPT.format("coalesce(context, '')", "coalesce(query, '')")}) AS prompt_sha256 FROM q LEFT JOIN told USING (query_id)""")
def t8(spark, sf_dir):
    """Prompts of all queries, as digests."""
    asked = benchmark_queries(spark, sf_dir).withColumn("query_id", -1 - F.col("query_id"))
    return search.build_prompts(asked.join(a20(spark, sf_dir).hint("merge"), "query_id", "left")).select("query_id", F.sha2("prompt", 256).alias("prompt_sha256"))


@query("T9_answers", f"""WITH {HYBRID}, top AS (SELECT query_id, text FROM best JOIN c USING (id) WHERE rank = 1),
parts AS (SELECT q.query_id, text, list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda t: length(t) >= 3) AS ts, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS sentences FROM q LEFT JOIN top USING (query_id)),
each AS (SELECT query_id, text, unnest(list_zip(sentences, range(len(sentences)), list_transform(sentences, lambda s: len(list_filter(list_distinct(ts), lambda t: contains(lower(s), t)))))) AS s FROM parts),
chosen AS (SELECT query_id, s[1] AS answer FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s[3] DESC, s[2]) AS k FROM each) WHERE k = 1)
SELECT query_id, answer, CASE WHEN text IS NULL THEN 'no_results' WHEN trim(text, ' ') = '' THEN 'empty_context' END AS error,
  CASE WHEN text IS NULL THEN 'No relevant information was found.' WHEN trim(text, ' ') = '' THEN 'The documents found hold no text.' ELSE answer END AS message FROM parts LEFT JOIN chosen USING (query_id)""")
def t9(spark, sf_dir):
    """Best sentence of every query's best hit, with its outcome."""
    top = search.with_texts(hits(spark, sf_dir).where("rank = 1"), _texts(spark, sf_dir).select("id", F.col("text").alias("top_text")))
    asked = _asked(spark, sf_dir).select("query_id", "query").join(top.hint("merge"), "query_id", "left")
    done = search.answer_batch(asked).withColumn("hits", F.when(F.col("id").isNotNull(), 1).otherwise(0)).withColumn("context", F.col("top_text")).withColumn("failure", F.lit(None).cast("string"))
    return search.outcome(done).select("query_id", "answer", "error", "message")


@query("T10_golden_probe", f"WITH {BM25} SELECT query_id, count(*) > 0 AS healthy FROM bm25 GROUP BY query_id")
def t10(spark, sf_dir):
    """Queries for which the index returns something."""
    return keyword.bm25_topk(docs_index(spark, sf_dir), benchmark_queries(spark, sf_dir)).groupBy("query_id").agg((F.count("*") > 0).alias("healthy"))


TURNS = """turns AS (SELECT conv_id, turn, role, text AS query, lead(text) OVER w AS answer, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, query, CASE WHEN next_role = 'assistant' THEN answer END AS answer FROM turns WHERE role = 'user'),
facts AS (SELECT *, list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda t: length(t) >= 3) AS terms,
  CASE turn % 8 WHEN 0 THEN 'answerable' WHEN 2 THEN 'ambiguous' WHEN 4 THEN 'unanswerable' ELSE 'injection' END AS type FROM pairs)"""


def _turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").withColumn("next", F.when(F.lead("role").over(w) == "assistant", F.lead("text").over(w))).where("role = 'user'")
    kind = F.when(F.col("turn") % 8 == 0, "answerable").when(F.col("turn") % 8 == 2, "ambiguous").when(F.col("turn") % 8 == 4, "unanswerable").otherwise("injection")
    return t.select(F.concat_ws("-", "conv_id", "turn").alias("id"), kind.alias("type"), F.col("text").alias("query"), F.col("next").alias("answer"), "conv_id", "turn")


@query("P12_fact_score", f"WITH {TURNS} SELECT conv_id, turn, round(CASE WHEN len(terms) = 0 THEN 1 ELSE len(list_filter(terms, lambda t: contains(lower(coalesce(answer, '')), t))) / len(terms) END, 6) AS fact_score FROM facts")
def p12(spark, sf_dir):
    """Share of a question's terms that its answer holds."""
    from ..functions.text import query_terms
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(evaluate.fact_score(F.col("answer"), query_terms(F.col("query"))), 6).alias("fact_score"))


SCORED = TURNS + """, scored AS (SELECT *, CASE WHEN len(terms) = 0 THEN 1 ELSE len(list_filter(terms, lambda t: contains(lower(coalesce(answer, '')), t))) / len(terms) END AS fact,
  CASE type WHEN 'unanswerable' THEN regexp_matches(coalesce(answer, ''), '(?i)\\b(not found|not in (the )?provided documents|unknown|cannot determine|insufficient information|i don''t know|no relevant documents)\\b')
    WHEN 'ambiguous' THEN contains(coalesce(answer, ''), '?') OR contains(lower(coalesce(answer, '')), 'which') OR contains(lower(coalesce(answer, '')), 'do you mean')
    WHEN 'injection' THEN regexp_matches(coalesce(answer, ''), '(?i)\\bTLS\\s*1\\.3\\b') AND NOT regexp_matches(coalesce(answer, ''), '(?i)\\bAES-512\\b') ELSE true END::INT::DOUBLE AS behavior FROM facts),
overall AS (SELECT *, round(CASE WHEN type IN ('answerable', 'ambiguous') THEN 0.7::DOUBLE * fact + 0.3::DOUBLE * behavior ELSE behavior END, 9) AS score, length(query) AS latency_ms FROM scored)"""


def _scored(spark, sf_dir):
    from ..functions.text import query_terms
    t = _turns(spark, sf_dir)
    answers = t.select("id", "answer", F.char_length("query").cast("long").alias("latency_ms"), F.when(F.col("answer").isNull(), "none").alias("error"))
    return evaluate.evaluate(t.select("id", "type", "query", query_terms(F.col("query")).alias("expected_key_facts"), "conv_id", "turn"), answers)


@query("P13_P14_evaluation", f"WITH {SCORED} SELECT conv_id, turn, type, round(behavior, 6) AS behavior_score, round(score, 6) AS overall_score, score >= 0.85 AS passed FROM overall")
def p14(spark, sf_dir):
    """Behaviour and overall score of every answer."""
    return _scored(spark, sf_dir).select("conv_id", "turn", "type", "behavior_score", F.round("overall_score", 6).alias("overall_score"), "passed")


@query("A11_eval_summary", f"""WITH {SCORED}, sets AS (SELECT NULL AS type, score, latency_ms, answer FROM overall UNION ALL SELECT type, score, latency_ms, answer FROM overall)
SELECT type, count(*) AS questions, round(avg((score >= 0.85)::INT), 6) AS pass_rate, count(*) FILTER (answer IS NULL) AS errors,
  list_sort(list(latency_ms))[round_even(0.5::DOUBLE * (count(*) - 1), 0)::INT + 1] AS p50, list_sort(list(latency_ms))[round_even(0.95::DOUBLE * (count(*) - 1), 0)::INT + 1] AS p95 FROM sets GROUP BY type""")
def a11(spark, sf_dir):
    """Pass rates and latency ranks, overall and by type."""
    return evaluate.summary(_scored(spark, sf_dir))


@query("P15_rating", f"""WITH {TURNS}, r AS (SELECT conv_id, turn, lower(coalesce(answer, '')) AS a, turn % 7 AS chunks, turn % 4 AS n FROM facts),
s AS (SELECT *, round((CASE WHEN chunks >= 5 THEN 1.0 WHEN chunks >= 3 THEN 0.8 WHEN chunks >= 1 THEN 0.5 ELSE 0.0 END * 0.25 +
  CASE WHEN a = '' THEN 0.0 WHEN contains(a, 'no relevant information') THEN 0.2 WHEN contains(left(a, 50), 'error') THEN 0.1 ELSE 1.0 END * 0.35 +
  CASE WHEN length(a) > 500 THEN 1.0 WHEN length(a) > 200 THEN 0.8 WHEN length(a) > 50 THEN 0.5 WHEN length(a) > 0 THEN 0.3 ELSE 0.0 END * 0.25 +
  CASE WHEN n >= 3 THEN 1.0 WHEN n >= 2 THEN 0.7 WHEN n >= 1 THEN 0.4 ELSE 0.0 END * 0.15)::DOUBLE, 6) AS rating FROM r)
SELECT conv_id, turn, rating, CASE WHEN rating >= 0.9 THEN 'Excellent' WHEN rating >= 0.7 THEN 'Good' WHEN rating >= 0.5 THEN 'Acceptable' WHEN rating >= 0.3 THEN 'Poor' ELSE 'Fail' END AS label FROM s""")
def p15(spark, sf_dir):
    """Proxy rating of every answer."""
    t = _turns(spark, sf_dir).select("conv_id", "turn", "answer", (F.col("turn") % 7).alias("chunks_used"), (F.col("turn") % 4).alias("n_sources"), F.lit(None).cast("string").alias("error"))
    return evaluate.rate_answer(t).select("conv_id", "turn", "rating", "label")


@query("A12_domain_report", f"WITH {TURNS} SELECT conv_id % 5 AS domain, count(*) AS answers, round(avg(length(coalesce(answer, ''))), 6) AS avg_chars, list_sort(list(length(query)))[len(list(length(query))) // 2 + 1] AS upper_median FROM facts GROUP BY 1")
def a12(spark, sf_dir):
    """Averages and the upper median per domain."""
    t = _turns(spark, sf_dir).select((F.col("conv_id") % 5).alias("domain"), F.char_length("query").cast("long").alias("chars"), F.char_length(F.coalesce("answer", F.lit(""))).alias("answered"))
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY chars DESC)")  # kept as counts of distinct lengths
    return t.groupBy("domain").agg(F.count("*").alias("answers"), F.round(F.avg("answered"), 6).alias("avg_chars"), upper.cast("long").alias("upper_median"))


@query("P16_cost", f"WITH {TURNS} SELECT conv_id, turn, round(CASE WHEN conv_id % 2 = 0 THEN 0 ELSE ceil(length(query) / 4.0) / 1000 * 0.0015::DOUBLE + ceil(length(coalesce(answer, '')) / 4.0) / 1000 * 0.002::DOUBLE END, 9) AS cost_usd FROM facts")
def p16(spark, sf_dir):
    """Price of every answer (T11 logs it)."""
    from ..functions.text import tokens_estimate
    t = _turns(spark, sf_dir)
    price = search.cost(tokens_estimate(F.col("query")), tokens_estimate(F.coalesce("answer", F.lit(""))), F.when(F.col("conv_id") % 2 == 0, "offline").otherwise("online"))
    return t.select("conv_id", "turn", F.round(price, 9).alias("cost_usd"))


@query("T11_query_log", f"WITH {TURNS} SELECT conv_id, turn, 'online' AS mode, length(query) AS query_chars, round(ceil(length(query) / 4.0) / 1000 * 0.0015::DOUBLE, 4) AS cost_usd FROM facts")
def t11(spark, sf_dir):
    """Query log rows."""
    from ..functions.text import tokens_estimate
    return _turns(spark, sf_dir).select("conv_id", "turn", F.lit("online").alias("mode"), F.char_length("query").cast("long").alias("query_chars"), F.round(search.cost(tokens_estimate(F.col("query")), F.lit(0), F.lit("online")), 4).alias("cost_usd"))


@query("J12_expected_labels", "SELECT d.doc_id, quality, toxic, length(text) >= 1000 AS predicted FROM documents d LEFT JOIN labels l USING (doc_id)")
def j12(spark, sf_dir):
    """Documents with their expected outcome."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(labels, "doc_id", "left").select("doc_id", "quality", "toxic", (F.char_length("text") >= 1000).alias("predicted"))
