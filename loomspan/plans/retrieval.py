"""Registered queries over texts, chunks, keywords and vectors, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import chunking, keyword, vector
from ..session import shared_path, spread

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents"
BM25 = f"""
tokens AS ({WORDS}),
postings AS (SELECT term, doc_id AS id, count(*) AS tf FROM tokens GROUP BY ALL),
stats AS (SELECT doc_id AS id, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS dl FROM documents),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
totals AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM stats),
asked AS (SELECT query_id, term, count(*) AS m FROM (SELECT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 3)) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT query_id, id, round(sum(m * greatest(1e-6::DOUBLE, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
  FROM asked JOIN postings USING (term) JOIN terms USING (term) JOIN stats USING (id), totals GROUP BY ALL),
bm25 AS (SELECT query_id, rank, id, score, score / (score + 1) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 20)"""


_STORED: dict[tuple, str] = {}


def docs_index(spark: SparkSession, sf_dir: str) -> keyword.KeywordIndex:
    """The stored index of the documents; written once for each application and state of their files."""
    docs = table(spark, sf_dir, "documents")
    place = spark._jvm.org.apache.hadoop.fs.Path
    states = []
    for name in sorted(docs.inputFiles()):  # names, lengths and times of all files
        path = place(name)
        state = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        states.append((name, state.getLen(), state.getModificationTime()))
    key = (spark.sparkContext.applicationId, sf_dir, tuple(states))
    if key not in _STORED:
        target = shared_path(spark, "keywords")
        keyword.write_index(spread(docs).select(F.col("doc_id").alias("id"), "text"), target)
        _STORED[key] = target
    return keyword.load_index(spark, _STORED[key])


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("T2_bm25_topk", f"WITH {BM25} SELECT query_id, rank, id, round(score, 6) AS score, round(shown, 6) AS shown FROM bm25")
def t2(spark, sf_dir):
    """The 20 best documents for every benchmark text."""
    return keyword.bm25_topk(docs_index(spark, sf_dir), benchmark_queries(spark, sf_dir)).withColumns({"score": F.round("score", 6), "shown": F.round("shown", 6)})


@query("A17_keyword_stats", f"WITH t AS ({WORDS}), p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term")
def a17(spark, sf_dir):
    """Document and corpus frequency of every word."""
    return docs_index(spark, sf_dir).term_stats.select("term", "df", "cf")


UNIT = "SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings"


@query("T1_vector_topk", f"""WITH e AS ({UNIT}), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(q.v, c.v), 9) AS score FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= 8""")
def t1(spark, sf_dir):
    """The eight nearest vectors of every hundredth row, against all rows."""
    corpus = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = corpus.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    return vector.vector_topk(corpus, asked).withColumn("score", F.round("score", 6))


for _name in ("T1_vector_topk_kernel", "T1_vector_topk_all"):  # earlier names of the same search
    QUERIES[_name], ORACLE[_name] = t1, ORACLE["T1_vector_topk"]


@query("E5_l2_normalise", f"WITH e AS ({UNIT}) SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first FROM e")
def e5(spark, sf_dir):
    """Norm and first normalised component of every vector."""
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(vector.dot(v, v)), 6).alias("norm"), F.round(F.get(vector.l2_normalise(v), F.lit(0)), 6).alias("first"))


@query("E6_vector_quality", "SELECT count(*) AS vectors, count(*) FILTER (embedding IS NULL) AS nulls, count(*) FILTER (len(embedding) <> 64) AS wrong_size, count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x))) > 0) AS with_nan, count(*) FILTER (embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) = 0) AS zero_norm FROM embeddings")
def e6(spark, sf_dir):
    """Counts of unusable vectors."""
    return vector.vector_quality(table(spark, sf_dir, "embeddings"), 64)


@query("E4_quantize_f16")
def e4(spark, sf_dir):
    """Largest error of each vector after a round trip through 16 bits."""
    return vector.quantize_f16(table(spark, sf_dir, "embeddings")).select("vec_id", "f16_error")


@query("E1_embed")
def e1(spark, sf_dir):
    """Norm and length of every document's hashed embedding."""
    v = F.col("vector")
    return vector.embed(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.size(v).alias("dim"), F.round(F.sqrt(vector.dot(v, v)), 6).alias("norm"))


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select(F.concat_ws("/", "source", "doc_id").alias("source_path"), F.lit(0).cast("long").alias("mtime_ns"), "text")


@query("C1_blocks", r"""WITH RECURSIVE w AS (
  SELECT doc_id, text, 0::BIGINT AS s, 0::BIGINT AS e, -1 AS k FROM documents
  UNION ALL
  SELECT doc_id, text, e, CASE WHEN e + 5000 >= length(text) THEN length(text)
    WHEN 5000 - strpos(reverse(substring(text, e + 1, 5000)), chr(10)) > 1000 AND strpos(substring(text, e + 1, 5000), chr(10)) > 0 THEN e + 5000 - strpos(reverse(substring(text, e + 1, 5000)), chr(10)) + 1
    ELSE e + 5000 END, k + 1 FROM w WHERE e < length(text))
SELECT doc_id, k AS block, s AS start, e AS stop FROM w WHERE k >= 0""")
def c1(spark, sf_dir):
    """Blocks of 5000 characters, or to the last line end beyond 1000."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.blocks(F.col("text"), 5000, 1000)).alias("block", "b")).select("doc_id", "block", F.col("b.start").cast("long").alias("start"), F.col("b.end").cast("long").alias("stop"))


@query("C2_chunks", r"""WITH RECURSIVE w AS (
  SELECT doc_id, text, -1::BIGINT AS s, 0::BIGINT AS e, -1 AS k FROM documents
  UNION ALL
  SELECT doc_id, text, n, CASE WHEN n + 1200 >= length(text) THEN length(text)
    WHEN strpos(win, chr(10) || chr(10)) > 0 THEN n + 1200 - strpos(reverse(win), chr(10) || chr(10)) + 1
    WHEN strpos(win, '. ') > 0 THEN n + 1200 - strpos(reverse(win), ' .') + 1
    WHEN strpos(win, chr(10)) > 0 THEN n + 1200 - strpos(reverse(win), chr(10)) + 1
    ELSE n + 1200 END, k + 1
  FROM (SELECT *, greatest(e - CASE WHEN k < 0 THEN 0 ELSE 200 END, s + 1) AS n, substring(text, greatest(e - CASE WHEN k < 0 THEN 0 ELSE 200 END, s + 1) + 601, 600) AS win FROM w WHERE e < length(text)))
SELECT doc_id, s AS start, e AS stop FROM w WHERE k >= 0 AND trim(substring(text, s + 1, e - s)) <> ''""")
def c2(spark, sf_dir):
    """Offsets of overlapping chunks of every document."""
    s = F.filter(chunking.spans(F.col("text")), lambda x: fn.strip(F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"])) != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(s).alias("s")).select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("stop"))


_WHITE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


@query("C4_chunk_rows", rf"""WITH RECURSIVE b AS (
  SELECT doc_id, source || '/' || doc_id AS source_path, text, 0::BIGINT AS s, 0::BIGINT AS e, -1 AS block FROM documents
  UNION ALL
  SELECT doc_id, source_path, text, e, CASE WHEN e + 200000 >= length(text) THEN length(text) WHEN line_at > 10000 THEN e + line_at + 1 ELSE e + 200000 END, block + 1
  FROM (SELECT *, CASE WHEN contains(win, chr(10)) THEN length(win) - strpos(reverse(win), chr(10)) ELSE -1 END AS line_at FROM (SELECT *, substring(text, e + 1, 200000) AS win FROM b WHERE e < length(text)))),
parts AS (SELECT doc_id, source_path, block, s AS offset_, substring(text, s + 1, e - s) AS part FROM b WHERE block >= 0),
w AS (
  SELECT doc_id, source_path, block, offset_, part, -1::BIGINT AS s, 0::BIGINT AS e, -1 AS k FROM parts
  UNION ALL
  SELECT doc_id, source_path, block, offset_, part, n, CASE WHEN n + 1200 >= length(part) THEN length(part)
    WHEN contains(win, chr(10) || chr(10)) THEN n + 1200 - strpos(reverse(win), chr(10) || chr(10)) + 1
    WHEN contains(win, '. ') THEN n + 1200 - strpos(reverse(win), ' .') + 1
    WHEN contains(win, chr(10)) THEN n + 1200 - strpos(reverse(win), chr(10)) + 1 ELSE n + 1200 END, k + 1
  FROM (SELECT *, substring(part, n + 601, 600) AS win FROM (SELECT *, greatest(e - CASE WHEN k < 0 THEN 0 ELSE 200 END, s + 1) AS n FROM w WHERE e < length(part)))),
c AS (SELECT *, trim(substring(part, s + 1, e - s), {_WHITE}) AS body,
  list_filter(list_transform(string_split(substring(part, greatest(0, s - 2000) + 1, least(s, 2000)), chr(10)), lambda x: trim(x, {_WHITE})), lambda x: x <> '') AS lines FROM w WHERE k >= 0),
l AS (SELECT *, coalesce(lines[-1], '') AS line, row_number() OVER (PARTITION BY doc_id, block ORDER BY s) - 1 AS chunk_index FROM c WHERE body <> ''),
h AS (SELECT *, CASE WHEN length(line) <= 160 AND ((regexp_matches(line, '\p{{Lu}}') AND NOT regexp_matches(line, '[\p{{Ll}}\p{{Lt}}]') AND length(line) > 3) OR regexp_matches(line, '^\d+(\.\d+)*\s+') OR (ends_with(line, ':') AND length(line) < 80)) THEN line ELSE '' END AS heading FROM l),
t AS (SELECT *, CASE WHEN heading <> '' AND NOT starts_with(body, heading) THEN '[SECTION] ' || heading || chr(10) || body ELSE body END AS chunk FROM h)
SELECT source_path, block, chunk_index::INT AS chunk_index, (offset_ + s)::INT AS start, (offset_ + e)::INT AS "end", (offset_ + chunk_index * 1000)::INT AS approx_start, heading, length(chunk)::INT AS text_length,
  sha256(concat_ws('|', lower(source_path), '0', (offset_ + s)::VARCHAR, (offset_ + e)::VARCHAR, sha256(left(chunk, 2000)))) AS chunk_id FROM t""")
def c4(spark, sf_dir):
    """Chunk rows with headings, offsets and ids."""
    return chunking.chunks(_docs(spark, sf_dir)).select("source_path", "block", "chunk_index", "start", "end", "approx_start", "heading", "text_length", "chunk_id")


@query("C5_document_ids", "SELECT doc_id, sha256(concat_ws('|', lower(source || '/' || doc_id), '0', '0', length(text)::VARCHAR, sha256(left(text, 2000)))) AS chunk_id FROM documents")
def c5(spark, sf_dir):
    """Deterministic id of each document taken as one chunk."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", chunking.chunk_id(F.concat_ws("/", "source", "doc_id"), F.lit(0), F.lit(0), F.char_length("text"), F.col("text")).alias("chunk_id"))


@query("C6_fingerprint", "SELECT doc_id, concat(strlen(text), ':0') AS fingerprint, sha256(text) AS content_hash FROM documents")
def c6(spark, sf_dir):
    """Size and time fingerprint and content hash."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.octet_length("text"), F.lit(":0")).alias("fingerprint"), F.sha2("text", 256).alias("content_hash"))


@query("P4_readable", "SELECT doc_id, length(text) >= 20 AND length(regexp_replace(left(text, 2000), '[^\\p{L}\\p{N} \\t\\n\\r.,;:!?()\\-/''\"@#$%&*+=\\[\\]{}|<>~]', '', 'g')) / length(left(text, 2000)) >= 0.3 AS readable FROM documents")
def p4(spark, sf_dir):
    """Whether each text is readable."""
    return table(spark, sf_dir, "documents").select("doc_id", fn.is_readable(F.col("text")).alias("readable"))


_READABLE = "length(regexp_replace(w, '[^\\p{L}\\p{N} \\t\\n\\r.,;:!?()\\-/''\"@#$%&*+=\\[\\]{}|<>~]', '', 'g')) / length(w)"


@query("P3_deep_check", f"""WITH w AS (SELECT doc_id, text IS NULL OR length(trim(text)) < 20 AS short, len(list_filter(list_filter(list_transform([0, 0.25, 0.5, 0.75], lambda p: substring(text, floor(length(text) * p)::BIGINT + 1, 2000)), lambda w: length(w) >= 50), lambda w: {_READABLE} < 0.3)) AS bad FROM documents)
SELECT doc_id, CASE WHEN short OR bad > 0 THEN 'WARNING' ELSE 'OK' END AS severity, CASE WHEN short THEN 0 ELSE bad END::INT AS windows FROM w""")
def p3(spark, sf_dir):
    """Unreadable windows of each text."""
    return table(spark, sf_dir, "documents").select("doc_id", fn.deep_check(F.col("text")).alias("c")).select("doc_id", "c.*")


@query("P5_clamp", "SELECT doc_id, length(left(text, 1000)) AS kept, length(text) > 1000 AS clamped FROM documents")
def p5(spark, sf_dir):
    """Texts cut at 1000 characters, as the feature asks."""
    return table(spark, sf_dir, "documents").select("doc_id", fn.clamp(F.col("text"), 1000).alias("c")).select("doc_id", F.char_length("c.text").cast("long").alias("kept"), "c.clamped")


@query("F1_query_terms", "SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 3), ' ') AS terms FROM benchmark")
def f1(spark, sf_dir):
    """Search terms of every benchmark text."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(fn.query_terms(F.col("text")), " ").alias("terms"))


@query("A19_token_estimate", "SELECT source, sum(ceil(length(text) / 4.0))::BIGINT AS tokens FROM documents GROUP BY source")
def a19(spark, sf_dir):
    """Estimated tokens per source."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(fn.tokens_estimate(F.col("text"))).alias("tokens"))


@query("S4_strip_tags", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', '', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</p>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ') AS text FROM pages""")
def s4(spark, sf_dir):
    """Pages without tags, natively."""
    return table(spark, sf_dir, "pages").select("page_id", fn.strip_tags(F.col("html")).alias("text"))
