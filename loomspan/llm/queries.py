"""One query for each operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chat, embedding, minhash, mixing, runs, simhash, subword, tokencount, tokenfile, toxicity, urlfilter, whitening, wrapper
from .common import Stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their near-duplicate component, by sets of four-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), config=minhash.MinHash(width=4))


def op1_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of one label at cosine 0.93 or more: links and components."""
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text with the last half replaced from the next document.

    ``n_near`` is asked for ids divisible by 100: documents whose fingerprint lies within the radius.
    """
    stage = Stage(spark, "simhash")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.char_length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.substring("next_text", F.lit(1), F.floor(n / 2).cast("int")))
    texts = simhash.with_next(docs, stage).withColumns({"n_chars": n.cast("long"), "edited": edited}).withColumn("edited_sha256", F.sha2("edited", 256))
    prints = stage.put(simhash.fingerprints(texts.drop("text", "next_text"), ["edited"]), "prints")
    own = prints.select("id", F.col("text_hi").alias("hi"), F.col("text_lo").alias("lo"))
    near = simhash.within_radius(own.where("id % 100 = 0"), own).groupBy(F.col("query").alias("id")).agg(F.count("*").alias("near"))
    words = ("text_hi", "text_lo")
    return prints.join(near.hint("merge"), "id", "left").select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256",
        simhash.shown(*words).alias("fingerprint"), simhash.shown("edited_hi", "edited_lo").alias("edited_fingerprint"),
        simhash.likeness(*words, "edited_hi", "edited_lo").alias("near_edited"), simhash.likeness(*words, "next_text_hi", "next_text_lo").alias("near_next"),
        F.when(F.col("id") % 100 == 0, F.coalesce("near", F.lit(0))).alias("n_near"))


def op3_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by its host's wrapper."""
    return wrapper.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150% of all words takes from each document, sources weighted 5, 2, 1 in turn."""
    return mixing.plan(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a reply tree without branches, formatted, and what is read back from the written result."""
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    stage = Stage(spark, "conversations")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    node = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.col("place"))
    before = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.col("place") - 1)
    messages = told.union(probe).withColumn("place", place).select(node.alias("node"), before.alias("parent"), "role", "text", F.char_length("text").alias("score"))
    messages = stage.put(messages, "messages")
    back = stage.put(chat.conversations(messages), "formatted")
    turns = F.transform(chat.parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    back = back.withColumn("turns", turns).withColumn("learnt", chat.learnt(F.col("formatted"), F.col("loss_spans")))
    return back.select(
        F.split_part("root", F.lit(":"), F.lit(1)).try_cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"), F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token ids, written to files of frequency-ranked ids and read back."""
    docs = table(spark, sf_dir, "documents")
    back = tokenfile.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return back.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: Stand-in dates, as the tables have none: a page is fetched on a day of 2024 that its id gives.
_FETCHED = "CAST(page_id % 360 AS INT)"


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against a dated list derived from all pages' hosts and paths, as of its fetch day.

    Days count from 2024-01-01. The lists hold domains of hosts, first path
    segments and whole paths of pages, added and removed on days taken from page ids.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_FETCHED).alias("fetched"))
    url = F.col("url")
    host, path = urlfilter.url_host(url), urlfilter.url_path(url)
    day = F.col("page_id") % 300
    whole = F.array_join(F.filter(F.split(path, "/"), lambda s: s != ""), "/")
    listed = pages.where(host != "").select("page_id", host.alias("host"), F.regexp_extract(path, "^(/[^/]+)", 1).alias("step"), whole.alias("whole"), day.cast("int").alias("day"))
    hosts = listed.groupBy("host").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    fixed = lambda name, pattern, action, at: (F.lit(name).alias("list"), pattern.alias("pattern"), F.lit(action).alias("action"), at.cast("int").alias("at"))
    entries = hosts.where("first % 2 = 0").select(*fixed("block", F.concat(F.lit("."), "host"), "add", F.col("first") % 100))
    entries = entries.union(hosts.where("first % 4 = 0").select(*fixed("block", F.concat(F.lit("."), "host"), "remove", F.col("first") % 100 + 120)))
    entries = entries.union(listed.where("page_id % 5 = 0 AND step <> ''").select(*fixed("allow", F.concat("host", "step"), "add", F.col("day"))))
    entries = entries.union(listed.where("page_id % 15 = 0 AND step <> ''").select(*fixed("allow", F.concat("host", "step"), "remove", F.col("day") + 40)))
    entries = entries.union(listed.where("page_id % 7 = 0 AND whole <> ''").select(*fixed("block", F.concat("host", F.lit("/"), "whole"), "add", F.col("day"))))
    return urlfilter.decide(pages, entries)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded and decoded with the 32k piece model, as counts and digests."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = subword.encode(docs, model, decoded_column="decoded")
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled rows that aren't held out."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("n_tokens")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, of which one in ten gets a loop by its id; a null id gets none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    placed = words.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    turns = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    loop = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), turns)), F.lit(1), F.col("n") - F.col("a"))
    edited = F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), loop), " ")).otherwise(F.col("text"))
    found = runs.periodic_runs(placed.select("doc_id", edited.alias("text")))
    longer = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), longer)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    shown = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period"))
    return shown.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings whitened onto their first 32 principal components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the 50k byte-level model, and whether they are more than 1024."""
    return tokencount.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_subspace_join": op1_subspace_join,
    "op2_simhash": op2_simhash,
    "op3_html_wrapper": op3_html_wrapper,
    "op4_mixing": op4_mixing,
    "op5_chat": op5_chat,
    "op6_token_file": op6_token_file,
    "op7_url_filters": op7_url_filters,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_whitening": op12_whitening,
    "op13_token_counts": op13_token_counts,
}

def _chat_sql() -> str:
    """Turns and their lengths; a control string in a text grows by the mark's two characters."""
    quoted = ["'" + c.replace("'", "''") + "'" for c in chat.CONTROLS]
    grown = " + ".join(f"2 * ((length(t) - length(replace(t, {c}, ''))) // length({c}))" for c in quoted)
    return f"""
WITH told AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, length(r) + length(t) + {grown} + {len(chat.START) + len(chat.END) + 2} AS n FROM told)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


ORACLE_SQL: dict[str, str] = {
    "op1_subspace_join": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(coalesce(component, vec_id) = vec_id, true) AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id
""",
    "op5_chat": _chat_sql(),
    "op9_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 2, 2)), lambda k: array_to_string(words[k : k + 3], ' '))) AS shingle FROM w WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(coalesce(component, d.doc_id) = d.doc_id, true) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
""",
    "op7_url_filters": r"""
WITH parts AS (
  SELECT page_id, CAST(page_id % 360 AS INT) AS fetched,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 1)) AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 2) AS path
  FROM pages),
steps AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS seg, string_split(host, '.') AS labels FROM parts),
listed AS (SELECT page_id, host, regexp_extract(path, '^(/[^/]+)', 1) AS step, array_to_string(seg, '/') AS whole, CAST(page_id % 300 AS INT) AS day FROM steps WHERE host <> ''),
hosts AS (SELECT host, min(page_id) AS first FROM listed GROUP BY host),
entries AS (
  SELECT 'block' AS list, '.' || host AS pattern, 'add' AS action, CAST(first % 100 AS INT) AS d FROM hosts WHERE first % 2 = 0
  UNION SELECT 'block', '.' || host, 'remove', CAST(first % 100 + 120 AS INT) FROM hosts WHERE first % 4 = 0
  UNION SELECT 'allow', host || step, 'add', day FROM listed WHERE page_id % 5 = 0 AND step <> ''
  UNION SELECT 'allow', host || step, 'remove', day + 40 FROM listed WHERE page_id % 15 = 0 AND step <> ''
  UNION SELECT 'block', host || '/' || whole, 'add', day FROM listed WHERE page_id % 7 = 0 AND whole <> ''),
spans AS (SELECT *, lead(d) OVER (PARTITION BY list, pattern ORDER BY d, action) AS valid_to FROM entries),
active AS (SELECT list, pattern, d AS valid_from, valid_to FROM spans WHERE action = 'add' AND (valid_to IS NULL OR d < valid_to)),
tried AS (
  SELECT page_id, fetched, unnest(list_distinct(list_concat(
    list_transform(range(1, len(seg) + 1), lambda k: host || '/' || array_to_string(seg[1:k], '/')), [host],
    list_transform(range(1, len(labels) + 1), lambda k: '.' || array_to_string(labels[k:], '.'))))) AS pattern
  FROM steps WHERE host <> ''),
hits AS (
  SELECT page_id, list, t.pattern, valid_from,
    row_number() OVER (PARTITION BY page_id ORDER BY starts_with(t.pattern, '.'), length(t.pattern) DESC, list, valid_from, t.pattern) AS nth
  FROM tried t JOIN active a ON t.pattern = a.pattern AND a.valid_from <= fetched AND (a.valid_to IS NULL OR fetched < a.valid_to))
SELECT p.page_id, coalesce(h.list, 'none') AS decision, h.pattern, h.valid_from AS listed_from
FROM pages p LEFT JOIN hits h ON h.page_id = p.page_id AND h.nth = 1
""",
}
