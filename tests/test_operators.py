"""Edge cases of the library's operators."""

import hashlib
import io
import mailbox
import math
import random
import re
import time
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.functions import text as fn
from loomspan.operators import chunking, evaluate, events, ingest, keyword, manifest, search, vector
from loomspan.sources import files


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {t}" for n, t in zip(names, ["string"] * len(names), strict=True))).select(column.alias("x")).first().x


def split(text, size=40, overlap=10):
    """Chunk offsets by a plain loop."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            half = start + size // 2
            for what in ("\n\n", ". ", "\n"):
                at = text.rfind(what, half, end)
                if at != -1:
                    end = at + len(what)
                    break
        out.append((start, end))
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab. \né", max_size=300), min_size=1, max_size=8))
def test_spans_equal_a_plain_loop(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: [(s.start, s.end) for s in r.s] for r in df.select("k", chunking.spans(F.col("t"), 40, 10).alias("s")).collect()}
    assert got == {k: split(t) for k, t in enumerate(texts)}


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="ab\n", max_size=400))
def test_blocks_partition_the_text(spark, text):
    got = one(spark, chunking.blocks(F.col("t"), 50, 10), t=text)
    assert "".join(text[b.start : b.end] for b in got) == text


def test_heading_rules(spark):
    cases = [("SAFETY RULES\n", "SAFETY RULES"), ("2.1 Setup\n\n", "2.1 Setup"), ("Steps:\n", "Steps:"), ("plain line\n", ""), ("TITLE\nplain\n", ""), ("ABC\n", ""), ("X" * 161 + "\n", ""), ("", "")]
    for before, want in cases:
        assert one(spark, chunking.heading(F.col("t"), F.lit(len(before))), t=before + "body") == want


def test_chunk_rows(spark):
    docs = spark.createDataFrame([("A\\b.txt ", 5, "INTRODUCTION\n" + "word. " * 400), ("e", 0, ""), ("n", 0, None), ("s", 0, "   \n ")], "source_path string, mtime_ns long, text string")
    got = chunking.chunks(docs).orderBy("chunk_index").collect()
    assert {r.source_path for r in got} == {"A\\b.txt "} and len({r.chunk_id for r in got}) == len(got) > 1
    assert all(r.text_length <= 1200 + 200 for r in got)


def test_a_long_text_is_cut_in_little_time(spark):
    text = "A sentence of some words that goes on and on. " * 22_000
    docs = spark.createDataFrame([("long", 0, text)], "source_path string, mtime_ns long, text string")
    began = time.time()
    got = chunking.chunks(docs).agg(F.count("*").alias("n"), F.max("end").alias("end")).first()
    assert got.n > 500 and got.end == len(text) and time.time() - began < 10


def test_readable(spark):
    for text, want in (("A plain sentence that is long enough.", True), ("\x00\x89PNG\r\n\x1a\x00" * 100, False), ("Hi", False), ("", False), (None, False)):
        assert one(spark, fn.is_readable(F.col("t")), t=text) is want


def test_fault_rules_first_match(spark):
    cases = [("E", "PII found with 401", "SECURITY_ERROR", 1), ("ConnectionError", "x", "NETWORK_ERROR", 2), ("Timeout", "", "NETWORK_ERROR", 3), ("E", "404 deployment", "API_ERROR", 2), ("E", "404", "INTERNAL_ERROR", 2), ("UnicodeDecodeError", "", "PARSE_ERROR", 4), ("E", "disk is full", "RESOURCE_ERROR", 1), ("E", "config not found", "CONFIG_ERROR", 2), ("E", "retrieval was empty", "RETRIEVAL_ERROR", 3), (None, None, "INTERNAL_ERROR", 2)]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, m string").select(events.classify_fault(F.col("t"), F.col("m")).alias("f"))
    assert [tuple(r.f) for r in df.collect()] == [c[2:] for c in cases]


def test_preflight(spark):
    good = io.BytesIO()
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("a", "x" * 5000)
    rows = [("a/~$x.docx", b"x"), ("a/e.txt", b""), ("a/bad.docx", b"no zip" * 500), ("a/cut.docx", good.getvalue()[:-30]), ("a/p.pdf", b"nothing" * 50), ("a/t.pdf", b"%PDF" + b"x" * 300), ("a/ok.pdf", b"%PDF" + b"x" * 300 + b"%%EOF"), ("a/z.txt", b"\0" * 300 + b"x" * 900), ("a/z2.txt", b"\0" * 220 + b"x" * 900), ("a/s.eml", b"short")]
    df = spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in rows], "path string, length long, content binary")
    got = {r.path.split("/")[1]: r.reason for r in ingest.preflight(df).collect()}
    assert got["~$x.docx"] == "temporary lock file" and got["e.txt"] == "empty file" and got["bad.docx"] == got["cut.docx"] == "not an archive"
    assert got["p.pdf"] == "no PDF header" and got["t.pdf"] == "truncated PDF" and got["ok.pdf"] is None
    assert got["z.txt"] == "too many zero bytes" and got["z2.txt"] is None and got["s.eml"] == "too small for its type"


def test_delta_pairs_renames_once(spark):
    prev = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "3")], "source_path string, content_hash string")
    cur = spark.createDataFrame([("x", "1"), ("c", "9"), ("d", "3"), ("e", "5")], "source_path string, content_hash string")
    got = {r.source_path: (r.change, r.renamed_from) for r in manifest.delta(prev, cur).collect()}
    assert got == {"x": ("renamed", "a"), "b": ("deleted", None), "c": ("modified", None), "d": ("unchanged", None), "e": ("new", None)}


def test_scores(spark):
    df = spark.createDataFrame([("unanswerable", "That is NOT FOUND here"), ("ambiguous", "Which one"), ("injection", "TLS 1.3 is used"), ("injection", "TLS 1.3 and AES-512"), ("answerable", None)], "k string, a string")
    assert [r.x for r in df.select(evaluate.behavior_score(F.col("k"), F.col("a")).alias("x")).collect()] == [1.0, 1.0, 1.0, 0.0, 1.0]
    assert one(spark, search.cost(F.lit(150), F.lit(25), F.col("m")), m="online") == 0.000275
    assert one(spark, evaluate.fact_score(F.col("a"), F.array().cast("array<string>")), a="x") == 1.0


def test_topk_excludes_itself_and_breaks_ties(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, vector array<double>")
    asked = corpus.where("id = 1").withColumnRenamed("id", "query_id")
    want = [(1, 1, 2, 1.0), (1, 2, 3, 0.0)]
    for f in (vector.vector_topk, vector.vector_topk_kernel):
        assert [tuple(r) for r in f(corpus, asked, 2).orderBy("rank").collect()] == want


def test_replaced_sources_on_disk(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1), ("b", 1)], "source_path string, v int")
    ingest.write_replaced(spark, path, first, 4)
    ingest.write_replaced(spark, path, spark.createDataFrame([("a", 2), ("c", 2)], "source_path string, v int"), 4)
    assert sorted((r.source_path, r.v) for r in spark.read.parquet(path).collect()) == [("a", 2), ("b", 1), ("c", 2)]


def test_mail_and_archives(spark, tmp_path):
    plain = b"Subject: one\nFrom: a@example.org\nContent-Type: text/plain\n\nhello\n"
    html = b"Subject: two\nContent-Type: text/html\n\n<style>x</style><p>shown</p>\n"
    box = mailbox.mbox(str(tmp_path / "m.mbox"))
    box.add(plain), box.add(html), box.flush()
    df = spark.createDataFrame([("m", bytearray((tmp_path / "m.mbox").read_bytes()))], "path string, content binary")
    got = files.explode_mbox(df).orderBy("message").collect()
    assert [r.subject for r in got] == ["one", "two"] and got[0].body.strip() == "hello" and got[1].body.strip() == "shown"


def test_mail_archives_cut_bodies_after_their_last_newlines(spark, tmp_path):
    import duckdb
    from loomspan.plans import all_queries, all_sql
    texts = ["x" * 4999 + "\n" + "y", "x" * 4998 + "\n\n\nz", "x" * 4999 + "\n\n", "x" * 5001, ""]
    spark.createDataFrame([(k, "s", t) for k, t in enumerate(texts)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = all_queries()["S6_mail_archives"](spark, str(tmp_path)).select("path", "message", "subject", "body_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(all_sql()["S6_mail_archives"]).fetchall())


def test_mails_reach_workers_in_batches_of_bounded_bytes(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    head = "From a\nSubject: s\n\n"
    (tmp_path / "a.mbox").write_text("".join(f"{head}{'x' * 400_000}\n\n" for _ in range(40)))
    mails = spark.range(0, 40, 1, 1).select(F.col("id").cast("string").alias("path"), F.concat(F.lit("Subject: s\n\n"), F.repeat(F.lit("x"), 400_000)).cast("binary").alias("content"))
    try:
        for read in (lambda: files.parse_mail(mails), lambda: files.read_mailboxes(spark, f"file://{tmp_path}", most=None, body=None)):
            spark.conf.set(key, "256m")
            found = read()
            assert int(spark.conf.get(key)) <= 4 << 20
            assert found.where("length(body) >= 400000").count() == 40
    finally:
        spark.conf.set(key, before)


def test_mailboxes_by_byte_ranges(spark, tmp_path):
    """Any cut of an archive gives the messages, numbers and bytes that the standard reader gives."""
    r, want = random.Random(3), {}
    lines = [b"From b@example.org today\n", b"\n", b"\r\n", b">From c\n", b" From d\n", b"Subject: s\n", b"caf\xc3\xa9 \xff\n", b"a line of text\n", b"x" * 700 + b"\n", b"From\n"]
    for k in range(12):
        data = b"".join(r.choice(lines) for _ in range(r.randrange(400)))
        data = [data, b"From a@example.org\n" + data, data.rstrip(b"\n"), b""][k % 4 if k < 11 else 3]
        (tmp_path / f"{k}.mbox").write_bytes(data)
        box = mailbox.mbox(str(tmp_path / f"{k}.mbox"))
        want |= {(f"{k}.mbox", n): hashlib.sha1(box.get_bytes(key)).hexdigest() for n, key in enumerate(box.keys())}
    (tmp_path / "other.txt").write_bytes(b"From a\n\nno archive\n")
    loaded = spark.createDataFrame([(f.name, bytearray(f.read_bytes())) for f in tmp_path.glob("*.mbox")], "path string, content binary")
    assert {(x.path, x.message): x.sha1 for x in files.explode_mbox(loaded, most=None).collect()} == want
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1000", "333", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = files.read_mailboxes(spark, f"file://{tmp_path}", most=None).select("path", "message", "sha1").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert len(got) == len(want) and {(x.path.rsplit("/", 1)[1], x.message): x.sha1 for x in got} == want, size
    assert files.read_mailboxes(spark, f"file://{tmp_path}", most=2).count() == sum(n < 2 for _, n in want)


def test_html_text_skips_and_decodes(spark):
    page = "<head><title>T &amp; U</title></head><body><script>no</script><embed><p>a&lt;b</p><svg>no</svg>c"
    got = files.extract_html(spark.createDataFrame([(page,), (None,)], "html string")).collect()
    assert (got[0].text, got[1].text) == ("a<b\nc", "")


def test_corpus_scan_and_extractors(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    for name, data in ((".git/HEAD", b"x"), ("a.txt", b"good \xff text"), ("b.HTML", b"<p>hi</p>"), ("c.png", b"x"), ("d.xyz", b"x")):
        (tmp_path / name).write_bytes(data)
    found = files.scan_corpus(spark, str(tmp_path), [".txt", ".html", ".xyz"], [".git"], content=True)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.extract(found).collect()}
    assert set(got) == {"a.txt", "b.HTML", "d.xyz"} and got["b.HTML"].text == "hi" and got["a.txt"].text == "good � text" and got["d.xyz"].error == "no extractor"


def test_all_faults_are_classified_and_traced(spark, tmp_path):
    from loomspan.plans import all_queries

    props = ["401 Unauthorized", "code 429", "HTTP 503", "odd"]
    rows = [(k, 1_700_000_040 + 60 * k, 1, "error" if k % 2 else "view", 1.0, props[k // 2 % 4]) for k in range(16)]
    made = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
    made.select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.error_class for r in all_queries()["ST7_faults_all"](spark, str(tmp_path)).collect()}
    assert got == {k: ("AUTH_ERROR", "API_ERROR", "API_ERROR", "INTERNAL_ERROR")[k // 2 % 4] for k in range(1, 16, 2)}
    near = {(f, e) for f in range(1, 16, 2) for e in (f - 1, f, f + 1) if e < 16}
    for name in ("J8_traces_all", "ST9_traces_all"):
        assert {(r.fault_id, r.event_id) for r in all_queries()[name](spark, str(tmp_path)).collect()} == near


def test_vector_blocks_equal_one_block(spark):
    corpus = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0]) for k in range(40)], "id long, vector array<double>")
    asked = corpus.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    assert sorted(vector.vector_topk(corpus, asked, 4, 5).collect()) == sorted(vector.vector_topk_kernel(corpus, asked, 4).collect())


def test_vector_ties_nulls_and_no_queries(spark):
    rows = [(k, [1.0, 1.0]) for k in range(20)] + [(20, None), (21, [float("nan"), 1.0]), (22, [0.0, 1.0])]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>").coalesce(1)
    asked = corpus.where("id IN (3, 20, 22)").withColumnRenamed("id", "query_id")
    got = sorted((r.query_id, r["rank"], r.id) for r in vector.vector_topk(corpus, asked, 3).collect())
    assert got == [(3, 1, 0), (3, 2, 1), (3, 3, 2), (22, 1, 0), (22, 2, 1), (22, 3, 2)]
    assert vector.vector_topk(corpus, asked.limit(0), 3).isEmpty()


def test_safe_names_never_clash(spark):
    rows = [("a", "f.txt"), ("b", "f.txt"), ("c", "f_1.txt"), ("d", "f.txt"), ("e", "f_3.txt"), ("g", "f_1.txt"), ("h", None), ("i", "plain"), ("j", "plain")]
    got = {r.source_path: r.name for r in manifest.safe_names(spark.createDataFrame(rows, "source_path string, target string")).collect()}
    assert got == {"a": "f.txt", "b": "f_2.txt", "c": "f_1.txt", "d": "f_4.txt", "e": "f_3.txt", "g": "f_1_1.txt", "h": None, "i": "plain", "j": "plain_1"}


def test_elements_of_html_text(spark):
    page = "<nav>Menu</nav><main><table><tr><td>a</td><td>b</td></tr></table><math><mi>x</mi></math><aside>note</aside></main>"
    got = files.extract_html(spark.createDataFrame([(1, page)], "page_id int, html string")).first()
    assert got.text == "Menu\na\nb\nnote"


def test_stored_index_follows_its_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green apple tree"), (3, None), (4, "")], "id long, text string")
    keyword.write_index(docs, f"{tmp_path}/1")
    new = spark.createDataFrame([(2, "blue sky"), (5, "apple pie")], "id long, text string")
    index = keyword.update_index(spark, f"{tmp_path}/1", f"{tmp_path}/2", new, spark.createDataFrame([(1,)], "id long"))
    want = keyword.build_index(new.union(docs.where("id > 2")))
    for part in ("postings", "doc_stats", "term_stats"):
        columns = getattr(want, part).columns
        assert sorted(getattr(index, part).select(columns).collect()) == sorted(getattr(want, part).collect())
    asked = spark.createDataFrame([(1, "the apple"), (2, "of")], "query_id long, query string")
    assert [r.id for r in keyword.bm25_topk(index, asked).collect()] == [5]


def test_one_failing_file_is_an_error_row(spark):
    def read(data):
        return data.decode("ascii"), {"size": len(data)}

    df = spark.createDataFrame([("a.x", b"good"), ("b.x", "é".encode()), ("c.y", b"")], "path string, content binary")
    got = {r.path: (r.text, r.error and r.error.split(":")[0]) for r in files.extract(df, files.with_extractors({".X": files.each_file(read)})).collect()}
    assert got == {"a.x": ("good", None), "b.x": (None, "UnicodeDecodeError"), "c.y": (None, "no extractor")}


def bm25_by_hand(docs, query, k):
    """The formula, document by document."""
    told = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in docs}
    mean = sum(map(len, told.values())) / len(told)
    scores = {}
    for term in [w for w in re.findall("[a-z0-9]+", query.lower()) if len(w) >= 3]:
        df = sum(term in w for w in told.values())
        for i, w in told.items():
            if term in w:
                tf = w.count(term)
                idf = max(1e-6, math.log((len(told) - df + 0.5) / (df + 0.5)))
                scores[i] = scores.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return [(i, round(s, 6)) for i, s in sorted(((i, round(s, 9)) for i, s in scores.items()), key=lambda x: (-x[1], x[0]))[:k]]


def test_pruned_search_finds_the_same(spark, tmp_path):
    """Queries with rare and common words read few postings, and give the rows that the formula gives."""
    r = random.Random(8)
    docs = [(i, " ".join(r.choice(("common", "usual", "often")) if r.random() < 0.7 else f"word{int(r.paretovariate(0.4)) % 900}" for _ in range(r.randint(0, 60)))) for i in range(1500)]
    docs += [(5000 + i, "needle " * (1 + i % 3) + "common usual " * (i % 5) + "filler " * r.randint(0, 30)) for i in range(20)]
    queries = [(1, "the needle is common and usual"), (2, "common usual often"), (3, "needle"), (4, "word7 word11 common common often"), (5, "no such of it"), (6, "an"), (7, "needle filler word3 usual")]
    index = keyword.write_index(spark.createDataFrame(docs, "id long, text string").repartition(3), f"{tmp_path}/index", docs_a_range=16)
    asked, report = spark.createDataFrame(queries, "query_id long, query string"), []
    got = {}
    for row in keyword.bm25_topk(index, asked, k=5, prune_from=0, report=report).collect():
        got.setdefault(row.query_id, []).append((row.rank, row.id, round(row.score, 6)))
    want = {q: [(n, *x) for n, x in enumerate(bm25_by_hand(docs, text, 5), 1)] for q, text in queries}
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}
    cost = report[0].first()
    assert 0 < cost.read < cost.postings / 2
    assert sorted(index.totals.first()) == sorted([len(docs), sum(len(t.split()) for _, t in docs), 95])


def test_index_of_no_documents(spark, tmp_path):
    none = spark.createDataFrame([], "id long, text string")
    index = keyword.write_index(none, f"{tmp_path}/none")
    asked = spark.createDataFrame([(1, "any word")], "query_id long, query string")
    assert keyword.bm25_topk(index, asked).count() == 0 and index.doc_stats.count() == 0


def test_vectors_of_other_lengths_types_and_repeats(spark):
    nan = float("nan")
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [nan, 1.0]), (5, None), (6, []), (7, [None, 1.0]), (None, [1.0, 0.0]), (8, [0.0, 0.0]), (9, [0.9, 0.1])], "id long, vector array<double>")
    rows = [("1", [2.0, 0.0]), ("x", [0.0, 0.0, 3.0]), ("y", [1.0, 1.0, 1.0, 1.0]), (None, [1.0, 0.0]), ("z", None)]
    got = sorted((r.query_id, r.rank, r.id, round(r.score, 3)) for r in vector.vector_topk(corpus, spark.createDataFrame(rows, "query_id string, vector array<float>"), k=3).collect())
    assert got == [("1", 1, 2, 0.994), ("1", 2, 9, 0.994), ("1", 3, 8, 0.0), ("x", 1, 3, 0.0)]
    with pytest.raises(ValueError, match="twice"):
        vector.vector_topk(corpus, spark.createDataFrame([(1, [1.0, 0.0])] * 2, "query_id long, vector array<double>"))


def test_vector_search_in_rounds(spark, monkeypatch):
    """Many small packs and rounds give the rows of one product."""
    r = random.Random(5)
    corpus = spark.createDataFrame([(i, [r.randint(-3, 3) + 0.5 for _ in range(6)]) for i in range(400)], "id long, vector array<double>").repartition(3)
    asked = corpus.where("id % 7 = 0").withColumnRenamed("id", "query_id")
    want = sorted(map(tuple, vector.vector_topk(corpus, asked, 4).collect()))
    monkeypatch.setattr(vector, "SENT_BYTES", 2000)
    assert sorted(map(tuple, vector.vector_topk(corpus, asked, 4, block=5).collect())) == want
    assert len(want) == 58 * 4


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_deals_one_bucket_and_group_to_a_task_and_counts_words_before(spark):
    docs = spark.createDataFrame([(k, "the the " * 50 + " ".join(f"w{k * n}" for n in range(9))) for k in range(60)] + [(60, ""), (61, None), (62, "...")], "id long, text string")
    postings = keyword._postings(docs, 40, 8)
    places = postings.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count_distinct("bucket", "part").alias("n"), F.count("*").alias("rows"))
    assert {r.n for r in places.collect()} == {1}
    assert "Generate" not in plan_of(postings)
    got = postings.orderBy("id").collect()
    assert {(r.tf, r.dl) for r in got if r.term == "the"} == {(100, 109)} and sum(r.first for r in got) == 63
    assert [(r.id, r.term, r.tf, r.dl, r.first) for r in got if r.id > 59] == [(k, None, 0, 0, True) for k in (60, 61, 62)]


def test_queries_that_share_terms_do_not_multiply_what_is_shuffled(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"alpha beta gamma word{k}") for k in range(50)], "id long, text string")
    index = keyword.write_index(docs, f"{tmp_path}/index", docs_a_range=8)
    asked = spark.createDataFrame([(q, "alpha beta beta") for q in range(9)] + [(9, "word7 none")], "query_id long, query string")
    for found in (keyword.matched(index, asked), keyword.bm25_topk(index, asked, k=3)):
        plan = plan_of(found)
        assert "SortMergeJoin" not in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, id#", plan)
    assert "WindowGroupLimit" in plan
    got = {(r.query_id, r.id): r.terms for r in keyword.matched(index, asked).collect()}
    assert got == {(q, k): 2 for q in range(9) for k in range(50)} | {(9, 7): 1}


def test_distinct_words_leave_out_documents_without_words(spark, tmp_path):
    from loomspan.plans import all_queries
    spark.createDataFrame([(1, "a b b"), (2, "..."), (3, ""), (4, "b c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in all_queries()["U5_distinct_words"](spark, str(tmp_path)).collect()] == [(3, 3 - 1)]


def test_few_hits_are_sent_to_the_texts(spark):
    texts = spark.range(100).select("id", F.concat(F.lit("t"), "id").alias("text"))
    found = search.with_texts(spark.createDataFrame([(1, 7), (1, 8), (2, 7)], "query_id long, id long"), texts)
    assert "BroadcastHashJoin" in plan_of(found) and "SortMergeJoin" not in plan_of(found)
    assert sorted((r.query_id, r.text) for r in found.collect()) == [(1, "t7"), (1, "t8"), (2, "t7")]


def test_streamed_documents_come_as_a_file_for_each_core(spark, tmp_path, monkeypatch):
    from loomspan.plans import pieces
    from loomspan.streaming import jobs
    docs = spark.range(0, 40, 1, 10).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("A text of a document "), "id").alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    runs, start = [], jobs.index_new_documents
    monkeypatch.setattr(pieces.jobs, "index_new_documents", lambda *a: runs.append(start(*a)) or runs[0])
    with_reads = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")  # a split for each file or two
    try:
        assert pieces.QUERIES["ST1_incremental_index"](spark, str(tmp_path)).count() == 40
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", with_reads)
    files_read = len(spark.read.parquet(f"{tmp_path}/documents.parquet").inputFiles())
    batches = [p for p in runs[0].recentProgress if p["numInputRows"]]
    assert files_read == 10 and 2 <= len(batches) <= 5


def against_sql(spark, folder, name):
    """Rows of a registered query and of its SQL over the tables in a folder, both sorted."""
    import duckdb

    from loomspan.plans import all_queries, all_sql
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    want = con.sql(all_sql()[name])
    got = all_queries()[name](spark, str(folder)).select(*want.columns).collect()
    return sorted(map(tuple, got), key=repr), sorted(map(tuple, want.fetchall()), key=repr)


#: Documents without text, with a null id, and with ids that stand twice.
ODD_DOCUMENTS = [(1, "a b"), (2, ""), (3, None), (4, "a b"), (4, "c"), (None, "d"), (None, None), (6, "c"), (6, "c")]


@pytest.mark.parametrize("ids", [[1, 9], [], [1, None], [None]])
def test_missing_embeddings_of_odd_documents(spark, tmp_path, ids):
    spark.createDataFrame(ODD_DOCUMENTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i,) for i in ids], "vec_id long").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = against_sql(spark, tmp_path, "E2_missing_embeddings")
    assert got == want


@pytest.mark.parametrize("documents", [ODD_DOCUMENTS, [(1, "a b"), (3, "")], []])
def test_rebuilt_embeddings_of_odd_documents(spark, tmp_path, documents):
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = against_sql(spark, tmp_path, "E3_rebuild_embeddings")
    assert got == want
