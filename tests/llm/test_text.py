"""Mixing, chat, pages, URL filters, token files, subwords and the pipeline on small fixtures."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomspan.llm import chat, mixing, queries, subword, tokenfile, urlfilter, wrapper
from loomspan.llm.common import Stage
from tests.conftest import DATA

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def odd_texts(n=300):
    r = random.Random(2)
    parts = list("aab  \n\t▁éüñ日本🎉<>0x4́/s\x00\r") + ["the ", "ing", "<s>", "<0x41>", "▁▁", "aaaa", "It's", "<|endoftext|>", "ΑΣ"]
    return ["", " ", "\n", "a" * 3000, "ab" * 400, " " * 700, "x" * 20_000 + " end"] + ["".join(r.choice(parts) for _ in range(r.randint(1, 50))) for _ in range(n)]


def test_subwords_equal_the_library(spark):
    import sentencepiece

    lib, texts = sentencepiece.SentencePieceProcessor(model_file=PIECES), odd_texts()
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)] + [(-1, None, "x", 1)], "k int, text string, decoded string, ids int")
    got = {r.k: r for r in subword.decode(subword.encode(df, PIECES), PIECES).collect()}
    assert list(got[-1].ids) == [] and got[-1].decoded == ""
    for k, (t, want) in enumerate(zip(texts, lib.encode(texts, num_threads=1), strict=True)):
        assert list(got[k].ids) == want, repr(t[:40])
        assert got[k].decoded == lib.decode(want)


def test_decoding_any_ids():
    import sentencepiece

    lib, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(5)
    lists = [[r.randrange(32_000) if r.random() < 0.5 else r.randrange(259) for _ in range(r.randint(0, 12))] for _ in range(500)]
    flat, offsets = np.array([i for x in lists for i in x]), np.cumsum([0] + [len(x) for x in lists])
    assert subword.decode_ids(subword.pieces(PIECES), flat, offsets) == [lib.decode(x) for x in lists]


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    lib, texts = Tokenizer.from_file(WORDS), odd_texts(150)
    rows = [(k * 7 % 1009, t, 1) for k, t in enumerate(texts)] + [(None, "null id", 1), (2000, None, 1), (2000, "twice", 1), (2000, "twice", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int").repartition(3)
    got = sorted(((r.id is not None, r.id), r.start, r.n_tokens, bytes(r.ids)) for r in tokenfile.round_trip(df, WORDS).collect())
    assert [g[1] for g in got] == np.cumsum([0] + [g[2] for g in got])[:-1].tolist()
    want = sorted(((d is not None, d), zlib.crc32(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for d, t, _ in rows)
    assert sorted((g[0], zlib.crc32(g[3])) for g in got) == want
    assert tokenfile.round_trip(df.limit(0), WORDS).count() == 0


def test_ranks_pack_and_unpack():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 1001):
        x = r.integers(0, r.choice([10, 300, 70_000, 2**32]), n)
        assert (tokenfile.unpack(*tokenfile.pack(x), n) == x).all()


def test_mix_meets_its_targets(spark):
    r = random.Random(6)
    rows = [(k, "w " * r.choice([0, 1, 5, 40, 300]), r.choice(["b", "a", "é", None, "z"]), "x") for k in range(1500)] + [(7, None, "a", "x"), (7, "dup dup", "a", "x"), (7, "dup dup", "a", "x"), (None, "n n", "new", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.plan(df, config=mixing.Mix(slot_rows=50)).collect()
    assert len(got) == len(rows)
    names = sorted({s for _, _, s, _ in rows if s}) + [None]
    total = {s: sum(len((t or "").split()) for _, t, x, _ in rows if x == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and weight[s] * level > 2 * total[s]}
        if not over:
            break
        capped |= over
    target = {s: 2 * total[s] if s in capped else weight[s] * level for s in names}
    assert {(g.source_size, round(g.target, 6)) for g in got} == {(total[s], round(target[s], 6)) for s in names}
    assert all(g.taken in (0, g.size, 2 * g.size) for g in got)
    by = {}
    for g in got:
        by[g.source_size, g.target] = by.get((g.source_size, g.target), 0) + g.taken
    assert all(t - 300 <= n <= t + 1e-6 for (_, t), n in by.items())
    again = mixing.plan(df.repartition(5), config=mixing.Mix(slot_rows=50)).where("doc_id <> 7").collect()
    assert {(g.doc_id, g.taken) for g in again} == {(g.doc_id, g.taken) for g in got if g.doc_id is not None and g.doc_id != 7}
    assert mixing.plan(df.limit(0)).count() == 0
    part = df.where("doc_id <> 7")
    mix = mixing.mixed(part)
    assert mix.columns == df.columns and mix.count() == mixing.plan(part).agg(F.sum("copies")).first()[0]


def test_mix_splits_rows_of_one_id(spark):
    """A third of the rows has no id: they fill many ranges, and the totals are those of one queue per source."""
    rows = [(None if k % 3 == 0 else k, "w " * (1 + k % 7), "ab"[k % 2]) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, many = (mixing.plan(docs, config=mixing.Mix(slot_rows=n)).collect() for n in (10_000, 10))
    assert sorted(map(str, one)) == sorted(map(str, many))
    taken = [sum(g.taken for g in many if g.source_size == size) for size in {g.source_size for g in many}]
    targets = [next(g.target for g in many if g.source_size == size) for size in {g.source_size for g in many}]
    assert all(t - 7 <= n <= t + 1e-6 for n, t in zip(taken, targets, strict=True))


def test_chat_round_trip_and_mask(spark):
    told = [("us\ner", "a<|im_end|>\n<|im_start|>assistant\nb"), ("assistant", "\x1a2<s>\x1a"), ("assistant", ""), (None, None), ("assistant", "<<SYS>>é🎉[/INST]"), ("user", "long " * 20_000)]
    df = spark.createDataFrame([(1, k, r, t, 0) for k, (r, t) in enumerate(told)], "c int, k int, role string, text string, formatted int")
    got = chat.formatted(df, ["c"], ["k"]).select("formatted", chat.parse(F.col("formatted")).alias("p"), chat.learnt(F.col("formatted"), F.col("loss_spans")).alias("l")).first()
    assert [tuple(t) for t in got.p] == [(r or "", t or "") for r, t in told]
    assert got.l == "".join(t or "" for r, t in told if r == "assistant")
    inner = re.sub(r"<\|im_(start|end)\|>", "", got.formatted)
    assert not any(c in inner for c in chat.CONTROLS)


def test_chat_paths(spark):
    r = random.Random(2)
    rows = [(k, None if k % 40 == 0 else r.randrange(k // 40 * 40, k), float(r.randrange(3))) for k in range(240)] + [(900, 901, 1.0), (901, 900, 1.0), (950, 12345, None), (None, 3, 1.0)]
    df = spark.createDataFrame(rows, "node long, parent long, score double")
    got = {}
    for x in chat.paths(df, Stage(spark, "t"), chat.Branches(per_tree=2)).collect():
        got.setdefault((x.root, x.leaf), {})[x.place] = x.node
    parent, score = {n: p for n, p, _ in rows[:240]}, {n: s for n, _, s in rows[:240]}
    best = {}
    for leaf in set(parent) - set(parent.values()):
        path = [leaf]
        while parent[path[-1]] is not None:
            path.append(parent[path[-1]])
        best.setdefault(path[-1], []).append((-sum(score[n] for n in path) / len(path), leaf, path[::-1]))
    want = {(root, leaf): dict(enumerate(p)) for root, all_ in best.items() for _, leaf, p in sorted(all_)[:2]}
    want[(950, 950)] = {0: 950}
    assert got == want


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page-content"><header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav>
<div class="cookie-notice"><p>We use cookies</p></div>%s<aside><p>Side</p></aside><div id="comments"><p>A reader says</p></div><form><p>Mail us</p></form><footer>&copy; x</footer></body></html>"""


def test_pages(spark):
    article = PAGE % "<article><header class='article-header'><h1>Head &amp; line</h1></header><p>One <b>two</b><br>three<p>Four\n  &lt;five&gt;</p><script>var x='</p>';</script><ul><li>a</li><li>b</li></ul><div class='share'>Share</div></article>"
    plain = [PAGE % f"<div class='wrap'><p>Always the same</p><p>Story {k} told</p><p>And more {k}</p></div>" for k in range(5)]
    rows = [(1, "https://a.org/x", article, 0), (2, "https://a.org/y", article, 0), (3, None, None, 0), (4, "http://b.org/", "", 0), (5, "c", "<p>un<closed", 0), (6, "http://d.org/", "<article>" + "<p>x</p>" * 3000, 0)]
    rows += [(10 + k, "http://p.org/", p, 0) for k, p in enumerate(plain)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper int")
    got = {r.page_id: r.text for r in wrapper.main_text(df).collect()}
    assert got[1] == got[2] == "Head & line\n\nOne two three\n\nFour <five>\n\na\n\nb"
    assert got[3] == got[4] == "" and got[6] == "\n\n".join(["x"] * 3000)
    assert [got[10 + k] for k in range(5)] == [f"Story {k} told\n\nAnd more {k}" for k in range(5)]
    assert wrapper.main_text(df.limit(0)).count() == 0


def test_copies_of_a_page_keep_their_text(spark):
    same = PAGE % "<div class='wrap'><p>Story told</p><p>And more</p></div>"
    plain = [PAGE % f"<div class='wrap'><p>Always the same</p>{more}</div>" for more in ("<p>One</p>", "<p>Two</p>", "<p>Three</p>", "")]
    rows = [(k, "http://s.org/", same) for k in range(3)] + [(10 + k, "http://p.org/", p) for k, p in enumerate(plain)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrapper.main_text(df).collect()}
    assert [got[k] for k in range(3)] == ["Story told\n\nAnd more"] * 3
    assert [got[10 + k] for k in range(4)] == ["One", "Two", "Three", "Always the same"]


def test_hosts_decide_inside_articles(spark):
    made = [f"<body><div class='layout has-sidebar'><div class='menu-open'><article><p>Follow our channel</p><p>Story {k}</p></article></div></div><div class='comments'><p>Said</p></div></body>" for k in range(4)]
    talk = "<main><div class='layout has-sidebar'><article><p>Body</p></article></div><div class='comments'><article><p>A reader</p></article></div></main>"
    rows = [(k, "http://a.org/", p) for k, p in enumerate(made)] + [(9, "http://b.org/", talk)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrapper.main_text(df).collect()}
    assert [got[k] for k in range(4)] == [f"Story {k}" for k in range(4)]


def test_the_wrapper_decides_where_no_tag_names_the_article(spark):
    def page(k):
        texts = "".join(f"<p>Own words {k}-{j} of a longer text that no other page has.</p>" for j in range(3))
        offer = f"<div><p>Offer {k} of the day</p></div>" if k % 2 else ""
        return f"<div><span>Start</span> <b>page {k}</b></div>{offer}<div><h1>Head {k}</h1>{texts}<p>Read on our site.</p><ul><li><a href=1>More {k}</a></li><li><a href=2>Most {k}</a></li></ul></div><div>End {k}</div>"

    rows = [(k, "http://plain.example/x", page(k)) for k in range(6)]
    got = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(6):
        assert got[k] == "\n\n".join([f"Head {k}", *(f"Own words {k}-{j} of a longer text that no other page has." for j in range(3))])
    empty = [block.text() for _, flag, block in wrapper._read_slots(page(1), wrapper.reader("[]", ())) if flag]
    assert {"Start page 1", "Offer 1 of the day", "End 1", "Read on our site."} <= set(empty)


def test_the_wrapper_finds_the_article_of_a_page_that_names_it():
    page = "<body><div>Buy now</div><article><h1>Title</h1><p>A long text of its own that fills the page with many words.</p></article><div>End</div></body>"
    stream = wrapper.dump([(n, False) for n in wrapper.fold(wrapper.tokens(page)[0])[0]])
    nodes = [n for n, _ in wrapper.load(stream)]
    mass = tuple((k, n, 0) for k, n in zip([k for k, s in enumerate(nodes) if s == wrapper.SLOT], (7, 5, 60, 3), strict=True))
    known = wrapper.reader(stream, mass, 1)
    assert nodes[known.box] == "article"
    assert [b.text() for _, flag, b in wrapper._read_slots(page, known) if flag] == ["Title", "A long text of its own that fills the page with many words."]
    assert [b.text() for _, flag, b in wrapper._read_slots(page, wrapper.reader("[]", ())) if flag] == ["Buy now", "Title", "A long text of its own that fills the page with many words.", "End"]


def test_alignment_is_a_longest_common_subsequence_of_each_stretch():
    """Every page's stream is taken by the wrapper of all: its nodes come in order, and what it lacks is optional."""
    r = random.Random(4)
    pages = [["html", *(x for _ in range(r.randrange(1, 5)) for x in r.choice([("p", "#", "/p"), ("h2", "#", "/h2"), ("div", "#", "/div"), ("ul", "li", "#", "/li", "/ul")])), "/html"] for _ in range(30)]
    whole = None
    for p in pages:
        whole = wrapper.generalise(whole, [(n, False) for n in wrapper.fold(p)[0]])
    groups = {n for n, _ in whole if isinstance(n, tuple)}
    for p in pages:
        nodes, covers = wrapper.absorb(*wrapper.fold(p), groups)
        assert sorted(k for c in covers for k in c) == list(range(len(p)))
        pairs = list(wrapper.align([*whole], nodes))
        both = [(a, b) for a, b in pairs if a is not None and b is not None]
        assert both == sorted(both) and all(whole[a][0] == nodes[b] for a, b in both)
        assert len(both) <= brute_common([n for n, _ in whole], nodes)
        assert all(whole[a][1] for a, b in pairs if b is None) and len(both) >= len(nodes) - 2


def brute_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize(("page", "text"), [
    ("<html><head><title>T</title><body><article><p>In</p></article>", "In"),
    ("<article><svg/><p>After</p></article>", "After"),
    ("<article><svg viewBox=1><text>no</text></svg><p>After</p></article>", "After"),
    ("<article><p>In</p><div class='comment content-body'>Me too</div><div class=kommentare>Ich auch</div></article>", "In"),
    ("<article><h2 id='share-of-income'>Share</h2><div class=social>Work</div><div id=share-buttons>Tell</div></article>", "Share\n\nWork"),
])
def test_odd_markup(spark, page, text):
    df = spark.createDataFrame([(1, "http://a.example", page), (1, "http://a.example", page)], "page_id long, url string, html string")
    assert [r.text for r in wrapper.main_text(df).collect()] == [text, text]


def test_wrappers_generalise():
    def seq(html):
        return [(n, False) for n in wrapper.fold(wrapper.tokens(html)[0])[0]]

    w = wrapper.generalise(None, seq("<div><h2>a</h2><p>b</p><p>c</p></div>"))
    w = wrapper.generalise(w, seq("<div><p>b</p></div>"))
    assert w == [("div", False), ("h2", True), ("#", True), ("/h2", True), (("+", ("p", "#", "/p")), False), ("/div", False)]
    assert wrapper.load(wrapper.dump(w)) == w


def test_url_filters_as_of(spark):
    entries = [("block", ".bad.org", "add", 10), ("block", ".bad.org", "remove", 20), ("block", ".bad.org", "add", 30), ("allow", "www.bad.org/ok", "add", 5), ("block", "x.org", "add", 1), ("allow", "x.org", "add", 1), ("block", None, "add", 1), ("block", ".bad.org", "add", 10)]
    caps = [(1, "http://www.bad.org/a", 9), (2, "http://www.bad.org/a", 10), (3, "http://www.bad.org/a", 20), (4, "http://u@WWW.bad.org:80/ok/b?q", 35), (5, "http://x.org", 3), (6, None, 3), (7, "odd", 3), (8, "http://bad.org/", None), (9, "http://bad.org/", 40), (9, "http://bad.org/", 40)]
    e = spark.createDataFrame(entries, "list string, pattern string, action string, at int")
    c = spark.createDataFrame([(*x, "z") for x in caps], "page_id long, url string, fetched int, pattern string")
    got = sorted((r.page_id, r.decision, r.pattern) for r in urlfilter.decide(c, e).collect())
    assert got == [(1, "none", None), (2, "block", ".bad.org"), (3, "none", None), (4, "allow", "www.bad.org/ok"), (5, "allow", "x.org"), (6, "none", None), (7, "none", None), (8, "none", None), (9, "block", ".bad.org"), (9, "block", ".bad.org")]
    assert urlfilter.decide(c, e.limit(0)).where("decision <> 'none'").count() == 0


def test_url_filters_match_paths_of_any_depth(spark):
    e = spark.createDataFrame([("block", "x.org/a/b/c/d/e", "add", 1), ("allow", "x.org/a/b/c/d/e/f/g", "add", 1), ("allow", "x.org", "add", 1)], "list string, pattern string, action string, at int")
    c = spark.createDataFrame([(1, "http://x.org/a/b/c/d/e", 2), (2, "http://x.org/a/b/c/d/e/f/g/h", 2), (3, "http://x.org/a/b/c/d", 2), (4, "http://x.org", 2)], "page_id long, url string, fetched int")
    got = sorted((r.page_id, r.decision, r.pattern) for r in urlfilter.decide(c, e).collect())
    assert got == [(1, "block", "x.org/a/b/c/d/e"), (2, "allow", "x.org/a/b/c/d/e/f/g"), (3, "allow", "x.org"), (4, "allow", "x.org")]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    kept = docs
    for name, step in corpus_pipeline.STAGES[:3]:
        out = step(spark, kept, f"{DATA}/sf0.001")
        assert out.columns == docs.columns, name
        kept = Stage(spark, name).put(out, name)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "mixing", "sentencepiece"]
    last = corpus_pipeline.encode(spark, kept, f"{DATA}/sf0.001")
    assert last.count() == kept.count() > 0


def test_pipeline_decides_by_row(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    clean = lambda n=40: " ".join(f"w{r.randrange(300)}" for _ in range(n))
    bad = lambda: f"{clean(20)} vilea vileb vilec {clean(20)}"
    learnt = [(k, bad() if k % 6 == 0 else clean(), "a") for k in range(600)]
    spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(600)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = [(None, bad(), "a"), (None, clean(), "a"), (700, bad(), "a"), (700, "fine " + clean(), "a")]
    docs = spark.createDataFrame(learnt + odd, "doc_id long, text string, source string")
    left = {x.text for x in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert [x[1] in left for x in odd] == [False, True, False, True]

    one, two = clean(), clean()
    rows = [(None, one, "a"), (9, one, "a"), (5, one, "a"), (5, one, "a"), (5, two, "a"), (6, "", "a"), (6, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted(((x.doc_id, x.text or "") for x in corpus_pipeline.near_dedup(spark, docs, "").collect()))
    assert kept == sorted([(5, one), (5, two), (6, ""), (6, "")])

    rows = [(1, f"{k} " + "w " * 9, "a") for k in range(6)] + [(None, f"n{k} " + "w " * 9, "b") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.mixed(docs).groupBy("text").count().collect()
    assert max(x["count"] for x in mix) <= 2
    assert sum(x["count"] for x in mix) == mixing.plan(docs).agg(F.sum("copies")).first()[0]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    table = "embeddings" if name.startswith("op1_") else "pages" if re.match("op[37]_", name) else "conversations" if name.startswith("op5_") else "documents"
    rows = spark.read.parquet(f"{DATA}/sf0.001/{table}.parquet")
    want = rows.select("conv_id").distinct().count() + 1 if table == "conversations" else rows.count()
    assert queries.QUERIES[name](spark, f"{DATA}/sf0.001").count() == want


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in every column, repeated rows, ids of several rows, an empty text, clashing column names, and an empty table."""
    import corpus_pipeline

    text = "ten plain words that say little about anything at all now"
    rows = [(None, text, None, None, None, 1, "a"), (1, text, "en", "s", 5, 2, "b"), (1, text, "en", "s", 5, 2, "b"), (2, None, "en", "s", 0, 3, "c"), (2, "", "en", "s", 0, 4, "d"), (3, "other words of its own here", "en", None, 1, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id int, row string")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"{DATA}/sf0.001")
        kept[name] = [r.doc_id for r in out.collect()]
        if name != "sentencepiece":
            assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), f"{DATA}/sf0.001").count() == 0
    key = lambda x: (x is None, x or 0)
    assert sorted(kept["toxicity"], key=key) == [1, 1, 2, 2, 3, None]
    assert sorted(kept["minhash_near_dedup"], key=key) == [1, 2, 2, 3]
    assert set(kept["mixing"]) <= {1, 3, None} and all(kept["mixing"].count(k) <= n for k, n in ((1, 4), (3, 2), (None, 2)))
    assert len(kept["sentencepiece"]) == len(rows)


def texts_of(spark, pages, url="http://some.example/x"):
    df = spark.createDataFrame([(k, url, p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrapper.main_text(df).collect()}
    return [got[k].split("\n\n") for k in range(len(pages))]


def own(k, n=4):
    return "".join(f"<p>Words {k}-{j} of a text that is long and stands on no other page of the host.</p>" for j in range(n))


def test_pages_lose_nothing_of_their_article(spark):
    said = [[f"Words {k}-{j} of a text that is long and stands on no other page of the host." for j in range(4)] for k in range(5)]
    intro = [f"<body><div><a href=1>Home</a></div><div><p>An intro of page {k} that tells what is to come.</p></div><div><h1>Head {k}</h1>{own(k)}</div></body>" for k in range(5)]
    assert texts_of(spark, intro) == [[f"An intro of page {k} that tells what is to come.", f"Head {k}", *said[k]] for k in range(5)]
    two = [f"<body><article>{own(k)}</article><article><p>Second {k}.</p></article></body>" for k in range(5)]
    assert texts_of(spark, two) == [[*said[k], f"Second {k}."] for k in range(5)]
    form = [f"<main><form action=x><div>{own(k)}</div></form></main>" for k in range(5)]
    assert texts_of(spark, form) == said
    assert texts_of(spark, [f"<main><form><div>{own(0)}</div></form></main><form><p>Mail us</p></form>"]) == said[:1]
    heads = [f"<body><div><h1>Daily report</h1>{own(k)}<h2>References</h2><ul><li><a href=1>Source {k}</a></li><li><a href=2>Other {k}</a></li></ul></div></body>" for k in range(5)]
    assert texts_of(spark, heads) == [["Daily report", *said[k], "References", f"Source {k}", f"Other {k}"] for k in range(5)]
    other = [f"<body><div>{own(k)}</div><p>tail</p></body>" for k in range(4)] + ["<body><table><tr><td>OTHER LAYOUT, with words enough to be a page of its own.</td></tr></table><div><p>tail of it</p></div></body>"]
    assert texts_of(spark, other) == [*said[:4], ["OTHER LAYOUT, with words enough to be a page of its own.", "tail of it"]]


@pytest.mark.parametrize("page", ['<div a="' * 20_000, "<svg a " * 20_000, "a<b " * 50_000, '<a "b>"' * 30_000, "<a x='>" * 30_000, '<a x=">\'' * 30_000 + ">", "<div>" * 20_000 + "x", "<div>" * 6_000 + "x" + "</p>" * 20_000, "<p>" * 20_000 + "</div>" * 20_000, "<svg>" * 30_000, "<!--" * 30_000, "<script>" * 30_000, "<form>" * 5_000 + "x", "<article>" * 5_000 + "x", "<b>" * 50_000, "<head>" * 20_000 + "<div>" * 20_000])
def test_malformed_pages_take_little_time(page):
    import time

    began = time.time()
    symbols, blocks = wrapper.tokens(page)
    nodes, covers = wrapper.fold(symbols)
    wrapper.articles_of(nodes, {k: (1, 0) for k in range(len(nodes))})
    assert [x for x in wrapper._read_slots(page, wrapper.reader("[]", ()))] is not None
    assert time.time() - began < 6


def test_tags_end_outside_quotes():
    parts = lambda page: [(kind, name or rest) for kind, name, rest in wrapper.scan(page)]
    assert parts("a<p x='>'>b</p >") == [("text", "a"), ("open", "p"), ("text", "b"), ("close", "p")]
    assert parts('<p x=">b') == [("open", "p"), ("text", "b")]  # quotes left open
    assert parts("1 < 2 <b") == [("text", "1 "), ("text", "<"), ("text", " 2 "), ("text", "<"), ("text", "b")]
    assert parts("<script>a<p></SCRIPT >b<svg><p></svg>c<svg/>d<svg>e") == [("raw", ""), ("text", "b"), ("raw", ""), ("text", "c"), ("raw", ""), ("text", "d"), ("raw", ""), ("text", "e")]
    assert parts("<!-- a > -->b<!doctype x>c<![CDATA[<p>]]>d<!-- e") == [("nothing", ""), ("text", "b"), ("nothing", ""), ("text", "c"), ("nothing", ""), ("text", "d"), ("nothing", "")]
