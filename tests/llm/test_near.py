"""Near-duplicates, fingerprints, embeddings and toxicity against brute force on small fixtures."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import embedding, minhash, simhash, toxicity
from loomspan.llm.common import Stage, shuffles_removed
from loomspan.llm.components import connected_components
from loomspan.llm.words import flat_words, shingle_hashes


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def closure(n, linked):
    least = list(range(n))

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = sorted((top(a), top(b)))
                least[y] = x
    return [top(k) for k in range(n)]


def near_texts(seed, n=140):
    r = random.Random(seed)
    base = [" ".join(f"w{r.randrange(400)}" for _ in range(r.choice([3, 4, 30, 80, 200]))) for _ in range(n // 5)]
    out = []
    for _ in range(n):
        words = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2, 4, 12])):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        out.append("  ".join(words))
    return out + ["", "   \n", "one", "One", "ONE two", "é" * 50]


@pytest.mark.parametrize("width", [4, 5])
def test_minhash_components(spark, width):
    texts = near_texts(width)
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts)] + [(None, "one", "x", 1), (None, None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, n int")
    got = minhash.near_duplicates(df, config=minhash.MinHash(width=width)).collect()
    sets = [shingles(t, width) for t in texts]
    want = closure(len(texts), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and bool(sets[a]))
    known = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == len(rows)
    assert [known[k].component_id for k in range(len(texts))] == want
    assert [known[k].n_shingles for k in range(len(texts))] == [len(s) for s in sets]
    assert all(r.kept == (r.doc_id == r.component_id) for r in known.values())
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)


def test_minhash_tiles_leave_no_pair_out(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 3)
    monkeypatch.setattr(minhash, "SHARE", 2)
    texts = near_texts(9, 60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    sets = [shingles(t, 5) for t in texts]
    assert [got[k] for k in range(len(texts))] == closure(len(texts), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and bool(sets[a]))


def test_minhash_pairs_are_dealt_to_no_more_tasks_than_the_session_asks_for(spark):
    rows = spark.createDataFrame([(1, 1, 1, 5, 5, 1, 2, b"")], "key long, id long, component long, n long, common long, rank long, last long, marks binary")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for asked, parts in ((64, 64), (2, 4 * spark.sparkContext.defaultParallelism)):
            spark.conf.set("spark.sql.shuffle.partitions", asked)
            plan = minhash._pairs(rows, minhash.MinHash(), 1, 1)._jdf.queryExecution().toString()
            assert re.findall(r"lead_tile#\d+L, other_tile#\d+L, (\d+)\)", plan) and set(re.findall(r"lead_tile#\d+L, other_tile#\d+L, (\d+)\)", plan)) == {str(parts)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_minhash_rounds_read_open_lists_and_end_when_nothing_links(spark, monkeypatch):
    monkeypatch.setattr(minhash, "ROUNDS", ((1, 1), (2, 2), (3, 1 << 62)))
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(base[:120] + [f"{j}x{k}" for k in range(25)]) for j in range(12)]  # about 0.7 alike: pairs without links
    texts += [" ".join([*base[:100], f"y{j}"]) for j in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    written, put = {}, Stage.put
    monkeypatch.setattr(Stage, "put", lambda self, df, name, *a, **k: (out := put(self, df, name, *a, **k), written.update({name: out.count()}))[0])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    sets = [shingles(t, 5) for t in texts]
    assert got == dict(enumerate(closure(len(texts), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))))
    assert not any(x.startswith("pairs-") for x in written)
    assert all((f"components-{k}" in written) == (written[f"links-{k}"] > 0) for k in range(3) if f"links-{k}" in written), written


def test_components_end_when_all_are_stars(spark, monkeypatch):
    written, put = [], Stage.put
    monkeypatch.setattr(Stage, "put", lambda self, df, name, *a, **k: (written.append(name), put(self, df, name, *a, **k))[1])

    def got(edges, kind="long"):
        del written[:]
        df = spark.createDataFrame(edges, f"a {kind}, b {kind}")
        return {r.node: r.component for r in connected_components(df, Stage(spark, "test"), "c").collect()}

    assert got([(1, k) for k in range(2, 9)] + [(20, 30), (20, 20), (None, 5)]) == {k: 1 for k in range(1, 9)} | {20: 20, 30: 20}
    assert written == ["c-0"]  # one contraction, not another to see that nothing changes
    assert got([(3, 3)]) == {} and written == ["c-0"]
    assert got([("b", "c"), ("c", "a")], "string") == {"a": "a", "b": "a", "c": "a"}
    r = random.Random(5)
    for edges in ([(k, k + 1) for k in range(40)], [(k, 50) for k in range(30)], [(r.randrange(60), r.randrange(60)) for _ in range(45)]):
        linked = {frozenset(e) for e in edges}
        least = closure(61, lambda a, b: frozenset((a, b)) in linked)  # noqa: B023
        assert got(edges) == {x: least[x] for a, b in edges if a != b for x in (a, b)}


def test_minhash_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_fingerprints_are_votes_of_weighted_shingles(spark):
    texts = ["a b c d e f g a b c d e f g", "a b c", "one two three four five six seven eight", "", None, "A B C D E F G a b c d e f g", "x " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: (r.text_hi, r.text_lo) for r in simhash.fingerprints(df, ["text"]).collect()}
    for k, text in enumerate(texts):
        values, _ = shingle_hashes(*flat_words([(text or "").encode()]), 5)
        votes = [0.0] * 128
        for v in set(values.tolist()):
            weight = np.float32(1 + np.log(values.tolist().count(v)))
            spread = np.array([v], np.uint64)
            pair = np.concatenate((spread, simhash.mix(spread + np.uint64(0x9E3779B97F4A7C15))))
            for place, byte in enumerate(pair.view(np.uint8).tolist()):
                for bit in range(8):
                    votes[8 * place + bit] += weight if byte >> (7 - bit) & 1 else -weight
        want = np.packbits(np.array(votes) > 0).view(np.int64).tolist()
        assert list(got[k]) == want, text
    assert got[0] == got[5] and got[3] == got[4] == (0, 0)


def test_fingerprints_within_the_radius(spark):
    r = random.Random(6)
    base = [r.getrandbits(128) for _ in range(30)]
    prints = [b ^ sum(1 << r.randrange(128) for _ in range(r.choice([0, 1, 3, 6, 9]))) for b in base * 5]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(k, signed(p >> 64), signed(p & (1 << 64) - 1)) for k, p in enumerate(prints)], "id long, hi long, lo long")
    got = {(x.query, x.id, x.bits) for x in simhash.within_radius(df.where("id % 3 = 0"), df).collect()}
    assert got == {(a, b, (prints[a] ^ prints[b]).bit_count()) for a in range(0, 150, 3) for b in range(150) if a != b and (prints[a] ^ prints[b]).bit_count() <= 6}
    assert simhash.within_radius(df.limit(0), df).count() == simhash.within_radius(df, df.limit(0)).count() == 0


def test_next_of_few_rows(spark):
    df = spark.createDataFrame([(5, "b"), (1, None), (1, "a")], "id long, text string")
    assert [(r.id, r.text, r.next_text) for r in simhash.with_next(df, Stage(spark, "t")).orderBy("id", "text").collect()] == [(1, None, "a"), (1, "a", "b"), (5, "b", None)]
    assert simhash.with_next(df.limit(0), Stage(spark, "t")).count() == 0
    with pytest.raises(TypeError):
        simhash.with_next(df.withColumn("id", F.col("id").cast("string")), Stage(spark, "t"))


def test_embedding_links(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((12, 16))
    vectors = [(base[k % 12] + r.standard_normal(16) * s).tolist() for k, s in zip(range(150), r.choice([0, 0.05, 0.1, 0.2, 0.3], 150), strict=True)]
    rows = [(k, v, k % 3 if k % 11 else None, 0) for k, v in enumerate(vectors)]
    rows += [(200, None, 1, 0), (201, [], 1, 0), (202, [0.0] * 16, 1, 0), (203, [float("nan")] * 16, 1, 0), (204, [1.0, None], 1, 0), (205, [1.0, 2.0], 1, 0), (206, [2.0, 4.0], 1, 0), (None, vectors[1], 1, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, component_id int")
    got = {r.vec_id: r for r in embedding.near_duplicates(df).collect()}
    x = np.array(vectors, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = x @ x.T

    def linked(a, b):
        return rows[a][2] is not None and rows[a][2] == rows[b][2] and cos[a, b] >= 0.93

    assert [got[k].component_id for k in range(150)] == closure(150, linked)
    assert [got[k].n_links for k in range(150)] == [sum(linked(a, b) for b in range(150) if b != a) for a in range(150)]
    assert [(got[k].n_links, got[k].kept) for k in (200, 201, 202, 203, 204)] == [(0, True)] * 5
    assert got[205].n_links == got[206].n_links == 1 and got[206].component_id == 205
    assert got[None].n_links == 0 and got[None].kept
    assert embedding.near_duplicates(df.limit(0)).count() == 0


def test_embedding_rows_with_one_id_keep_their_own_links(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 2), (7, [1.0, 0.0], 1), (8, [0.0, 1.0], 2), (9, [0.1, 1.0], 2)]
    got = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(5, 1, 5), (5, 2, 5), (7, 1, 5), (8, 2, 5), (9, 2, 5)]


def test_embedding_links_of_very_small_and_large_components(spark):
    rows = [(1, [1e-200, 2e-200], 1), (2, [1e-200, 2.1e-200], 1), (3, [1e200, 2e200], 1), (4, [-1e-200, 2e-200], 1)]
    got = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4)]


def test_embedding_tiles(spark, monkeypatch):
    monkeypatch.setattr(embedding, "TILE", 8)
    r = np.random.default_rng(5)
    rows = [(k, (np.ones(16) + r.standard_normal(16) * 0.2).tolist(), 1) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    x = np.array([v for _, v, _ in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T) >= 0.93).sum(axis=1) - 1
    assert [r.n_links for r in embedding.near_duplicates(df).orderBy("vec_id").collect()] == want.tolist()


def embedded(spark, seed, n, dim, spread, labels=1):
    """Vectors around a few centres, and the matrix of their links."""
    r = np.random.default_rng(seed)
    centres, label = r.standard_normal((4, dim)), r.integers(0, labels, n)
    x = (centres[r.integers(0, 4, n)] + r.standard_normal((n, dim)) * r.choice(spread, (n, 1))).astype(np.float32)
    df = spark.createDataFrame([(k, x[k].tolist(), int(label[k])) for k in range(n)], "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    return df, (u @ u.T >= 0.93) & (label[:, None] == label) & ~np.eye(n, dtype=bool)


def stored_rows(monkeypatch):
    """Rows of each table that an operator writes from now on."""
    rows, put = {}, Stage.put

    def counted(self, df, name, *a):
        out = put(self, df, name, *a)
        rows[name] = out.count()
        return out
    monkeypatch.setattr(Stage, "put", counted)
    return rows


@pytest.mark.parametrize("tile", [None, 7])
def test_embedding_links_in_rounds(spark, monkeypatch, tile):
    rounds, asked = embedding._rounds, []
    monkeypatch.setattr(embedding, "_rounds", lambda blocks, n: asked.extend(rounds(blocks, 20)) or asked)
    monkeypatch.setattr(embedding, "TILE", tile or embedding.TILE)
    df, links = embedded(spark, 8, 120, 24, [0.05, 0.2, 0.27, 0.4], labels=2)
    got = embedding.near_duplicates(df).orderBy("vec_id").collect()
    assert len(asked) == 16 and {(b, k) for blocks, k, _ in asked for b in blocks} == {(b, k) for b in range(8) for k in range(2)}
    assert [r.n_links for r in got] == links.sum(axis=1).tolist()
    assert [r.component_id for r in got] == closure(120, lambda a, b: links[a, b])


def test_embedding_rounds_cover_all_blocks_and_parts():
    for n in (1, 3, 8, 17, 40):
        found = [(b, k, parts) for blocks, k, parts in embedding._rounds(8, n) for b in blocks]
        assert sorted(found) == sorted((b, k, p) for p in {max(1, round(n / 8))} for b in range(8) for k in range(p))


def test_embedding_pairs_are_not_stored(spark, monkeypatch):
    stored = stored_rows(monkeypatch)
    df, links = embedded(spark, 9, 300, 16, [0.01])
    got = embedding.near_duplicates(df).orderBy("vec_id").collect()
    assert [r.n_links for r in got] == links.sum(axis=1).tolist() and links.sum() > 300 * 60
    assert max(stored.values()) <= 300 * 36 / 4  # of 36 rows of grid cells for each vector, and over ten thousand pairs


def test_embedding_pairs_at_the_bound(spark, monkeypatch):
    stored = stored_rows(monkeypatch)
    r = np.random.default_rng(10)
    rows, want = [], []
    for k, away in enumerate([1e-4, 1e-5, 1e-7, 1e-10, -1e-10, -1e-7, -1e-5, -1e-4]):
        q = np.linalg.qr(r.standard_normal((64, 2)))[0].T
        v = (0.93 + away) * q[0] + np.sqrt(1 - (0.93 + away) ** 2) * q[1]
        rows += [(2 * k, (3 * q[0]).tolist(), k), (2 * k + 1, v.tolist(), k)]
        want += [int(away > 0)] * 2
    got = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).orderBy("vec_id").collect()
    assert [x.n_links for x in got] == want
    assert [x.component_id for x in got] == [k - k % 2 if n else k for k, n in enumerate(want)]
    assert stored["close"] >= 2  # those that steps can't decide


def test_shuffle_files_are_kept_outside(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with pytest.raises(KeyError), shuffles_removed(spark):
        assert spark.conf.get(key) == "true"
        raise KeyError
    assert spark.conf.get(key) == before


def test_simhash_search_equals_brute_force(spark):
    r = random.Random(4)
    prints = [(r.getrandbits(128)) for _ in range(60)]
    prints += [p ^ sum(1 << b for b in r.sample(range(128), r.choice([0, 3, 6, 7, 9]))) for p in prints for _ in range(2)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(k, signed(p >> 64), signed(p & (1 << 64) - 1)) for k, p in enumerate(prints)], "id long, hi long, lo long")
    got = {(x.query, x.id, x.bits) for x in simhash.within_radius(df.where("id % 3 = 0"), df).collect()}
    assert got == {(a, b, (p ^ q).bit_count()) for a, p in enumerate(prints) for b, q in enumerate(prints) if a != b and a % 3 == 0 and (p ^ q).bit_count() <= 6}


def test_fingerprints_and_next_texts(spark):
    rows = [(5, "b a", 1), (None, "n", 1), (9, None, 1), (7, "", 1), (5, "a a", 1), (7, "x " * 100_000, 1)]
    df = spark.createDataFrame(rows, "id long, text string, text_hi int").select("id", "text")
    got = simhash.with_next(df, Stage(spark, "t"), rows=2).collect()
    assert len(got) == len(rows)
    order = [(None, "n"), (5, "a a"), (5, "b a"), (7, ""), (7, "x " * 100_000), (9, None)]
    want = {(a, b): order[(k + 1) % len(order)][1] for k, (a, b) in enumerate(order)}
    assert {(r.id, r.text): r.next_text for r in got} == want
    same = simhash.fingerprints(spark.createDataFrame([("a b c",), ("a b c",), ("A  b c",), (None,)], "t string"), ["t"]).collect()
    assert same[0] == same[1] == same[2] and same[3].t_hi == 0


def test_words_are_hashed_as_sets_of_bytes():
    texts = [b"", b"One two  one", b" \n", b"x", "é É".encode()]
    words, offsets = flat_words(texts)
    assert np.diff(offsets).tolist() == [0, 3, 0, 1, 2] and words[0] == words[2] and len(set(words.tolist())) == 5
    values, ends = shingle_hashes(words, offsets, 4)
    assert np.diff(ends).tolist() == [0, 1, 0, 1, 1]


def brute_segments(scores):
    """Maximal segments by their definition: best segment first, then both sides."""
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a = -best[2]
    b = a - best[1]
    return [(x, y) for x, y in brute_segments(scores[:a])] + [(a, b)] + [(x + b, y + b) for x, y in brute_segments(scores[b:])]


def test_maximal_segments():
    r = random.Random(8)
    for _ in range(200):
        scores = [r.choice([-3, -2, -1, 1, 2, 4]) + r.random() / 100 for _ in range(r.randrange(14))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(np.array(scores))] == brute_segments(scores)


def test_toxicity_learns_and_handles_odd_rows(spark):
    r = random.Random(1)
    rows, labels = [], []
    for k in range(600):
        words = [f"w{r.randrange(300)}" for _ in range(60)]
        bad = k % 6 == 0
        if bad:
            words[20:23] = r.sample(["vilea", "vileb", "vilec", "viled", "vilee", "vilef"], 3)
        rows.append((k, " ".join(words), "x"))
        labels.append((k, int(bad), 1))
    rows += [(None, "vilea vileb vilec", "x"), (900, "", "x"), (901, None, "x"), (902, "vilea, vileb. vilec! " + "w1 " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    marks = spark.createDataFrame(labels + [(3, None, 1), (None, 1, 1)], "doc_id long, toxic int, text int")
    got = {x.doc_id: x for x in toxicity.toxicity(docs, marks).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k].held_out for k in held) and all(got[k].predicted == labels[k][1] for k in held)
    passages = got[0].passages
    assert any("vile" in rows[0][1][p.start : p.start + p.length] for p in passages)
    assert got[None].predicted == got[902].predicted == 1 and got[900].score == got[901].score < 0.3
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0
    flat = toxicity.toxicity(docs, marks.limit(0)).select("score").distinct().count()
    assert flat == 1


def brute_token_scores(model, learned, words, own=None):
    """Scores of one text's words from sets of documents by form, in plain Python."""
    out = []
    for word in words:
        score = -toxicity.DRIFT
        for size in (*toxicity.PREFIXES, None):
            holders = [label for k, (text, label) in learned.items() if k != own and word[:size] in {w[:size] for w in text.split()}]
            n, t = len(holders), sum(holders)
            if n >= toxicity.SEEN:
                a, b = t + toxicity.PRIOR * model.base, n - t + toxicity.PRIOR * (1 - model.base)
                score = math.log(a / b) - math.log(model.base / (1 - model.base)) - math.sqrt(1 / a + 1 / b) - toxicity.DRIFT
        out.append(score)
    return out


def brute_evidence(model, words, scores):
    found = [sum(scores[a:b]) for a, b in brute_segments(scores)]
    peers = math.log(max(model.scale * len(words), 1e-9))
    return min(toxicity.MOST_EVIDENCE, sum(max(0.0, model.rate * s - peers) for s in found))


def test_toxicity_scores_equal_brute_force(spark):
    r = random.Random(12)
    rows = []
    for k in range(160):
        words = [f"word{r.randrange(40)}" if r.random() < 0.5 else f"w{r.randrange(60)}" for _ in range(r.randrange(1, 30))]
        if k % 5 == 0:
            words[:0] = r.sample(["vilea", "vileb", "viled", "nastyone", "nastytwo"], 2)
        rows.append((k, " ".join(words), int(k % 5 == 0)))
    docs = spark.createDataFrame(rows, "id long, text string, label int")
    marks = docs.select("id", "label")
    stage = Stage(spark, "t")
    model = toxicity.train(docs.select("id", "text"), marks, stage)
    learned = {k: (text, label) for k, text, label in rows if zlib.crc32(str(k).encode()) % 4 != 2}
    assert model.base == pytest.approx((sum(label for _, label in learned.values()) + 0.5) / (len(learned) + 1))
    # the tail of clean documents' segments, each scored without its own counts
    tails, tokens, evidence = [], 0, {}
    without = {k: brute_token_scores(model, learned, text.split(), k) for k, (text, _) in learned.items()}
    for k, (text, label) in learned.items():
        if not label:
            tails += [sum(without[k][a:b]) for a, b in brute_segments(without[k])]
            tokens += len(text.split())
    assert model.scale == pytest.approx(len(tails) / tokens) and model.rate == pytest.approx(min(20.0, len(tails) / sum(tails)))
    # the curve: no nearby slope and level has a higher likelihood on the quarters of evidence
    for k, (text, label) in learned.items():
        evidence[k] = (math.floor(4 * brute_evidence(model, text.split(), without[k]) + 0.5) / 4, label)
    def likelihood(slope, level):
        return sum(-math.log1p(math.exp(-z if y else z)) for z, y in ((slope * x + level, y) for x, y in evidence.values())) - 5e-4 * (slope**2 + level**2)
    best = likelihood(model.slope, model.level)
    assert all(best >= likelihood(model.slope + a, model.level + b) - 1e-9 for a in (-0.05, 0, 0.05) for b in (-0.05, 0, 0.05))
    for x in toxicity.score(docs.select("id", "text"), model).collect():
        words = rows[x.id][1].split()
        z = model.slope * brute_evidence(model, words, brute_token_scores(model, learned, words)) + model.level
        assert x.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_toxicity_learns_from_a_bounded_share(spark):
    """Half of the labelled rows have one id; a share of rows is learned from, the same one each time."""
    rows = [(0 if k % 2 else k, f"alpha beta w{k % 50}", int(k % 4 == 0)) for k in range(4000)]
    docs = spark.createDataFrame(rows, "id long, text string, label int")
    stage = Stage(spark, "t")
    marks = docs.groupBy("id").agg(F.max("label").alias("label"))
    alpha = toxicity.Tokens([b"alpha"]).keys[-1]
    whole = toxicity.train(docs.select("id", "text"), marks, stage).counts(alpha)[0][0]
    some = [toxicity.train(docs.select("id", "text"), marks, stage, most_rows=800).counts(alpha)[0][0] for _ in range(2)]
    assert some[0] == some[1] and 700 < some[0] < 900 < whole


def test_edited_digest(spark):
    assert spark.range(1).select(F.sha2(F.lit("é"), 256).alias("x")).first().x == hashlib.sha256("é".encode()).hexdigest()


def test_each_copy_of_a_toxic_passage_is_found(spark):
    r = random.Random(4)
    rows, labels = [], []
    clean = lambda n: " ".join(f"w{r.randrange(300)}" for _ in range(n))
    for k in range(600):
        bad = k % 6 == 0
        rows.append((k, clean(20) + (" vilea vileb vilec " if bad else " ") + clean(20)))
        labels.append((k, int(bad)))
    text = clean(3000) + " vilea vileb vilec " + clean(3000) + " vilea vileb vilec " + clean(3000)
    docs = spark.createDataFrame([*rows, (1000, text)], "doc_id long, text string")
    found = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).where("doc_id = 1000").first().passages
    for m in re.finditer("vilea vileb vilec", text):
        assert any(p.start <= m.start() and m.end() <= p.start + p.length for p in found), found


def test_rare_toxic_words_stay_apart_in_a_large_vocabulary(spark):
    texts = [(k, " ".join(f"{k * 9000 + j:x}q" for j in range(9000))) for k in range(150)] * 3  # 1.35 million words, three times each
    rows = [(k, text, 0) for k, (_, text) in enumerate(texts)] + [(1000 + k, f"vilea{k % 10} vileb{k % 10}", 1) for k in range(100)]
    docs = spark.createDataFrame(rows, "id long, text string, label int").repartition(4)
    model = toxicity.train(docs.select("id", "text"), docs.select("id", "label"), Stage(spark, "t"))
    words = [f"vile{x}{k}" for x in "ab" for k in range(10)]
    seen, bad = model.counts(toxicity.Tokens([" ".join(words).encode()]).keys[-1])
    assert (seen == bad).all() and seen.min() >= 3
