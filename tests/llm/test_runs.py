"""Periodic runs, whitening and token counts against brute force, numpy and the tokenizers library."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from loomspan.llm import queries, runs, tokencount, whitening
from tests.conftest import DATA

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def all_runs(words):
    """Every run of a list of words, by trying every period."""
    codes = {w: k for k, w in enumerate(dict.fromkeys(words))}
    x, out = np.array([codes[w] for w in words], int), []
    for q in range(1, len(x) // 4 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (x[:-q] == x[q:]).astype(int), [0]))))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            n = e - s + q
            if n >= max(6, 4 * q) and not any((x[s : s + n - p] == x[s + p : s + n]).all() for p in range(1, q)):
                out.append((s, n, q))
    return sorted(out)


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def looped(r, letters, longest):
    words = []
    for _ in range(r.randint(0, 8)):
        part = [str(r.randrange(letters)) for _ in range(r.randint(1, longest))]
        words += (part * r.randint(1, 7))[: 7 * len(part) - r.randint(0, 3)]
        if words and r.random() < 0.3:
            words[r.randrange(len(words))] = "z"
    return words


def test_runs_equal_brute_force():
    r, seen = random.Random(3), 0
    for _ in range(60):
        texts = [looped(r, r.choice([1, 2, 3, 5, 40]), r.choice([3, 10, 40])) for _ in range(r.randint(0, 30))]
        lists, left = runs.runs_of([" \n".join(t).encode() for t in texts])
        for words, got, rest in zip(texts, lists.to_pylist(), left, strict=True):
            want = all_runs(words)
            assert [(g["start"], g["length"], g["period"]) for g in got] == want
            assert rest.decode() == collapsed(words, want)
            seen += len(want)
    assert seen > 1000


@pytest.mark.parametrize("period", [1, 3, 4, 7, 8, 31, 32, 33, 63, 64, 100, 1000])
@pytest.mark.parametrize("extra", [0, 1])
def test_runs_of_every_scale(period, extra):
    """A run of just four periods, and one a word short of it, whatever scale its period is on."""
    r = random.Random(period)
    loop = [f"w{k}" for k in range(period)]
    words = ["a"] * 3 + (loop * 5)[: 4 * period + extra] + ["b"] * 3
    short = (loop * 4)[: 4 * period - 1]
    r.shuffle(loop)
    lists, _ = runs.runs_of([" ".join(words).encode(), b"", " ".join(short).encode()])
    want = [(3, 4 * period + extra, period)] if 4 * period + extra >= 6 else []
    assert [[tuple(x.values()) for x in got] for got in lists.to_pylist()] == [want, [], []]


def test_runs_in_runs_and_very_long_texts():
    inner = ["x"] * 9 + ["y"]
    words = inner * 6 + [f"w{k}" for k in range(200_000)] + ["q", "r"] * 50_000
    lists, left = runs.runs_of([" ".join(words).encode()])
    got = [tuple(x.values()) for x in lists.to_pylist()[0]]
    assert got == sorted([(0, 60, 10), *((10 * k, 9, 1) for k in range(6)), (200_060, 100_000, 2)])
    assert left[0].decode() == collapsed(words, got)


def test_runs_of_odd_rows(spark):
    rows = [(1, None, 5), (1, "", 5), (None, "a " * 6, 6), (2, " \t\x0b a\x0ca\ra a\na a ", 7), (2, "A a a a a a", 7), (3, "é é é é é é", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumn("other", F.lit("x"))
    got = sorted(((r.doc_id, r.other, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(df).collect()), key=repr)
    assert got == sorted([(1, "x", [], ""), (1, "x", [], ""), (None, "x", [(0, 6, 1)], "a"), (2, "x", [(0, 6, 1)], "a"), (2, "x", [], "A a a a a a"), (3, "x", [(0, 6, 1)], "é")], key=repr)
    assert runs.periodic_runs(df.limit(0)).count() == 0


def test_op11_against_brute_force(spark):
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, f"{DATA}/sf0.001").collect()}
    docs = ds.dataset(f"{DATA}/sf0.001/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    assert len(got) == len(docs)
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        h = zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(len(words))]
        want = all_runs(words)
        s, n, q = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if want else (None,) * 3
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in want)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert tuple(got[d["doc_id"]])[1:] == (len(want), s, n, q, 1000 * n // q if want else None, digest(lines), digest(collapsed(words, want)))


def principal(rows):
    x = np.array(rows, float)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    return x - x.mean(0), values[::-1], vectors[:, ::-1]


def test_charpoly_by_remainders(spark):
    r = random.Random(4)
    for d in (1, 2, 3, 9):
        b = [[r.randrange(-50, 50) for _ in range(d)] for _ in range(d + 1)]
        m = [[sum(row[i] * row[j] for row in b) for j in range(d)] for i in range(d)]
        poly = whitening.characteristic_polynomial(spark, m)
        for at in range(d + 2):  # the determinant by fractions
            a, det = [[Fraction((i == j) * at - m[i][j]) for j in range(d)] for i in range(d)], Fraction(1)
            for k in range(d):
                pivot = next((i for i in range(k, d) if a[i][k]), None)
                if pivot is None:
                    det = Fraction(0)
                    break
                if pivot != k:
                    a[k], a[pivot], det = a[pivot], a[k], -det
                det *= a[k][k]
                for i in range(k + 1, d):
                    f = a[i][k] / a[k][k]
                    a[i] = [x - f * y for x, y in zip(a[i], a[k], strict=True)]
            assert sum(c * at**i for i, c in enumerate(poly)) == det


def test_roots_are_counted_and_found():
    roots = [0, 0, 3, 3, 3, 7, 1000, 10**12]
    poly = [1]
    for x in roots:
        poly = [(poly[i - 1] if i else 0) - x * (poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    for at in (-1, 0, 1, 2, 3, 6, 7, 999, 10**12):
        assert whitening.roots_beyond(poly, at) == sum(x > at for x in roots)
    got = [whitening.kth_root(poly, k, 20) for k in range(1, 7)]
    assert [(g[0] / 2**20, g[1], g[2]) for g in got] == [(10**12, 1, 1), (1000, 2, 1), (7, 3, 1), (3, 4, 3), (3, 4, 3), (3, 4, 3)]


@pytest.mark.parametrize("shape", [(60, 6), (5, 9), (1, 4), (40, 1)])
def test_whitening_equals_eigenvectors(spark, shape):
    r = np.random.default_rng(shape[0])
    vectors = r.normal(size=shape).astype(np.float32)
    x = np.floor(64 * vectors.astype(float)).astype(int) + 1_000_000
    got = whitening.whiten(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(3), most=4).toPandas()
    centred, values, units = principal(x)
    rank = min(4, shape[1], int((values > 1e-9).sum()))
    assert len(got) == shape[0] * rank
    if not rank:
        return
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = centred @ units[:, :rank] / np.sqrt(values[:rank])
    assert np.abs(w - want * np.sign((w * want).sum(0))).max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), values[:rank] / values.sum(), rtol=1e-9)
    n = len(x)
    assert got.groupby("vec_id").deviation.first().tolist() == ((n * x - x.sum(0)) ** 2).sum(1).tolist()
    assert set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_equal_roots(spark):
    """All eigenvalues equal: any right-angled set of components is right."""
    rows = [(k, [float(3 * (k % 5 == j) * (1 if k < 5 else -1)) for j in range(5)]) for k in range(10)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert w.shape == (10, 5) and np.abs(w.T @ w / 10 - np.eye(5)).max() < 1e-12
    assert np.allclose(got.explained, 0.2)


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (1, [3.0, -1.0]), (None, [0.5, 0.25]), (4, [1.0, 2.0])]
    bad = [(5, None), (6, []), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 2.0, 3.0])]
    kind = "vec_id long, embedding array<double>, n string"
    df = spark.createDataFrame([(*r, "x") for r in good + bad], kind)
    got = whitening.whiten(df).toPandas()
    assert len(got) == 8 and set(got.n) == {4} and sorted(got.vec_id.dropna()) == [1, 1, 1, 1, 4, 4]
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(*good[0], "x"), (*good[3], "x")], kind)).count() == 0  # no spread
    far = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0], ""), (2, [-1e30, 1.0], ""), (3, [0.0, 5.0], "")], kind)).toPandas()
    assert len(far) == 6 and far[far.vec_id < 3].deviation.isna().all() and far.identity_error[0] < 1e-9
    assert far[far.vec_id == 3].deviation.tolist() == [(3 * 320 - 384) ** 2] * 2


def test_sums_are_exact(spark):
    rows = [([float(k * 2**20), float(-k)],) for k in range(1, 200)]
    df = spark.createDataFrame(rows, "v array<double>").repartition(5)
    n, s, m = whitening.scatter(df, "v", 2)
    x = [[int(64 * c) for c in r[0]] for r in rows]
    assert n == 199 and s == [sum(c) for c in zip(*x, strict=True)]
    assert m == [[n * sum(a[i] * a[j] for a in x) - s[i] * s[j] for j in range(2)] for i in range(2)]


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    lib, r = Tokenizer.from_file(BYTES), random.Random(6)
    parts = list("aab  \n\t▁éüñ日本🎉<>0x4́/s\x00\r\x1c\x85\xa0　՘\U00011de0'.,-") + ["the ", "ing", "It's", "'ll", "'RE", "<|endoftext|>", "<|endof", "ΑΣ", "aaaa", "     ", " ."]
    texts = ["", " ", "\n", "a" * 3000, "ab" * 400, " " * 700, "x" * 20_000 + " end", "<|endoftext|>" * 3] + ["".join(r.choice(parts) for _ in range(r.randint(1, 50))) for _ in range(4000)]
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(-1, None, "x"), (-1, "twice", "x"), (-1, "twice", "x"), (None, "null id", "x")], "doc_id long, text string, n_tokens string").repartition(3)
    got = tokencount.token_counts(df, BYTES, limit=100).collect()
    assert len(got) == len(texts) + 4
    for row in got:
        if row.doc_id is not None and row.doc_id >= 0:
            text = texts[row.doc_id]
            assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), want[row.doc_id], want[row.doc_id] > 100), repr(text)
    assert sorted(row.n_tokens for row in got if row.doc_id == -1) == [0, 2, 2]
    assert tokencount.token_counts(df.limit(0), BYTES).count() == 0


def test_token_counts_forget_and_count_long_stretches():
    from tokenizers import Tokenizer

    lib, model = Tokenizer.from_file(BYTES), tokencount.TokenCounter(BYTES)
    words = [f"word{k}".encode() for k in range(50)]
    before, tokencount.MOST_UNITS = tokencount.MOST_UNITS, 10
    try:
        got = [model([b" ".join(words)]).tolist() for _ in range(3)]
    finally:
        tokencount.MOST_UNITS = before
    assert got == [[len(lib.encode(b" ".join(words).decode()).ids)]] * 3
    assert model([b"ab" * 200_000]).tolist() == [len(lib.encode("ab" * 200_000).ids)]
    with pytest.raises(ValueError, match="byte-level"):
        tokencount.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
