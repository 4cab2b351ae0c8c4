import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import crc, words
from weirflow.llm import lm
from weirflow.llm._shared import id_crc32

def held(k):
    return F.pmod(id_crc32("doc_id"), F.lit(7)) == k


BY = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")


def tokens(t):
    return [*words(t), None]


def counts(rows, keep):
    uni, bi, tri, ctx, texts = Counter(), Counter(), Counter(), Counter(), 0
    for i, t in rows:
        if keep(i):
            w = tokens(t)
            uni.update(w)
            bi.update(zip(["<s>", *w], w, strict=False))
            tri.update(zip(["<s>", "<s>", *w], ["<s>", *w], w, strict=False))
            ctx.update(zip(["<s>", "<s>", *w], ["<s>", *w[:-1]], strict=False))
            texts += 1
    return uni, bi, tri, ctx, texts


def bucket(c):
    return min(math.ceil(math.log2(c + 1)), lm.BUCKETS - 1)


def plain(rows, low, top):
    out_of = lambda i: i is not None and crc(i) % 7 == 2
    uni, bi, tri, ctx, texts = counts(rows, lambda i: not out_of(i))
    n, v = sum(uni.values()), len(uni)
    out = []
    for i, t in rows:
        w, base, score = tokens(t), 0.0, 0.0
        for f, h, x in zip(["<s>", "<s>", *w], ["<s>", *w], w, strict=False):
            c, d = texts if h == "<s>" else uni[h], ctx[f, h]
            (l2, l1, l0), (t3, t2) = low[bucket(c)], top[bucket(d)]
            base += math.log10((uni[x] + 1) / (n + v + 1))
            p = l2 * (bi[h, x] / c if c else 0) + l1 * uni[x] / max(n, 1) + l0 / (v + 1)
            score += math.log10(t3 * (tri[f, h, x] / d if d else 0) + t2 * p)
        out.append((i, out_of(i), len(w), sum(uni[x] > 0 for x in w), n, base, score))
    return sorted(out, key=lambda r: (repr(r[0]), r[2]))


def scored(df, monkeypatch):
    kept = {}
    real, real_top = lm.em, lm.em_top
    monkeypatch.setattr(lm, "em", lambda *a: kept.setdefault("low", real(*a)))
    monkeypatch.setattr(lm, "em_top", lambda *a: kept.setdefault("top", real_top(*a)))
    got = lm.interpolated_scores(df, held_out=held(2), em_fold=held(3)).collect()
    return sorted(map(tuple, got), key=lambda r: (repr(r[0]), r[2])), (kept["low"], kept["top"])


@pytest.mark.parametrize("chunk", [None, 40_000])
def test_scores_equal_a_plain_model(docs, monkeypatch, chunk):
    if chunk:
        monkeypatch.setattr(lm, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(lm, "RANGE_TOKENS", 3000)
    got, lam = scored(docs, monkeypatch)
    for g, w in zip(got, plain([(r.doc_id, r.text) for r in docs.collect()], *lam), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)
    out = [g for g in got if g[1]]
    assert sum(g[6] for g in out) > sum(g[5] for g in out)


def test_em_sees_the_counts_without_the_fold(docs, monkeypatch):
    """The histograms' cells, counted plainly."""
    seen = []
    real, real_top = lm.em, lm.em_top
    monkeypatch.setattr(lm, "em", lambda c, n, u: seen.append((c, n)) or real(c, n, u))
    monkeypatch.setattr(lm, "em_top", lambda c, n: seen.append((c, n)) or real_top(c, n))
    lm.interpolated_scores(docs, held_out=held(2), em_fold=held(3)).count()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    uni, bi, tri, ctx, texts = counts(rows, lambda i: crc(i) % 7 not in (2, 3))
    steps, want, want_top = lm.FINE * lm.DEPTH + 1, Counter(), Counter()
    step = lambda p: int(lm._step(np.array([p]))[0])
    for i, t in rows:
        if crc(i) % 7 == 3:
            w = tokens(t)
            for f, h, x in zip(["<s>", "<s>", *w], ["<s>", *w], w, strict=False):
                c, d = texts if h == "<s>" else uni[h], ctx[f, h]
                want[bucket(c), step(bi[h, x] / c if c else 0), step(uni[x] / sum(uni.values()))] += 1
                want_top[bucket(d), step(tri[f, h, x] / d if d else 0)] += 1
    (c, n), (c3, n3) = seen
    assert {(x // steps**2, x // steps % steps, x % steps): k for x, k in zip(c.tolist(), n.tolist(), strict=True)} == want
    got = Counter()
    for x, k in zip(c3.tolist(), n3.tolist(), strict=True):
        got[x // steps**2, x // steps % steps] += k
    assert got == want_top


def test_words_of_one_structure_are_not_known(spark):
    tm = ["".join("ab"[(k.bit_count() + flip) % 2] for k in range(1024)) for flip in (0, 1)]
    train, out = next(i for i in range(50) if crc(i) % 7 not in (2, 3)), next(i for i in range(50) if crc(i) % 7 == 2)
    df = spark.createDataFrame([(train, tm[0]), (out, tm[1])], "doc_id long, text string")
    assert {r.doc_id: r.n_known for r in lm.interpolated_scores(df, held_out=held(2), em_fold=held(3)).collect()} == {train: 2, out: 1}


def test_edge_cases(odd, none, monkeypatch):
    got, lam = scored(odd, monkeypatch)
    want = plain([(r.doc_id, r.text) for r in odd.collect()], *lam)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-7)
    assert lm.interpolated_scores(none, held_out=held(2), em_fold=held(3)).count() == 0


def test_no_training_rows(docs):
    r = lm.interpolated_scores(docs, held_out=F.lit(True), em_fold=F.lit(False)).first()
    assert (r.n_known, r.train_tokens) == (0, 0) and math.isfinite(r.score)


def test_em_finds_the_likeliest_weights():
    rng = np.random.default_rng(1)
    steps = lm.FINE * lm.DEPTH + 1
    p2, p1 = rng.integers(0, 40, 300), rng.integers(20, 80, 300)
    cells, n = (3 * steps + p2) * steps + p1, rng.integers(1, 50, 300).astype(float)
    lam = lm.em(cells, n, 1e-6)
    value = np.concatenate([[0], 2.0 ** -(np.arange(steps - 1) / lm.FINE)])
    like = lambda w: (n * np.log(np.stack([value[p2], value[p1], np.full(300, 1e-6)], 1) @ w)).sum()
    best = max(like(np.array([a, b, 1 - a - b])) for a in np.linspace(0, 1, 60) for b in np.linspace(0, 1 - a, 60) if 1 - a - b > 1e-9)
    assert like(lam[3]) >= best - 1e-2 * abs(best) and np.allclose(lam.sum(1), 1)


def test_weights_make_a_distribution(docs, monkeypatch):
    """Over all known words, the end and one unknown class the probabilities after a context sum to one."""
    _, (low, top) = scored(docs, monkeypatch)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    uni, bi, tri, ctx, _ = counts(rows, lambda i: crc(i) % 7 != 2)
    n, v = sum(uni.values()), len(uni)
    for (f, h), d in [x for x in ctx.most_common(12) if x[0][1] != "<s>"][:3]:
        c, (t3, t2) = uni[h], top[bucket(d)]
        l2, l1, l0 = low[bucket(c)]
        total = sum(t3 * tri[f, h, x] / d + t2 * (l2 * bi[h, x] / c + l1 * uni[x] / n + l0 / (v + 1)) for x in uni) + t2 * l0 / (v + 1)
        assert total == pytest.approx(1)


def test_trigrams_help(spark):
    """Held-out texts are likelier than under the bigram model alone."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    full = lm.interpolated_scores(df, held_out=held(2), em_fold=held(3)).where("held_out").agg(F.sum("score")).first()[0]
    real = lm.em_top
    try:
        lm.em_top = lambda c, n: np.tile([0.0, 1.0], (lm.BUCKETS, 1))
        two = lm.interpolated_scores(df, held_out=held(2), em_fold=held(3)).where("held_out").agg(F.sum("score")).first()[0]
    finally:
        lm.em_top = real
    assert full > two
