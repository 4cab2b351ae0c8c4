import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weirflow.llm import _text as T
from weirflow.llm import langid, queries


@pytest.fixture(scope="module")
def model(docs):
    return langid.fit(langid.training_sample(docs, F.lit(True)))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def lengths(m, *texts):
    return m.lengths(*T.strings(pa.array(texts)))


def plain_bits(texts, text):
    """A walk along the definition: counts of every context, those kept that occur often enough, escapes by method C."""
    follow: dict[bytes, Counter] = {}
    for t in texts:
        raw = t.encode()
        for n in range(langid.ORDER + 1):
            for i in range(len(raw) - n):
                follow.setdefault(raw[i : i + n], Counter())[raw[i + n]] += 1
    kept = {c: f for c, f in follow.items() if not c or sum(f.values()) >= langid.LEAST}

    def p(ctx, b):
        if ctx not in kept:
            return p(ctx[1:], b) if ctx else 1 / 256
        c, low = kept[ctx], p(ctx[1:], b) if ctx else 1 / 256
        n, d = sum(c.values()), len(c)
        return c[b] / (n + d) if c[b] else d / (n + d) * low

    raw = text.encode()
    return -sum(math.log2(p(raw[max(0, i - langid.ORDER) : i], b)) for i, b in enumerate(raw))


def test_code_lengths_equal_a_plain_walk(spark):
    texts = {"aa": ["abracadabra abracad", "cab bad", ""], "bb": ["zabra zebra", "abba zz", "abbabba"], "cc": ["x"]}
    m = langid.fit(spark.createDataFrame([(k, t) for k, v in texts.items() for t in v], "lang string, text string"))
    asked = ["abracadabra", "zebra abba cab", "qé !", "b", "", "xx", "abbabba abracad" * 3]
    got = lengths(m, *asked)
    for k, name in enumerate(m.languages):
        assert got[:, k] == pytest.approx([plain_bits(texts[name], t) for t in asked], rel=1e-5)


def test_query_equals_a_plain_walk(spark, docs):
    """Predictions and scores of the whole query, from the sample that the query takes."""
    sf = "/root/testdata/sf0.001"
    held = F.pmod(queries.id_crc32("doc_id"), F.lit(4)) == 2
    sample: dict[str, list] = {}
    for r in langid.training_sample(docs, ~held).collect():
        sample.setdefault(r.lang, []).append(r.text)
    rows = {r.doc_id: r.text for r in docs.collect()}
    short = sorted(rows, key=lambda i: len(rows[i] or ""))[:25]
    got = {r.doc_id: r for r in queries.op7_language(spark, sf).collect()}
    assert set(got) == set(rows)
    for i in short:
        t, bits = rows[i] or "", {k: plain_bits(v, rows[i] or "") for k, v in sorted(sample.items())}
        if not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        best = min(bits, key=bits.get)
        w = min(1.0, 64 / len(t.encode()))
        assert got[i].lang_pred == best and got[i].score == pytest.approx(1 / sum(2 ** -min((b - bits[best]) * w, 1000) for b in bits.values()), rel=1e-3)


def test_segments_and_batches_do_not_matter(model, docs, monkeypatch):
    d = ["the thing of the and " * 50, "", "ein Ding " * 7, "x"]
    whole = lengths(model, *d)
    monkeypatch.setattr(langid.T, "SEGMENT", 17)
    assert np.allclose(lengths(model, *d), whole)
    for k, t in enumerate(d):
        assert np.allclose(lengths(model, t)[0], whole[k])


def test_many_languages_beyond_what_is_broadcast(spark, monkeypatch):
    r = random.Random(4)
    tongues = {f"l{k:03}": ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 6))) for _ in range(12)] for k in range(230)}
    say = lambda k: " ".join(r.choice(tongues[k]) for _ in range(60))
    docs = spark.createDataFrame([(i, say(k), k) for i, k in enumerate(k for k in tongues for _ in range(3))], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(i, say(k), k) for i, k in enumerate(sorted(tongues))], "doc_id long, text string, want string").coalesce(2)
    m = langid.fit(langid.training_sample(docs, F.lit(True)))
    assert len(m.languages) == 230 and m.trees
    one = {r.doc_id: (r["__wf_lang"], r["__wf_score"]) for r in langid.identify(asked, m).collect()}
    assert all(one[i][0] == k for i, k in enumerate(sorted(tongues)))
    monkeypatch.setattr(langid, "MOST_BYTES", 10)
    monkeypatch.setattr(langid, "MOST_KEPT", 200_000)
    far = langid.fit(langid.training_sample(docs, F.lit(True)))
    assert not far.trees
    assert {r.doc_id: (r["__wf_lang"], r["__wf_score"]) for r in langid.identify(asked.limit(20), far).collect()} == {i: one[i] for i in range(20)}


def test_the_sample_is_bounded_and_whole(spark):
    rows = [(i, f"text {i} " * 20, "aa") for i in range(3000)] + [(5000 + i, "w " * 1000, "bb") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = {t for _, t, _ in rows}
    got = langid.training_sample(df, F.lit(True), per_language=100, most_bytes=5000).collect()
    assert 10 < sum(r.lang == "aa" for r in got) <= 100 and sum(r.lang == "bb" for r in got) == 2 and all(r.text in texts for r in got)
    assert sorted(got) == sorted(langid.training_sample(df.repartition(7), F.lit(True), per_language=100, most_bytes=5000).collect())


def test_edge_cases(odd, none, model):
    got = langid.identify(odd, model)
    assert got.columns == [*odd.columns, "__wf_lang", "__wf_score", "__wf_bits"]
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == odd.count()
    for i in (9001, 9002, 9003, 9004):
        assert by[i]["__wf_lang"] == "und" and by[i]["__wf_score"] == 0
    for i in (9005, 9009, 9010, 9011):
        assert by[i]["__wf_lang"] in model.languages and 0 < by[i]["__wf_score"] <= 1
    assert langid.identify(none, model).count() == 0


def test_nothing_learned(odd):
    m = langid.fit(langid.training_sample(odd, F.lit(False)))
    assert m.languages == [] and {r[0] for r in langid.identify(odd, m).select("__wf_lang").collect()} == {"und"}


def test_prediction_does_not_see_labels(docs, model):
    a = langid.identify(docs.select("doc_id", "text"), model).select("doc_id", "__wf_lang")
    b = langid.identify(docs.select("doc_id", "text", F.lit("xx").alias("lang")), model).select("doc_id", "__wf_lang")
    assert sorted(a.collect()) == sorted(b.collect())


def test_clashing_names(spark, model):
    df = spark.createDataFrame([(1, "the thing", "mine", "ab")], "doc_id long, text string, `__wf_lang` string, `a.b` string")
    out = langid.identify(df, model)
    assert out.columns == ["doc_id", "text", "__wf_lang_", "a.b", "__wf_lang", "__wf_score", "__wf_bits"] and out.first()["__wf_lang_"] == "mine"
