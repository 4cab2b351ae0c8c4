from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from weirflow.llm import mixing


def expected(sizes, weights, cap=3):
    """Shares again and again until no target is above its cap."""
    free, rest, out = set(sizes), sum(sizes.values()), {}
    while free:
        level = rest / sum(weights[n] for n in free)
        over = [n for n in free if weights[n] * level >= cap * sizes[n]]
        if not over:
            break
        for n in over:
            out[n] = cap * sizes[n]
            rest -= out[n]
            free.discard(n)
    return out | {n: weights[n] * level for n in free}


def check(df, got, near):
    rows = got.collect()
    assert len(rows) == df.count() and got.columns[: len(df.columns)] == df.columns
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        largest[r.source] = max(largest[r.source], r["__wf_size"])
        assert r["__wf_size"] == len(words(r.text)) and 0 <= r["__wf_copies"] <= 3
        sizes[r.source] += r["__wf_size"]
        taken[r.source] += r["__wf_size"] * r["__wf_copies"]
    names = sorted(x for x in sizes if x is not None) + ([None] if None in sizes else [])
    want = expected(sizes, {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)})
    for r in rows:
        assert r["__wf_source_size"] == sizes[r.source] and r["__wf_target"] == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
    for n in names:
        # in the order of sizes one document may fall on either side of each mark
        assert abs(taken[n] - want[n]) <= largest[n] + near * want[n], n
    return sorted((repr(r.doc_id), r["__wf_copies"]) for r in rows)


def test_targets_and_draws(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a = check(df, mixing.plan_mix(df), 0.02)
    assert a == check(df, mixing.plan_mix(df.repartition(5)), 0.02)
    monkeypatch.setattr(mixing, "MOST_SOURCES", 0)
    assert a == check(df, mixing.plan_mix(df), 0.02)


def test_emitted_rows_are_the_copies(docs):
    plan = {r.doc_id: r["__wf_copies"] for r in mixing.plan_mix(docs).collect()}
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    seen = defaultdict(int)
    for r in got.collect():
        seen[r.doc_id] += 1
    assert dict(seen) == {k: n for k, n in plan.items() if n}


def test_bernoulli_rate(spark):
    df = spark.createDataFrame([(i, "w " * 10, s) for i in range(6000) for s in "ab" if i % 2 == (s == "b")], "doc_id long, text string, source string")
    rows = mixing.plan_mix(df).groupBy("source", "__wf_copies").count().collect()
    n = {(r.source, r["__wf_copies"]): r["count"] for r in rows}
    # 3000 documents each; targets 5/7 and 2/7 of 60000 words: rates 1.4286 and 0.5714; five standard deviations of a draw for each
    assert set(n) == {("a", 1), ("a", 2), ("b", 0), ("b", 1)}
    assert abs(n["a", 2] - 3000 * 3 / 7) < 136 and abs(n["b", 1] - 3000 * 4 / 7) < 136


def test_every_document_has_the_fraction_as_its_probability(spark):
    # 200 sources of the same sizes, each with a shift of its own; weights 1 and 3 make rates 0.5 and 1.5
    rows = [(k * 100 + i, "w " * (1 + i * i % 40 + (900 if i == 7 else 0)), f"{'ab'[k % 2]}{k}") for k in range(400) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([(f"{'ab'[k % 2]}{k}", 1 + 2 * (k % 2)) for k in range(400)], "source string, weight int")
    found = mixing.plan_mix(df, weights=weights).groupBy(F.substring("source", 1, 1).alias("s"), (F.col("doc_id") % 100).alias("i")).agg(F.avg("__wf_copies").alias("mean"), F.min("__wf_copies").alias("lo")).collect()
    assert len(found) == 60
    for r in found:
        want = 0.5 if r.s == "a" else 1.5
        assert abs(r["mean"] - want) < 5 * 0.5 / 200**0.5 and r.lo == int(want)


def test_edge_cases(odd, none):
    check(odd, mixing.plan_mix(odd), 0)
    assert mixing.mix(none).count() == 0 and mixing.plan_mix(none).count() == 0


def test_given_weights(spark, docs):
    w = spark.createDataFrame([("src1", 1), ("src2", 3)], "source string, weight int")
    rows = mixing.plan_mix(docs, weights=w, max_repeat=10).select("source", "__wf_target", "__wf_copies", "__wf_size").collect()
    assert {r.source for r in rows if r["__wf_copies"]} == {"src1", "src2"}
    t = {r.source: r["__wf_target"] for r in rows if r["__wf_target"] is not None}
    assert t["src2"] == pytest.approx(3 * t["src1"])


def test_main_path_is_native(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_word_count(spark):
    df = spark.createDataFrame([(t,) for t in ("", " a\tb\x0bc\r\n", "a b c", None, "x")], "t string")
    assert [r[0] for r in df.select(mixing.word_count(F.col("t"))).collect()] == [0, 3, 2, 0, 1]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "s", 5, "x", "y", 7), (2, "c", "t", 6, "x", "y", 8)], "doc_id long, text string, source string, `__wf_size` int, `__wf_id` string, `a.b` string, size long")
    out = mixing.plan_mix(df)
    assert out.columns == ["doc_id", "text", "source", "__wf_size_", "__wf_id", "a.b", "size", *mixing.PLANNED]
    assert sorted((r["__wf_size_"], r["__wf_size"]) for r in out.collect()) == [(5, 2), (6, 1)]
    assert mixing.mix(df).columns == df.columns and set(map(tuple, mixing.mix(df).collect())) <= set(map(tuple, df.collect()))
