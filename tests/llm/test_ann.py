import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import ann

def asks():
    return F.col("vec_id") % 20 == 0


def exact(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i in sorted({int(i) for i in ids if i % 20 == 0}):
        v = x[np.flatnonzero(ids == i)[0]]
        own = ids != i
        s = x[own] @ v
        out[i] = [(int(ids[own][j]), float(s[j])) for j in np.lexsort((ids[own], -np.round(s, 12)))[:k]]
    return out


def compare(df, rows, k=20):
    want = exact(rows, k)
    got = {}
    for r in ann.nearest(df, asks(), k=k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i, w in want.items() if w}
    vec = {i: np.array(v, float) for i, v in rows}
    hit = total = 0
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, len(want[q]) + 1))
        for _, i, s in found:
            assert s == pytest.approx(float(vec[i] @ vec[q]), rel=1e-12, abs=1e-14)
        assert [f[1] for f in found] == [f[1] for f in sorted(found, key=lambda f: (-round(f[2], 12), f[1]))]
        hit += len({f[1] for f in found} & {i for i, _ in want[q]})
        total += len(want[q])
    return hit / total


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert compare(df, [(r.vec_id, list(r.embedding)) for r in df.collect()]) >= 0.9


def test_small_tables_are_exact(spark):
    r = np.random.default_rng(0)
    for n in (1, 2, 15, 60):
        rows = [(i, [float(np.float32(x)) for x in r.normal(size=8)]) for i in range(n)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        if n > 1:
            assert compare(df, rows) == 1
        else:
            assert ann.nearest(df, asks()).count() == 0


def test_ties_hot_vectors_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 64)
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=8)]) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(300)] + [(2000 + i, rows[20][1]) for i in range(45)]
    nan = float("nan")
    bad = [(20 * 500, None), (20 * 501, []), (20 * 502, [0.0] * 8), (20 * 503, [nan] * 8), (20 * 504, [float("inf")] + [1.0] * 7), (20 * 505, [None] + [1.0] * 7), (20 * 506, [1.0] * 3), (None, [9.0] * 8)]
    df = spark.createDataFrame([(*x, "e", 1) for x in rows + bad], "vec_id long, embedding array<float>, v string, rep int")
    assert compare(df, rows) >= 0.99
    assert ann.nearest(df.where("false"), asks()).count() == 0
    assert ann.nearest(df.where("vec_id % 20 != 0"), asks()).count() == 0


def test_ties_between_different_vectors(spark):
    """Vectors of small whole numbers: many equal inner products, also at the last rank."""
    r = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in r.integers(0, 2, 8)]) for i in r.permutation(300)]
    rows = [x for x in rows if any(x[1])]
    assert compare(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), rows) == 1


def test_tree_visits_every_leaf_once():
    x = np.random.default_rng(2).normal(size=(500, 6))
    t = ann.grow(x, 20)
    for reach in (0.0, 1.0):
        leaves, keys = zip(*t.visits(x[0], reach), strict=True)
        assert sorted(leaves) == list(range(t.leaves)) and list(keys) == sorted(keys, reverse=True)
    assert set(t.place(x)) <= set(range(t.leaves))


def test_grafted_trees_visit_and_place_alike():
    x = np.random.default_rng(2).normal(size=(2000, 6))
    t = ann.grow(x, 400)
    leaf = t.place(x)
    subs = {i: ann.grow(x[leaf == i], 30) for i in range(0, t.leaves, 2)}
    g = t.grafted(subs)
    assert g.leaves == t.leaves + sum(s.leaves - 1 for s in subs.values())
    assert sorted(i for i, _ in g.visits(x[0])) == list(range(g.leaves))
    deep = g.place(x)
    for i in range(t.leaves):
        own = deep[leaf == i]
        assert len(set(own)) == (subs[i].leaves if i in subs else 1) and own.max() - own.min() < len(set(own))


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(9)
    centres = r.normal(size=(60, 24)) * 3
    return [(i, [float(np.float32(v)) for v in centres[r.integers(60)] + r.normal(size=24)]) for i in range(6000)]


def test_few_leaves_are_visited_and_unseen_queries_are_found(spark, clustered, monkeypatch):
    """Recall on all queries, of which the calibration has seen a tenth, with a tree from a sample whose leaves are split in tasks."""
    monkeypatch.setattr(ann, "LEAF", 32)
    monkeypatch.setattr(ann, "SAMPLE_BYTES", 500 * 8 * 24)
    monkeypatch.setattr(ann, "CALIBRATION", 30)
    monkeypatch.setattr(ann, "SPLIT", 2)
    monkeypatch.setattr(ann, "CELL", 256)
    seen = {}
    full = ann.Search.calibrated

    def spy(self, q, truth, recall):
        out = full(self, q, truth, recall)
        seen.update(search=out, trees=out.tree.leaves)
        return out

    monkeypatch.setattr(ann.Search, "calibrated", spy)
    df = spark.createDataFrame(clustered, "vec_id long, embedding array<float>").repartition(4)
    assert compare(df, clustered) >= 0.9
    search, x = seen["search"], np.array([v for _, v in clustered])
    assert search.tree.leaves > 120  # the sample alone makes fewer
    q = x[::20]
    visited = [sum(search.sizes[i] for i in search.leaves(v, n, 42)) / len(x) for v, n in zip(q, search.need(q).tolist(), strict=True)]
    assert np.mean(visited) < 0.25


def test_clashing_names(spark):
    rows = [(i, [float(i), 1.0], "x", 1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, `a.b` string, v int, c0 int")
    assert ann.nearest(df, asks(), k=3).count() == 9
