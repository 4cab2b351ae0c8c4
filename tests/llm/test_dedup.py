from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import words
from weirflow.llm import dedup


def brute(rows, size, percent):
    sets, ids = [], []
    for i, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
        ids.append(i)
    parent = {i: i for i in ids if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    for k, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in where[x] if j > k).items():
            if None not in (ids[k], ids[j]) and 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(ids[k]), find(ids[j])
                parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in zip(ids, sets, strict=True)), key=repr)


def got(df, **options):
    return sorted(map(tuple, dedup.near_duplicates(df, **options).collect()), key=repr)


@pytest.mark.parametrize("size, percent", [(4, 80), (5, 80)])
def test_documents(docs, size, percent):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs, shingle=size, percent=percent) == brute(rows, size, percent)


def test_large_families_in_small_blocks(family, monkeypatch):
    rows = [(r.doc_id, r.text) for r in family.collect()]
    want = brute(rows, 4, 80)
    assert 1 < len({c for i, _, c, _ in want if i < 1000}) < 400
    assert got(family, shingle=4) == want
    monkeypatch.setattr(dedup, "BLOCK", 37)
    monkeypatch.setattr(dedup, "BLOCK_SHINGLES", 9000)
    assert got(family, shingle=4) == want


def test_a_link_from_a_member_that_is_not_the_smallest(spark):
    base = [f"w{i}" for i in range(600)]

    def edited(at, by):
        return " ".join(by if i in at else w for i, w in enumerate(base))

    light = [(i, edited({5 + 2 * i}, f"light{i}")) for i in range(40)]
    rows = [*light, (500, " ".join(base)), *((600 + k, edited({100 + 38 * j + k for j in range(13)}, f"heavy{k}")) for k in range(8))]
    want = brute(rows, 5, 80)
    assert {c for _, _, c, _ in want} == {0}
    assert {c for _, _, c, _ in brute([x for x in rows if x[0] != 500], 5, 80)} != {0}
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want


def test_edge_cases(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(odd, shingle=4) == brute(rows, 4, 80)
    assert got(none) == []


def test_ids_that_repeat_with_different_texts_tie_their_classes(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(5, a), (5, b), (1, a), (2, b), (9, "other words entirely here now")], "doc_id long, text string")
    assert {(r[0], r[2]) for r in got(df, shingle=4)} == {(5, 1), (1, 1), (2, 1), (9, 9)}


@pytest.mark.parametrize("few", [0, 1000])
def test_components_of_a_chain(spark, monkeypatch, few):
    monkeypatch.setattr(dedup, "FEW_EDGES", few)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20] + [(7, 7)], "a long, b long")
    found = {r.node: r.component for r in dedup.components(edges).collect()}
    assert found == {i: (i - 1) // 20 * 20 + 1 for i in range(1, 61) if (i - 1) % 20}


def thue_morse(n, flip):
    return "".join("ab"[(k.bit_count() + flip) % 2] for k in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_of_one_structure_are_different_words(spark, n):
    rows = [(k, f"{thue_morse(n, k % 2)}") for k in range(2)] + [(2 + k, " ".join([thue_morse(n, k % 2)] * 30 + ["x", "y"])) for k in range(2)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4) == brute(rows, 4, 80)


def test_more_ids_than_may_be_broadcast(docs, monkeypatch):
    monkeypatch.setattr(dedup, "MOST_IDS", 3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs, shingle=4) == brute(rows, 4, 80)


def test_members_of_the_largest_component_are_copied_once_a_block_of_the_rest(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(dedup, "BLOCK", 100)
    members = spark.range(20_000).select(F.lit(7).alias("h"), F.col("id").alias("rep"), F.when(F.col("id") < 19_900, 0).otherwise(F.col("id")).alias("comp"))
    out = dedup._met_in_blocks(members, "h", F.lit(0))
    assert out.where("comp = 0").count() == 19_900
    assert out.count() <= 19_900 + 100 * 200
    pairs = out.groupBy("g").agg(F.collect_set("comp").alias("c")).where("size(c) = 1").count()
    assert pairs <= 1
