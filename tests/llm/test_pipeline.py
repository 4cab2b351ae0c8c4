import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as p
from tests.llm.test_decontam import brute as hits
from tests.llm.test_dedup import brute as near
from tests.test_queries import TABLES, plain
from weirflow.llm import langid, mixing, queries, tokens

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), names)


def stages(spark, docs, tmp_path):
    for i, (_, f) in enumerate(p.STAGES):
        f(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        yield docs


def test_stages_against_plain_versions(spark, docs, odd, tmp_path):
    start = docs.select("*", F.lit("x").alias("a.b"), F.lit(1).alias("__wf_lang"), F.lit(2).alias("rep"), F.lit(3).alias("c0"))
    odd = odd.select(*docs.columns, "`a.b`", F.lit(1).alias("__wf_lang"), F.col("rep"), F.lit(3).alias("c0"))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    some = [r.text for r in bench.limit(3).collect()]
    more = spark.createDataFrame([(8001, f"{some[0]} and {some[1]}", "en", "src3", 1), (8002, "before it " + some[2] + " after it", "en", "src3", 1), (8003, "￾￾" * 60 + "中文字" * 80, "en", "src3", 1)], docs.schema)
    start = start.unionByName(odd).unionByName(more.select("*", F.lit("x").alias("a.b"), F.lit(1).alias("__wf_lang"), F.lit(2).alias("rep"), F.lit(3).alias("c0")))
    one, two, three, four, five = stages(spark, start, tmp_path)
    assert all(x.columns == start.columns for x in (one, two, three, four))
    assert all(r["a.b"] == "x" and r["__wf_lang"] == 1 and r.c0 == 3 for r in four.collect())
    ids = lambda df: sorted(r[0] if r[0] is not None else -1 for r in df.select("doc_id").collect())

    kept = ids(one)
    assert set(ids(start)) - set(kept) == {9001, 9002, 9003, 9004} | ({8003} - set(kept))
    assert set(ids(docs)) - set(kept) == {r.doc_id for r in docs.collect() if not any(c.isalpha() for c in r.text)}

    rows = [(r.doc_id, r.text) for r in one.collect()]
    want = sorted({i if i is not None else -1 for i, _, _, keep in near(rows, 5, 80) if keep})
    assert ids(two) == want

    found = {r[0]: r for r in hits([(r.doc_id, r.text) for r in two.collect()], [(r.item_id, r.text) for r in bench.collect()], 8)}
    assert ids(three) == sorted(i if i is not None else -1 for i, r in found.items() if r[3] < 2)
    assert 8001 not in ids(three) and 8002 in ids(three)
    left = {r.doc_id: r.text for r in three.collect()}
    assert left[8002].split() == ["before", "it", ".", "after", "it"]

    plan = {r.doc_id: r["__wf_copies"] for r in mixing.plan_mix(three).collect()}
    copies = {i: 0 for i in plan}
    for r in four.collect():
        copies[r.doc_id] += 1
        assert r.text == left[r.doc_id]
    assert copies == plan

    enc, at = tokens.Encoder(queries.tokenizer_file()).lib, 0
    out = sorted(map(tuple, five.collect()), key=lambda r: r[1])
    texts = sorted([(r.doc_id, r.text) for r in four.collect()], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for (i, t), r in zip(texts, out, strict=True):
        x = [*enc.encode(t, add_special_tokens=False).ids, 0]
        assert r == (i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)


def test_rows_that_share_an_id_stay_unless_near_copies(spark, docs):
    a, b = ([f"{x}{i}" for i in range(80)] for x in "ab")
    texts = [" ".join(a), " ".join([*a, "more"]), " ".join(b), " ".join(b), "", "", None]
    rows = [(5, t, "en", f"src{i % 2}", i) for i, t in enumerate(texts)] + [(6, "something else entirely stands here", "en", "src0", 1)]
    df = spark.createDataFrame(rows, docs.schema)
    out = [tuple(r) for r in p.near_duplicates(spark, df, SF).collect()]
    assert set(out) <= set(rows) and out.count(rows[-1]) == 1 and len(out) == 5
    left = [r[1] for r in out if r[0] == 5]
    assert sum(t in texts[:2] for t in left) == 1 and left.count(texts[2]) == 1 and left.count("") == 1 and left.count(None) == 1
    assert sorted(out, key=repr) == sorted(map(tuple, p.near_duplicates(spark, df.repartition(5), SF).collect()), key=repr)


def test_run_and_reruns_agree(spark):
    a = sorted(map(tuple, p.run(spark, SF).collect()))
    assert a and a == sorted(map(tuple, p.run(spark, SF).collect()))


def test_empty_input(spark, docs, tmp_path):
    out = list(stages(spark, docs.where("false"), tmp_path))
    assert [x.count() for x in out] == [0] * 5


def test_sure_predictions_become_the_label(spark, docs):
    labels = {r.doc_id: r.lang for r in docs.collect()}
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") % 40 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 40 == 1, F.lit("fr")).otherwise(F.col("lang")))
    got = {r.doc_id: r.lang for r in p.language(spark, wrong, SF).collect()}
    some = [i for i in got if i % 40 < 2]
    assert some and sum(got[i] == labels[i] for i in some) / len(some) > 0.9
    assert all(got[i] == labels[i] for i in got if i % 40 > 1)


def test_without_labels_nothing_readable_goes(spark, docs):
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert p.language(spark, bare, SF).count() == docs.where(F.rlike("text", F.lit(r"\p{L}"))).count()
    assert langid.UND == "und"
