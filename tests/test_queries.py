import math

import duckdb
import pytest

import __spark_entry__ as entry
from weirflow import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(round(r[i], 6) if isinstance(r[i], float) and not math.isnan(r[i]) else r[i] for i in order) for r in rows], key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def _wide_parts(spark, tmp_path, name):
    """A cogroup query and its SQL where part keys pass a million and some quantities are null."""
    lines = [(1, 5, 10.0), (1, 1_100_005, 11.0), (1, 7, 9.0), (2, 1_500_000, 3.0), (2, 20, 2.0), (3, 4, None), (3, 9, 1.0), (4, 6, None), (5, 3, 7.0), (5, 2, 7.0)]
    con = duckdb.connect()
    for t, rows, model in (("orders", [(k, "F" if k % 2 else "O") for k in range(1, 8)], "o_orderkey LONG, o_orderstatus STRING"), ("lineitem", lines, "l_orderkey LONG, l_partkey LONG, l_quantity DOUBLE")):
        spark.createDataFrame(rows, model).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df, want = entry.queries()[name](spark, str(tmp_path)), con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    return plain([tuple(r) for r in df.select(names).collect()], names), plain(want.fetchall(), names)


def test_cogroup_python_on_a_million_parts(spark, tmp_path):
    got, want = _wide_parts(spark, tmp_path, "cogroup_python")
    assert got == want


def test_cogroup_two_on_a_million_parts(spark, tmp_path):
    got, want = _wide_parts(spark, tmp_path, "cogroup_two")
    assert got == want
