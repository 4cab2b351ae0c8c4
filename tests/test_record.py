import datetime as dt

import pytest
from pyspark.sql import functions as F

from weirflow.model import GroupKey, Model, ModelError
from weirflow.operators import Selection, branch, cogroup_with, confluent, convert, empty, extend, extract, extract_with, fold_with, group_stream, logging_op, master_join, project, restructure, split, update, update_with

IL = Model.of("i INT, l BIGINT")


@pytest.fixture
def il(spark):
    return spark.createDataFrame([(i, i * 10) for i in range(10)], IL.schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_projections(il):
    assert project(il, Model.of("i INT")).columns == ["i"]
    e = extend(il, Model.of("i INT, l BIGINT, s STRING"))
    assert e.where("s is null").count() == 10
    r = restructure(il, Model.of("i INT, d DOUBLE"))
    assert r.columns == ["i", "d"] and r.where("d is null").count() == 10


@pytest.mark.parametrize("op, model", [(project, "x INT"), (extend, "i INT, s STRING"), (restructure, "i BIGINT")])
def test_projection_errors(il, op, model):
    with pytest.raises(ModelError):
        op(il, Model.of(model))


def test_update_keeps_the_model(il):
    assert rows(update(il, {"i": F.col("i") + 1, "l": F.col("i").cast("long")}))[0] == (1, 0)
    for bad in ({"l": F.lit("x")}, {"x": F.lit(1)}):
        with pytest.raises(ModelError):
            update(il, bad)

    def plus(b):
        return {"l": b["l"] + 1}

    assert rows(update_with(il, plus))[1] == (1, 11)


def test_convert_and_split(il):
    c = convert(il, {"s": F.col("i").cast("string")})
    assert rows(c.original) == rows(il) and c.converted.columns == ["s"] and c.converted.count() == 10
    s = split(il, {"id": "i"}, {"id": "l"})
    assert s.left.agg(F.sum("id")).first()[0] * 10 == s.right.agg(F.sum("id")).first()[0]


def test_extract(il):
    out = extract(il, {"one": F.array(F.struct("i")), "many": F.transform(F.sequence(F.lit(1), F.col("i") + 1), lambda x: F.struct(x.alias("x"))), "none": F.lit(None).cast("array<struct<i:int>>")})
    assert [out[k].count() for k in ("one", "many", "none")] == [10, 55, 0]

    def gen(records):
        for r in records:
            yield "a", {"i": int(r["i"])}
            for _ in range(int(r["i"])):
                yield "b", {"l": int(r["l"])}

    got = extract_with(il, gen, {"a": Model.of("i INT"), "b": Model.of("l BIGINT")})
    assert got["a"].count() == 10 and got["b"].count() == 45


def test_branch_routes_each_row_once_and_rejects_null(il):
    out = branch(il, F.when(F.col("i") < 5, "LOW").otherwise("HIGH"), ["LOW", "HIGH"])
    assert out["LOW"].count() == 5 and out["HIGH"].count() == 5
    for label in (F.when(F.col("i") < 5, "LOW"), F.lit("OTHER")):
        with pytest.raises(Exception, match="branch"):
            branch(il, label, ["LOW", "HIGH"])["LOW"].collect()


def test_logging_passes_records(il):
    for level in ("ERROR", "WARN", "INFO", "DEBUG"):
        assert rows(logging_op(il, F.concat(F.lit("i="), "i"), level)) == rows(il)


def test_confluent_and_empty(spark, il):
    assert confluent(il, il.select("l", "i"), empty(spark, IL)).count() == 20
    with pytest.raises(ModelError):
        confluent(il, il.select("i"))


def test_group_key_notation():
    k = GroupKey.of("=a", "b", "+c", "-d")
    assert k.by == ("a", "b") and k.order == (("c", True), ("d", False))


def test_strict_model():
    with pytest.raises(ModelError):
        Model.of("a ARRAY<INT>", strict=True)


def test_python_forms_keep_every_value(spark):
    big, end, nan = 9007199254740993, dt.datetime(9999, 12, 31), float("nan")
    d = spark.createDataFrame([(1, big, nan, end), (2, None, None, None), (3, big + 2, 1.5, end), (4, 5, nan, None), (5, 6, None, end), (6, 7, -0.0, end), (7, 8, 0.0, end)], "i INT, l BIGINT, d DOUBLE, t TIMESTAMP_NTZ").coalesce(1)
    text = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    want = text(d)
    model = Model.of(d)
    assert text(logging_op(d, F.lit("x"))) == want
    assert text(update_with(d, lambda r: {})) == want and text(update_with(d, lambda r: {"l": r["l"], "d": r["d"], "t": r["t"]})) == want
    assert text(extract_with(d, lambda rs: (("o", r) for r in rs), {"o": model})["o"]) == want
    assert text(group_stream(d, GroupKey.of("i"), lambda rs: (("o", r) for r in rs), {"o": model})["o"]) == want
    groups = group_stream(d, GroupKey.of("=d", "+i"), lambda rs: [("o", {"n": len(list(rs))})], {"o": Model.of("n INT")})["o"]
    assert sorted(r.n for r in groups.collect()) == [1, 2, 2, 2]
    assert text(fold_with(d, GroupKey.of("i"), lambda a, r: a)) == want and text(fold_with(d, GroupKey.of("i"), lambda a, r: a, partial=True)) == want
    both = cogroup_with([(d, GroupKey.of("i")), (d, GroupKey.of("=i"))], lambda a, b: (("o", r) for r in a if repr(r) == repr(b[0])), {"o": model})["o"]
    assert text(both) == want
    met = master_join(d, d.withColumnRenamed("l", "m"), "i", {"l": ("master", "l"), "m": ("tx", "m")}, select=Selection(fn=lambda ms, t: 0 if ms else None)).joined
    assert sorted(r.l for r in met.collect() if r.l) == [5, 6, 7, 8, big, big + 2] and all(r.l == r.m for r in met.collect())
    keyed = master_join(d, d.select("d", F.col("i").alias("k")), "d", {"i": ("master", "i"), "k": ("tx", "k")}, select=Selection(fn=lambda ms, t: 0)).joined
    assert keyed.count() == 7


def test_update_with_rejects_unknown_properties(il):
    with pytest.raises(Exception, match="no property x"):
        update_with(il, lambda r: {"x": 1}).collect()
