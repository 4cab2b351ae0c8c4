import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions import any_, count_, max_, min_, sum_
from weirflow.model import GroupKey
from weirflow.operators import fold, fold_with, summarize

KINDS = {"z": "BOOLEAN", "b": "TINYINT", "s": "SMALLINT", "i": "INT", "j": "BIGINT", "f": "FLOAT", "d": "DOUBLE", "dec": "DECIMAL(18,2)", "str": "STRING", "date": "DATE", "at": "TIMESTAMP_NTZ"}
EPOCH = dt.datetime(1970, 1, 1)


@pytest.fixture
def values(spark):
    rows = [(i % 2, i % 2 == 0, i, i, i, i, float(i), float(i), decimal.Decimal(i), str(i), EPOCH.date() + dt.timedelta(i), EPOCH + dt.timedelta(seconds=i)) for i in range(100)]
    return spark.createDataFrame(rows, "key INT, " + ", ".join(f"{n} {t}" for n, t in KINDS.items()))


def test_summarize_over_all_types(values):
    sums = ["b", "s", "i", "j", "f", "d", "dec"]
    f = {f"{n}_any": any_(n) for n in KINDS} | {f"{n}_sum": sum_(n) for n in sums} | {f"{n}_max": max_(n) for n in KINDS} | {f"{n}_min": min_(n) for n in KINDS} | {"n": count_("i")}
    out = summarize(values, ["key"], f)
    kinds = {x.name: x.dataType for x in out.schema}
    assert all(kinds[f"{n}_sum"] == T.LongType() for n in "bsij") and all(kinds[f"{n}_sum"] == T.DoubleType() for n in "fd") and isinstance(kinds["dec_sum"], T.DecimalType)
    got = {r.key: r for r in out.collect()}
    for k, total in ((0, 2450), (1, 2500)):
        r = got[k]
        assert all(int(r[f"{n}_sum"]) == total for n in sums) and r.n == 50
        assert all(int(r[f"{n}_max"]) == 98 + k and int(r[f"{n}_min"]) == k for n in sums)
        assert (r.str_max, r.str_min) == (str(98 + k), str(k)) and r.z_max == (k == 0)
        assert (r.date_max - r.date_min).days == 98 and r.at_min == EPOCH + dt.timedelta(seconds=k)


@pytest.mark.parametrize("folding", [sum_, max_, min_])
def test_nulls_raise(spark, folding):
    d = spark.createDataFrame([(1, 1), (1, None)], "k INT, n INT")
    with pytest.raises(Exception, match="k_by.n must not be null"):
        summarize(d, ["k"], {"x": folding("n")}, "k_by").collect()
    r = summarize(d, ["k"], {"c": count_("n"), "a": any_("n", ("n",))}).first()
    assert (r.c, r.a) == (2, None)


def test_empty_grouping(spark):
    d = spark.createDataFrame([(1,), (2,)], "n INT")
    assert summarize(d, [], {"s": sum_("n")}).collect()[0].s == 3
    assert summarize(d.where("n > 5"), [], {"s": sum_("n")}).count() == 0


def test_null_and_float_keys_group(spark):
    d = spark.createDataFrame([(None,), (None,), (0.0,), (-0.0,), (float("nan"),), (float("nan"),)], "k DOUBLE")
    assert summarize(d, ["k"], {"n": count_()}).count() == 3


def test_partial_sums_form_before_the_shuffle(values):
    plan = summarize(values, ["key"], {"s": sum_("i")})._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan


def test_fold_forms_agree(spark):
    d = spark.createDataFrame([(i % 3 if i else None, i, f"s{i}") for i in range(50)], "k INT, i INT, s STRING")
    key = GroupKey.of("=k", "+i")
    merge = lambda a, x: {"i": a["i"] + x["i"] + 10}
    a = fold(d, key, merge)
    b = fold_with(d, key, lambda acc, x: {**acc, "i": acc["i"] + x["i"] + 10})
    rows = lambda x: sorted((r.k if r.k is not None else -1, r.i, r.s) for r in x.collect())
    assert rows(a) == rows(b) and rows(a)[0] == (-1, 0, "s0")
    plus = lambda a, x: {"i": a["i"] + x["i"]}
    strip = lambda x: sorted((r.k if r.k is not None else -1, r.i) for r in x.collect())
    assert strip(fold(d, key, plus)) == strip(fold(d, key, plus, partial=True))
    assert fold(d, GroupKey.of("+i"), plus).count() == 1
    assert fold(d.where("i < 0"), GroupKey.of("+i"), plus).count() == 0


def test_partial_folds(spark):
    rows = [(i % 3 if i else None, i % 7 if i % 11 else None, float(i % 5), f"s{i % 4}") for i in range(200)]
    d = spark.createDataFrame(rows, "k INT, i INT, x DOUBLE, s STRING").repartition(5)
    strip = lambda x: sorted((repr(tuple(r)) for r in x.collect()))
    for merge in (
        lambda a, r: {"i": a["i"] + r["i"], "x": F.greatest(r["x"], a["x"]), "s": F.least(a["s"], r["s"])},
        lambda a, r: {"i": F.greatest(a["i"], r["i"]), "x": a["x"] + r["x"]},
        lambda a, r: {"i": F.coalesce(a["i"], F.lit(0)) + F.coalesce(r["i"], F.lit(0))},
    ):
        cols = merge(F.col("a"), F.col("r")).keys()
        one, two = (fold(d, GroupKey.of("k"), merge, partial=p).select("k", *cols) for p in (False, True))
        assert strip(one) == strip(two)
    plan = fold(d, GroupKey.of("k"), lambda a, r: {"i": a["i"] + r["i"], "x": F.greatest(a["x"], r["x"])}, partial=True)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "collect_list" not in plan
    firsts = fold(d, GroupKey.of("=k", "-x", "+s"), lambda a, r: {"i": F.greatest(a["i"], r["i"])}, partial=True)
    assert strip(firsts) == strip(fold(d, GroupKey.of("=k", "-x", "+s"), lambda a, r: {"i": F.greatest(a["i"], r["i"])}))
    equal = spark.createDataFrame([(1, 2)] * 300, "k INT, n INT").repartition(3)
    times = fold(equal, GroupKey.of("k"), lambda a, r: {"n": a["n"] * 1 + r["n"]}, partial=True)
    assert [tuple(r) for r in times.collect()] == [(1, 600)]
