import pytest
from pyspark.sql import functions as F

from weirflow import queries as core
from weirflow.model import GroupKey
from weirflow.operators import Selection, cogroup, cogroup_stream, group_sort, group_sort_with, group_stream, master_branch, master_check, master_join, master_join_update, view
from weirflow.operators.group import cogroup_with
from weirflow.model import Model, ModelError

FOO, BAR = "id INT, foo STRING", "id INT, fooId INT, bar STRING"


@pytest.fixture
def foo(spark):
    return spark.createDataFrame([(i, f"foo{i}") for i in range(10)] + [(None, "nul")], FOO)


@pytest.fixture
def bar(spark):
    return spark.createDataFrame([(10 + j, i, f"bar{10 + j}") for i in range(10) for j in range(i)] + [(99, None, "n"), (98, 77, "m")], BAR)


MAP = {"id": ("tx", "fooId"), "foo": ("master", "foo"), "bar": ("tx", "bar")}
KEY = {"fooId": "id"}


@pytest.mark.parametrize("broadcast", [None, True, False])
def test_join_family_partitions_the_transactions(foo, bar, broadcast):
    n = bar.count()
    j = master_join(foo, bar, KEY, MAP, broadcast=broadcast)
    assert j.joined.count() == n - 1 and [r.id for r in j.missed.collect()] == [98]
    assert j.joined.where("id is null").first().foo == "nul"
    u = master_join_update(foo, bar, KEY, lambda m, t: {"bar": F.concat(t["bar"], m["foo"])}, broadcast=broadcast)
    assert u.updated.where("fooId = 3").first().bar.endswith("foo3") and u.missed.count() == 1
    c = master_check(foo, bar, KEY, broadcast=broadcast)
    assert (c.found.count(), c.missed.count()) == (n - 1, 1)
    b = master_branch(foo, bar, KEY, lambda m, t: F.when(m.isNull() | (m["id"] < 5), "LOW").otherwise("HIGH"), ["LOW", "HIGH"], broadcast=broadcast)
    assert b["LOW"].count() + b["HIGH"].count() >= n - 1
    assert b["LOW"].where("fooId = 77").count() == 1


def test_at_most_one_master(spark, bar):
    many = spark.createDataFrame([(i, f"foo{i}-{k}") for i in range(10) for k in (2, 1, 3)], FOO)
    j = master_join(many, bar, KEY, MAP, order=["foo"])
    assert j.joined.count() == 45 and all(r.foo.endswith("-1") for r in j.joined.collect())
    d = master_join(many, bar, KEY, MAP, select=Selection(order=lambda m, t: [-F.length(m["foo"]), m["foo"]])).joined
    assert d.count() == 45


def test_selection_forms_agree(foo, bar):
    even = lambda m, t: t["id"] % 2 == 0
    forms = [Selection(cond=even), Selection(cond=even, ranked=True), Selection(fn=lambda ms, t: 0 if ms and t["id"] % 2 == 0 else None)]
    got = []
    for s in forms:
        j = master_join(foo, bar, KEY, MAP, select=s)
        got.append((sorted((r.id or -1, r.foo, r.bar) for r in j.joined.collect()), sorted(r.bar for r in j.missed.collect())))
        c = master_check(foo, bar, KEY, select=s)
        assert c.found.count() + c.missed.count() == bar.count()
    assert got[0] == got[1] == got[2] and got[0][0] and got[0][1]


def test_null_branch_label_raises(foo, bar):
    with pytest.raises(Exception, match="must not be null"):
        master_branch(foo, bar, KEY, lambda m, t: F.when(m["id"] > 100, "A"), ["A"])["A"].collect()


def test_join_errors(foo, bar):
    with pytest.raises(ModelError):
        master_join(foo, bar, KEY, {"x": ("master", "nope")})
    with pytest.raises(ModelError):
        master_join_update(foo, bar, KEY, lambda m, t: {"bar": F.lit(1)})


def test_cogroup_visits_the_union_of_keys(spark):
    foos = spark.createDataFrame([(i,) for i in range(100)], "id INT")
    bars = spark.createDataFrame([(j, i) for i in range(100) for j in range(i)], "id INT, fooId INT")
    one = lambda f, b: (F.size(f) == 1) & (F.size(b) == 1)
    none = F.array().cast("array<struct<id:int>>")
    ids = lambda x: F.transform(x, lambda r: F.struct(r["id"].alias("id")))
    out = cogroup(
        [(foos, GroupKey.of("id")), (bars, GroupKey.of("=fooId", "+id"))],
        {"ok": lambda f, b: F.when(one(f, b), ids(f)).otherwise(none), "foo": lambda f, b: F.when(one(f, b), none).otherwise(ids(f)), "bar": lambda f, b: F.when(one(f, b), none).otherwise(ids(b))},
    )
    assert [out[k].count() for k in ("ok", "foo", "bar")] == [1, 99, 4949]


def test_cogroup_three_sides_with_orders_and_null_keys(spark):
    a, b, c = (spark.createDataFrame(r, "k STRING, n INT") for r in ([("x", 1), (None, 5)], [("x", 10), ("x", 1)], [("x", 1), ("x", 10), ("y", 2)]))
    inputs = [(a, GroupKey.of("k")), (b, GroupKey.of("=k", "+n")), (c, GroupKey.of("=k", "-n"))]
    n = lambda x: F.transform(x, lambda r: r["n"])
    got = cogroup(inputs, {"o": lambda x, y, z: F.array(F.struct(n(x).alias("x"), n(y).alias("y"), n(z).alias("z")))})["o"].collect()
    want = sorted([([1], [1, 10], [10, 1]), ([5], [], []), ([], [], [2])])
    assert sorted((r.x, r.y, r.z) for r in got) == want

    def run(x, y, z):
        yield "o", {"t": ",".join(str(r["n"]) for s in (x, y, z) for r in s)}

    got = cogroup_with(inputs, run, {"o": Model.of("t STRING")})["o"].collect()
    assert sorted(r.t for r in got) == ["1,1,10,10,1", "2", "5"]


def test_empty_grouping(spark):
    d = spark.createDataFrame([(2,), (1,)], "n INT")
    top = {"t": lambda x, w: x.withColumn("i", F.row_number().over(w)).where("i = 1")}
    assert group_sort(d, GroupKey.of("+n"), top)["t"].first().n == 1
    assert group_sort(d.where("n > 5"), GroupKey.of("+n"), top)["t"].count() == 0
    out = group_stream(d, GroupKey.of("-n"), lambda rows: iter([("o", {"s": "".join(str(r["n"]) for r in rows)})]), {"o": Model.of("s STRING")})["o"]
    assert [r.s for r in out.collect()] == ["21"]


def test_group_sort_python(spark):
    d = spark.createDataFrame([(i % 3, i) for i in range(30)] + [(None, 7)], "k INT, n INT")

    def two(rows):
        for r in rows[:2]:
            yield "top", r
        yield "size", {"k": rows[0]["k"], "n": len(rows)}

    out = group_sort_with(d, GroupKey.of("=k", "-n"), two, {"top": Model.of("k INT, n INT"), "size": Model.of("k INT, n INT")})
    assert sorted((r.k if r.k is not None else -1, r.n) for r in out["top"].collect()) == [(-1, 7), (0, 24), (0, 27), (1, 25), (1, 28), (2, 26), (2, 29)]
    assert sorted(r.n for r in out["size"].collect()) == [1, 10, 10, 10]


def test_views(spark, foo):
    v = view(foo, "=id", "+foo")
    d = spark.createDataFrame([(3,), (50,), (None,)], "k INT")
    got = {r.k: [x.foo for x in r.found] for r in v.attach(d, [F.col("k")], "found").collect()}
    assert got == {3: ["foo3"], 50: [], None: ["nul"]}
    for bad in ([], [F.col("k").cast("string")]):
        with pytest.raises(ModelError):
            v.attach(d, bad, "found")
    assert v.table().value[(3,)][0]["foo"] == "foo3"


def test_latest_master(spark):
    m = spark.createDataFrame([(1, 10, "a"), (1, 10, "b"), (1, 20, "c"), (None, 5, "n"), (2, None, "never")], "k INT, at INT, v STRING")
    t = spark.createDataFrame([(1, 9), (1, 10), (1, 15), (1, 25), (None, 6), (2, 100), (1, None), (3, 1)], "k INT, now INT")
    j = master_join(m, t, "k", {"now": ("tx", "now"), "v": ("master", "v")}, select=Selection(latest=("at", "now"), order=lambda m, t: [m["v"]]))
    assert sorted((r.now, r.v) for r in j.joined.collect()) == [(6, "n"), (10, "a"), (15, "a"), (25, "c")]
    assert j.missed.count() == 4
    same = Selection(cond=lambda m, t: m["at"] <= t["now"], order=lambda m, t: [-m["at"], m["v"]])
    k = master_join(m, t, "k", {"now": ("tx", "now"), "v": ("master", "v")}, select=same)
    assert sorted(map(tuple, j.joined.collect())) == sorted(map(tuple, k.joined.collect()))


def test_streamed_cogroup_reads_long_groups_once(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k INT, v STRING")
    b = spark.range(200_000).select((F.col("id") % 2 + 1).cast("int").alias("k"), "id")

    def run(left, right):
        first = next(right, None)
        yield "o", {"v": left[0]["v"], "first": first and first["id"], "n": (first is not None) + sum(1 for _ in right)}

    out = cogroup_stream([(a, GroupKey.of("k")), (b, GroupKey.of("=k", "-id"))], run, {"o": Model.of("v STRING, first BIGINT, n BIGINT")})["o"]
    assert sorted(map(tuple, out.collect())) == [("x", 199_998, 100_000), ("y", 199_999, 100_000), ("z", None, 0)]
    flipped = cogroup_stream([(b, GroupKey.of("=k", "-id")), (a, GroupKey.of("k"))], lambda x, y: run(y, x), {"o": Model.of("v STRING, first BIGINT, n BIGINT")}, streamed=0)["o"]
    assert sorted(map(tuple, flipped.collect())) == sorted(map(tuple, out.collect()))


_NAN = float("nan")
_MS = [(k, a, v) for k in (1, None) for a, v in [(-0.0, 5), (0.0, 4), (1.5, 9), (2.5, 1), (2.5, 0), (7.0, -3), (_NAN, -9), (None, -99)]]
_TS = [(k, b) for k in (1, None, 3) for b in (-1.0, 0.0, -0.0, 1.5, 2.0, 2.5, 9.0, _NAN, None)]
_COMPARED = {
    "<=": (lambda m, t: m["a"] <= t["b"], lambda a, b: a <= b),
    "<": (lambda m, t: t["b"] > m["a"], lambda a, b: a < b),
    ">=": (lambda m, t: (m["a"] >= t["b"]) & (m["v"] < 5) & (t["b"] != 1.5), lambda a, b: a >= b),
    ">": (lambda m, t: t["b"] < m["a"], lambda a, b: a > b),
    "none": (lambda m, t: (m["v"] < 5) & (t["b"] != 1.5), lambda a, b: True),
}


def _one_comparison(spark, how, ranked):
    m, t = spark.createDataFrame(_MS, "k INT, a DOUBLE, v INT"), spark.createDataFrame([(i, k, b) for i, (k, b) in enumerate(_TS)], "i INT, k BIGINT, b DOUBLE")
    cond, says = _COMPARED[how]
    both = master_join(m, t, "k", {"i": ("tx", "i"), "v": ("master", "v")}, select=Selection(cond=cond, order=lambda m, t: [-m["v"]], ranked=ranked))
    high = lambda x: (x != x, 0 if x != x else x)
    want = {}
    for i, (k, b) in enumerate(_TS):
        own = how in (">=", "none")
        if b is None or own and b == 1.5:
            continue
        met = [v for mk, a, v in _MS if mk == k and (how == "none" or a is not None and says(high(a), high(b))) and not (own and v >= 5)]
        if met:
            want[i] = max(met)
    return both, want


@pytest.mark.parametrize("how", _COMPARED)
def test_ranked_selection_by_one_comparison_makes_no_pairs(spark, how):
    both, want = _one_comparison(spark, how, True)
    assert {r.i: r.v for r in both.joined.collect()} == want
    assert sorted(r.i for r in both.missed.collect()) == [i for i in range(len(_TS)) if i not in want]
    plan = both.joined._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and (how == "none" or "Join" not in plan)


@pytest.mark.parametrize("ranked", [False, True])
def test_selection_of_another_form_tries_every_pair(spark, ranked):
    m, t = spark.createDataFrame(_MS, "k INT, a DOUBLE, v INT"), spark.createDataFrame([(i, 1 if i % 2 else None) for i in range(12)], "i INT, k INT")
    forms = [(lambda m, t: (m["v"] + t["i"]) % 3 == 0, lambda m, t: [-m["v"]]), (lambda m, t: (m["v"] < t["i"]) & (m["v"] > t["i"] - 7), lambda m, t: [-m["v"]]), (lambda m, t: m["v"] <= t["i"], lambda m, t: [F.abs(m["v"] + t["i"]), m["v"]])]
    says = [(lambda v, i: (v + i) % 3 == 0, lambda v, i: -v), (lambda v, i: i - 7 < v < i, lambda v, i: -v), (lambda v, i: v <= i, lambda v, i: (abs(v + i), v))]
    for (cond, order), (met, rank) in zip(forms, says, strict=True):
        got = master_join(m, t, "k", {"i": ("tx", "i"), "v": ("master", "v")}, select=Selection(cond=cond, order=order, ranked=ranked)).joined
        want = {i: min(able, key=lambda v, i=i: rank(v, i)) for i in range(12) if (able := [v for k, _, v in _MS if k == (1 if i % 2 else None) and met(v, i)])}
        assert {r.i: r.v for r in got.collect()} == want


@pytest.mark.parametrize("how", _COMPARED)
def test_scanned_selection_by_one_comparison_gathers_no_masters(spark, how):
    both, want = _one_comparison(spark, how, False)
    assert {r.i: r.v for r in both.joined.collect()} == want
    assert sorted(r.i for r in both.missed.collect()) == [i for i in range(len(_TS)) if i not in want]
    assert "collect_list" not in both.joined._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("how", _COMPARED)
def test_either_is_both_outputs_by_one_computation(spark, how):
    both, want = _one_comparison(spark, how, False)
    one = both.either(lambda t: {"i": t["i"], "v": F.lit(-1)})
    assert sorted((r.i, r.v) for r in one.collect()) == [(i, want.get(i, -1)) for i in range(len(_TS))]
    assert [(f.name, f.dataType) for f in one.schema] == [(f.name, f.dataType) for f in both.joined.schema]
    assert str(one._jdf.queryExecution().optimizedPlan()).count("Window ") == (how != "none")
    for bad in ({"i": F.lit(1)}, {"i": F.lit(1), "v": F.lit("x")}):
        with pytest.raises(ModelError):
            both.either(lambda t: bad)  # noqa: B023


def test_either_keeps_a_masters_null(spark):
    m, t = spark.createDataFrame([(1, None), (2, "b")], "k INT, v STRING"), spark.createDataFrame([(1,), (2,), (3,), (None,)], "k INT")
    j = master_join(m, t, "k", {"k": ("tx", "k"), "v": ("master", "v")})
    assert sorted(map(tuple, j.either(lambda t: {"k": t["k"], "v": F.lit("none")}).collect()), key=repr) == [(1, None), (2, "b"), (3, "none"), (None, "none")]


@pytest.mark.parametrize("name", ["master_selection_as_of", "master_selection_ranked", "master_selection_scanned"])
def test_selection_queries_sort_once(spark, name):
    plan = str(core.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan())
    assert plan.count("Window ") == 1


def _shuffled_rows(df) -> int:
    """Rows that the exchanges of a frame wrote when it was collected."""
    def of(p):
        kind = p.getClass().getSimpleName()
        below = [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        return sum(map(of, below)) + (p.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0)

    return of(df._jdf.queryExecution().executedPlan())


def test_streamed_cogroup_packs_frequent_keys(spark):
    a = spark.createDataFrame([(1.0, "x"), (0.0, "y"), (float("nan"), "n"), (None, "z"), (-7.0, "alone")], "k DOUBLE, v STRING")
    k = F.when(F.col("id") % 5 == 0, F.lit(-0.0)).when(F.col("id") % 5 == 1, F.lit(0.0)).when(F.col("id") % 5 == 2, F.lit(float("nan"))).when(F.col("id") % 5 == 3, F.lit(1.0))
    b = spark.range(0, 200_000, 1, 4).select(F.when(F.col("id") % 2000 == 1999, F.col("id").cast("double")).otherwise(k).alias("k"), (F.col("id") + 9007199254740993).alias("big"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"), F.lit("9999-12-31 23:59:59").cast("timestamp_ntz").alias("until"), (F.col("id") / 7).cast("decimal(20,3)").alias("d"))

    def run(left, right):
        rows = list(right)
        assert all(list(r) == ["k", "big", "s", "until", "d"] and r["until"].year == 9999 for r in rows)
        yield "o", {"v": left[0]["v"] if left else None, "n": len(rows), "big": sum(r["big"] - 9007199254740993 for r in rows), "s": sum(int(r["s"]) for r in rows if r["s"] is not None), "d": sum((r["d"] for r in rows), 0)}

    out = cogroup_stream([(a, GroupKey.of("k")), (b, GroupKey.of("k"))], run, {"o": Model.of("v STRING, n BIGINT, big BIGINT, s BIGINT, d DECIMAL(38,3)")})["o"]
    got = sorted(map(tuple, out.collect()), key=str)
    shuffled = _shuffled_rows(out)
    cases = {v: [i for i in range(200_000) if i % 5 in of and i % 2000 != 1999] for v, of in (("x", (3,)), ("y", (0, 1)), ("n", (2,)), ("z", (4,)))} | {"alone": []}
    want = {v: (len(ids), sum(ids), sum(i for i in ids if i % 3)) for v, ids in cases.items()}
    assert {r[0]: r[1:4] for r in got if r[0]} == want
    assert sum(r[0] is None for r in got) == 100 and sum(r[2] for r in got) == sum(range(200_000))
    exact = b.agg(F.sum("d")).first()[0]
    assert sum(r[4] for r in got) == exact
    assert 100 < shuffled < 2000
    every = cogroup_stream([(a, GroupKey()), (b, GroupKey())], lambda x, y: iter([("o", {"n": len(x) + sum(1 for _ in y)})]), {"o": Model.of("n BIGINT")})["o"]
    assert every.first().n == 200_005
    wide = b.select("k", F.repeat(F.lit("w"), 3000).alias("w")).limit(2000)
    long = cogroup_stream([(a, GroupKey.of("k")), (wide, GroupKey.of("k"))], lambda x, y: iter([("o", {"n": sum(len(r["w"]) for r in y)})]), {"o": Model.of("n BIGINT")})["o"]
    assert long.agg(F.sum("n")).first()[0] == 6_000_000
