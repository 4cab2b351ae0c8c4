import datetime as dt
import decimal
import json
import os

import pytest
from pyspark.sql import functions as F

from weirflow.context import MissingArgument, RunContext
from weirflow.functions import PathPattern
from weirflow.model import Model
from weirflow.sources import Counters, FlatOutput, GroupOutput, StagedOutput, delete_matching, read_direct, read_staged, recover, write_outputs
from weirflow.sources import outputs as O

CTX = RunContext({"arg": "A", "d": "deep"})


def listing(base):
    return sorted(os.path.relpath(os.path.join(d, f), base) for d, _, fs in os.walk(base) for f in fs if not f.startswith("."))


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv"])
def test_flat_output_round_trip(spark, tmp_path, fmt):
    base = str(tmp_path / "out")
    d = spark.createDataFrame([(1, decimal.Decimal("1.0"), "A"), (2, decimal.Decimal("2.0"), "B"), (3, decimal.Decimal("3.0"), "C")], "n INT, d DECIMAL(3,1), s STRING").repartition(2)
    c = Counters()
    write_outputs([("o", d, FlatOutput(base, "${arg}/x-*.bin", fmt))], CTX, c)
    files = listing(base)
    assert files and all(f.startswith("A/x-smain-p") and f.endswith(".bin") for f in files)
    back = read_direct(spark, CTX, base, "${arg}/*.bin", Model.of(d), fmt=fmt)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, d.collect()))
    assert c.outputs["o"]["records"] == 3 and c.outputs["o"]["files"] == len(files) and c.summary()["total"]["bytes"] > 0


def test_group_output_sorts_each_file(spark, tmp_path):
    base = str(tmp_path / "g")
    d = spark.createDataFrame([(i % 10, i) for i in range(100)], "id INT, n INT").repartition(4)
    write_outputs([("g", d, GroupOutput(base, "baz_{id}.csv", "csv", ("-n",)))], CTX)
    assert listing(base) == [f"baz_{i}.csv" for i in range(10)]
    for i in range(10):
        got = [int(x.split(",")[1]) for x in open(f"{base}/baz_{i}.csv").read().split()]
        assert got == sorted(got, reverse=True) and len(got) == 10


def test_setup_deletes_only_matching(tmp_path):
    (tmp_path / "a").mkdir()
    for n in ("x.bin", "a/y.bin", "z.txt"):
        (tmp_path / n).write_text("1")
    assert delete_matching(str(tmp_path), ["*.bin"]) == 2 and listing(tmp_path) == ["z.txt"]
    assert delete_matching(str(tmp_path), []) == 0 and delete_matching(str(tmp_path / "nope"), ["*"]) == 0


def test_all_or_nothing(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    good = spark.range(5)
    bad = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="boom"):
        write_outputs([("a", good, FlatOutput(a, "x-*.parquet")), ("b", bad, FlatOutput(b, "x-*.parquet"))], CTX)
    assert [f for f in listing(tmp_path) if f.endswith(".parquet")] == []


def test_interrupted_commit_is_finished(spark, tmp_path):
    base = str(tmp_path / "a")
    p = O.prepare(spark.range(5), FlatOutput(base, "x-*.parquet"), CTX, "a", "t1")
    assert not [f for f in listing(base) if not f.startswith(O.HIDDEN)]
    mark = f"{base}/{O.HIDDEN}/t1.mark"
    with open(mark, "w") as f:
        json.dump({"bases": [base], "moves": p.moves}, f)
    assert recover(base) == ["t1"] and not os.path.exists(mark)
    assert spark.read.parquet(f"{base}/x-*.parquet").count() == 5
    assert recover(base) == []


def test_mark_stays_while_a_base_is_not_marked(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    ps = [O.prepare(spark.range(3), FlatOutput(x, "x-*.parquet"), CTX, x, "t2") for x in (a, b)]
    with open(f"{a}/{O.HIDDEN}/t2.mark", "w") as f:
        json.dump({"bases": [a, b], "moves": ps[0].moves}, f)
    assert recover(a) == [] and os.path.exists(f"{a}/{O.HIDDEN}/t2.mark")


def test_name_clashes_raise(spark, tmp_path):
    out = GroupOutput(str(tmp_path / "a"), "one.parquet")
    with pytest.raises(ValueError, match="one file"):
        write_outputs([("a", spark.range(2), out), ("b", spark.range(2), out)], CTX)
    with pytest.raises(ValueError):
        write_outputs([("a", spark.range(2), FlatOutput(str(tmp_path / "a"), "one.parquet"))], CTX)


def test_staged_and_paths(spark, tmp_path):
    for i in (1, 2):
        write_outputs([("s", spark.range(i), StagedOutput(f"{tmp_path}/s{i}"))], CTX)
    assert read_staged(spark, CTX, [f"{tmp_path}/s1", f"{tmp_path}/s2"], Model.of("id BIGINT")).count() == 3
    assert read_direct(spark, CTX, str(tmp_path), "s*/*", Model.of("id BIGINT")).count() == 3


def test_staged_takes_part_in_the_commit(spark, tmp_path):
    base = str(tmp_path / "s")
    c = Counters()
    write_outputs([("s", spark.range(7).repartition(2), StagedOutput(base))], CTX, c)
    assert c.outputs["s"]["records"] == 7 and c.outputs["s"]["files"] == 2 and c.outputs["s"]["bytes"] > 0
    before = listing(base)
    assert before and all(f.startswith("main/part-") for f in before)
    bad = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="boom"):
        write_outputs([("s", spark.range(9), StagedOutput(base)), ("f", bad, FlatOutput(str(tmp_path / "f"), "x-*.parquet"))], CTX)
    assert listing(base) == before and listing(tmp_path / "f") == []
    write_outputs([("s", spark.range(3), StagedOutput(base))], CTX)
    assert read_staged(spark, CTX, [base], Model.of("id BIGINT")).count() == 3
    write_outputs([("s", spark.range(0), StagedOutput(base))], RunContext(stage=""))
    assert listing(base) != [] and read_staged(spark, CTX, [base], Model.of("id BIGINT")).count() == 3


def test_filter_and_columns_reach_the_scan(spark):
    d = read_direct(spark, CTX, "/root/testdata/sf0.001", "lineitem.parquet", Model.of("l_partkey BIGINT"), where=F.col("l_partkey") > 5)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_partkey,5)" in plan and "ReadSchema: struct<l_partkey:bigint>" in plan


@pytest.mark.parametrize(
    "pattern, want",
    [
        ("c-${arg}.bin", "c-A.bin"),
        ("{s}", "str${arg}"),
        ("{n}", "null"),
        ("{b:0000}", "0001"),
        ("{i:#,##0}", "1,234,567"),
        ("{f:0.00}", "1.50"),
        ("{d:0.##}", "-2.5"),
        ("{d:#.#}", "-2.5"),
        ("{dec:0.0}", "12.3"),
        ("{i:'n'0 'x'}", "n1234567 x"),
        ("{f:0%}", "150%"),
        ("{d:0.0;(0.0)}", "(2.5)"),
        ("{d:$0}", "-$2"),
        ("{date:yyyyMMdd}", "20000102"),
        ("{date:yy-M-d}", "00-1-2"),
        ("{at:h'h'm a EEE SSS}", "3h4 AM Sun 000"),
        ("{at:yyyy-MM-dd HH:mm:ss}", "2000-01-02 03:04:05"),
        ("${d}/{b}/{i}", "deep/1/1234567"),
        ("{n:yyyy}", "null"),
    ],
)
def test_path_segments(spark, pattern, want):
    d = spark.createDataFrame([("str${arg}", 1, 1234567, 1.5, -2.5, decimal.Decimal("12.34"), dt.date(2000, 1, 2), dt.datetime(2000, 1, 2, 3, 4, 5), None)], "s STRING, b TINYINT, i INT, f FLOAT, d DOUBLE, dec DECIMAL(9,2), date DATE, at TIMESTAMP_NTZ, n DATE")
    assert d.select(PathPattern(pattern).column(CTX, Model.of(d))).first()[0] == want


def test_random_segment(spark):
    c = PathPattern("r[3..5]").column(CTX, Model.of("id BIGINT"))
    got = {r[0] for r in spark.range(200).select(c).collect()}
    assert got == {"r3", "r4", "r5"}


@pytest.mark.parametrize("bad", ["{nope}", "{s:000}", "{i:x}", "{i:0#0}", "{date:QQ}", "[5..1]"])
def test_bad_segments(spark, bad):
    d = spark.createDataFrame([], "s STRING, i INT, date DATE")
    with pytest.raises(ValueError):
        d.select(PathPattern(bad).column(CTX, Model.of(d)))


def test_arguments():
    assert PathPattern("${a}/{b}/${c}-*").arguments == {"a", "c"}
    with pytest.raises(MissingArgument):
        RunContext().resolve("${x}")


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_times_without_a_zone_keep_their_clock_in_every_format(spark, tmp_path, zone):
    at = [dt.datetime(1969, 7, 20, 20, 17, 40), dt.datetime(2020, 2, 29, 1, 2, 3, 456789), dt.datetime(9999, 12, 31, 23, 59, 59), None]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(at)], "i INT, at TIMESTAMP_NTZ").coalesce(1)
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for fmt in ("parquet", "orc", "csv"):
            write_outputs([("o", d, FlatOutput(f"{tmp_path}/{fmt}", "x-*", fmt))], CTX)
            back = read_direct(spark, CTX, f"{tmp_path}/{fmt}", "x-*", Model.of(d), fmt=fmt)
            assert [r.at for r in back.orderBy("i").collect()] == at, fmt
        early = spark.createDataFrame([(dt.datetime(1969, 7, 20, 20, 17, 40, 123456),)], "at TIMESTAMP_NTZ")
        with pytest.raises(Exception, match="before 1970"):
            write_outputs([("o", early, FlatOutput(f"{tmp_path}/orc", "y-*", "orc"))], CTX)
        d.write.orc(f"{tmp_path}/own")
        assert [r.at for r in read_direct(spark, CTX, str(tmp_path), "own", Model.of(d), fmt="orc").orderBy("i").collect()] == at
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
