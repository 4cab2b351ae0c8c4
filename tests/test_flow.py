import pytest
from pyspark.sql import functions as F

from weirflow.context import MissingArgument, Report, RunContext
from weirflow.model import Model
from weirflow.operators import branch, one_pass, update_with, view
from weirflow.plans import Flow, Listener, Recompute, operator, operators, register, run_rounds
from weirflow.plans.flow import Kind, NodeError
from weirflow.sources import FlatOutput, StagedOutput
from weirflow.streaming import run_stream


class Notes(Listener):
    def __init__(self):
        self.seen = []

    def run_started(self, ctx):
        self.seen.append("start")

    def run_completed(self, ctx, seconds, error):
        self.seen.append("failed" if error else "done")

    def round_completed(self, ctx, error):
        self.seen.append((ctx["round"], error is None))


def numbers(base, calls=None, pattern="${round}-*.parquet"):
    def source(ctx, spark):
        if calls is not None:
            calls.append("source")
        return spark.range(10)

    def shifted(ctx, d):
        if ctx.args.get("round") == "8":
            raise ValueError("round eight")
        return d.select((F.col("id") + 100 * int(ctx["round"])).alias("id"))

    return Flow("numbers").add("source", source).add("shift", shifted, "source", recompute=Recompute.parameter("round")).sink("out", "shift", FlatOutput(base, pattern))


def test_run_with_branches_and_listeners(spark, tmp_path):
    flow = (
        Flow()
        .add("n", lambda ctx, s: s.range(10))
        .add("b", lambda ctx, d: branch(d, F.when(F.col("id") < 3, "LOW").otherwise("HIGH"), ["LOW", "HIGH"]), "n")
        .add("dead", lambda ctx, d: 1 / 0, "n")
        .sink("low", "b.LOW", FlatOutput(f"{tmp_path}/a", "low-*.parquet"))
        .sink("high", "b.HIGH", FlatOutput(f"{tmp_path}/a", "high-*.parquet"))
    )
    notes = Notes()
    c = flow.run(spark, listeners=[notes])
    assert {k: v["records"] for k, v in c.outputs.items()} == {"low": 3, "high": 7} and notes.seen == ["start", "done"]
    assert "dead" not in flow.order()
    assert "Physical Plan" in flow.explain(spark)


def test_mistakes_are_found_before_running(spark, tmp_path):
    out = FlatOutput(str(tmp_path), "${x}-*.parquet")
    with pytest.raises(MissingArgument, match="x"):
        Flow().add("n", lambda ctx, s: s.range(1)).sink("o", "n", out).explain(spark)
    with pytest.raises(ValueError, match="not there"):
        Flow().sink("o", "n", out).order()
    cyc = Flow().add("a", lambda ctx, d: d, "b").add("b", lambda ctx, d: d, "a").sink("o", "a", out)
    with pytest.raises(ValueError, match="cycle"):
        cyc.order()
    with pytest.raises(NodeError, match="n:"):
        Flow().add("n", lambda ctx, s: 1 / 0).sink("o", "n", FlatOutput(str(tmp_path), "*")).run(spark)


def test_recompute_kinds_merge():
    a, p, q, n = Recompute.always(), Recompute.parameter("x"), Recompute.parameter("y"), Recompute.never()
    assert (a | p).kind is Kind.ALWAYS and (p | q).names == {"x", "y"} and (p | n) == p and (n | n) == n


def test_rounds_share_and_commit_once(spark, tmp_path):
    calls = []
    r = run_rounds(numbers(str(tmp_path), calls), spark, [RunContext({"round": str(i)}) for i in range(3)], slots=1)
    assert r.status == 0 and len(r.succeeded) == 3 and calls == ["source"]
    for i in range(3):
        assert spark.read.parquet(f"{tmp_path}/{i}-*.parquet").agg(F.min("id")).first()[0] == 100 * i


def test_stop_on_fail(spark, tmp_path):
    notes = Notes()
    r = run_rounds(numbers(str(tmp_path)), spark, [RunContext({"round": str(i)}) for i in range(10)], slots=1, listeners=[notes])
    assert (len(r.succeeded), len(r.failed), len(r.remaining), r.status) == (8, 1, 1, 1)
    assert not list(tmp_path.glob("*.parquet")) and ("8", False) in notes.seen


def test_go_on_after_failure(spark, tmp_path):
    r = run_rounds(numbers(str(tmp_path)), spark, [RunContext({"round": str(i)}) for i in (7, 8, 9)], slots=2, stop_on_fail=False)
    assert (len(r.succeeded), len(r.failed), r.status) == (2, 1, 0)
    assert {f.name[0] for f in tmp_path.glob("*.parquet")} == {"7", "9"}


def test_registry():
    assert operator("master_join") and "fold" in operators()
    register("mine", len)
    assert operator("mine") is len
    for bad in (lambda: register("mine", len), lambda: operator("nope")):
        with pytest.raises(ValueError):
            bad()


def test_stream_as_rounds(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(Model.of("id BIGINT").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    flow = lambda d: Flow().add("d", lambda ctx, s: d).sink("o", "d", FlatOutput(f"{tmp_path}/out", "b${batch}-*.parquet"))
    run_stream(source, flow, f"{tmp_path}/cp").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out/*.parquet").count() == 30


def test_settings_and_sizes(spark):
    from weirflow.config import Settings, sized

    assert Settings.of(spark).slots is None and Settings.of(spark).stop_on_fail
    spark.conf.set("weirflow.slots", "2")
    spark.conf.set("weirflow.stopOnFail", "false")
    try:
        s = Settings.of(spark)
        assert (s.slots, s.stop_on_fail) == (2, False)
        assert [s.partitions(x) for x in ("tiny", "small", "regular", "huge")] == [1, 4, 8, 32]
    finally:
        spark.conf.unset("weirflow.slots")
        spark.conf.unset("weirflow.stopOnFail")
    assert sized(spark.range(10), "small", "id").rdd.getNumPartitions() == 4


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from weirflow.__main__ import main

    (tmp_path / "jobs_under_test.py").write_text(
        "from tests.test_flow import numbers\n" f"def flow():\n    return numbers({str(tmp_path / 'out')!r})\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    assert main(["jobs_under_test:flow", "--verify", "--arg", "round=1"]) == 0 and "Physical Plan" in capsys.readouterr().out
    assert main(["jobs_under_test:flow", "--arg", "round=1"]) == 0
    (tmp_path / "rounds.csv").write_text("round\n7\n8\n9\n")
    assert main(["jobs_under_test:flow", "--rounds", str(tmp_path / "rounds.csv"), "--slots", "1"]) == 1
    assert main(["jobs_under_test:flow", "--rounds", str(tmp_path / "rounds.csv"), "--go-on"]) == 0
    assert {f.name[0] for f in (tmp_path / "out").glob("*.parquet")} == {"1", "7", "9"}


def test_outputs_of_one_operator_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(r):
        seen.add(1)
        return {"id": r["id"]}

    def labels(ctx, d):
        return branch(update_with(d, count), F.when(F.col("id") < 3, "LOW").otherwise("HIGH"), ["LOW", "HIGH"])

    flow = Flow().add("n", lambda ctx, s: s.range(10)).add("b", labels, "n").sink("low", "b.LOW", FlatOutput(str(tmp_path), "low-*.parquet")).sink("high", "b.HIGH", FlatOutput(str(tmp_path), "high-*.parquet"))
    c = flow.run(spark)
    assert seen.value == 10 and c.inputs() == {"n": 10}
    with one_pass(labels(None, spark.range(10))) as out:
        assert out["LOW"].count() + out["HIGH"].count() == 10 and seen.value == 20


def test_errors_at_run_time_name_their_nodes(spark, tmp_path):
    def fails(ctx, d):
        return d.select(F.when(F.col("id") == 3, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).alias("id"))

    flow = Flow().add("n", lambda ctx, s: s.range(5)).add("other", lambda ctx, s: s.range(5)).add("bad", fails, "n").sink("o", "bad", FlatOutput(str(tmp_path / "o"), "*.parquet")).sink("p", "other", StagedOutput(str(tmp_path / "p")))
    with pytest.raises(NodeError, match="o <- n, bad: .*boom"):
        flow.run(spark)
    assert not [f for f in tmp_path.rglob("*") if f.is_file()]


def test_what_reads_an_output_is_always_built_again(spark, tmp_path):
    base = str(tmp_path)

    def back(ctx, s):
        return s.read.schema("id BIGINT").parquet(f"{base}/{ctx['round']}-*.parquet")

    flow = numbers(base).add("back", back, after=["out"]).add("sum", lambda ctx, d: d.agg(F.sum("id").alias("id")), "back").sink("sums", "sum", FlatOutput(base, "sum-${round}-*.parquet"))
    assert flow.recompute()["sum"].kind is Kind.ALWAYS and flow.waves() == [["out"], ["sums"]]
    flow.run(spark, RunContext({"round": "1"}))
    assert spark.read.parquet(f"{base}/sum-1-*.parquet").first()[0] == 1045


def test_report_counts_errors_of_tasks(spark):
    report = Report(spark=spark)

    def check(r):
        if r["id"] > 6:
            report.error("too large")
        return {}

    assert update_with(spark.range(10), check).collect() and report.errors == 3
    own = Report()
    own.error("x")
    assert own.errors == 1


def test_views_are_sent_once(spark, tmp_path):
    sent = []

    def use(ctx, v, d):
        sent.append(v.table())
        return d

    flow = Flow().add("m", lambda ctx, s: view(s.range(5), "id")).add("n", lambda ctx, s: s.range(5)).add("use", use, "m", "n", recompute=Recompute.always()).sink("o", "use", FlatOutput(str(tmp_path), "${round}-*.parquet"))
    assert run_rounds(flow, spark, [RunContext({"round": str(i)}) for i in range(3)], slots=1).status == 0
    assert len(sent) == 3 and len({id(x) for x in sent}) == 1
