"""``python -m weirflow MODULE:FLOW [--arg NAME=VALUE]... [--rounds FILE.csv] [--slots N] [--go-on] [--verify]``

FLOW is a Flow or a function that returns one. With ``--rounds`` the flow runs once for each row of the CSV file, whose
header names arguments. The exit status is 0 if all was committed.
"""

from __future__ import annotations

import argparse
import csv
import importlib
import sys

from pyspark.sql import SparkSession

from weirflow.config import Settings
from weirflow.context import RunContext
from weirflow.plans import Flow, run_rounds
from weirflow.plans.flow import installed_listeners


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weirflow", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("flow")
    p.add_argument("--arg", action="append", default=[], metavar="NAME=VALUE")
    p.add_argument("--rounds", metavar="FILE")
    p.add_argument("--slots", type=int)
    p.add_argument("--go-on", action="store_true", help="do not stop at the first failed round")
    p.add_argument("--verify", action="store_true", help="plan only")
    a = p.parse_args(argv)
    module, _, name = a.flow.partition(":")
    found = getattr(importlib.import_module(module), name or "flow")
    flow = found if isinstance(found, Flow) else found()
    args = dict(x.split("=", 1) for x in a.arg)
    conf: dict[str, str] = {}
    for x in installed_listeners():
        x.configure(conf)
    builder = SparkSession.builder.appName(flow.name)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    settings = Settings.of(spark)
    if a.verify or settings.verify:
        print(flow.explain(spark, RunContext(args)))
        return 0
    if a.rounds:
        with open(a.rounds, newline="") as f:
            contexts = [RunContext({**args, **row}, flow=flow.name) for row in csv.DictReader(f)]
        result = run_rounds(flow, spark, contexts, slots=a.slots or settings.slots, stop_on_fail=not a.go_on and settings.stop_on_fail)
        for ctx, error in result.failed:
            print(f"round {dict(ctx.args)} failed: {error}", file=sys.stderr)
        return result.status
    counters = flow.run(spark, RunContext(args, flow=flow.name))
    print(counters.outputs)
    return 0


if __name__ == "__main__":
    sys.exit(main())
