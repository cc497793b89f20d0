"""python -m parchment run | report | eval."""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from pyspark.sql import SparkSession

from parchment.operators import evaluation, ledger, runs
from parchment.sources import config as configs


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="parchment")
    commands = parser.add_subparsers(dest="command", required=True)
    go = commands.add_parser("run")
    go.add_argument("--input", required=True)
    go.add_argument("--config")
    for name in ("--workers", "--limit", "--budget"):
        go.add_argument(name, type=int)
    rep = commands.add_parser("report")
    rep.add_argument("--json", action="store_true")
    score = commands.add_parser("eval")
    score.add_argument("--expected", required=True)
    for p in (go, rep, score):
        p.add_argument("--db", required=True, help="folder of the state tables")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("parchment").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    state = runs.State(spark, args.db)
    if args.command == "run":
        given = {k: v for k in ("workers", "limit", "budget") if (v := getattr(args, k)) is not None}
        given |= {k: None for k in ("limit", "budget") if given.get(k) == 0}
        run_id, stop = runs.run(state, args.input, replace(configs.load(args.config), **given), args.config or "")
        print(f"run_id={run_id} stop_reason={stop}")
    elif args.command == "report":
        row = ledger.report(state.read("files"), state.documents(), state.runs(), state.ledger()).first().asDict()
        row["quarantine_by_reason"] = dict(sorted((row["quarantine_by_reason"] or {}).items()))
        if args.json:
            print(json.dumps(row, ensure_ascii=False))
        else:
            for key, value in row.items():
                print(f"{key}: {value}" if key != "quarantine_by_reason" else "\n".join([f"{key}:", *(f"  {k}: {v}" for k, v in value.items())]))
    else:
        pairs = evaluation.matched(configs.golden(spark, args.expected), state.read("files"), state.documents())
        print(evaluation.text_table(evaluation.scored(pairs).collect(), evaluation.summary(pairs).first()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
