"""Command line: list the queries, run one, or render a small result.

    python -m citeweave.cli list
    python -m citeweave.cli run ir_votes --tables DIR --out PATH [--format parquet|json|csv]
    python -m citeweave.cli report vote_distribution --tables DIR [--style markdown|latex]
    python -m citeweave.cli sql ir_votes
    python -m citeweave.cli demo --tables DIR
    python -m citeweave.cli stage search --items PATH --passages PATH --out DIR [--config FILE]

The stages, in their order: adapter, generate, merge, search, stage, vote, evaluate,
judge (with --answers for answers), finalize, validate, audit-export,
audit-aggregate, answer-eval; curate runs those from merge to judge, and
benchmark-statistics and quality-by-retrieval report on what they made.
"""

from __future__ import annotations

import argparse
import sys


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("citeweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="citeweave", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    report = commands.add_parser("report")
    sql = commands.add_parser("sql")
    for p in (run, report, sql):
        p.add_argument("name")
    for p in (run, report):
        p.add_argument("--tables", required=True)
    run.add_argument("--out", required=True)
    run.add_argument("--format", choices=("parquet", "json", "csv"), default="parquet")
    report.add_argument("--style", choices=("markdown", "latex"), default="markdown")
    commands.add_parser("demo").add_argument("--tables", required=True)
    stages = commands.add_parser("stage").add_subparsers(dest="stage", required=True)
    from citeweave import commands as work

    for name, (_, inputs) in work.STAGES.items():
        p = stages.add_parser(name)
        for i in inputs:
            p.add_argument("--" + i.rstrip("*"), required=True, nargs="+" if i.endswith("*") else None)
        for o in work.OPTIONS.get(name, ()):
            p.add_argument("--" + o.removesuffix("_path").replace("_", "-"), dest=o)
        if name == "judge":
            p.add_argument("--answers", action="store_true")
        p.add_argument("--out", required=True)
        p.add_argument("--config")
    args = parser.parse_args(argv)

    if args.command == "stage":
        from citeweave.plans import config

        run_stage, inputs = work.STAGES[args.stage]
        given = {k: v for k, v in vars(args).items() if k not in ("command", "stage", "config") and v is not None}
        run_stage(_session(), config.load(args.config) if args.config else config.Config(), **given)
        return 0

    from citeweave.plans import queries, queries_curation, queries_more, queries_records, queries_retrieval  # noqa: F401

    if args.command == "demo":
        from citeweave.operators import statistics

        print(statistics.markdown_table(queries.QUERIES["retrieval_pipeline"](_session(), args.tables)))
        return 0

    if args.command == "list":
        print("\n".join(sorted(queries.QUERIES)))
        return 0
    if args.name not in queries.QUERIES:
        print(f"no such query: {args.name}", file=sys.stderr)
        return 2
    if args.command == "sql":
        print(queries.ORACLES.get(args.name, "-- SQL cannot express this query"))
        return 0

    result = queries.QUERIES[args.name](_session(), args.tables)
    if args.command == "run":
        result.write.mode("overwrite").format(args.format).option("header", "true").save(args.out)
        return 0

    from citeweave.operators import statistics

    print(statistics.markdown_table(result) if args.style == "markdown" else statistics.latex_table(result))
    return 0


if __name__ == "__main__":
    sys.exit(main())
