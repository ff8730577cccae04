"""python -m xylem.cli -s SCHEMA DOCUMENT... : validates XML files ('-': standard input).

Exit codes: 0 valid, 1 a failed assert, 2 usage, 3 a schema or evaluation error, 4 a document that can't be read."""

from __future__ import annotations

import argparse
import sys

from xylem.plans.lint import lint
from xylem.plans.schema import FileResolver, SchemaError, parse_schema
from xylem.plans.xpath import XPathError


def main(argv: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="xylem")
    p.add_argument("-s", "--schema", required=True)
    p.add_argument("-p", "--phase")
    p.add_argument("-f", "--format", choices=["text", "svrl", "json"], default="text")
    p.add_argument("--flag", action="append", default=[], help="only findings with one of these flags")
    p.add_argument("--max-failures", type=int)
    p.add_argument("--list-phases", action="store_true")
    p.add_argument("--explain", action="store_true")
    p.add_argument("--lint", action="store_true")
    p.add_argument("documents", nargs="*")
    try:
        args = p.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        with open(args.schema, encoding="utf-8") as f:
            schema = parse_schema(f.read(), FileResolver(), args.schema)
    except (OSError, SchemaError, XPathError, SyntaxError) as e:
        print(e, file=sys.stderr)
        return 3
    if args.list_phases:
        for phase in schema.phases.values():
            print(phase.id + (" (default)" if phase.id == schema.default_phase else ""), *phase.active)
        return 0
    if args.explain:
        for i, pattern in enumerate(schema.patterns, 1):
            print(f"pattern {pattern.id or i}")
            for r in pattern.rules:
                print(f"  {r.context}")
                for a in r.assertions:
                    print(f"    {a.kind} {a.test}")
        return 0
    if args.lint:
        found = lint(schema)
        for kind, text in found:
            print(f"{kind}: {text}")
        return int(bool(found))
    if not args.documents:
        print("no documents", file=sys.stderr)
        return 2
    docs = []
    for path in args.documents:
        try:
            docs.append((path, sys.stdin.buffer.read() if path == "-" else open(path, "rb").read()))
        except OSError as e:
            print(e, file=sys.stderr)
            return 4
    return validate_files(docs, schema, args, spark)


def validate_files(docs, schema, args, spark) -> int:
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    from xylem.operators import render
    from xylem.operators.validate import validate

    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    df = spark.createDataFrame(docs, "doc_id string, xml binary")
    try:
        report = validate(df, schema, args.phase, max_failures=args.max_failures)
        if args.flag:
            report.findings = report.with_flag(*args.flag)
        for e in report.errors.collect():
            print(f"{e.doc_id}:{e.line}:{e.column}: {e.message}", file=sys.stderr)
            return 4
        out = {"text": lambda: render.to_text(report, df), "svrl": lambda: render.to_svrl(report, df), "json": lambda: render.to_json(report)}[args.format]()
        for row in out.orderBy("doc_id").collect():
            print(f"{row[0]}\n{row[1]}" if args.format == "text" else row[1])
        return 0 if report.is_valid() else 1
    except (SchemaError, XPathError, PySparkException) as e:
        print(e, file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
