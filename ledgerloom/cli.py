"""``python -m ledgerloom audit|check|export``: the reports of all statements under a path; the highest code is the exit code."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import decisions, integrity
from ledgerloom.plans import reports
from ledgerloom.plans.pipeline import audit_statements, parsed_files, review_texts
from ledgerloom.scratch import written
from ledgerloom.sources import sinks
from ledgerloom.sources.documents import read_receipts
from ledgerloom.sources.statements import read_texts


def _print(lines: DataFrame) -> None:
    """Prints a report in order, a partition at a time."""
    last = None
    for row in lines.orderBy("statement_id", "number").toLocalIterator():
        if row["statement_id"] != last:
            last = row["statement_id"]
            print(f"\n{last}")
        print(row["line"])


def _worst(codes: DataFrame) -> int:
    return codes.agg(F.coalesce(F.max("code"), F.lit(2))).first()[0]


def audit(spark: SparkSession, args: argparse.Namespace) -> int:
    parsed = parsed_files(read_texts(spark, args.statements))
    made = audit_statements(parsed)
    _print(reports.audit_report(made).unionByName(reports.refusal_report(parsed)))
    return _worst(reports.audit_codes(parsed, made))


def _reviewed(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queue, refusals with incomplete statements, unreadable receipts)."""
    parsed = parsed_files(read_texts(spark, args.statements))
    receipts, unreadable = read_receipts(spark, args.receipts)
    states = integrity.completeness(parsed.lines, parsed.statements)
    bad = reports.refusal_report(parsed).unionByName(states.filter("not usable").select("statement_id", F.lit(1).alias("number"), F.lit("Incomplete: its own figures contradict it.").alias("line")))
    return written(review_texts(parsed, receipts), "cli-queue"), bad, unreadable


def check(spark: SparkSession, args: argparse.Namespace) -> int:
    queue, bad, unreadable = _reviewed(spark, args)
    for row in unreadable.orderBy("receipt_id").toLocalIterator():
        print(f"unreadable: {row['receipt_id']}: {row['reason']}")
    _print(reports.review_report(queue).unionByName(bad))
    return _worst(reports.review_codes(queue).unionByName(bad.select("statement_id", F.lit(2).alias("code"))))


def export(spark: SparkSession, args: argparse.Namespace) -> int:
    """Writes a ledger; a decision log that was tampered with stops it."""
    log = decisions.read_log(spark, args.decisions) if args.decisions else None
    if log is not None and (broken := decisions.verify_chain(log).filter("not intact").first()):
        print(f"Not exported: the decision log breaks at line {broken['broken_at']}.", file=sys.stderr)
        return 2
    queue, bad, _ = _reviewed(spark, args)
    decided = decisions.decisions(log) if log is not None else spark.createDataFrame([], f"log_id string, line_no int, {decisions.SCHEMA}")
    rows = decisions.ledger_rows(queue, decided)
    sinks.write(rows, args.to, args.out, single_file=args.single)
    if args.to == "firefly":
        print(sinks.firefly_config(args.account))
    print(sinks.summary(rows).first()["summary"], file=sys.stderr)
    return 2 if bad.limit(1).count() else 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run in (("audit", audit), ("check", check), ("export", export)):
        command = commands.add_parser(name)
        command.set_defaults(run=run)
        command.add_argument("statements", help="a file, a folder or a pattern")
        if name != "audit":
            command.add_argument("receipts", help="a folder of receipts")
        if name == "export":
            command.add_argument("out")
            command.add_argument("--to", default="generic", choices=sorted([*sinks.CSV_TARGETS, "beancount"]))
            command.add_argument("--decisions", help="the decision log")
            command.add_argument("--account", default="")
            command.add_argument("--single", action="store_true", help="one file, for one person's ledger")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return args.run(spark, args)
