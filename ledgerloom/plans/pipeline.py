"""The two questions end to end: what a statement says of itself, and what receipts say of it."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import extract, integrity, pairing, queue, selfaudit, verdict
from ledgerloom.scratch import release, written
from ledgerloom.sources.statements import Statements, statement_rows, statements_of


class Audit(NamedTuple):
    states: DataFrame
    findings: DataFrame
    recurring: DataFrame
    coverage: DataFrame


def parsed_once(parsed: Statements) -> Statements:
    """``parsed`` as tables: files are read and parsed once, however many questions follow."""
    return Statements(*(df if hasattr(df, "_ledgerloom_path") else written(df, name) for name, df in parsed._asdict().items()))


def parsed_files(files: DataFrame) -> Statements:
    """(statement_id, text) files as tables: each is read and parsed once, however many questions follow."""
    rows = written(statement_rows(files), "statement-rows")
    try:
        return parsed_once(statements_of(rows))
    finally:
        release(rows)


def audit_statements(parsed: Statements) -> Audit:
    """States, findings and recurring charges of all statements; incomplete ones have neither findings nor charges.

    ``coverage`` says how many lines could be examined at all: a statement without dates or names is whole and yet nothing
    in it was audited.
    """
    parsed = parsed_once(parsed)
    states = integrity.completeness(parsed.lines, parsed.statements)
    good = parsed.lines.join(states.filter("usable").select("statement_id"), "statement_id", "left_semi")
    looked = selfaudit.billed(parsed.lines).groupBy("statement_id").agg(F.count("*").alias("auditable"), F.count_if(F.col("date").isNull()).alias("undated"))
    coverage = parsed.lines.groupBy("statement_id").agg(F.count("*").alias("n_lines")).join(looked, "statement_id", "left").fillna(0, ["auditable", "undated"])
    # Clustered once: findings and the inventory are told from the same facts.
    of_runs = selfaudit.runs(good)
    facts = written(selfaudit.recurring_facts(of_runs), "recurring")
    return Audit(states, selfaudit.audit(parsed.lines, states, facts=facts), selfaudit.recurring(of_runs, facts), coverage)


def review(lines: DataFrame, receipts: DataFrame, scope: Sequence[str] = (), window_days: int = pairing.WINDOW_DAYS) -> DataFrame:
    """The ranked review queue of charges (``lines`` of usable statements) against receipts.

    ``receipts``: receipt_id, merchant, date, currency, generated, items and the amounts' columns of ``verdict``.
    """
    charges = lines.withColumn("charge_currency", F.col("currency")).drop("currency")
    decided = pairing.assigned(charges, receipts, window_days, scope)
    papers = receipts.withColumn("receipt_source", F.col("receipt_id").cast("string")).drop("date", *scope)
    pairs = charges.join(decided, ["statement_id", "row"]).join(papers, "receipt_id", "left")
    none = F.expr("array()").cast(pairs.schema["items"].dataType)
    pairs = pairs.withColumn("items", F.coalesce("items", none)).withColumn("rivals", F.coalesce("rivals", F.expr("array()").cast(pairs.schema["rivals"].dataType)))
    made = queue.items(verdict.reconcile(pairs))
    return queue.ranked(queue.mark_duplicates(made, selfaudit.suspects(lines)))


def review_texts(parsed: Statements, texts: DataFrame) -> DataFrame:
    """``review`` of parsed statements against receipts given as text (receipt_id, text, degraded)."""
    parsed = parsed_once(parsed)
    states = integrity.completeness(parsed.lines, parsed.statements)
    good = parsed.lines.join(states.filter("usable").select("statement_id"), "statement_id", "left_semi")
    read = written(extract.receipts(texts), "receipts")
    for column, kind in (("date", "date"), ("generated", "boolean")):
        if column not in read.columns:
            read = read.withColumn(column, F.lit(None).cast(kind))
    return review(good, read)
