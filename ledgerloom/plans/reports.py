"""Reports as tables of text lines, and what a script should make of them; one row of ``codes`` for each statement.

Codes: 0 nothing to act on, 1 something needs a person, 2 the statement can't be trusted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.money import format_cents
from ledgerloom.plans.pipeline import Audit
from ledgerloom.sources.statements import Statements

KINDS = {"paid_twice": "PAID TWICE", "price_rose": "PRICE ROSE", "new_recurring": "NEW RECURRING"}


def _padded(text: Column, width: int) -> Column:
    return F.when(F.length(text) < width, F.lpad(text, width, " ")).otherwise(text)


def _lines(df: DataFrame, part: int, place: Column, text: Column) -> DataFrame:
    return df.select("statement_id", F.lit(part).alias("part"), place.cast("bigint").alias("place"), text.alias("line"))


def _numbered(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("statement_id").orderBy("part", "place", "line")
    return every.withColumn("number", F.row_number().over(order)).select("statement_id", "number", "line")


def refusal_report(parsed: Statements) -> DataFrame:
    """(statement_id, number, line): why a file was refused."""
    text = F.concat(F.lit("Cannot read this statement: "), F.translate("code", "_", " "), F.when(F.col("row") > 0, F.concat(F.lit(", row "), F.col("row").cast("string"))).otherwise(F.lit("")))
    return parsed.refusals.select("statement_id", F.lit(1).alias("number"), text.alias("line"))


def audit_report(audit: Audit) -> DataFrame:
    """(statement_id, number, line): what a statement says of itself; an incomplete one says that and nothing else."""
    states = audit.states.join(audit.coverage, "statement_id", "left")
    nothing = F.lit(0)
    head = F.concat(F.coalesce(F.col("n_lines"), nothing).cast("string"), F.lit(" rows, "), F.col("state"))
    parts = [_lines(states, 0, nothing, head)]
    broken = F.when(~F.col("walk_ok"), F.concat(F.lit("  The running balance breaks at row "), F.col("break_row").cast("string"), F.lit("."))).otherwise(F.lit("  The rows do not add up to the declared total."))
    bad = states.filter("state = 'incomplete'")
    parts += [_lines(bad, 1, nothing, broken), _lines(bad, 1, F.lit(1), F.lit("  Nothing else is reported: what looks like a finding may be a missing row."))]
    parts.append(_lines(states.filter("state = 'unverifiable'"), 1, nothing, F.lit("  It carries neither a running balance nor a declared total, so nothing confirms that it is whole.")))
    sums = audit.findings.groupBy("statement_id").agg(F.sum("at_risk").alias("s"))
    good = states.filter("state != 'incomplete'").select("statement_id").join(sums, "statement_id", "left")
    parts.append(_lines(good, 2, nothing, F.when(F.col("s").isNull(), F.lit("  Nothing looks wrong.")).otherwise(F.concat(F.lit("  What looks wrong: "), format_cents(F.col("s")), F.lit(" at stake")))))
    label = F.lit("")
    for kind, name in KINDS.items():
        label = F.when(F.col("kind") == kind, F.lit(name)).otherwise(label)
    rows = F.concat(F.col("first_row").cast("string"), F.lit(" to "), F.col("last_row").cast("string"))
    parts.append(_lines(audit.findings, 3, F.col("rank"), F.concat(F.lit("    "), _padded(format_cents(F.col("at_risk")), 10), F.lit("  "), F.rpad(label, 14, " "), F.lit(" "), F.coalesce("merchant", F.lit("")), F.lit(", rows "), rows)))
    yearly = audit.recurring.groupBy("statement_id").agg(F.sum("a_year_cents").alias("s"))
    parts.append(_lines(yearly, 4, nothing, F.concat(F.lit("  Recurring charges: "), format_cents(F.col("s")), F.lit(" a year, no finding, just what is there"))))
    each = F.concat(F.lit("    "), _padded(format_cents(F.col("a_year_cents")), 10), F.lit("/yr  "), _padded(format_cents(F.col("latest_cents")), 8), F.lit(" x "), F.col("charges").cast("string"), F.lit("  "), F.col("merchant"), F.lit("  since "), F.date_format("first_seen", "yyyy-MM-dd"))
    parts.append(_lines(audit.recurring, 5, F.col("rank"), each))
    return _numbered(parts)


def audit_codes(parsed: Statements, audit: Audit) -> DataFrame:
    """(statement_id, code)."""
    found = audit.findings.select("statement_id").distinct().withColumn("found", F.lit(True))
    states = audit.states.join(found, "statement_id", "left")
    code = F.when(F.col("state") == "incomplete", F.lit(2)).when(F.col("found"), F.lit(1)).otherwise(F.lit(0))
    return states.select("statement_id", code.alias("code")).unionByName(parsed.refusals.select("statement_id", F.lit(2).alias("code")))


def review_report(queue: DataFrame) -> DataFrame:
    """(statement_id, number, line) of a ranked queue: the headline, then what needs a person."""
    needs = F.col("state") != "filed"
    n = lambda c: F.count_if(c).cast("string")
    head = F.concat(n(F.col("state") == "possible duplicate"), F.lit(" possible duplicates, "), n(needs), F.lit(" need you, "), n(F.col("state") == "unverified"), F.lit(" of them unverified, "), n(~needs), F.lit(" filed, "), format_cents(F.coalesce(F.sum(F.when(needs, F.abs("at_risk"))), F.lit(0))), F.lit(" at risk"))
    heads = queue.groupBy("statement_id").agg(head.alias("line")).select("statement_id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("place"), "line")
    text = F.concat(_padded(F.col("state"), 18), F.lit("  "), _padded(format_cents(F.col("at_risk")), 12), F.lit("  "), F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("          ")), F.lit("  "), F.substring(F.coalesce("description", F.lit("")), 1, 34), F.lit("  "), F.col("why"))
    return _numbered([heads, _lines(queue.filter(needs), 1, F.col("place"), text)])


def review_codes(queue: DataFrame) -> DataFrame:
    """(statement_id, code)."""
    return queue.groupBy("statement_id").agg(F.bool_or(F.col("state") != "filed").cast("int").alias("code"))
