"""Whether statements are complete: three-valued checks over their own figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def balance_walk(lines: DataFrame) -> DataFrame:
    """(statement_id, walk_ok, break_row, expected_cents, actual_cents): each balance against the one before plus the amount.

    ``walk_ok`` is null (not run) with fewer than two balances, or where all balance rows are dated and run out of order.
    Only rows with a balance take part, in row order; the first break is reported.
    """
    order = Window.partitionBy("statement_id").orderBy("row")
    walked = lines.filter(F.col("balance_cents").isNotNull()).select(
        "statement_id",
        "row",
        "date",
        "balance_cents",
        (F.lag("balance_cents").over(order) + F.col("amount_cents")).alias("expected"),
        (F.col("date") < F.lag("date").over(order)).alias("back"),
    )
    broken = F.col("expected") != F.col("balance_cents")
    found = walked.groupBy("statement_id").agg(
        F.count("*").alias("n"),
        F.count("date").alias("dated"),
        F.coalesce(F.bool_or("back"), F.lit(False)).alias("disordered"),
        F.min(F.when(broken, F.struct("row", "expected", F.col("balance_cents").alias("actual")))).alias("first"),
    )
    run = (F.col("n") >= 2) & ~(F.col("disordered") & (F.col("dated") == F.col("n")))
    ok = F.when(run, F.col("first").isNull())
    return found.select("statement_id", ok.alias("walk_ok"), F.when(run, F.col("first.row")).alias("break_row"), F.when(run, F.col("first.expected")).alias("expected_cents"), F.when(run, F.col("first.actual")).alias("actual_cents"))


def declared_totals(lines: DataFrame, statements: DataFrame) -> DataFrame:
    """(statement_id, total_ok, sum_cents, declared_cents): rows against a period total, or closing less opening balance."""
    sums = lines.groupBy("statement_id").agg(F.when(F.count("*") == F.count("amount_cents"), F.sum("amount_cents")).alias("sum_cents"))
    declared = F.coalesce("period_total_cents", F.col("closing_balance_cents") - F.col("opening_balance_cents"))
    joined = statements.select("statement_id", declared.alias("declared_cents")).join(sums, "statement_id", "left")
    return joined.select("statement_id", (F.col("sum_cents") == F.col("declared_cents")).alias("total_ok"), "sum_cents", "declared_cents")


def completeness(lines: DataFrame, statements: DataFrame) -> DataFrame:
    """(statement_id, walk_ok, total_ok, state, usable, verified): ``whole``, ``incomplete`` or ``unverifiable``.

    A check that could not run never counts as one that passed.
    """
    both = statements.select("statement_id").join(balance_walk(lines).select("statement_id", "walk_ok", "break_row"), "statement_id", "left").join(declared_totals(lines, statements).select("statement_id", "total_ok"), "statement_id", "left")
    failed = ~F.coalesce("walk_ok", F.lit(True)) | ~F.coalesce("total_ok", F.lit(True))
    passed = F.coalesce("walk_ok", F.lit(False)) | F.coalesce("total_ok", F.lit(False))
    state = F.when(failed, F.lit("incomplete")).when(passed, F.lit("whole")).otherwise(F.lit("unverifiable"))
    return both.select("statement_id", "walk_ok", "break_row", "total_ok", state.alias("state"), (~failed).alias("usable"), (passed & ~failed).alias("verified"))


def statement_sum(lines: DataFrame, statements: DataFrame) -> DataFrame:
    """(statement_id, ok): the period total alone; null without one or where a row has no readable amount."""
    sums = lines.groupBy("statement_id").agg(F.when(F.count("*") == F.count("amount_cents"), F.sum("amount_cents")).alias("s"))
    return statements.select("statement_id", "period_total_cents").join(sums, "statement_id", "left").select("statement_id", (F.col("s") == F.col("period_total_cents")).alias("ok"))
