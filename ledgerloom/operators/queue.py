"""The review queue: one row for each charge, ranked by what needs a person and by money at risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATES = ("possible duplicate", "failed", "ambiguous", "unverified", "filed")
_AMBIGUOUS = ("ambiguous", "unnamed")


def items(reconciled: DataFrame) -> DataFrame:
    """``verdict.reconcile``'s rows with an ``outcome`` of pairing, as queue items with ``state``, ``at_risk`` and ``seen``."""
    state = (
        F.when(F.col("verdict") == "does_not_reconcile", F.lit("failed"))
        .when(F.col("outcome").isin(*_AMBIGUOUS), F.lit("ambiguous"))
        .when(F.col("verdict") == "reconciled", F.lit("filed"))
        .otherwise(F.lit("unverified"))
    )
    why = F.when(state == "ambiguous", F.concat(F.size("rivals").cast("string"), F.lit(" receipts fit the amount, none can be chosen"))).otherwise(F.col("why"))
    seen = F.struct("statement_id", "row", F.col("amount_cents").alias("charge_cents"), F.col("total_cents").alias("receipt_cents"), "verdict", F.lit(None).cast("int").alias("duplicate_of"))
    return reconciled.withColumns({"state": state, "why": why, "at_risk": F.coalesce("amount_cents", F.lit(0)), "seen": seen})


def mark_duplicates(queue: DataFrame, suspects: DataFrame) -> DataFrame:
    """Marks the last charge of each suspected pair; never adds a row. A later suspect of one row wins."""
    last = Window.partitionBy("statement_id", "second_row").orderBy(F.asc("cents"), F.desc("first_row"))
    marks = suspects.withColumn("turn", F.row_number().over(last)).filter("turn = 1")
    marks = marks.select("statement_id", F.col("second_row").alias("row"), F.col("first_row").alias("duplicate_of"), F.col("refund_row").alias("refunded_by"), "days_apart")
    joined = queue.join(marks, ["statement_id", "row"], "left")
    hit = F.col("duplicate_of").isNotNull()
    told = F.when(F.col("days_apart").isNull(), F.lit("charged again, dates unknown")).otherwise(F.concat(F.lit("charged again after "), F.col("days_apart").cast("string"), F.lit(" days")))
    told = F.concat(told, F.when(F.col("refunded_by").isNotNull(), F.lit(", since refunded")).otherwise(F.lit("")), F.when(F.col("state") != "unverified", F.concat(F.lit("; also: "), F.col("why"))).otherwise(F.lit("")))
    return joined.withColumns({"why": F.when(hit, told).otherwise(F.col("why")), "state": F.when(hit, F.lit(STATES[0])).otherwise(F.col("state")), "seen": F.col("seen").withField("duplicate_of", F.col("duplicate_of"))}).drop("days_apart")


def ranked(queue: DataFrame) -> DataFrame:
    """``queue`` with ``state_rank`` (least first) and ``place`` among those that need a person (null for filed rows)."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state")).cast("int") - 1
    with_rank = queue.withColumn("state_rank", rank)
    needs = F.col("state") != "filed"
    order = Window.partitionBy("statement_id", needs).orderBy("state_rank", F.desc(F.abs("at_risk")), "row")
    return with_rank.withColumn("place", F.when(needs, F.row_number().over(order)))


def headline(queue: DataFrame) -> DataFrame:
    """(statement_id, duplicates, filed, unverified, needs_you, at_risk): one aggregation, nothing unchecked left unsaid."""
    needs = F.col("state") != "filed"
    return queue.groupBy("statement_id").agg(
        F.count_if(F.col("state") == STATES[0]).alias("duplicates"),
        F.count_if(~needs).alias("filed"),
        F.count_if(F.col("state") == "unverified").alias("unverified"),
        F.count_if(needs).alias("needs_you"),
        F.coalesce(F.sum(F.when(needs, F.abs("at_risk"))), F.lit(0)).alias("at_risk"),
    )
