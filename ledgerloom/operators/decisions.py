"""Reading the decision log: chain verification, what is still outstanding, and decisions beside ledger rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.money import format_cents

# Fixed values of the log's format.
GENESIS = "0" * 64
ACTIONS = ("accept_as_printed", "correct", "split", "ignore", "match")
SCHEMA = "schema int, prev string, at string, actor string, action string, note string, correction string, seen struct<statement_id:string,row:int,charge_cents:bigint,receipt_cents:bigint,verdict:string,duplicate_of:int>, state string, why string, charge struct<date:string,description:string,amount:string>"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, line_no, line): the raw lines of each log, in order; a log is one file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("log_id"), F.split("value", "\n").alias("lines"))
    return files.select("log_id", F.posexplode("lines").alias("at", "line")).filter("line != ''").select("log_id", (F.col("at") + 1).alias("line_no"), "line")


def segment_lines(files: DataFrame) -> DataFrame:
    """(log_id, line_no, line) from (path, value), whole segments of logs: the folder is the log, the name the number of the first line."""
    found = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("log_id"), F.regexp_extract("path", r"([0-9]+)[.][^/]*$", 1).cast("bigint").alias("first"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    return found.filter("line != ''").select("log_id", (F.col("first") + F.col("at")).alias("line_no"), "line")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, line_no, line) of all segments under a path; each folder is a log."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return segment_lines(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def verify_chain(log: DataFrame) -> DataFrame:
    """(log_id, intact, broken_at, entries): each line's ``prev`` must be the digest of the line before it.

    Editing, deleting, reordering and forging all break the chain at the line after; a cut at the end or an edit of the
    last line needs an outside record of the count and tip (see ``tip``).
    """
    order = Window.partitionBy("log_id").orderBy("line_no")
    wanted = F.coalesce(F.lag(F.sha2("line", 256)).over(order), F.lit(GENESIS))
    bad = ~F.coalesce(F.get_json_object("line", "$.prev") == wanted, F.lit(False))
    checked = log.withColumn("bad", bad)
    return checked.groupBy("log_id").agg((~F.bool_or("bad")).alias("intact"), F.min(F.when(F.col("bad"), F.col("line_no"))).alias("broken_at"), F.count("*").alias("entries"))


def tip(log: DataFrame) -> DataFrame:
    """(log_id, entries, tip): what to keep elsewhere to notice a cut at the end."""
    return log.groupBy("log_id").agg(F.count("*").alias("entries"), F.sha2(F.max_by("line", "line_no"), 256).alias("tip"))


def decisions(log: DataFrame) -> DataFrame:
    """Parsed entries of intact logs only: a broken log decides nothing."""
    good = verify_chain(log).filter("intact").select("log_id")
    return log.join(good, "log_id", "left_semi").select("log_id", "line_no", F.from_json("line", SCHEMA).alias("d")).select("log_id", "line_no", "d.*")


def latest(decided: DataFrame) -> DataFrame:
    """The last decision on each ``seen``."""
    return decided.groupBy("seen").agg(F.max_by(F.struct("action", "note", "at"), F.struct("at", "line_no")).alias("decision"))


def outstanding(queue: DataFrame, decided: DataFrame) -> DataFrame:
    """Items without a decision on exactly the figures they show now; nulls equal nulls."""
    made = decided.select(F.col("seen").alias("__seen")).distinct()
    return queue.join(made, F.col("seen").eqNullSafe(F.col("__seen")), "left_anti")


_TAGS = {"possible duplicate": "possible-duplicate", "failed": "does-not-reconcile", "ambiguous": "ambiguous", "unverified": "unchecked", "filed": "reconciled"}


def ledger_rows(queue: DataFrame, decided: DataFrame) -> DataFrame:
    """One row for each charge, in text, for the sinks: date, description, amount, verdict, why, receipt, checks, currency."""
    made = latest(decided).select(F.col("seen").alias("__seen"), "decision")
    joined = queue.join(made, F.col("seen").eqNullSafe(F.col("__seen")), "left")
    accepted = F.coalesce(F.col("decision.action").isin("accept_as_printed", "correct"), F.lit(False))
    tag = F.lit("unchecked")
    for state, name in _TAGS.items():
        tag = F.when(F.col("state") == state, F.lit(name)).otherwise(tag)
    note = F.concat(F.lit("accepted by you on "), F.substring("decision.at", 1, 10), F.when(F.coalesce("decision.note", F.lit("")) != "", F.concat(F.lit(": "), F.col("decision.note"))).otherwise(F.lit("")), F.lit("; "), F.col("why"))
    ran = F.transform("checks", lambda c: F.concat(c["name"], F.lit("="), F.when(c["ok"], F.lit("ok")).when(~c["ok"], F.lit("FAILED")).otherwise(F.lit("unrun"))))
    amount = F.col("amount_cents")
    return joined.select(
        "statement_id",
        "row",
        F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("")).alias("date"),
        F.coalesce("description", F.lit("")).alias("description"),
        format_cents(amount).alias("amount"),
        F.when(accepted, F.lit("accepted")).otherwise(tag).alias("verdict"),
        F.when(accepted, note).otherwise(F.coalesce("why", F.lit(""))).alias("why"),
        F.coalesce("receipt_source", "merchant", F.lit("")).alias("receipt"),
        F.array_join(ran, "; ").alias("checks"),
        F.col("charge_currency").alias("currency"),
    )
