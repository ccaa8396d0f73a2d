"""Ledgers for other programs: four text formats with every row's verdict, written by Spark."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "ledgerloom"


def defused(text: Column) -> Column:
    """Text that no spreadsheet runs: line breaks and tabs become spaces, control characters go, a leading operator is quoted."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n\t]", " "), r"\p{Cntrl}", ""))
    return F.when(F.regexp_like(flat, F.lit("^[=+@-]")), F.concat(F.lit("'"), flat)).otherwise(flat)


def tag(verdict: Column) -> Column:
    return F.concat(F.lit(PREFIX + ":"), verdict)


def generic(rows: DataFrame) -> DataFrame:
    """date, description, amount, verdict, why, receipt, checks. Amounts are figures and stay as they are."""
    return rows.select("date", defused(F.col("description")).alias("description"), "amount", tag(F.col("verdict")).alias("verdict"), *(defused(F.col(c)).alias(c) for c in ("why", "receipt", "checks")))


def actual(rows: DataFrame) -> DataFrame:
    """Date, Payee, Notes, Amount; the verdict is a hashtag in the notes."""
    notes = F.trim(F.concat(F.lit(f"#{PREFIX}-"), F.col("verdict"), F.lit(" "), F.coalesce("why", F.lit(""))))
    return rows.select(F.col("date").alias("Date"), defused(F.col("description")).alias("Payee"), defused(notes).alias("Notes"), F.col("amount").alias("Amount"))


def firefly(rows: DataFrame) -> DataFrame:
    """date, description, amount, tags, notes."""
    given = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    notes = F.concat_ws(" | ", given(F.col("why")), F.concat(F.lit("receipt: "), given(F.col("receipt"))), given(F.col("checks")))
    return rows.select("date", defused(F.col("description")).alias("description"), "amount", tag(F.col("verdict")).alias("tags"), defused(notes).alias("notes"))


def firefly_config(account_id: str = "") -> str:
    """The importer's column mapping; an unknown account is left at 0 so that the importer asks."""
    roles = ["date_transaction", "description", "amount", "tags-comma", "note"]
    made = {
        "version": 3,
        "source": PREFIX,
        "date": "Y-m-d",
        "delimiter": "comma",
        "headers": True,
        "roles": roles,
        "do_mapping": [False] * 5,
        "mapping": [[] for _ in roles],
        "default_account": int(account_id) if str(account_id).isdigit() else 0,
        "duplicate_detection_method": "cell",
        "unique_column_index": 1,
        "unique_column_type": "description",
    }
    return json.dumps(made, indent=2) + "\n"


def beancount(rows: DataFrame, account: str = "Assets:Bank:Checking", expenses: str = "Expenses:Unknown", currency: str = "USD") -> DataFrame:
    """One text block for each dated row; flagged ``!`` unless reconciled or accepted; in the statement's currency where it states one."""
    quoted = lambda c: F.regexp_replace(defused(c), '"', "'")
    meta = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f'  {PREFIX}-{name}: "'), quoted(c), F.lit('"')))
    flag = F.when(F.col("verdict").isin("reconciled", "accepted"), F.lit("*")).otherwise(F.lit("!"))
    unit = F.coalesce("currency", F.lit(currency))
    block = F.concat_ws(
        "\n",
        F.concat(F.col("date"), F.lit(" "), flag, F.lit(' "'), quoted(F.col("description")), F.lit('"')),
        meta("verdict", F.col("verdict")),
        meta("why", F.col("why")),
        meta("receipt", F.col("receipt")),
        F.concat(F.lit(f"  {account}  "), F.col("amount"), F.lit(" "), unit),
        F.lit(f"  {expenses}"),
        F.lit(""),
    )
    return rows.filter("date != ''").select("statement_id", "row", block.alias("value"))


CSV_TARGETS = {"generic": generic, "actual": actual, "firefly": firefly}


def write(rows: DataFrame, target: str, path: str, single_file: bool = False) -> None:
    """Writes a ledger in statement order. ``single_file`` is for one person's ledger; otherwise files are as many as partitions."""
    ordered = rows.orderBy("statement_id", "row")
    if single_file:
        ordered = ordered.coalesce(1)
    if target == "beancount":
        beancount(ordered).select("value").write.mode("overwrite").text(path)
        return
    CSV_TARGETS[target](ordered).write.mode("overwrite").option("header", True).option("lineSep", "\n").option("emptyValue", "").csv(path)


def verdict_counts(rows: DataFrame) -> DataFrame:
    """(verdict, n) over all rows."""
    return rows.groupBy("verdict").agg(F.count("*").alias("n"))


#: Verdicts in the order in which a summary names them.
ORDER = ("possible-duplicate", "reconciled", "accepted", "does-not-reconcile", "ambiguous", "unchecked")


def summary(rows: DataFrame) -> DataFrame:
    """(summary): one sentence that leaves no verdict out."""
    counted = verdict_counts(rows)  # a row for each verdict
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("verdict"))
    named = F.struct(place.alias("place"), F.concat(F.col("n").cast("string"), F.lit(" "), F.col("verdict")).alias("text"))
    made = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("string").alias("all"), F.array_sort(F.collect_list(named)).alias("each"))
    return made.select(F.concat("all", F.lit(" transactions: "), F.array_join(F.transform("each", lambda x: x["text"]), ", ")).alias("summary"))
