"""Bank statements from CSV and OFX texts: one scan for each file, then Catalyst expressions over all files at once.

A refused file is a row of ``refusals`` and has no lines; one bad file never fails a job over many.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.dates import order_vote, resolve_date
from ledgerloom.functions.money import decimal_vote, first_currency, normalise_currency, parse_cents

# Header names by role, delimiters in order of preference, header search depth.
HEADERS = {
    "date": ("date", "transaction date", "posted date", "posting date", "date posted", "trans date", "value date", "booking date", "datum", "buchungstag", "fecha", "data"),
    "description": ("description", "details", "narrative", "payee", "merchant", "memo", "particulars", "transaction description", "name", "beschreibung", "verwendungszweck", "descripcion", "omschrijving"),
    "amount": ("amount", "value", "transaction amount", "amt", "betrag", "importe", "importo", "montant", "bedrag", "belopp", "kwota", "valor", "iznos", "summa"),
    "debit": ("debit", "withdrawal", "withdrawals", "money out", "paid out", "debit amount", "soll", "debito", "debit eur"),
    "credit": ("credit", "deposit", "deposits", "money in", "paid in", "credit amount", "haben", "credito"),
    "balance": ("balance", "running balance", "closing balance", "balance after", "kontostand", "saldo", "solde", "saldo contabile"),
}
DELIMITERS = (",", ";", "\t", "|")
HEADER_LINES = 8

ROLES = tuple(HEADERS)
_MONEY = ("amount", "debit", "credit")
_ROLE_OF = {name: role for role, names in HEADERS.items() for name in names}
_CELLS = "statement_id string, code string, row int, " + ", ".join(f"{r} string" for r in ROLES) + ", has_amount boolean, has_date boolean, has_description boolean, cells string"


#: Marks a file that is passed on whole.
OFX = "ofx"


class Statements(NamedTuple):
    lines: DataFrame
    statements: DataFrame
    refusals: DataFrame


def header_name(header: str) -> str:
    return re.sub(r"[^a-z ]", " ", (header or "").lower()).strip()


def column_roles(names: list[str]) -> dict[str, int]:
    """Role to column: the first header that claims a role has it; a bracketed qualifier is dropped on a second try."""
    roles: dict[str, int] = {}
    for again in (False, True):
        for i, name in enumerate(names):
            role = _ROLE_OF.get(header_name(re.sub(r"\(.*?\)|\[.*?\]", "", name or "") if again else name))
            if role and role not in roles and i not in roles.values():
                roles[role] = i
    return roles


def find_header(text: str) -> tuple[str, int, dict[str, int]] | None:
    """(delimiter, line number, roles) of the first line that names a money column and one more role."""
    best = None
    for n, line in enumerate(text.split("\n")[:HEADER_LINES]):
        for delimiter in DELIMITERS:
            if delimiter not in line:
                continue
            roles = column_roles(next(csv.reader([line.rstrip("\r")], delimiter=delimiter), []))
            if len(roles) >= 2 and any(r in roles for r in _MONEY) and (best is None or len(roles) > len(best[2])):
                best = (delimiter, n, roles)
        if best:
            return best
    return None



def _csv_rows(batches: Iterator[pd.DataFrame], ofx: bool = False) -> Iterator[pd.DataFrame]:
    """The rows of files that hold delimited text; with ``ofx`` the others are passed on whole, as one row each."""

    def one(name: str, text: str) -> Iterator[tuple]:
        nothing = (None,) * len(ROLES)
        if ofx and "<STMTTRN>" in text.upper():
            yield (name, OFX, 0, *nothing, False, False, False, text)
            return
        text = text.removeprefix("﻿")
        if not text.strip():
            yield (name, "no_rows", 0, *nothing, False, False, False, None)
            return
        found = find_header(text)
        if found is None:
            yield (name, "no_money_column", 0, *nothing, False, False, False, None)
            return
        delimiter, skip, roles = found
        flags = ("amount" in roles, "date" in roles, "description" in roles)
        reader = csv.reader(io.StringIO("\n".join(text.split("\n")[skip:])), delimiter=delimiter)
        names = next(reader)
        # The header's own row tells what a file without rows looked like.
        yield (name, None, 0, *nothing, *flags, None)
        number = 0
        for values in reader:
            if not any(v.strip() for v in values):
                continue
            number += 1
            cell = lambda role: values[roles[role]].strip() if role in roles and roles[role] < len(values) else None  # noqa: B023, E731
            yield (name, None, number, *(cell(r) for r in ROLES), *flags, json.dumps(dict(zip(names, values)), ensure_ascii=False))

    for batch in batches:
        rows = [row for name, text in zip(batch["statement_id"], batch["text"]) for row in one(name, text or "")]
        columns = [c.split()[0] for c in _CELLS.split(", ")]
        yield pd.DataFrame(rows, columns=columns)


def _blank(c: str):
    return F.coalesce(F.trim(c), F.lit("")) == ""


def statement_rows(files: DataFrame, ofx: bool = True) -> DataFrame:
    """All rows of (statement_id, text) files with what was made of them: one pass over the files, from which ``statements_of`` tells."""
    rows = files.select("statement_id", "text").mapInPandas(partial(_csv_rows, ofx=ofx), _CELLS)
    money = ("amount", "debit", "credit", "balance")
    whole = Window.partitionBy("statement_id")
    # Evidence of each row, then of the whole file: one window over the file decides marks, dates and currency for all rows.
    votes = F.array(*(decimal_vote(F.col(c)) for c in money))
    values = F.map_values(F.from_json("cells", "map<string,string>"))
    rows = rows.withColumns({"votes": votes, "marks": F.transform(values, first_currency), "date_vote": order_vote(F.col("date"))})
    both = F.filter("votes", lambda v: v["both"])
    rows = rows.withColumns({"first_both": F.try_element_at(both, F.lit(1))["mark"], "lone": F.transform(F.filter("votes", lambda v: ~v["both"] & v["mark"].isNotNull()), lambda v: v["mark"])})
    every = lambda c: F.array_distinct(F.flatten(F.collect_set(c).over(whole)))
    facts = rows.withColumns(
        {
            "settled": F.min(F.when(F.col("first_both").isNotNull(), F.struct("row", "first_both"))).over(whole)["first_both"],
            "lones": every("lone"),
            "currencies": F.array_compact(every("marks")),
            "date_votes": F.collect_set("date_vote").over(whole),
        }
    )
    orders = F.array_remove("date_votes", "open")
    facts = facts.withColumns(
        {
            "mark": F.coalesce("settled", F.when(F.size("lones") == 1, F.element_at("lones", 1)), F.lit("")),
            "currency": F.when(F.size("currencies") == 1, F.element_at("currencies", 1)),
            "date_order": F.when(F.size(orders) > 1, F.lit("mixed")).when(F.size(orders) == 1, F.element_at(orders, 1)).when(F.size("date_votes") > 0, F.lit("unsettled")).otherwise(F.lit("")),
        }
    ).drop("votes", "marks", "date_vote", "first_both", "lone", "settled", "lones", "currencies", "date_votes")
    read = facts.withColumns({f"{c}_c": parse_cents(F.col(c), F.col("mark")) for c in money})
    debit, credit = F.nullif("debit_c", F.lit(0)), F.nullif("credit_c", F.lit(0))
    # A zero on the unused side of a split row is no amount.
    split = F.when(debit.isNotNull(), -F.abs(debit)).when(credit.isNotNull(), F.abs(credit)).otherwise(F.coalesce("debit_c", "credit_c"))
    read = read.withColumn("amount_cents", F.when(F.col("has_amount"), F.col("amount_c")).otherwise(split))
    unreadable = F.lit(False)
    for c in money:
        seen = ~_blank(c) & F.col(f"{c}_c").isNull()
        unreadable = unreadable | (~F.col("has_amount") & seen if c in ("debit", "credit") else seen)
    two_sided = ~F.col("has_amount") & debit.isNotNull() & credit.isNotNull()
    head = (F.col("row") == 0) & F.col("date_order").isin("mixed", "unsettled")
    code = F.coalesce("code", F.when(unreadable, F.lit("unreadable_amount")).when(two_sided, F.lit("both_sides")).when(head, F.concat(F.lit("dates_"), "date_order")))
    read = read.withColumn("code", code)
    read = read.withColumns({"refused": F.min(F.when(F.col("code").isNotNull(), F.struct("row", "code"))).over(whole), "n_amounts": F.count("amount_cents").over(whole)})
    return read.withColumn("refused", F.coalesce("refused", F.when(F.col("n_amounts") == 0, F.struct(F.lit(0).alias("row"), F.lit("no_amounts").alias("code")))))


def _delimited(read: DataFrame) -> Statements:
    refusals = read.filter((F.col("row") == 0) & F.col("refused").isNotNull()).select("statement_id", "refused.code", "refused.row")
    lines = read.filter(F.col("refused").isNull() & (F.col("row") > 0) & F.col("amount_cents").isNotNull()).select(
        "statement_id",
        "row",
        resolve_date(F.col("date"), F.col("date_order")).alias("date"),
        F.coalesce("description", F.lit("")).alias("description"),
        "amount_cents",
        F.col("balance_c").alias("balance_cents"),
        "currency",
        F.from_json("cells", "map<string,string>").alias("raw"),
    )
    nothing = F.lit(None).cast("bigint")
    statements = read.filter(F.col("refused").isNull() & (F.col("row") == 0)).select(
        "statement_id",
        F.lit("csv").alias("source"),
        F.col("mark").alias("decimal_separator"),
        "currency",
        nothing.alias("period_total_cents"),
        nothing.alias("opening_balance_cents"),
        nothing.alias("closing_balance_cents"),
        (F.col("has_date") & F.col("has_description")).alias("auditable"),
    )
    return Statements(lines, statements, refusals)


def _tag(block, name: str):
    value = F.trim(F.regexp_extract(block, f"(?i)<{name}>([^<\\r\\n]*)", 1))
    return F.nullif(value, F.lit(""))


def parse_ofx(files: DataFrame) -> Statements:
    """Statements of (statement_id, text) rows that hold OFX; expressions only."""
    blocks = F.regexp_extract_all("text", F.lit(r"(?is)<STMTTRN>(.*?)(?=</STMTTRN>|<STMTTRN>|</BANKTRANLIST>|$)"), F.lit(1))
    heads = files.select("statement_id", _tag(F.col("text"), "CURDEF").alias("currency"), parse_cents(_tag(F.regexp_extract("text", r"(?is)<LEDGERBAL>(.*)", 1), "BALAMT")).alias("closing_balance_cents"), blocks.alias("blocks"))
    rows = heads.select("statement_id", "currency", F.posexplode("blocks").alias("at", "block"))
    read = rows.select(
        "statement_id",
        "currency",
        (F.col("at") + 1).alias("row"),
        F.try_to_date(F.substring(_tag(F.col("block"), "DTPOSTED"), 1, 8), "yyyyMMdd").alias("date"),
        F.coalesce(_tag(F.col("block"), "NAME"), _tag(F.col("block"), "MEMO"), F.lit("")).alias("description"),
        parse_cents(_tag(F.col("block"), "TRNAMT")).alias("amount_cents"),
        F.create_map(F.lit("block"), F.col("block")).alias("raw"),
    )
    none = heads.filter(F.size("blocks") == 0).select("statement_id", F.lit("no_rows").alias("code"), F.lit(0).alias("row"))
    bad = read.filter(F.col("amount_cents").isNull()).groupBy("statement_id").agg(F.min("row").alias("row")).select("statement_id", F.lit("unreadable_amount").alias("code"), "row")
    refusals = none.unionByName(bad)
    lines = read.join(refusals.select("statement_id"), "statement_id", "left_anti").select(
        "statement_id", "row", "date", "description", "amount_cents", F.lit(None).cast("bigint").alias("balance_cents"), normalise_currency(F.col("currency")).alias("currency"), "raw"
    )
    nothing = F.lit(None).cast("bigint")
    statements = heads.join(refusals.select("statement_id"), "statement_id", "left_anti").select(
        "statement_id",
        F.lit("ofx").alias("source"),
        F.lit(".").alias("decimal_separator"),
        normalise_currency(F.col("currency")).alias("currency"),
        nothing.alias("period_total_cents"),
        nothing.alias("opening_balance_cents"),
        "closing_balance_cents",
        F.lit(True).alias("auditable"),
    )
    return Statements(lines, statements, refusals)


def parse_csv(files: DataFrame) -> Statements:
    """Statements of (statement_id, text) rows that hold delimited text."""
    return _delimited(statement_rows(files, ofx=False))


def statements_of(read: DataFrame) -> Statements:
    """Statements of both kinds from ``statement_rows``."""
    whole = F.coalesce(F.col("code") == OFX, F.lit(False))
    a, b = _delimited(read.filter(~whole)), parse_ofx(read.filter(whole).select("statement_id", F.col("cells").alias("text")))
    return Statements(*(x.unionByName(y) for x, y in zip(a, b)))


def parse(files: DataFrame) -> Statements:
    """Both kinds, told apart by content."""
    return statements_of(statement_rows(files))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(statement_id, text): one row for each file under a path."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("statement_id"), F.col("value").alias("text"))
