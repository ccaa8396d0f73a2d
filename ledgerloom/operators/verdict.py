"""Checking receipts against themselves and against charges: checks of three values and one verdict.

Receipts come as columns subtotal_cents, tax_cents, tip_cents, fees_cents, discount_cents, total_cents, each with an optional
companion ``<field>_present`` (true where the field is printed, readable or not), items (array of struct with
amount_cents), currency and generated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import format_cents, normalise_currency

CENTS_PER_ITEM = 1
PARTS = (("tax", 1), ("tip", 1), ("fees", 1), ("discount", -1))
CHECKS = ("lines_sum_to_subtotal", "subtotal_builds_total", "parts_within_total", "receipt_matches_charge")


def _check(name: str, ok: Column, expected: Column, actual: Column, detail: Column) -> Column:
    expected, actual = expected.cast("bigint"), actual.cast("bigint")
    return F.struct(F.lit(name).alias("name"), ok.alias("ok"), expected.alias("expected"), actual.alias("actual"), (actual - expected).alias("gap"), detail.alias("detail"))


def poisoned_sum(items: Column) -> Column:
    """Sum of the items' amounts; null for no items or any unreadable amount."""
    amounts = F.transform(items, lambda x: x["amount_cents"])
    whole = (F.size(items) > 0) & ~F.exists(amounts, lambda x: x.isNull())
    return F.when(whole, F.aggregate(amounts, F.lit(0).cast("bigint"), lambda a, x: a + x))


def lines_sum_to_subtotal() -> Column:
    total, subtotal = poisoned_sum(F.col("items")), F.col("subtotal_cents")
    ok = F.abs(total - subtotal) <= CENTS_PER_ITEM * F.size("items")
    detail = F.when(ok.isNull(), F.lit("items or subtotal not stated")).otherwise(F.concat(F.lit("items "), format_cents(total), F.lit(", subtotal "), format_cents(subtotal)))
    return _check(CHECKS[0], ok, F.when(ok.isNotNull(), subtotal), F.when(ok.isNotNull(), total), detail)


def subtotal_builds_total(df: DataFrame) -> Column:
    built, unreadable = F.col("subtotal_cents"), F.lit(False)
    for part, sign in PARTS:
        built = built + sign * F.coalesce(f"{part}_cents", F.lit(0))
        if f"{part}_present" in df.columns:
            unreadable = unreadable | (F.coalesce(f"{part}_present", F.lit(False)) & F.col(f"{part}_cents").isNull())
    ok = F.when(~unreadable, built == F.col("total_cents"))
    detail = (
        F.when(F.col("subtotal_cents").isNull() | F.col("total_cents").isNull(), F.lit("subtotal or total not stated"))
        .when(unreadable, F.lit("an adjustment is printed but unreadable"))
        .otherwise(F.concat(F.lit("built "), format_cents(built), F.lit(", total "), format_cents(F.col("total_cents"))))
    )
    return _check(CHECKS[1], ok, F.when(ok.isNotNull(), F.col("total_cents")), F.when(ok.isNotNull(), built), detail)


def parts_within_total() -> Column:
    total, tax, tip = F.abs("total_cents"), F.abs("tax_cents"), F.abs("tip_cents")
    over = F.when(tax > total, tax).when(tip > total, tip)
    run = (F.col("total_cents") != 0) & (tax.isNotNull() | tip.isNotNull())
    ok = F.when(run, over.isNull())
    detail = F.when(run & over.isNotNull(), F.concat(F.lit("a part of "), format_cents(over), F.lit(" in a total of "), format_cents(total))).when(run, F.lit("tax and tip fit the total")).otherwise(F.lit("no total, or neither tax nor tip"))
    return _check(CHECKS[2], ok, F.when(run & over.isNotNull(), total), F.when(run, over), detail)


def receipt_matches_charge() -> Column:
    total, charged = F.abs("total_cents"), F.abs("amount_cents")
    ours, theirs = normalise_currency(F.col("charge_currency")), normalise_currency(F.col("currency"))
    apart = F.coalesce(ours != theirs, F.lit(False))
    ok = F.when(~apart, total == charged)
    detail = (
        F.when(total.isNull(), F.lit("no receipt with a total"))
        .when(charged.isNull(), F.lit("no amount on the statement line"))
        .when(apart, F.concat(F.lit("receipt in "), theirs, F.lit(", charge in "), ours))
        .otherwise(F.concat(F.lit("receipt "), format_cents(total), F.lit(", charged "), format_cents(charged)))
    )
    return _check(CHECKS[3], ok, F.when(ok.isNotNull(), charged), F.when(ok.isNotNull(), total), detail)


def reconcile(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a charge's columns beside its receipt's, null where there is none) with ``checks``, ``verdict`` and ``why``.

    One failed check is a failure. Passing needs a passed check, and for a generated receipt the match with the charge. A check
    that did not run neither passes nor fails.
    """
    checked = pairs.withColumn("checks", F.array(lines_sum_to_subtotal(), subtotal_builds_total(pairs), parts_within_total(), receipt_matches_charge()))
    failed = F.filter("checks", lambda c: F.coalesce(~c["ok"], F.lit(False)))
    passed = F.filter("checks", lambda c: F.coalesce(c["ok"], F.lit(False)))
    unrun = F.filter("checks", lambda c: c["ok"].isNull())
    generated = F.coalesce("generated", F.lit(False))
    across = F.element_at("checks", 4)
    verdict = (
        F.when(F.size(failed) > 0, F.lit("does_not_reconcile"))
        .when((F.size(passed) > 0) & (~generated | F.coalesce(across["ok"], F.lit(False))), F.lit("reconciled"))
        .otherwise(F.lit("unchecked"))
    )
    why = (
        F.when(verdict == "does_not_reconcile", F.try_element_at(failed, F.lit(1))["detail"])
        .when(verdict == "reconciled", F.concat(F.size(passed).cast("string"), F.lit(" checks agree")))
        .when(generated & (F.size(passed) > 0), F.lit("a model wrote these figures; that they agree is no evidence, and no charge matches them"))
        .when(across["detail"] == "no receipt with a total", across["detail"])
        .otherwise(F.coalesce(F.try_element_at(unrun, F.lit(1))["detail"], F.lit("nothing to check")))
    )
    return checked.withColumns({"verdict": verdict, "why": why})
