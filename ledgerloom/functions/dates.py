"""Dates: the day/month order of a file as an aggregate, and null for whatever isn't a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMERIC = r"^\s*(\d{1,4})[/.\-](\d{1,2})[/.\-](\d{1,4})"

# The formats that receipts' and charges' dates are tried in, in this order.
FORMATS = ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d-M-yyyy", "d.M.yyyy", "yyyyMMdd")


def _part(raw: Column, n: int) -> Column:
    return F.regexp_extract(raw, _NUMERIC, n).try_cast("int")


def _year_first(raw: Column) -> Column:
    return F.length(F.regexp_extract(raw, _NUMERIC, 1)) == 4


def order_vote(raw: Column) -> Column:
    """'dmy' or 'mdy' if this value can only be read so, 'open' if either, null if it needs no order or is no date."""
    needs = F.regexp_like(F.coalesce(raw, F.lit("")), F.lit(_NUMERIC)) & ~_year_first(raw)
    return F.when(needs, F.when(_part(raw, 1) > 12, F.lit("dmy")).when(_part(raw, 2) > 12, F.lit("mdy")).otherwise(F.lit("open")))


def date_order(vote: Column) -> Column:
    """Aggregate: 'dmy', 'mdy', 'mixed' (both seen: refuse), 'unsettled' (an order is needed, none is shown: refuse) or ''."""
    votes = F.collect_set(F.when(vote != "open", vote))
    return (
        F.when(F.size(votes) > 1, F.lit("mixed"))
        .when(F.size(votes) == 1, F.element_at(votes, 1))
        .when(F.count(vote) > 0, F.lit("unsettled"))
        .otherwise(F.lit(""))
    )


def _made(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def resolve_date(raw: Column, order: Column) -> Column:
    """DATE of a numeric date under the file's order; what follows the date is ignored, impossible dates are null."""
    a, b, c = _part(raw, 1), _part(raw, 2), _part(raw, 3)
    year = F.when(c < 100, c + 2000).otherwise(c)
    other = F.when(order == "dmy", _made(year, b, a)).otherwise(_made(year, a, b))
    return F.when(F.regexp_like(raw, F.lit(_NUMERIC)), F.when(_year_first(raw), _made(a, b, c)).otherwise(other))


def any_date(raw: Column) -> Column:
    """DATE of the first of the fixed formats that fits the first ten characters."""
    text = F.substring(F.trim(raw), 1, 10)
    return F.coalesce(*(F.try_to_date(text, f) for f in FORMATS))
