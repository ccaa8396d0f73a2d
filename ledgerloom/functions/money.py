"""Money as whole cents: reading, evidence about decimal marks, currencies, and printing. All Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What may stand around an amount, and currency marks with their codes.
CURRENCY_CODES = (
    "USD", "EUR", "GBP", "JPY", "THB", "SGD", "AUD", "CAD", "CHF", "SEK", "NOK", "DKK", "PLN", "CZK", "HUF", "INR", "CNY", "HKD",
    "NZD", "ZAR", "MXN", "BRL",
)
CURRENCY_MARKS = {"$": "USD", "£": "GBP", "€": "EUR", "¥": "JPY", "₹": "INR"}

# Only a word of three letters is compared with the codes.
_CODE = r"(?<![A-Za-z])(?=[A-Za-z]{3}(?![A-Za-z]))(?:" + "|".join(CURRENCY_CODES) + ")"
_FURNITURE = r"(?iU)[$£€¥₹\s ']|" + _CODE
_MARK = r"(?i)[$£€¥₹]|" + _CODE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_furniture(raw: Column) -> Column:
    """The text without currency marks and codes, white space and apostrophes."""
    return F.regexp_replace(raw, _FURNITURE, "")


def _last(text: Column, mark: str) -> Column:
    """One-based place of the last mark, 0 if there is none."""
    return F.when(F.contains(text, F.lit(mark)), F.length(text) - F.length(F.substring_index(text, mark, -1))).otherwise(F.lit(0))


def decimal_vote(raw: Column) -> Column:
    """struct(both, mark): which decimal mark this one value speaks for (null: none), and whether it holds both marks."""

    def body(text: Column) -> Column:
        point, comma = _last(text, "."), _last(text, ",")
        later = F.when(point > comma, F.lit(".")).otherwise(F.lit(","))
        both = (point > 0) & (comma > 0)
        short = F.regexp_like(text, F.lit("[.,][0-9]{1,2}$"))
        return F.struct(both.alias("both"), F.when(both | short, later).alias("mark"))

    return let(F.coalesce(strip_furniture(raw), F.lit("")), body)


def own_mark(text: Column) -> Column:
    """The decimal mark of one bare number: the later of two; a lone mark unless exactly three digits follow it."""
    point, comma = _last(text, "."), _last(text, ",")
    lone = F.when(point > 0, F.lit(".")).when(comma > 0, F.lit(","))
    return F.when((point > 0) & (comma > 0), F.when(point > comma, F.lit(".")).otherwise(F.lit(","))).when(~F.regexp_like(text, F.lit("[.,][0-9]{3}$")), lone)


def parse_cents(raw: Column, mark: Column | None = None) -> Column:
    """Cents as BIGINT; null for whatever isn't an amount, never zero.

    ``mark`` is the decimal mark of the document where known ('' or null: unknown). Parentheses, a leading minus and a
    trailing DR make the amount negative; a third decimal other than zero is no money.
    """
    mark = F.coalesce(mark, F.lit("")) if mark is not None else F.lit("")
    bare = strip_furniture(raw)

    def signed(text: Column) -> Column:
        closed = F.startswith(text, F.lit("(")) & F.endswith(text, F.lit(")"))
        inner = F.when(closed, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)

        def suffixed(x: Column) -> Column:
            end = F.upper(F.right(x, F.lit(2)))
            body = F.when(end.isin("CR", "DR"), F.substring(x, F.lit(1), F.length(x) - 2)).otherwise(x)

            def led(y: Column) -> Column:
                first = F.substring(y, 1, 1)
                number = F.when(first.isin("-", "+"), F.substring(y, F.lit(2), F.length(y))).otherwise(y)
                minus = closed.cast("int") + (end == "DR").cast("int") + (first == "-").cast("int")
                return F.struct((1 - 2 * (minus % 2)).alias("sign"), number.alias("number"))

            return let(body, led)

        return let(inner, suffixed)

    def valued(x: Column) -> Column:
        text = x["number"]
        own = own_mark(text)
        # The document's mark decides wherever it occurs in the value.
        used = F.when((mark != "") & F.contains(text, mark), mark).otherwise(own)
        whole_only = F.when(F.regexp_like(text, F.lit(r"^(?:[0-9]+|(?!0+[.,])[0-9]{1,3}(?:(?:\.[0-9]{3})+|(?:,[0-9]{3})+))$")), F.regexp_replace(text, "[.,]", ""))
        shape = (
            F.when(used == ".", F.regexp_like(text, F.lit(r"^(?:[0-9]*|(?!0+,)[0-9]{1,3}(?:,[0-9]{3})+)\.[0-9]{1,2}0*$")))
            .when(used == ",", F.regexp_like(text, F.lit(r"^(?:[0-9]*|(?!0+\.)[0-9]{1,3}(?:\.[0-9]{3})+),[0-9]{1,2}0*$")))
        )
        fraction = F.regexp_extract(text, "[.,]([0-9]+)$", 1)
        head = F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - F.length(fraction)), "[.,]", "")
        digits = F.when(used.isNull(), F.concat(whole_only, F.lit("00"))).when(shape, F.concat(head, F.rpad(F.substring(fraction, 1, 2), 2, "0")))
        return digits.try_cast("bigint") * x["sign"]

    return F.when(bare != "", let(let(bare, signed), valued))


def format_cents(cents: Column, missing: str = "") -> Column:
    """Cents as a signed decimal string."""
    size = F.abs(cents)
    text = F.concat(F.when(cents < 0, F.lit("-")).otherwise(F.lit("")), F.floor(size / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))
    return F.coalesce(text, F.lit(missing))


def normalise_currency(mark: Column) -> Column:
    """A symbol or code as a code; null where nothing is stated or it isn't one."""

    def code(text: Column) -> Column:
        out = F.when(F.regexp_like(text, F.lit("^[A-Za-z]+$")), F.upper(text))
        for symbol, known in CURRENCY_MARKS.items():
            out = F.when(text == symbol, F.lit(known)).otherwise(out)
        return out

    return let(F.trim(mark), code)


def first_currency(text: Column) -> Column:
    """The first currency mark or code in a text, as a code; the text is searched once."""
    found = F.nullif(F.regexp_extract(text, _MARK, 0), F.lit(""))
    return normalise_currency(found)


def document_mark(vote: Column, order: Column) -> Column:
    """Aggregate of ``decimal_vote``: the first value with both marks decides, else the votes if they agree, else ''."""
    first = F.min_by(F.when(vote["both"], vote["mark"]), F.when(vote["both"], order))
    votes = F.collect_set(F.when(~vote["both"], vote["mark"]))
    return F.coalesce(first, F.when(F.size(votes) == 1, F.element_at(votes, 1)), F.lit(""))
