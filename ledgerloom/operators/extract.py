"""Fields of a receipt from its lines of text, as expressions over (receipt_id, text, degraded).

A receipt's lines stay an array in its row: labels and amounts are added to each, and each field is the first or last of some
of them. No row leaves its place, so reading receipts shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerloom.functions.money import first_currency, let

# Labels by field, tender and change words, confidences.
LABELS = {
    "subtotal": ("subtotal", "sub total", "net total", "goods total", "merchandise", "items total", "total ht", "total hors taxes", "zwischensumme", "netto", "total excl", "total before tax"),
    "tax": ("tax", "sales tax", "vat", "gst", "hst", "pst", "qst", "iva", "tva", "mwst", "ust", "btw", "moms", "alv", "iva incl"),
    "tip": ("tip", "gratuity", "service charge", "service"),
    "discount": ("discount", "coupon", "savings", "promotion", "you saved"),
    "fees": ("fee", "fees", "surcharge", "service fee", "booking fee"),
    "total": (
        "total", "amount due", "balance due", "grand total", "total due", "total sale", "to pay", "total ttc", "summe", "gesamt", "totale", "importe total",
        "totaal", "te betalen", "totaalbedrag", "ukupno", "razem", "celkem", "toplam", "totalt", "yhteensa", "yhteens", "suma total", "importo totale", "valor total",
    ),
}
TENDER = ("amount paid", "amount tendered", "tendered", "cash tendered", "paid", "cash", "bar", "contant", "efectivo")
CHANGE = ("change", "change due", "rueckgeld", "ruckgeld", "wisselgeld", "cambio", "rendu", "resto")
# How a sentence says that a tax is included.
INCLUSIVE = r"\b(?:whereof|of which|dont|davon|waarvan|hiervan)\b|\b(?:vat|tax|gst|hst|tva|mwst|ust|btw|iva|moms|alv|qst) *of\b"
INCLUSIVE_HINTS = ("of", "dont", "davon", "waarvan", "hiervan")
LABELLED, INFERRED, GUESSED, TRUSTED = 1.0, 0.55, 0.2, 0.6
MARK_MINIMUM = 3
MERCHANT_LINES = 6

# An amount, which no rate is; and an amount as it is cut out of a description, rates included.
_AMOUNT = r"(?<![\d.])(-?\d{1,3}(?:[,\s]\d{3})*|-?\d+)([.,])(\d{2})(?![\d%])"
_ANY_AMOUNT = r"(?<![\d.])(-?\d{1,3}(?:[,\s]\d{3})*|-?\d+)([.,])(\d{2})(?![\d])"
FIELDS = tuple(LABELS)


_RANKS = {w: 10 * len(w) + 9 - i for i, f in enumerate(FIELDS) for w in LABELS[f]}
_LONGEST = max(w.count(" ") for w in (*_RANKS, *TENDER, *CHANGE)) + 1


def plain(line: Column) -> Column:
    """A line as labels are looked up in it: small letters and spaces only."""
    return F.regexp_replace(F.lower(line), "[^a-z ]", " ")


def _array(words) -> Column:
    return F.array(*map(F.lit, words))


def _standing(words) -> str:
    """Pattern of words that stand between spaces or a line's ends; nothing is taken, so those that overlap are all found.

    Words are tried by their first letter, and only where one can begin.
    """
    by_letter: dict[str, list[str]] = {}
    for w in words:
        by_letter.setdefault(w[0], []).append(w[1:])
    tried = "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in by_letter.items())
    return f"(?=[{''.join(by_letter)}])(?<![^ ])(?=({tried})(?![^ ]))"


def phrases(plain_line: Column) -> Column:
    """Every label, tender and change word of a plain line, once each: those of one word, then of two, then of three.

    Words of a phrase are parted by one space. Lines without a word that begins a phrase, which most are, are searched once.
    """
    known = list(dict.fromkeys([*_RANKS, *TENDER, *CHANGE]))
    firsts = dict.fromkeys(w.split(" ")[0] for w in known)
    of_size = [[w for w in known if w.count(" ") + 1 == n] for n in range(1, _LONGEST + 1)]
    every = F.concat(*(F.regexp_extract_all(plain_line, F.lit(_standing(words)), F.lit(1)) for words in of_size))
    none = F.array().cast("array<string>")
    return F.when(F.regexp_like(plain_line, F.lit(_standing(firsts))), F.array_distinct(every)).otherwise(none)


def has_any(found: Column, words) -> Column:
    return F.arrays_overlap(found, _array(words))


def label_on(plain_line: Column, found: Column | None = None) -> Column:
    """The field a line is labelled as: a sentence about included tax is the tax, else the longest label; null for none.

    ``found`` are its ``phrases``. Equally long labels go by the order of fields.
    """
    ranks = F.create_map(*(F.lit(x) for pair in _RANKS.items() for x in pair))
    best = F.array_max(F.transform(phrases(plain_line) if found is None else found, lambda w: F.try_element_at(ranks, w)))
    field = F.element_at(F.array(*map(F.lit, FIELDS)), 10 - best % 10)
    # Few lines have a word that such a sentence needs.
    hint = F.lit(False)
    for word in INCLUSIVE_HINTS:
        hint = hint | F.contains(plain_line, F.lit(word))
    return F.when(hint & F.regexp_like(plain_line, F.lit(INCLUSIVE)), F.lit("tax")).when(best.isNotNull(), field)


def _cents(token: Column) -> Column:
    return F.translate(token, "., \t\n\x0b\f\r", "").try_cast("bigint")


def _parsed(text: Column, labels: bool = True) -> Column:
    """struct(mark, lines): lines is an array of (number, line, plain, amounts, phrases, label).

    Amounts are the cents of every amount on a line, left to right; rates, and amounts without the receipt's decimal mark, are left
    out. Labels are looked up where they can matter: beside amounts, and in the first lines. Values that are used more than
    once are bound by ``let``, so the expression stays small wherever the optimizer copies it. Without ``labels`` lines have their
    number, text and amounts only.
    """
    raw = F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    none = F.array().cast("array<string>")

    def tokens(line: Column) -> Column:
        return F.struct(line.alias("line"), F.when(F.regexp_like(line, F.lit(r"\d[.,]\d\d")), F.regexp_extract_all(line, F.lit(_AMOUNT), F.lit(0))).otherwise(none).alias("tokens"))

    def marked(rows: Column) -> Column:
        # An amount's mark stands before its last two digits.
        votes = F.flatten(F.transform(rows, lambda x: F.transform(x["tokens"], lambda t: F.substring(t, -3, 1))))

        def mark(v: Column) -> Column:
            dots, commas = F.size(F.filter(v, lambda m: m == ".")), F.size(F.filter(v, lambda m: m == ","))
            return F.when(F.size(v) < MARK_MINIMUM, F.lit("")).when(dots > commas, F.lit(".")).when(commas > dots, F.lit(",")).otherwise(F.lit(""))

        return let(let(votes, mark), lambda m: F.struct(m.alias("mark"), F.transform(rows, lambda x, i: line(x, i, m)).alias("lines")))

    def line(x: Column, i: Column, mark: Column) -> Column:
        kept = F.transform(F.filter(x["tokens"], lambda t: (mark == "") | (F.substring(t, -3, 1) == mark)), _cents)
        if not labels:
            return F.struct(i.alias("number"), x["line"].alias("line"), kept.alias("amounts"))
        made = F.struct(i.alias("number"), x["line"].alias("line"), plain(x["line"]).alias("plain"), kept.alias("amounts"))
        made = let(made, lambda y: y.withField("phrases", phrases(y["plain"])))
        return let(made, lambda y: y.withField("label", F.when((F.size(y["amounts"]) > 0) | (y["number"] < MERCHANT_LINES), label_on(y["plain"], y["phrases"]))))

    return let(F.transform(raw, tokens), marked)


def _reading(parsed: Column, degraded: Column) -> Column:
    """struct(fields, items, merchant) of ``_parsed`` lines."""
    first, last = (lambda a: F.try_element_at(a, F.lit(1))), (lambda a: F.try_element_at(a, F.lit(-1)))
    value = lambda x: F.element_at(x["amounts"], -1)
    stated = lambda x: F.struct(value(x).alias("value"), x["number"].alias("number"), x["line"].alias("line"))
    lines = parsed["lines"]

    def labelled(priced: Column, f: str) -> Column:
        found = F.filter(priced, lambda x: x["label"] == f)
        return F.transform(F.array(last(found) if f == "total" else F.when(degraded, last(found)).otherwise(first(found))), stated)[0].alias(f)

    def facts(priced: Column) -> Column:
        tail = F.filter(priced, lambda x: x["number"] >= F.floor(F.size(lines) * 2 / 3))
        largest = F.array_max(F.transform(tail, lambda x: F.struct(F.array_max(x["amounts"]).alias("value"), (-x["number"]).alias("up"), x["line"].alias("line"))))
        tender = last(F.transform(F.filter(priced, lambda x: has_any(x["phrases"], TENDER)), stated))
        change = F.exists(lines, lambda x: has_any(x["phrases"], CHANGE))
        return F.struct(priced.alias("priced"), *(labelled(priced, f) for f in FIELDS), largest.alias("largest"), tender.alias("tender"), change.alias("change"))

    def field(name: str, found: Column, confidence: Column, how: str, number: Column | None = None) -> Column:
        at = found["number"] if number is None else number
        return F.struct(F.lit(name).alias("field"), found["value"].alias("value_cents"), confidence.alias("confidence"), at.alias("line_number"), found["line"].alias("line"), F.lit(how).alias("how"))

    def made(x: Column) -> Column:
        level = F.when(degraded, F.lit(GUESSED)).otherwise(F.lit(LABELLED))
        unsure = F.when(degraded, F.lit(GUESSED)).otherwise(F.lit(INFERRED))
        stated_ = [F.when(x[f]["number"].isNotNull(), field(f, x[f], level, "labelled")) for f in FIELDS if f != "total"]
        total = (
            F.when(x["total"]["number"].isNotNull(), field("total", x["total"], level, "labelled"))
            .when(~x["change"] & x["tender"].isNotNull(), field("total", x["tender"], unsure, "handed over"))
            .when(x["largest"].isNotNull(), field("total", x["largest"], unsure, "largest near the end", -x["largest"]["up"]))
            .otherwise(field("total", x["total"], F.lit(0.0), "no amount"))
        )
        above = F.filter(x["priced"], lambda y: y["label"].isNull() & (y["number"] < x["subtotal"]["number"]))
        items = F.filter(F.transform(above, item), lambda y: y["description"] != "")
        fit = F.filter(F.slice(lines, 1, MERCHANT_LINES), lambda y: y["label"].isNull() & (F.size(y["amounts"]) == 0) & F.regexp_like(y["line"], F.lit(r"\p{L}.*\p{L}")))
        merchant = F.coalesce(F.trim(first(fit)["line"]), F.lit(""))
        return F.struct(F.array_compact(F.array(*stated_, total)).alias("fields"), items.alias("items"), merchant.alias("merchant"))

    def item(x: Column) -> Column:
        description = F.regexp_replace(F.regexp_replace(x["line"], _ANY_AMOUNT, ""), r"^[ .\-\t]+|[ .\-\t]+$", "")
        return F.struct(x["number"].alias("row"), description.alias("description"), value(x).alias("amount_cents"), x["line"].alias("line"))

    return let(let(F.filter(lines, lambda x: F.size(x["amounts"]) > 0), facts), made)


def lines_of(receipts: DataFrame) -> DataFrame:
    """(receipt_id, degraded, mark, number, line, plain, amounts, phrases, label): one row for each line of text."""
    parsed = receipts.select("receipt_id", F.coalesce("degraded", F.lit(False)).alias("degraded"), _parsed(F.col("text")).alias("p"))
    return parsed.select("receipt_id", "degraded", "p.mark", F.inline_outer("p.lines"))


def amounts_of(receipts: DataFrame) -> DataFrame:
    """(receipt_id, mark, number, line, amounts): ``lines_of`` without labels, which nobody then has to look up."""
    parsed = receipts.select("receipt_id", _parsed(F.col("text"), labels=False).alias("p"))
    return parsed.select("receipt_id", "p.mark", F.inline_outer("p.lines"))


def readings(receipts: DataFrame) -> DataFrame:
    """(receipt_id, fields, items, merchant): everything that the lines of (receipt_id, text, degraded) state.

    ``fields``: array of (field, value_cents, confidence, line_number, line, how). The first labelled line of a field
    counts, for the total the last; in a degraded reading the last of every field, and nothing is trusted. Without a
    total, what was handed over stands in (unless change was given), else the largest amount of the last third; neither is
    trusted. ``items``: priced, unlabelled lines above the subtotal, none without a subtotal. ``merchant``: the first of six lines
    with two letters, no amount and no label.
    """
    degraded = F.coalesce("degraded", F.lit(False))
    read = let(_parsed(F.col("text")), lambda p: _reading(p, degraded))
    return receipts.select("receipt_id", read.alias("r")).select("receipt_id", "r.fields", "r.items", "r.merchant")


def fields(read: DataFrame) -> DataFrame:
    """(receipt_id, field, value_cents, confidence, line_number, line, how) from ``readings``, one row for each field."""
    # Always at least the total, so the outer form is the same, and no filter is inferred that would read all lines twice.
    return read.select("receipt_id", F.inline_outer("fields"))


def _doubtful() -> Column:
    unsure = F.filter("fields", lambda f: f["value_cents"].isNotNull() & (f["confidence"] < TRUSTED))
    return F.array_sort(F.transform(unsure, lambda f: f["field"]))


def needs_human(read: DataFrame) -> DataFrame:
    """(receipt_id, doubtful): fields with a value that nobody should trust unseen."""
    return read.select("receipt_id", _doubtful().alias("doubtful"))


def receipts(texts: DataFrame) -> DataFrame:
    """One row for each receipt: trusted fields as columns, items, merchant and currency; columns of ``texts`` other than text stay.

    Texts that share a receipt_id are receipts of their own.
    """
    others = [c for c in texts.columns if c not in ("receipt_id", "text", "degraded")]
    base = texts.select(F.struct("receipt_id", *others, *(c for c in ("degraded",) if c in texts.columns), first_currency(F.col("text")).alias("currency")).alias("receipt_id"), "text", "degraded")
    read = readings(base)

    def trusted(name: str) -> Column:
        kept = F.filter("fields", lambda f: (f["field"] == name) & (f["confidence"] >= TRUSTED))
        return F.try_element_at(kept, F.lit(1))["value_cents"].alias(f"{name}_cents")

    return read.select("receipt_id.*", *map(trusted, FIELDS), "items", "merchant", _doubtful().alias("doubtful"))


# Whether the amounts of a receipt hold a sum at all, whatever they are labelled.

#: Digits that recognisers take for each other, in this direction.
CONFUSIONS = (("4", "8"), ("8", "4"), ("1", "7"), ("7", "1"), ("3", "8"), ("8", "3"), ("5", "6"), ("6", "5"), ("0", "8"), ("8", "0"), ("9", "4"), ("6", "8"))
NEAR_CENTS = 10
FEWEST_AMOUNTS = 3
#: So many parts are summed by a fold in the JVM, whose sums may double with each; more by bits, one for each cent.
FOLDED_PARTS = 8
_BARE_AMOUNT = r"(?<![\d.,])(\d{1,6}[.,]\d{2})(?![\d])"


def reachable(parts: Column, most: Column) -> Column:
    """All sums of one or more parts, up to ``most``: a fold that adds a part to each sum so far."""
    return F.aggregate(parts, F.array().cast("array<bigint>"), lambda sums, x: F.filter(F.array_distinct(F.concat(sums, F.transform(sums, lambda s: s + x), F.array(x))), lambda s: s <= most))


def _swapped(part: Column) -> Column:
    """What a part would be with one digit, where it first stands, taken for another."""
    digits = part.cast("string")
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in CONFUSIONS))
    swap = lambda c: F.concat(F.call_function("substring_index", digits, c["a"], F.lit(1)), c["b"], F.substr(digits, F.call_function("instr", digits, c["a"]) + 1))
    return F.array_distinct(F.transform(F.filter(pairs, lambda c: F.contains(digits, c["a"])), lambda c: swap(c).cast("bigint")))


def _one_digit_closes(parts: Column, target: Column) -> Column:
    """Whether a digit taken for another in one part is all that keeps some parts from summing to the target.

    No sum of ``parts`` is the target. So a sum that is has the changed part in it, and the others must reach what that leaves.
    """

    def with_part(x: Column, i: Column) -> Column:
        rest = reachable(F.filter(parts, lambda _, j: j != i), target)
        return let(rest, lambda r: F.exists(_swapped(x), lambda p: (p == target) | F.array_contains(r, target - p)))

    return F.exists(F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: with_part(y["x"], y["i"]))


def _swaps(part: int) -> set[int]:
    """``_swapped`` of one part."""
    digits = str(part)
    return {int(digits.replace(a, b, 1)) for a, b in CONFUSIONS if a in digits}


def nearest_sum(amounts: Sequence[int]) -> tuple[int, bool]:
    """(gap, closes) of amounts sorted the largest first: how near sums of the others come to it, and whether one digit closes the gap.

    Sums are the bits of a number, one for each cent up to twice the target, so any number of parts costs a shift each and
    no more memory. The sums of all parts but one come from halves: each half starts with the sums of the other.
    """
    target, parts = amounts[0], list(amounts[1:])

    def plus(sums: int, more: Sequence[int], mask: int) -> int:
        for x in more:
            sums |= (sums << x) & mask
        return sums

    sums = plus(1, parts, (2 << 2 * target) - 1)
    below = (sums & ((2 << target) - 1)).bit_length() - 1
    above = sums >> target
    gap = min(target - below, (above & -above).bit_length() - 1 if above else target)
    if gap <= NEAR_CENTS:
        return gap, False
    mask = (2 << target) - 1

    def closes(sums: int, some: Sequence[int]) -> bool:
        if len(set(some)) == 1:
            rest = plus(sums, some[1:], mask)
            return any(p <= target and rest >> (target - p) & 1 for p in _swaps(some[0]))
        half = len(some) // 2
        return closes(plus(sums, some[half:], mask), some[:half]) or closes(plus(sums, some[:half], mask), some[half:])

    return gap, closes(1, parts)


@F.pandas_udf(T.StructType([T.StructField("gap", T.LongType()), T.StructField("closes", T.BooleanType())]))
def _nearest(amounts: pd.Series) -> pd.DataFrame:
    found = [(None, None) if x is None else nearest_sum(x.tolist()) for x in amounts]
    gaps, closes = pd.array([g for g, _ in found], dtype="Int64"), pd.array([c for _, c in found], dtype="boolean")
    return pd.DataFrame({"gap": gaps, "closes": closes})


def arithmetic(texts: DataFrame) -> DataFrame:
    """(receipt_id, n_amounts, gap, verdict): whether some amounts of a text sum to its largest: exact, near, far or too few amounts.

    All sums of all other amounts are looked at, however many there are. Near is a gap of a few cents, or one that a digit taken
    for another explains.
    """
    tokens = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_BARE_AMOUNT), F.lit(1))
    found = texts.select("receipt_id", F.sort_array(F.transform(tokens, _cents), asc=False).alias("amounts"))
    found = found.withColumn("many", _nearest(F.when(F.size("amounts") > FOLDED_PARTS + 1, F.col("amounts"))))
    target, parts = F.try_element_at("amounts", F.lit(1)), F.slice("amounts", 2, F.greatest(F.size("amounts"), F.lit(1)))
    # No part is over the target, so no sum over twice the target is nearer than a single part.
    folded = F.array_min(F.transform(reachable(parts, 2 * target), lambda s: F.abs(s - target)))
    enough, few = F.size("amounts") >= FEWEST_AMOUNTS, F.size("amounts") <= FOLDED_PARTS + 1
    found = found.withColumn("gap", F.when(enough, F.when(few, folded).otherwise(F.col("many.gap"))))
    near = (F.col("gap") <= NEAR_CENTS) | F.when(few, _one_digit_closes(parts, target)).otherwise(F.col("many.closes"))
    verdict = F.when(~enough, F.lit("too few amounts")).when(F.col("gap") == 0, F.lit("exact")).when(near, F.lit("near")).otherwise(F.lit("far"))
    return found.select("receipt_id", F.size("amounts").alias("n_amounts"), "gap", verdict.alias("verdict"))


def amounts_by_kind(texts: DataFrame) -> DataFrame:
    """(kind, texts, with_text, with_amounts, median_amounts) of (kind, text): how many texts hold at least three amounts; the upper median of counts."""
    n = F.size(F.regexp_extract_all("text", F.lit(_BARE_AMOUNT), F.lit(1)))
    # Counts of amounts are few, however many texts there are.
    counts = texts.select("kind", F.when(F.trim("text") != "", n).alias("n")).groupBy("kind", "n").agg(F.count("*").alias("times"))
    kind = Window.partitionBy("kind")
    reached = F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).over(kind.orderBy("n"))
    counts = counts.withColumns({"reached": reached, "half": F.floor(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).over(kind) / 2)})
    read = F.col("n").isNotNull()
    return counts.groupBy("kind").agg(
        F.sum("times").alias("texts"),
        F.coalesce(F.sum(F.when(read, F.col("times"))), F.lit(0)).alias("with_text"),
        F.coalesce(F.sum(F.when(F.col("n") >= FEWEST_AMOUNTS, F.col("times"))), F.lit(0)).alias("with_amounts"),
        F.min(F.when(F.col("reached") > F.col("half"), F.col("n"))).alias("median_amounts"),
    )


def boxes(words: DataFrame) -> DataFrame:
    """(doc_id, line, left, top, right, bottom): each line's rectangle from its words' boxes."""
    right, bottom = F.max(F.col("left") + F.col("width")), F.max(F.col("top") + F.col("height"))
    return words.groupBy("doc_id", "line").agg(F.min("left").alias("left"), F.min("top").alias("top"), right.alias("right"), bottom.alias("bottom"))
