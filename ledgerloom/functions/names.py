"""Merchant names: normal forms as expressions, and similarity with an Arrow UDF only where tokens can't decide."""

from __future__ import annotations

import difflib
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Payment processors' prefixes, and words that say nothing about a merchant.
PREFIXES = ("sq *", "tst*", "sp *", "pp*", "paypal *")
NOISE = (
    "pos", "purchase", "debit", "credit", "card", "visa", "mastercard", "amex", "payment", "pmt", "transaction", "txn", "ref",
    "auth", "recurring", "online", "www", "com", "inc", "llc", "ltd", "co", "store", "shop", "no", "nr", "id",
)
RATIO_FLOOR = 0.8

_PREFIX = r"\b(?:" + "|".join(p.replace("*", r"\*") for p in PREFIXES) + ")"
_NOISE = r"\b(?:" + "|".join(NOISE) + r"|xx+|[0-9]{4,})\b"


def normalise_merchant(raw: Column) -> Column:
    """The part of a descriptor that names the merchant; '' for none."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    text = F.when(F.contains(low, F.lit("*")), F.regexp_replace(low, _PREFIX, " ")).otherwise(low)
    text = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9 ]", " "), _NOISE, " ")
    return F.trim(F.regexp_replace(text, " +", " "))


def stable_name(merchant: Column) -> Column:
    """A normal name without trailing tokens that hold a digit; the first token stays."""
    return F.regexp_replace(merchant, r"(?<=\S)(?: [^ ]*[0-9][^ ]*)+$", "")


def containment(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller token set of two normal names."""
    left, right = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    shared = F.size(F.array_intersect(left, right)) / F.least(F.size(left), F.size(right))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(shared)


def ratio(a: str, b: str) -> float:
    """Matching characters of two names, in this order (the measure is not symmetric)."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def ratio_bound(a: str, b: str) -> float:
    """No ratio is above this: letters that two names share, wherever they stand."""
    if not a or not b:
        return 0.0
    return 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = list(zip(a, b))
    known = {pair: 0.0 if pair[0] is None else ratio(*pair) for pair in set(pairs)}
    return pd.Series([known[pair] for pair in pairs], dtype=float)


def ratio_limit(a: Column, b: Column) -> Column:
    """A bound of ``ratio`` that is cheap: what must be inserted and deleted is no matching character, and is no less than the edit distance."""
    total = F.length(a) + F.length(b)
    short = 2 * F.least(F.length(a), F.length(b)) / total
    return F.when(short >= RATIO_FLOOR, 1 - F.levenshtein(a, b) / total).otherwise(short)


def with_similarity(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``df`` with the similarity of two columns of normal names: containment, or a ratio of at least the floor.

    Only pairs whose edit distance allows such a ratio, and whose tokens don't decide, reach Python (as non-null arguments).
    """
    x, y = F.col(a), F.col(b)
    held = F.when((x != "") & (x == y), F.lit(1.0)).otherwise(containment(x, y))
    with_held = df.withColumn("__held", held)
    ask = (F.col("__held") < 1) & (x != "") & (y != "") & (ratio_limit(x, y) >= RATIO_FLOOR)
    asked = with_held.withColumn("__ratio", _ratios(F.when(ask, x), F.when(ask, y)))
    close = F.when(F.col("__ratio") >= RATIO_FLOOR, F.col("__ratio")).otherwise(F.lit(0.0))
    return asked.withColumn(out, F.greatest("__held", close)).drop("__held", "__ratio")
