import datetime

from pyspark.sql import functions as F

from ledgerloom.functions.dates import any_date, date_order, order_vote, resolve_date
from ledgerloom.functions.money import decimal_vote, document_mark, first_currency, format_cents, normalise_currency, parse_cents
from ledgerloom.functions.names import containment, normalise_merchant, ratio, stable_name, with_similarity

MONEY = [
    ("2,345.60", "", 234560),
    ("2.345,60", "", 234560),
    ("23,45", "", 2345),
    ("2,345", "", 234500),
    ("2.345", "", 234500),
    ("2.345", ".", None),
    ("(55.00)", "", -5500),
    ("55.00 DR", "", -5500),
    ("-55.00", "", -5500),
    ("55.00 CR", "", 5500),
    ("€ 55.00", "", 5500),
    ("55.00 EUR", "", 5500),
    ("0.002", "", None),
    ("3.4.5", "", None),
    ("7..00", "", None),
    ("--7", "", None),
    ("n/a", "", None),
    ("", "", None),
    (None, "", None),
    ("100,000,000,000,000.00", "", 10**16),
    ("17", "", 1700),
    (".5", "", 50),
    ("1.230", ".", 123),
    ("12.3456", "", None),
    ("(1.234,5 DR)", "", 123450),
    ("1'234.50", "", 123450),
    ("12,34,567", "", None),
    ("-0,50", "", -50),
    ("0", "", 0),
]


def test_parse_cents(spark):
    df = spark.createDataFrame([(i, *m) for i, m in enumerate(MONEY)], "i int, raw string, mark string, want bigint")
    got = df.select("i", parse_cents(F.col("raw"), F.col("mark")).alias("got"), format_cents(F.col("want")).alias("text")).collect()
    assert {r["i"]: r["got"] for r in got} == {i: m[2] for i, m in enumerate(MONEY)}
    assert next(r["text"] for r in got if r["i"] == 27) == "-0.50"


def test_round_trip(spark):
    df = spark.range(-20_000, 20_000, 37).select(F.col("id").alias("c"))
    bad = df.filter(~parse_cents(format_cents(F.col("c")), F.lit(".")).eqNullSafe(F.col("c")))
    assert bad.count() == 0


def test_decimal_evidence(spark):
    rows = [("a", 1, "1,50"), ("a", 2, "3,75"), ("b", 1, "1.50"), ("b", 2, "2,50"), ("c", 1, "1.50"), ("c", 2, "1.234,50"), ("d", 1, "1,234"), ("d", 2, None)]
    df = spark.createDataFrame(rows, "k string, n int, raw string").withColumn("v", decimal_vote(F.col("raw")))
    got = {r["k"]: r["m"] for r in df.groupBy("k").agg(document_mark(F.col("v"), F.col("n")).alias("m")).collect()}
    assert got == {"a": ",", "b": "", "c": ",", "d": ""}


def test_dates(spark):
    rows = [("iso", "2024-02-03"), ("eu", "25/12/2024"), ("eu", "03/04/24"), ("us", "12/25/2024"), ("mixed", "25/12/2024"), ("mixed", "12/25/2024"), ("open", "03/04/2024"), ("text", "14 Aug 2026")]
    df = spark.createDataFrame(rows, "k string, raw string")
    orders = {r["k"]: r["o"] for r in df.groupBy("k").agg(date_order(order_vote(F.col("raw"))).alias("o")).collect()}
    assert orders == {"iso": "", "eu": "dmy", "us": "mdy", "mixed": "mixed", "open": "unsettled", "text": ""}
    one = spark.createDataFrame([("31/02/2024", "03/04/24 12:00", "20240506", "5.6.2024")], "a string, b string, c string, d string")
    row = one.select(resolve_date(F.col("a"), F.lit("dmy")), resolve_date(F.col("b"), F.lit("mdy")), any_date(F.col("c")), any_date(F.col("d"))).first()
    assert list(row) == [None, datetime.date(2024, 3, 4), datetime.date(2024, 5, 6), datetime.date(2024, 6, 5)]


def test_names(spark):
    rows = [("SQ *BLUE BOTTLE 0042 SAN", "Blue Bottle Coffee"), ("POS PURCHASE CARD 4471", "Cafe"), ("sunset bar", "sunrise cafe"), ("Netflx", "netflix")]
    df = spark.createDataFrame(rows, "a string, b string").select(normalise_merchant(F.col("a")).alias("a"), normalise_merchant(F.col("b")).alias("b"))
    got = {r["a"]: r["s"] for r in with_similarity(df, "a", "b", "s").collect()}
    assert abs(got["blue bottle san"] - 2 / 3) < 1e-9 and got[""] == 0 and got["sunset bar"] == 0
    assert abs(got["netflx"] - ratio("netflx", "netflix")) < 1e-12 and got["netflx"] > 0.9
    one = spark.createDataFrame([("spotify p3a 99x", "7eleven 22", "a b", "b c d")], "a string, b string, c string, d string")
    assert list(one.select(stable_name(F.col("a")), stable_name(F.col("b")), containment(F.col("c"), F.col("d"))).first()) == ["spotify", "7eleven", 0.5]


def test_currencies(spark):
    df = spark.createDataFrame([("€", "paid 12.00 gbp"), ("xy9", "no mark")], "m string, t string")
    assert [tuple(r) for r in df.select(normalise_currency(F.col("m")), first_currency(F.col("t"))).collect()] == [("EUR", "GBP"), (None, None)]
