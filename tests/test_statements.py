import pytest

from ledgerloom.operators import integrity, selfaudit
from ledgerloom.plans.pipeline import audit_statements, review_texts
from ledgerloom.sources.statements import Statements, column_roles, find_header, parse

YEAR = """My account,12345
Date,Description,Amount,Balance
01/01/2024,STREAMFLIX.COM 1234,-8.99,991.01
15/01/2024,BEAN HOUSE 11,-4.20,986.81
15/01/2024,BEAN HOUSE 12,-4.20,982.61
16/01/2024,HARDWARE HUT,-84.20,898.41
17/01/2024,HARDWARE HUT,-84.20,814.21
20/01/2024,HARDWARE HUT,84.20,898.41
01/02/2024,STREAMFLIX.COM 9912,-8.99,889.42
02/03/2024,STREAMFLIX.COM 7712,-11.99,877.43
01/04/2024,STREAMFLIX.COM 5555,-11.99,865.44
05/04/2024,Gym Club,-30.00,835.44
"""
OFX = "<OFX><CURDEF>USD<BANKTRANLIST><STMTTRN><TRNTYPE>DEBIT<DTPOSTED>20240105120000<TRNAMT>-12.50<NAME>Corner Grocer</STMTTRN><STMTTRN><DTPOSTED>20240106<TRNAMT>-3.00<MEMO>Bus</STMTTRN></BANKTRANLIST><LEDGERBAL><BALAMT>100.00</LEDGERBAL></OFX>"
FILES = [
    ("year", YEAR),
    ("german", "Datum;Beschreibung;Betrag\n2024-01-01;A B;-1.234,50\n2024-01-03;A B;-17,31\n"),
    ("split", "Date,Payee,Debit,Credit\n2024-01-01,x,1.00,0.00\n2024-01-02,y,0.00,2.50\n"),
    ("no money", "Date,Desc\n1,2\n"),
    ("both", "Date,Payee,Debit,Credit\n2024-01-01,x,1.00,2.00\n"),
    ("empty", ""),
    ("open dates", "Date,Amount\n03/04/2024,1.00\n"),
    ("bad cell", "Date,Amount\n2024-01-01,1.00\n2024-01-02,n/a\n"),
    ("broken", YEAR.replace("898.41\n17", "898.40\n17")),
    ("ofx", OFX),
]


@pytest.fixture(scope="module")
def parsed(spark):
    made = parse(spark.createDataFrame(FILES, "statement_id string, text string"))
    return Statements(*(x.persist() for x in made))


def test_parse(parsed):
    amounts = {}
    for r in parsed.lines.collect():
        amounts.setdefault(r["statement_id"], {})[r["row"]] = r["amount_cents"]
    assert len(amounts["year"]) == 10 and amounts["year"][6] == 8420
    assert amounts["german"] == {1: -123450, 2: -1731}
    assert amounts["split"] == {1: -100, 2: 250}  # zero on the unused side is no amount
    assert amounts["ofx"] == {1: -1250, 2: -300}
    refused = {r["statement_id"]: (r["code"], r["row"]) for r in parsed.refusals.collect()}
    assert refused == {"no money": ("no_money_column", 0), "both": ("both_sides", 1), "empty": ("no_rows", 0), "open dates": ("dates_unsettled", 0), "bad cell": ("unreadable_amount", 2)}
    facts = {r["statement_id"]: (r["decimal_separator"], r["currency"]) for r in parsed.statements.collect()}
    assert facts["german"] == (",", None) and facts["ofx"] == (".", "USD") and set(facts) == set(amounts)


def test_headers():
    assert find_header("a,b\n\nPosting Date,Narrative,Value\n")[1:] == (2, {"date": 0, "description": 1, "amount": 2})
    assert column_roles(["Date", "Payee", "Amount (EUR)", "Other"]) == {"date": 0, "description": 1, "amount": 2}
    assert find_header("Date;Desc\n1;2") is None


def test_audit(parsed):
    result = audit_statements(parsed)
    states = {r["statement_id"]: (r["state"], r["break_row"]) for r in result.states.collect()}
    assert states["year"] == ("whole", None) and states["broken"] == ("incomplete", 4) and states["ofx"] == ("unverifiable", None)
    found, rows = {}, {}
    for r in selfaudit.finding_rows(result.findings, parsed.lines).collect():
        rows.setdefault((r["statement_id"], r["rank"]), []).append(r["row"])
    for r in result.findings.collect():
        found.setdefault(r["statement_id"], []).append((r["rank"], r["kind"], r["at_risk"], tuple(sorted(rows[r["statement_id"], r["rank"]]))))
    assert sorted(found["year"]) == [(1, "price_rose", 3600, (1, 7, 8, 9)), (2, "paid_twice", 420, (2, 3)), (3, "paid_twice", 0, (4, 5))]
    assert "broken" not in found  # a broken statement has no findings
    assert [(r["charges"], r["latest_cents"], r["a_year_cents"]) for r in result.recurring.filter("statement_id = 'year'").collect()] == [(4, 1199, 14388)]


def test_order_of_rows_is_no_input(spark, parsed):
    lines = parsed.lines.filter("statement_id = 'year'")
    want = sorted(map(tuple, selfaudit.suspects(lines).select("first_row", "second_row", "days_apart", "refund_row").collect()), key=repr)
    dealt = spark.createDataFrame(lines.toPandas().sample(frac=1, random_state=1).drop(columns="raw").assign(date=lambda d: d["date"]), lines.drop("raw").schema).repartition(3)
    assert sorted(map(tuple, selfaudit.suspects(dealt).select("first_row", "second_row", "days_apart", "refund_row").collect()), key=repr) == want
    assert want == [(2, 3, 0, None), (4, 5, 1, 6)]


def test_disorder_is_unrun(spark):
    rows = [("s", 1, "2024-01-02", 100, 100), ("s", 2, "2024-01-01", 50, 999), ("u", 1, None, 100, 100), ("u", 2, "2024-01-01", 50, 150)]
    lines = spark.createDataFrame(rows, "statement_id string, row int, date string, amount_cents bigint, balance_cents bigint").withColumn("date", __import__("pyspark.sql.functions", fromlist=["to_date"]).to_date("date"))
    assert {r["statement_id"]: r["walk_ok"] for r in integrity.balance_walk(lines).collect()} == {"s": None, "u": True}


def test_first_fit():
    names = ["alpha beta", "alpha beta gamma", "delta", "alpha gamma", "deltb"]
    assert selfaudit.first_fit(names, 0.8) == [0, 0, 2, 3, 2]


def test_review(spark, parsed):
    texts = [
        ("r1", "Corner Grocer\nMilk 10.00\nSub total 10.00\nTax 25% 2.50\nTOTAL 12.50\nCash 20.00\nChange 7.50", False),
        ("r2", "Hardware Hut\nHammer 84.20\nTotal 84.20", False),
        ("r3", "???", True),
    ]
    queue = review_texts(parsed, spark.createDataFrame(texts, "receipt_id string, text string, degraded boolean"))
    got = {(r["statement_id"], r["row"]): r for r in queue.collect()}
    paid = got["ofx", 1]
    assert (paid["outcome"], paid["receipt_id"], paid["verdict"], paid["state"]) == ("matched", "r1", "reconciled", "filed")
    assert got["year", 5]["state"] == "possible duplicate" and got["year", 5]["seen"]["duplicate_of"] == 4
    assert got["ofx", 2]["state"] == "unverified" and len(got) == 16
    holders = [r["row"] for r in got.values() if r["receipt_id"] == "r2"]
    assert holders == [4]  # one receipt, one charge
