import hashlib
import json
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import decisions, extract, pairing, verdict
from ledgerloom.sources import decision_writer, documents, sinks
from ledgerloom.streaming.intake import watch


def fields(spark, text, degraded=False):
    read = extract.readings(spark.createDataFrame([("r", text, degraded)], "receipt_id string, text string, degraded boolean"))
    return {r["field"]: (r["value_cents"], r["confidence"]) for r in extract.fields(read).collect()}, read.first()


def test_receipt_rules(spark):
    got, read = fields(spark, "Shop Name\nTea 2.00\nBread 3.00\nSUB-TOTAL 5.00\nTAX 8.25% 0.41\nTotal 5.41\nTOTAL DUE 5.41\nChange 1.00")
    assert got == {"subtotal": (500, 1.0), "tax": (41, 1.0), "total": (541, 1.0)} and read["merchant"] == "Shop Name"
    assert [(i["description"], i["amount_cents"]) for i in read["items"]] == [("Tea", 200), ("Bread", 300)]
    got, _ = fields(spark, "TOTAL INCLUDES VAT OF 1.77\nTotal (incl. VAT) 19.50")
    assert got == {"tax": (177, 1.0), "total": (1950, 1.0)}
    assert fields(spark, "Amount paid 20.00")[0] == {"total": (2000, 0.55)}
    assert fields(spark, "Amount paid 20.00\nChange 1.00")[0]["total"][1] == 0.55
    assert fields(spark, "x\ny")[0] == {"total": (None, 0.0)}
    assert fields(spark, "Totaal 2,10\nTotaal 3,10", True)[0] == {"total": (310, 0.2)}
    assert fields(spark, "A 1.00\nB 2.00\nC 3.00\nTotal 6,00\nTotal 6.00")[0]["total"] == (600, 1.0)


CHECKED = "subtotal_cents bigint, tax_cents bigint, tip_cents bigint, fees_cents bigint, discount_cents bigint, total_cents bigint, items array<struct<amount_cents:bigint>>, currency string, generated boolean, amount_cents bigint, charge_currency string, tax_present boolean"


@pytest.mark.parametrize(
    ("row", "want", "oks"),
    [
        ((1000, 80, None, None, None, 1080, [(500,), (501,)], "$", False, -1080, "USD", True), "reconciled", [True, True, True, True]),
        ((1000, None, None, None, None, 1080, [], None, False, -1080, None, True), "reconciled", [None, None, None, True]),
        ((None, None, None, None, None, None, [], None, None, -5, None, None), "unchecked", [None, None, None, None]),
        ((1000, 80, None, None, None, 1080, [], "$", True, -1080, "EUR", True), "unchecked", [None, True, True, None]),
        ((None, 900, None, None, None, 380, [], None, False, -380, None, True), "does_not_reconcile", [None, None, False, True]),
        ((1000, 80, 0, 0, 100, 980, [(1000,), (None,)], None, False, -981, None, True), "does_not_reconcile", [None, True, True, False]),
    ],
)
def test_verdicts(spark, row, want, oks):
    got = verdict.reconcile(spark.createDataFrame([row], CHECKED)).first()
    assert got["verdict"] == want and [c["ok"] for c in got["checks"]] == oks


def test_one_receipt_one_charge(spark):
    charges = spark.createDataFrame([("s", i, f"2024-01-{i:02d}", "Cafe Uno", -500) for i in range(1, 13)], "statement_id string, row int, date string, description string, amount_cents bigint").withColumn("date", F.to_date("date"))
    receipts = spark.createDataFrame([("a", "cafe uno", "2024-01-05", 500), ("b", "cafe duo", "2024-01-05", 500), ("c", "harbour hotel", "2024-01-09", 500)], "receipt_id string, merchant string, date string, total_cents bigint").withColumn("date", F.to_date("date"))
    found = pairing.candidates(charges, receipts)
    got = pairing.assign(charges, found).collect()
    held = [r["receipt_id"] for r in got if r["receipt_id"]]
    assert len(got) == 12 and len(held) == len(set(held))
    winner = next(r["row"] for r in got if r["receipt_id"] == "a")
    assert winner == 5 and all(r["receipt_id"] != "c" for r in got)


def test_decision_chain(spark, tmp_path):
    path = str(tmp_path / "log.jsonl")
    seen = {"statement_id": "s", "row": 1, "charge_cents": -500, "receipt_cents": None, "verdict": "unchecked", "duplicate_of": None}
    decision_writer.record(path, seen, "accept_as_printed", actor="human", note="ok")
    decision_writer.record(path, seen | {"row": 2}, "ignore", actor="human")
    decision_writer.record(path, seen | {"row": 3}, "correct", actor="human", correction="5.00")
    with pytest.raises(decision_writer.NotAHumanDecision):
        decision_writer.record(path, seen, "ignore", actor="model")
    with pytest.raises(ValueError):
        decision_writer.record(path, seen, "correct", actor="human")
    lines = open(path).read().splitlines()
    tampered = {
        "intact": lines,
        "edited": [lines[0].replace("ok", "no"), *lines[1:]],
        "deleted": [lines[0], lines[2]],
        "reordered": [lines[1], lines[0], lines[2]],
        "cut from top": lines[1:],
        "forged": [*lines, json.dumps({"prev": hashlib.sha256(b"x").hexdigest()})],
        "malformed": [lines[0], "not json", lines[2]],
    }
    log = spark.createDataFrame([(k, i + 1, x) for k, v in tampered.items() for i, x in enumerate(v)], "log_id string, line_no int, line string")
    got = {r["log_id"]: r["broken_at"] for r in decisions.verify_chain(log).collect()}
    assert got == {"intact": None, "edited": 2, "deleted": 2, "reordered": 1, "cut from top": 1, "forged": 4, "malformed": 2}
    decided = decisions.decisions(decisions.read_log(spark, path))
    schema = "seen struct<statement_id:string,row:int,charge_cents:bigint,receipt_cents:bigint,verdict:string,duplicate_of:int>, statement_id string, row int, amount_cents bigint"
    items = [((("s", r, c, None, "unchecked", None)), "s", r, c) for r, c in ((1, -500), (2, -501), (4, -500))]
    left = decisions.outstanding(spark.createDataFrame(items, schema), decided)
    assert sorted(r["row"] for r in left.collect()) == [2, 4]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame(
        [("s", 1, "2024-01-02", "=cmd\n\"x\"", "-5.00", "reconciled", "fine", "r1", "a=ok", "EUR"), ("s", 2, "", "plain", "1.00", "unchecked", "", "", "", None)],
        "statement_id string, row int, date string, description string, amount string, verdict string, why string, receipt string, checks string, currency string",
    )
    first = sinks.generic(rows).orderBy("amount").first()
    assert first["amount"] == "-5.00" and first["description"] == "'=cmd \"x\""  # figures are never quoted
    block = sinks.beancount(rows).collect()
    assert len(block) == 1 and block[0]["value"].split("\n")[0] == "2024-01-02 * \"'=cmd 'x'\"" and "  Assets:Bank:Checking  -5.00 EUR" in block[0]["value"]
    assert json.loads(sinks.firefly_config("12"))["default_account"] == 12 and json.loads(sinks.firefly_config())["default_account"] == 0
    sinks.write(rows, "actual", str(tmp_path / "a"), single_file=True)
    text = next((tmp_path / "a").glob("part-*")).read_text()
    assert text.startswith("Date,Payee,Notes,Amount\n") and "#ledgerloom-reconciled fine" in text
    assert {r["verdict"]: r["n"] for r in sinks.verdict_counts(rows).collect()} == {"reconciled": 1, "unchecked": 1}


def test_pdf():
    drawn = b"BT (Total) Tj [(12) -20 (.50)] TJ (a\\)b\\101) Tj ET"
    packed = b"%PDF-1.4\n1 0 obj << /Filter /FlateDecode >> stream\n" + zlib.compress(drawn) + b"\nendstream"
    assert documents.pdf_kind(packed) == "text" and documents.pdf_text(packed) == "Total\n12.50\na)bA"
    assert documents.pdf_kind(packed + b"/Subtype /Image") == "scan"
    assert documents.pdf_kind(b"%PDF-1.4 stream\n\nendstream") == "empty"


def test_inbox_words_and_replies(spark):
    files = [("in/a.csv", b"Date,Amount\n2024-01-01,1.00\n"), ("in/b.txt", b"Shop\nTotal 1.00"), ("in/.hidden", b""), ("in/c.xyz", b""), ("in/d.pdf", b"%PDF")]
    kinds = documents.classify_inbox(spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary"))
    got = {r["path"]: r["kind"] for r in kinds.collect()}
    assert got == {"in/a.csv": "statement", "in/b.txt": "receipt", "in/.hidden": "ignored", "in/c.xyz": "ignored", "in/d.pdf": "receipt"}
    assert documents.inbox_problems(kinds).first()["problem"] is None
    words = [("d", w, 90.0, 10 * i, 0, 9, 9, 1) for i, w in enumerate("this is a line of some eight words".split())] + [("d", "low", 10.0, 0, 20, 5, 5, 2)]
    made = documents.assemble_words(spark.createDataFrame(words, "doc_id string, text string, confidence double, left int, top int, width int, height int, line int")).first()
    assert made["text"] == "this is a line of some eight words\nlow" and not made["degraded"] and made["confidence"] == 88.9
    replies = spark.createDataFrame([("p", 'sure: {"total": "12.50", "tax": "lots", "merchant": "M"} done'), ("q", "no")], "path string, raw string")
    row = documents.read_replies(replies).collect()
    assert [(r["receipt_id"], r["total_cents"], r["tax_cents"], r["generated"]) for r in row][0] == ("p", 1250, None, True)


def test_stream(spark, tmp_path):
    inbox, store, mark = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "mark")
    inbox.mkdir()
    rows = "Date,Description,Amount\n2024-01-01,Tool Barn,-9.00\n2024-01-02,Tool Barn,-9.00\n"
    (inbox / "a.csv").write_text(rows)
    watch(spark, str(inbox), store, mark).awaitTermination()
    (inbox / "b.csv").write_text(rows.replace("9.00", "7.00"))
    watch(spark, str(inbox), store, mark).awaitTermination()
    # Renamed copies: of an earlier batch's file, and of another in the same batch.
    (inbox / "c.csv").write_text(rows)
    (inbox / "d.csv").write_text(rows.replace("9.00", "5.00"))
    (inbox / "e.csv").write_text(rows.replace("9.00", "5.00"))
    watch(spark, str(inbox), store, mark).awaitTermination()
    found = spark.read.parquet(f"{store}/findings")
    assert sorted(r["at_risk"] for r in found.collect()) == [500, 700, 900]
    assert sorted(r["batch"] for r in found.collect()) == [0, 1, 2]
    name = lambda x: x.rsplit("/", 1)[1]
    assert sorted((name(r["statement_id"]), name(r["same_as"])) for r in spark.read.parquet(f"{store}/rejected").collect()) == [("c.csv", "a.csv"), ("e.csv", "d.csv")]


def test_files_are_opened_once(spark, tmp_path):
    files = {"a.csv": b"Date,Amount\n2024-01-01,1.00\n", "b.csv": b"just,a,table\n", "c.txt": b"Shop\nTotal 1.00", "d.png": b"x", "e.pdf": b"%PDF-1.4 stream\nBT (Total 2.00) Tj\nendstream", "f.pdf": b"no", "g.xyz": b"", ".h": b"", "i.txt": b"Shop\nTotal 1.00"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    source = spark.read.format("binaryFile").load(str(tmp_path))
    opened = documents.read_inbox(source)
    plan = opened._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["text"], r["degraded"]) for r in opened.collect()}
    assert got["a.csv"] == ("statement", None, None) and got["b.csv"] == ("receipt", "just,a,table\n", True) and got["c.txt"][2] is False
    assert got["e.pdf"] == ("receipt", "Total 2.00", False) and got["f.pdf"] == ("receipt", "", True) and got["d.png"] == ("receipt", None, None)
    texts, unreadable = documents.read_receipts(spark, str(tmp_path))
    assert sorted(r["receipt_id"].rsplit("/", 1)[1] for r in texts.collect()) == ["b.csv", "c.txt", "e.pdf", "i.txt"]
    assert sorted(r["receipt_id"].rsplit("/", 1)[1] for r in unreadable.collect()) == ["d.png", "f.pdf"]
    assert [(r["path"].rsplit("/", 1)[1], r["same_as"].rsplit("/", 1)[1]) for r in documents.copies(opened).collect() if "txt" in r["path"]] == [("i.txt", "c.txt")]
