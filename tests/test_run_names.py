"""What clustering charges costs: a text is normalised once for each group, and not for each charge that bears it."""

from ledgerloom.operators import selfaudit

SCHEMA = "statement_id int, row int, date string, description string, amount_cents long"


def charges(spark):
    names = ("SQ *Corner Cafe 0042", "Corner Cafe Lisbon", "1234567", None, "Alpine Dairy 77")
    rows = [(s, 10 * i + s, f"2024-0{i % 9 + 1}-05", names[i % 5], -500 - 100 * (i % 2)) for s in (1, 2) for i in range(20)]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("statement_id", "row", "to_date(date) AS date", "description", "amount_cents")


def test_texts_are_normalised_after_they_are_grouped(spark):
    for made in (selfaudit.runs(charges(spark)), selfaudit.clusters(charges(spark))):
        plan = made._jdf.queryExecution().optimizedPlan().toString().split("\n")
        normalising = [line for line in plan if "[^a-z0-9 ]" in line]
        assert normalising and all("Generate explode" in line for line in normalising)


def test_charges_meet_their_leaders_by_text(spark):
    """Charges without a name are left out, and every other charge has its text's leader."""
    made = selfaudit.runs(charges(spark)).collect()
    assert len(made) == 24
    leads = {(r["description"], r["leader"]) for r in made}
    assert leads == {("SQ *Corner Cafe 0042", "corner cafe"), ("Corner Cafe Lisbon", "corner cafe"), ("Alpine Dairy 77", "alpine dairy")}
