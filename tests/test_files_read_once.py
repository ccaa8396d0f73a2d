"""What statements of files cost: every question is told from one reading of the files."""

from ledgerloom.plans import queries


def test_statement_files_are_read_once(spark):
    made = queries.QUERIES["statement_files"](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan
    assert made.count() > 0
