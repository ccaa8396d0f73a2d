"""Amounts are read without looking labels up."""

from pyspark.sql import functions as F

from ledgerloom.operators import extract


def test_amounts_without_labels(spark):
    texts = [(1, "Tea 1,50\nTax 0,10 and 5%\n\nTOTAL 1,60 | 2.00"), (2, None), (3, "no amount"), (4, "Sub total 1,234.50\r\n7.50% 3.4.05")]
    receipts = spark.createDataFrame(texts, "receipt_id int, text string").withColumn("degraded", F.lit(False))
    made = extract.amounts_of(receipts)
    want = extract.lines_of(receipts).select(made.columns)
    order = ("receipt_id", "number")
    assert made.orderBy(*order).collect() == want.orderBy(*order).collect() and made.count() == 8
    assert "arrays_overlap" not in made._jdf.queryExecution().optimizedPlan().toString()
