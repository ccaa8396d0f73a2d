"""What reading a receipt costs: a text is searched for its currency once, a line for its phrases by patterns."""

import itertools
import random

from pyspark.sql import functions as F

from ledgerloom.functions.money import first_currency
from ledgerloom.operators import extract

KNOWN = list(dict.fromkeys([*itertools.chain(*extract.LABELS.values()), *extract.TENDER, *extract.CHANGE]))


def test_a_text_is_searched_for_its_currency_once(spark):
    texts = spark.createDataFrame([("Total 1.00 usd",), ("€ 3",), ("nothing",), (None,)], "text string")
    made = texts.select(first_currency(F.col("text")).alias("c"))
    assert [r["c"] for r in made.collect()] == ["USD", "EUR", None, None]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1


def test_phrases_against_runs_of_words(spark):
    """Every run of one to three words parted by one space, with overlaps, copies and words that only begin or end like one."""
    rng = random.Random(4)
    words = [*dict.fromkeys(w for k in KNOWN for w in k.split(" ")), "", "", "totals", "subtota", "xtax", "part"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 7))) for _ in range(400)] + KNOWN + [f"a {k} {k}" for k in KNOWN]

    def runs(line):
        parts = line.split(" ")
        every = [" ".join(parts[i : i + n]) for n in (1, 2, 3) for i in range(len(parts) - n + 1)]
        return [w for w in dict.fromkeys(every) if w in KNOWN]

    made = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", extract.phrases(F.col("line")).alias("p")).collect()
    assert [r["p"] for r in sorted(made, key=lambda r: r["i"])] == [runs(line) for line in lines]
