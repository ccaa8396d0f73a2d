"""Clusters, refunds and runs against brute force, and that nothing grows with one popular key."""

import datetime
import random

from pyspark.sql import functions as F

from ledgerloom.functions.names import ratio, ratio_bound, ratio_limit, with_similarity
from ledgerloom.operators import selfaudit

WORDS = ("harbour", "harbor", "freight", "frieght", "alpine", "dairy", "daily", "netflix", "netfilx", "cafe", "cafes", "telecom")


def naive_alike(name, leader, floor):
    a, b = set(name.split()), set(leader.split())
    shared = len(a & b)
    return bool(shared and shared / min(len(a), len(b)) >= floor) or ratio(name, leader) >= max(floor, 0.8)


def naive_first_fit(names, floor):
    leaders, out = [], []
    for name in names:
        hit = next((x for x in leaders if naive_alike(name, x, floor)), None)
        if hit is None:
            leaders.append(name)
        out.append(hit or name)
    return out


def random_names(rng, n):
    return list(dict.fromkeys(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n)))


def test_first_fit_is_that_of_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        names, floor = random_names(rng, rng.randint(1, 25)), rng.choice([0.72, 0.8])
        assert [names[j] for j in selfaudit.first_fit(names, floor)] == naive_first_fit(names, floor)


def test_leaders_of_groups_of_every_size(spark):
    rng = random.Random(2)
    groups = {g: random_names(rng, rng.choice([1, 2, 2, 3, 20])) for g in range(150)}
    rows = [(g, name, i) for g, names in groups.items() for i, name in enumerate(names)]
    rows += [(g, name, i + 50) for g, name, i in rows[::3]]
    rng.shuffle(rows)
    found = selfaudit.leaders(spark.createDataFrame(rows, "g int, name string, row int"), ["g"], 0.8)
    got = {(r["g"], r["name"]): r["leader"] for r in found.collect()}
    assert got == {(g, n): x for g, names in groups.items() for n, x in zip(names, naive_first_fit(names, 0.8))}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "FlatMapGroups" not in plan and plan.count("ArrowEvalPython") == 1  # no call for each group


def test_bounds_hold_and_few_pairs_reach_python(spark):
    rng = random.Random(3)
    pairs = [(a, b) for a, b in zip(random_names(rng, 400), random_names(rng, 400))]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("limit", ratio_limit(F.col("a"), F.col("b")))
    for r in df.collect():
        exact = ratio(r["a"], r["b"])
        assert exact <= ratio_bound(r["a"], r["b"]) + 1e-12
        assert exact <= r["limit"] + 1e-12 or r["limit"] < 0.8 and exact < 0.8
    assert df.filter("limit >= 0.8").count() < 0.1 * len(pairs)
    got = {(r["a"], r["b"]): r["s"] for r in with_similarity(df, "a", "b", "s").collect()}
    for (a, b), s in got.items():
        shared = len(set(a.split()) & set(b.split())) / min(len(set(a.split())), len(set(b.split())))
        assert abs(s - max(shared, ratio(a, b) if ratio(a, b) >= 0.8 else 0)) < 1e-12


def lines(spark, rows):
    return spark.createDataFrame(rows, "statement_id string, row int, date string, description string, amount_cents bigint").withColumn("date", F.to_date("date"))


def test_refunds_of_one_popular_amount(spark):
    rng = random.Random(4)
    day = lambda: (datetime.date(2024, 1, 1) + datetime.timedelta(rng.randint(0, 60))).isoformat()
    charges = [("s", i, day(), "Harbour Freight", -500) for i in range(150)]
    refunds = [("s", 1000 + i, None if i % 9 == 0 and i else day(), "Harbour Freight", 500) for i in range(60)]
    refunds += [("s", 2000, "2024-05-01", "Alpine Dairy", 500), ("t", 1, "2024-05-01", "Harbour Freight", 500)]
    rng.shuffle(refunds)
    for late in (refunds, [r for r in refunds if r[2]], [r for r in refunds if r[2] and r[2] < "2024-02-01"]):
        df = lines(spark, charges + late)
        found = selfaudit.suspects(df)
        for r in found.filter("days_apart is not null").collect():
            second = charges[r["second_row"]][2]
            fit = [n for s, n, d, name, _ in late if s == "s" and name == "Harbour Freight" and (d is None or d >= second)]
            assert r["refund_row"] == (min(fit) if fit else None)
    pairs = spark.createDataFrame([("s", "harbour freight", 500, 1, 2, "2024-01-02")], "statement_id string, leader string, cents bigint, first_row int, second_row int, second_date string").withColumn("second_date", F.to_date("second_date"))
    plan = selfaudit._first_refund(pairs, df, ["statement_id", "cents", "leader"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # pairs and refunds pass one window: their sum, not their product


def test_runs_hold_no_lists(spark):
    rng = random.Random(5)
    rows, runs = [], {}
    for run in range(40):
        at = datetime.date(2023, 1, 1)
        for _ in range(rng.randint(1, 12)):
            at += datetime.timedelta(rng.choice([0, 5, 28, 30, 31, 33]))
            rows.append(("s", len(rows), at.isoformat(), f"run{run}x", -rng.choice([900, 940, 960, 1200])))
            runs.setdefault(f"run{run}x", []).append((at, len(rows) - 1, -rows[-1][4]))
    of_runs = lines(spark, rows).select("statement_id", F.col("description").alias("leader"), "description", "date", "row", (-F.col("amount_cents")).alias("cents"))
    facts = selfaudit.run_facts(of_runs)
    assert not any(f.dataType.typeName() == "array" for f in facts.schema)
    assert "collect_" not in facts._jdf.queryExecution().executedPlan().toString()
    for r in facts.collect():
        run = sorted(runs[r["leader"]])
        gaps = sorted((b[0] - a[0]).days for a, b in zip(run, run[1:]))
        dear = [d for d, _, c in run if c > run[0][2] + 50]
        want = (len(run), gaps[len(gaps) // 2] if gaps else None, run[0][0], run[-1][0], run[0][2], run[-1][2], min(dear, default=None), min(n for _, n, _ in run), max(n for _, n, _ in run))
        assert tuple(r[c] for c in ("charges", "median_gap", "first_seen", "last_seen", "first_cents", "last_cents", "rose_on", "first_row", "last_row")) == want
