"""Reports, the command line, subset sums, and pairing until nothing is awarded."""

import itertools
import random

import numpy as np

from pyspark.sql import functions as F

from ledgerloom.cli import main
from ledgerloom.operators import decisions, extract, pairing
from ledgerloom.sources import decision_writer


def brute_gap(parts, target):
    kept = sorted(parts, reverse=True)[:18]
    return min((abs(sum(c) - target) for n in range(1, len(kept) + 1) for c in itertools.combinations(kept, n)), default=target)


def brute_verdict(amounts):
    if len(amounts) < 3:
        return None, "too few amounts"
    parts = sorted(amounts, reverse=True)
    target = parts.pop(0)
    gap = brute_gap(parts, target)
    swapped = ([*parts[:i], int(str(p).replace(a, b, 1)), *parts[i + 1 :]] for i, p in enumerate(parts) for a, b in extract.CONFUSIONS if a in str(p))
    near = gap <= 10 or any(brute_gap(x, target) == 0 for x in swapped)
    return gap, "exact" if gap == 0 else "near" if near else "far"


def test_subset_sums(spark):
    rng = random.Random(2)
    sets = [[rng.randrange(0, rng.choice([5, 300, 9999])) for _ in range(rng.randint(0, 7))] for _ in range(200)]
    for parts in sets[:120]:
        if parts:
            parts.append(sum(parts[: rng.randint(1, 7)]) + rng.choice([0, 0, 7, -7, 400, 4000, 60]))
    sets = [[abs(x) for x in s] for s in sets]
    # Nineteen parts and more: only the largest eighteen are looked at, and a changed one can fall behind.
    sets += [[100] * 30, [*range(1000, 1019), 1000], [800, *[400] * 17, 999999]]
    texts = [(str(i), "\n".join(f"{x // 100}.{x % 100:02d}" for x in s)) for i, s in enumerate(sets)]
    got = {r["receipt_id"]: (r["gap"], r["verdict"]) for r in extract.arithmetic(spark.createDataFrame(texts, "receipt_id string, text string")).collect()}
    few = {str(i): brute_verdict(s) for i, s in enumerate(sets[:200])}
    assert {k: got[k] for k in few} == few and {v for _, v in few.values()} == {"exact", "near", "far", "too few amounts"}
    assert [got[str(k)] for k in (200, 201, 202)] == [(0, "exact"), (1, "near"), (992399, "far")]
    texts = {"a": "1.00\n2.00\n3.00", "b": "1.00 2.00 3.07", "c": "4.00\n1.50\n9.50", "d": "1.00\n2.00\n77.00", "e": "1.00 2.00", "f": None}
    got = {r["receipt_id"]: (r["n_amounts"], r["gap"], r["verdict"]) for r in extract.arithmetic(spark.createDataFrame(list(texts.items()), "receipt_id string, text string")).collect()}
    assert got == {"a": (3, 0, "exact"), "b": (3, 7, "near"), "c": (3, 400, "near"), "d": (3, 7400, "far"), "e": (2, None, "too few amounts"), "f": (0, None, "too few amounts")}


def test_pairing_goes_on_until_nothing_is_awarded(spark):
    """All want the same receipt most, then the same next one: five rounds award one each."""
    charges = spark.createDataFrame([("s", i) for i in range(7)], "statement_id string, row int")
    rows = [("s", i, f"r{j}", 1.0, True, 1, 0.9 - 0.1 * j - 0.001 * i) for i in range(6) for j in range(5)]
    found = spark.createDataFrame(rows, "statement_id string, row int, receipt_id string, similarity double, comparable boolean, days_apart int, score double")
    got = {r["row"]: r["receipt_id"] for r in pairing.assign(charges, found).collect()}
    assert got == {0: "r0", 1: "r1", 2: "r2", 3: "r3", 4: "r4", 5: None, 6: None}


def test_candidates_by_time_slots(spark):
    rng = random.Random(5)
    day = lambda: None if rng.random() < 0.15 else f"2024-{rng.randint(1, 3):02d}-{rng.randint(1, 28):02d}"
    charges = [("s", i, day(), "Cafe", -100 * rng.randint(1, 3)) for i in range(60)]
    receipts = [(f"r{i}", day(), "Cafe", 100 * rng.randint(1, 3)) for i in range(60)]
    date = F.to_date("date")
    c = spark.createDataFrame(charges, "statement_id string, row int, date string, description string, amount_cents bigint").withColumn("date", date)
    r = spark.createDataFrame(receipts, "receipt_id string, date string, merchant string, total_cents bigint").withColumn("date", date)
    got = sorted((x["row"], x["receipt_id"], x["days_apart"]) for x in pairing.candidates(c, r).collect())
    import datetime

    read = lambda d: d and datetime.date.fromisoformat(d)
    want = []
    for _, row, d, _, a in charges:
        for name, e, _, t in receipts:
            apart = abs((read(d) - read(e)).days) if d and e else None
            if -a == t and (apart is None or apart <= 5):
                want.append((row, name, apart))
    assert got == sorted(want, key=lambda x: (x[0], x[1]))


def test_command_line(spark, tmp_path, capsys):
    bank, papers = tmp_path / "bank", tmp_path / "papers"
    bank.mkdir()
    papers.mkdir()
    (bank / "a.csv").write_text("Date,Description,Amount\n2024-01-01,Tool Barn,-9.00\n2024-01-02,Tool Barn,-9.00\n")
    (bank / "b.csv").write_text("Date,Description,Amount,Balance\n2024-01-01,x,-1.00,9.00\n2024-01-02,y,-1.00,7.00\n")
    (bank / "c.csv").write_text("nothing here")
    assert main(["audit", str(bank)]) == 2
    out = capsys.readouterr().out
    assert "2 rows, unverifiable" in out and "PAID TWICE" in out and "9.00" in out
    assert "incomplete" in out and "breaks at row 2" in out and "Cannot read this statement: no money column" in out
    (papers / "r.txt").write_text("Tool Barn\nHammer 9.00\nSubtotal 9.00\nTotal 9.00\n")
    (papers / "p.png").write_bytes(b"x")
    assert main(["check", str(bank / "a.csv"), str(papers)]) == 1
    out = capsys.readouterr().out
    assert "unreadable" in out and "need you" in out
    log = str(tmp_path / "log.jsonl")
    decision_writer.record(log, {"statement_id": "s", "row": 1}, "ignore", actor="human")
    assert main(["export", str(bank / "a.csv"), str(papers), str(tmp_path / "out"), "--to", "firefly", "--decisions", log, "--single"]) == 0
    assert "2 transactions: " in capsys.readouterr().err
    assert next((tmp_path / "out").glob("part-*")).read_text().startswith("date,description,amount,tags,notes\n")
    open(log, "a").write("{}\n")
    assert main(["export", str(bank / "a.csv"), str(papers), str(tmp_path / "out2"), "--decisions", log]) == 2
    assert not decisions.verify_chain(decisions.read_log(spark, log)).first()["intact"]


def brute_rounds(pairs):
    """Rounds of nominations and awards over (charge, receipt, score, days, alike), one after another."""
    charges, receipts, won = {p[0] for p in pairs}, {p[1] for p in pairs}, set()
    while True:
        bids = {}
        for c in sorted(charges):
            mine = sorted((p for p in pairs if p[0] == c and p[1] in receipts), key=lambda p: (-p[2], p[3], p[1]))
            if mine and mine[0][4] and (len(mine) == 1 or mine[1][2] < mine[0][2] - pairing.TIE):
                bids.setdefault(mine[0][1], []).append((-mine[0][2], c))
        if not bids:
            return won, {p[:2] for p in pairs if p[0] in charges and p[1] in receipts}
        for r, offers in bids.items():
            won.add((min(offers)[1], r))
            charges.discard(min(offers)[1])
            receipts.discard(r)


def random_pairs(rng, n, m):
    score = lambda: round(rng.choice([1.0, 0.9, rng.random()]) - 0.01 * rng.randint(0, 2), 4)
    return [(c, r, score(), rng.randint(0, 5), rng.random() < 0.8) for c in range(n) for r in range(m) if rng.random() < 0.6]


def test_pools_are_settled_as_rounds_would():
    rng = random.Random(1)
    for _ in range(500):
        pairs = random_pairs(rng, rng.randint(1, 9), rng.randint(1, 9))
        rng.shuffle(pairs)
        if pairs:
            won, still = pairing.settle(*(np.array([p[i] for p in pairs]) for i in range(5)))
            assert ({p[:2] for p, w in zip(pairs, won) if w}, {p[:2] for p, w in zip(pairs, still) if w}) == brute_rounds(pairs)


def test_one_pass_and_rounds_agree(spark, monkeypatch):
    """Pools of every size by one task each; then all of them too large for that, by rounds of all tasks."""
    rng = random.Random(3)
    rows, want = [], {}
    for pool in range(30):
        pairs = random_pairs(rng, rng.randint(1, 6), rng.randint(1, 6))
        rows += [("s", pool * 100 + c, f"r{pool * 100 + r:05d}", 1.0 if a else 0.0, True, d, s, pool) for c, r, s, d, a in pairs]
        want |= {pool * 100 + c: f"r{pool * 100 + r:05d}" for c, r in brute_rounds(pairs)[0]}
    found = spark.createDataFrame(rows, "statement_id string, row int, receipt_id string, similarity double, comparable boolean, days_apart int, score double, pool bigint")
    charges = found.select("statement_id", "row").distinct()
    for most in (1 << 20, 12, 0):
        monkeypatch.setattr(pairing, "MOST_PAIRS", most)
        monkeypatch.setattr(pairing, "PAIRS_A_CALL", 50)
        assert {r["row"]: r["receipt_id"] for r in pairing.assign(charges, found).collect() if r["receipt_id"]} == want


def test_jobs_don_t_grow_with_the_group(spark):
    """One order of preference for all: a round of all tasks would award one receipt each."""

    def jobs(n):
        charges = spark.createDataFrame([("s", i) for i in range(n)], "statement_id string, row int")
        rows = [("s", i, f"r{j:03d}", 1.0, True, 1, 0.9 - 0.005 * j - 0.00001 * i, 7) for i in range(n) for j in range(n)]
        found = spark.createDataFrame(rows, "statement_id string, row int, receipt_id string, similarity double, comparable boolean, days_apart int, score double, pool bigint")
        spark.sparkContext.setJobGroup(f"assign-{n}", "")
        got = {r["row"]: r["receipt_id"] for r in pairing.assign(charges, found).collect()}
        assert got == {i: f"r{i:03d}" for i in range(n)}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"assign-{n}"))

    assert jobs(40) == jobs(4)
