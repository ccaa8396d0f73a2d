"""Sums of more amounts than the fold in the JVM takes: all of them count."""

import random

from ledgerloom.operators import extract

DIGITS = (("4", "8"), ("8", "4"), ("1", "7"), ("7", "1"), ("3", "8"), ("8", "3"), ("5", "6"), ("6", "5"), ("0", "8"), ("8", "0"), ("9", "4"), ("6", "8"))


def shown(amounts):
    return "\n".join(f"{x // 100}.{x % 100:02d}" for x in amounts)


def verdicts(spark, sets):
    texts = [(i, shown(s)) for i, s in enumerate(sets)]
    made = extract.arithmetic(spark.createDataFrame(texts, "receipt_id int, text string")).collect()
    return [(r["gap"], r["verdict"]) for r in sorted(made, key=lambda r: r["receipt_id"])]


def brute(amounts):
    target, *parts = sorted(amounts, reverse=True)

    def sums(of):
        out = {0}
        for x in of:
            out |= {s + x for s in out if s + x <= 2 * target}
        return out

    gap = min(abs(s - target) for s in sums(parts))
    if gap == 0:
        return 0, "exact"
    swaps = lambda d: {int(d.replace(a, b, 1)) for a, b in DIGITS if a in d}
    closes = any(target - p in sums(parts[:i] + parts[i + 1 :]) for i, x in enumerate(parts) for p in swaps(str(x)))
    return gap, "near" if gap <= 10 or closes else "far"


def test_every_amount_counts_towards_a_sum(spark):
    """Twenty-four lines and their total, whole, seven cents over it, and far over it."""
    lines = [100 * q + n % 7 + 1 for n, q in enumerate(range(3, 51, 2))]
    got = verdicts(spark, [[*lines, sum(lines) + over] for over in (0, 7, 100_000)])
    assert got == [(0, "exact"), (7, "near"), (100_000, "far")]


def test_many_amounts_against_brute_force(spark):
    rng = random.Random(8)
    sets = []
    for _ in range(60):
        parts = [rng.randrange(100, rng.choice([400, 3000])) * rng.choice([1, 10]) for _ in range(rng.randint(9, 26))]
        misread = [int(str(parts[0]).replace("8", "4", 1)), *parts[1:]]
        sets.append([*rng.choice([parts, misread]), sum(parts) + rng.choice([0, 0, 7, 400, 800, 30_000])])
    got = verdicts(spark, sets)
    assert got == [brute(s) for s in sets] and {v for _, v in got} == {"exact", "near", "far"}
