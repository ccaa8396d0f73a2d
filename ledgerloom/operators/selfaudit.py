"""Self-audit of statements: charges paid twice, prices that rose, charges newly recurring, and the recurring inventory.

Every window and group leads with ``statement_id`` and ends its order with ``row``, so results don't depend on how rows
are dealt to partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.names import RATIO_FLOOR, containment, normalise_merchant, ratio, ratio_bound, ratio_limit, stable_name

# Fixed values.
WINDOW_DAYS = 3
MONTH = (26, 35)
SAME_CHARGE, SAME_RUN = 0.80, 0.72
LEAST_CHARGES = 3
NOISE_CENTS = 50
SETTLING_DAYS = 45


def charged(lines: DataFrame) -> DataFrame:
    """Charges, named or not: (statement_id, row, date, description, cents)."""
    return lines.filter(F.col("amount_cents") < 0).select("statement_id", "row", "date", "description", (-F.col("amount_cents")).alias("cents"))


def billed(lines: DataFrame) -> DataFrame:
    """Charges with a nameable merchant: (statement_id, row, date, description, merchant, cents)."""
    named = lines.filter(F.col("amount_cents") < 0).withColumn("merchant", normalise_merchant(F.col("description")))
    return named.filter("merchant != ''").select("statement_id", "row", "date", "description", "merchant", (-F.col("amount_cents")).alias("cents"))


class _Likeness:
    """Whether names are alike enough, each pair of names decided once in a worker."""

    def __init__(self, floor: float):
        self.floor, self.least = floor, max(floor, RATIO_FLOOR)
        self.known: dict[tuple[str, str], bool] = {}

    def __call__(self, name: str, leader: str) -> bool:
        pair = name, leader
        found = self.known.get(pair)
        if found is None:
            if len(self.known) >= 200_000:
                self.known.clear()
            found = self.known[pair] = self._decide(name, leader)
        return found

    def _decide(self, name: str, leader: str) -> bool:
        a, b = set(name.split()), set(leader.split())
        if (shared := len(a & b)) and shared >= self.floor * min(len(a), len(b)):
            return True
        return ratio_bound(name, leader) >= self.least and ratio(name, leader) >= self.least


def first_fit(names: Sequence[str], floor: float, alike: Callable[[str, str], bool] | None = None) -> list[int]:
    """For each name the place of its leader: the first earlier leader that it resembles, else itself.

    Resemblance to the leader only, so it is no transitive closure, and the order of names matters. Leaders are indexed by
    their tokens, which most names find their leader by; only leaders before it that share no token are then compared by
    characters.
    """
    alike = alike or _Likeness(floor)
    leaders: list[int] = []
    by_token: dict[str, list[int]] = {}
    out = []
    for i, name in enumerate(names):
        tokens = set(name.split())
        sharing = sorted({j for t in tokens for j in by_token.get(t, ())})
        hit = next((j for j in sharing if alike(name, names[j])), None)
        for j in leaders:
            if hit is not None and j >= hit:
                break
            if alike(name, names[j]):
                hit = j
                break
        if hit is None:
            leaders.append(i)
            for t in tokens:
                by_token.setdefault(t, []).append(i)
        out.append(i if hit is None else hit)
    return out


def _leaders_of(floor: float):
    """Leaders of groups of names, group by group through Arrow batches that hold many groups."""

    @F.pandas_udf("array<int>")
    def places(groups: Iterator[pd.Series]) -> Iterator[pd.Series]:
        alike = _Likeness(floor)
        for batch in groups:
            yield batch.map(lambda names: None if names is None else first_fit(list(names), floor, alike))

    return places


def leader_names(names: DataFrame, keys: Sequence[str], floor: float) -> DataFrame:
    """(keys, names, leaders): each group's distinct names in order of their first rows, and the leading name of each.

    ``names`` has keys, name and row. One row for each group, so that many groups share a batch and none is a call of its own. Names
    that are alone, and two whose tokens or letters decide, never reach Python.
    """
    keys = list(keys)
    distinct = names.groupBy(*keys, "name").agg(F.min("row").alias("row"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("row", "name"))), lambda x: x["name"])
    groups = distinct.groupBy(*keys).agg(listed.alias("names"))
    first, second = F.element_at("names", 1), F.try_element_at("names", F.lit(2))
    held = containment(second, first) >= floor
    apart = ~held & (ratio_limit(second, first) < max(floor, RATIO_FLOOR))
    few = F.size("names") <= 2
    by_tokens = F.when(F.size("names") == 1, F.col("names")).when(few & held, F.array(first, first)).when(few & apart, F.col("names"))
    groups = groups.withColumn("decided", by_tokens)
    groups = groups.withColumn("places", _leaders_of(floor)(F.when(F.col("decided").isNull(), F.col("names"))))
    found = F.coalesce("decided", F.transform("places", lambda p: F.element_at("names", p + 1)))
    return groups.select(*keys, "names", found.alias("leaders"))


def leaders(names: DataFrame, keys: Sequence[str], floor: float) -> DataFrame:
    """(keys, name, leader) from (keys, name, row): first-fit clusters of each group's distinct names in row order."""
    found = leader_names(names, keys, floor).select(*keys, F.explode(F.arrays_zip("names", "leaders")).alias("x"))
    return found.select(*keys, F.col("x.names").alias("name"), F.col("x.leaders").alias("leader"))


def _with_leader(charges: DataFrame, keys: Sequence[str], floor: float, name: Callable[[Column], Column] = lambda merchant: merchant, least: int = 1) -> DataFrame:
    """``charges`` that name a merchant, with merchant, name and the leading name of each; groups of fewer than ``least`` are left out.

    A text is normalised once for each group that it stands in, however many charges bear it; charges meet it again by group and text.
    """
    keys = list(keys)
    texts = charges.groupBy(*keys, "description").agg(F.min("row").alias("row"), F.count("*").alias("times"))
    # An array's element keeps the merchant from being worked out again by the filter on it.
    texts = texts.withColumn("merchant", F.explode(F.array(normalise_merchant(F.col("description"))))).filter("merchant != ''")
    if least > 1:
        texts = texts.withColumn("times", F.sum("times").over(Window.partitionBy(*keys))).filter(F.col("times") >= least)
    texts = texts.withColumn("name", name(F.col("merchant")))
    found = texts.join(leaders(texts.select(*keys, "name", "row"), keys, floor), [*keys, "name"])
    return charges.join(found.select(*keys, "description", "merchant", "name", "leader"), [*keys, "description"])


def clusters(lines: DataFrame, floor: float = SAME_CHARGE) -> DataFrame:
    """Charges of ``lines`` with a merchant and the leading name of each one's cluster among equal amounts."""
    # Amounts charged once can't be paid twice.
    return _with_leader(charged(lines), ["statement_id", "cents"], floor, least=2)


def _first_refund(pairs: DataFrame, lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``pairs`` with ``refund_row``: the least row of a refund of the same cluster that is undated or no earlier than the second charge.

    Pairs and refunds go through one window from late to early, so a popular amount costs their sum and not their product.
    """
    refunds = lines.filter("amount_cents > 0").select("statement_id", F.col("amount_cents").alias("cents"), normalise_merchant(F.col("description")).alias("leader"), F.col("row").alias("refund"), F.col("date").alias("at")).filter("leader != ''")
    both = pairs.withColumn("at", F.col("second_date")).unionByName(refunds, allowMissingColumns=True)
    key = Window.partitionBy(*keys)
    # On one day refunds come before pairs; those without a date come before all.
    late = key.orderBy(F.col("at").desc_nulls_first(), F.col("refund").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("refund_row", F.min("refund").over(late)).filter(F.col("refund").isNull()).drop("refund", "at")


def suspects(lines: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Pairs of equal charges close together, and undated groups, with the refund that put a pair right.

    (statement_id, merchant, leader, cents, days_apart, first_row, second_row, refund_row): one row for each consecutive
    dated pair at most ``window_days`` apart, and one for a cluster with undated rows (``days_apart`` null). Clusters whose
    every gap is a month are subscriptions and drop out.
    """
    clustered = clusters(lines)
    keys = ["statement_id", "cents", "leader"]
    order = Window.partitionBy(*keys).orderBy(F.col("date").asc_nulls_last(), "row")
    whole = Window.partitionBy(*keys)
    gap = F.when(F.col("date").isNotNull(), F.datediff("date", F.lag("date").over(order)))
    seen = clustered.withColumns({"gap": gap, "before": F.lag("row").over(order), "before_name": F.lag("description").over(order)})
    monthly = F.bool_and(F.col("gap").between(*MONTH)).over(whole)
    seen = seen.withColumns({"monthly": F.coalesce(monthly, F.lit(False)), "n": F.count("*").over(whole)}).filter("n > 1 and not monthly")
    pairs = seen.filter(F.col("gap") <= window_days).select("statement_id", F.col("before_name").alias("merchant"), "leader", "cents", F.col("gap").alias("days_apart"), F.col("before").alias("first_row"), F.col("row").alias("second_row"), F.col("date").alias("second_date"))
    columns = ("statement_id", "merchant", "leader", "cents", "days_apart", "first_row", "second_row", "refund_row")
    undated = seen.groupBy(*keys).agg(F.count_if(F.col("date").isNull()).alias("undated"), F.min("row").alias("first_row"), F.max("row").alias("second_row"), F.min_by("description", "row").alias("merchant")).filter("undated > 0")
    nothing = F.lit(None).cast("int")
    groups = undated.withColumns({"days_apart": nothing, "refund_row": nothing})
    return _first_refund(pairs, lines, keys).select(*columns).unionByName(groups.select(*columns))


def double_risk(found: DataFrame) -> DataFrame:
    """(statement_id, at_risk): the second charges of dated pairs without a refund."""
    return found.groupBy("statement_id").agg(F.coalesce(F.sum(F.when(F.col("refund_row").isNull() & F.col("days_apart").isNotNull(), F.col("cents"))), F.lit(0)).alias("at_risk"))


def runs(lines: DataFrame, floor: float = SAME_RUN) -> DataFrame:
    """Dated charges of each statement with the leading stable name of their run."""
    return _with_leader(charged(lines).filter(F.col("date").isNotNull()), ["statement_id"], floor, stable_name)


def run_facts(of_runs: DataFrame, keys: Sequence[str] = ("statement_id", "leader")) -> DataFrame:
    """One row for each run: its ends, count, upper median gap and, where its price rose by more than the noise, when.

    Gaps are counted before their median is taken, so nothing that a group holds grows with the run. The rows of a run are those of
    ``of_runs``.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("date", "row")
    at, dearer = F.struct("date", "row"), F.col("cents") > F.first("cents").over(order) + NOISE_CENTS
    steps = of_runs.withColumns({"gap": F.datediff("date", F.lag("date").over(order)), "dear_on": F.when(dearer, F.col("date"))})
    counted = steps.groupBy(*keys, "gap").agg(
        F.count("*").alias("times"),
        F.min("date").alias("first_seen"),
        F.max("date").alias("last_seen"),
        F.min_by(F.struct("cents"), at).alias("first"),
        F.min(at).alias("first_at"),
        F.max_by(F.struct("cents", "description"), at).alias("last"),
        F.max(at).alias("last_at"),
        F.min("dear_on").alias("rose_on"),
        F.min("row").alias("first_row"),
        F.max("row").alias("last_row"),
    )
    gaps = F.sum(F.when(F.col("gap").isNotNull(), F.col("times")))
    run = Window.partitionBy(*keys)
    counted = counted.withColumns({"reached": gaps.over(run.orderBy(F.col("gap").asc_nulls_first())), "half": F.floor(gaps.over(run) / 2)})
    return counted.groupBy(*keys).agg(
        F.sum("times").alias("charges"),
        F.min(F.when(F.col("reached") > F.col("half"), F.col("gap"))).alias("median_gap"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.min_by("first.cents", "first_at").alias("first_cents"),
        F.max_by("last.cents", "last_at").alias("last_cents"),
        F.max_by("last.description", "last_at").alias("merchant"),
        F.min("rose_on").alias("rose_on"),
        F.min("first_row").alias("first_row"),
        F.max("last_row").alias("last_row"),
    )


def is_recurring(median_gap: Column, charges: Column) -> Column:
    """At least three charges and an upper median gap of a month."""
    return F.coalesce((charges >= LEAST_CHARGES) & median_gap.between(*MONTH), F.lit(False))


def recurring_facts(of_runs: DataFrame) -> DataFrame:
    """``run_facts`` of recurring charges: what the inventory, price rises and new charges are told from."""
    return run_facts(of_runs).filter(is_recurring(F.col("median_gap"), F.col("charges")))


def recurring(of_runs: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(statement_id, leader, merchant, charges, latest_cents, a_year_cents, first_seen, last_seen, first_row, rank), the largest year first."""
    order = Window.partitionBy("statement_id").orderBy(F.desc("last_cents"), "first_row")
    facts = (recurring_facts(of_runs) if facts is None else facts).withColumn("rank", F.row_number().over(order))
    return facts.select("statement_id", "leader", "merchant", "charges", F.col("last_cents").alias("latest_cents"), (F.col("last_cents") * 12).alias("a_year_cents"), "first_seen", "last_seen", "first_row", "rank")


def price_rises(of_runs: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Recurring charges whose last price is over the first by more than the noise, and when that was first so."""
    facts = recurring_facts(of_runs) if facts is None else facts
    rise = F.col("last_cents") - F.col("first_cents")
    return facts.filter(rise > NOISE_CENTS).select("statement_id", "leader", "merchant", "first_cents", "last_cents", rise.alias("rise_cents"), (rise * 12).alias("at_risk"), "rose_on", "first_row", "last_row")


def new_recurring(of_runs: DataFrame, lines: DataFrame, settling_days: int = SETTLING_DAYS, facts: DataFrame | None = None) -> DataFrame:
    """Recurring charges that began more than ``settling_days`` after the statement's first dated line."""
    starts = lines.filter(F.col("date").isNotNull()).groupBy("statement_id").agg(F.min("date").alias("opened"))
    facts = (recurring_facts(of_runs) if facts is None else facts).join(starts, "statement_id")
    fresh = facts.filter(F.col("first_seen") > F.date_add("opened", settling_days))
    return fresh.select("statement_id", "leader", "merchant", "charges", "last_cents", (F.col("last_cents") * 12).alias("at_risk"), "first_seen", "first_row", "last_row")


def paid_twice(lines: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """``suspects`` with the money at risk of each (nothing for refunded pairs and undated groups) and their rank, the largest amount first."""
    risk = F.when(F.col("refund_row").isNull() & F.col("days_apart").isNotNull(), F.col("cents")).otherwise(F.lit(0))
    order = Window.partitionBy("statement_id").orderBy(F.desc("cents"), "first_row", "second_row", F.col("days_apart").asc_nulls_last())
    return suspects(lines, window_days).withColumns({"at_risk": risk, "rank": F.row_number().over(order)})


def audit(lines: DataFrame, states: DataFrame, window_days: int = WINDOW_DAYS, facts: DataFrame | None = None) -> DataFrame:
    """Findings of usable statements, largest money first: (statement_id, kind, merchant, leader, cents, days_apart, at_risk, first_row, last_row, rank).

    ``states`` comes from ``integrity.completeness``; incomplete statements have no findings at all. ``facts`` are ``recurring_facts``
    of the usable lines' runs, for callers that need them too. ``finding_rows`` tells each finding's rows.
    """
    good = lines.join(states.filter("usable").select("statement_id"), "statement_id", "left_semi")
    of_runs = runs(good)
    facts = recurring_facts(of_runs) if facts is None else facts
    columns = ("statement_id", "merchant", "leader", "cents", "days_apart", "at_risk", "first_row", "last_row")
    shape = lambda df, kind, place: df.select(*(c for c in columns if c in df.columns), F.lit(kind).alias("kind"), F.lit(place).alias("kind_order"))
    found = shape(paid_twice(good, window_days).withColumnRenamed("second_row", "last_row"), "paid_twice", 0)
    for place, kind, df in ((1, "price_rose", price_rises(of_runs, facts)), (2, "new_recurring", new_recurring(of_runs, good, facts=facts))):
        found = found.unionByName(shape(df, kind, place), allowMissingColumns=True)
    order = Window.partitionBy("statement_id").orderBy(F.desc("at_risk"), "kind_order", "first_row", "last_row", F.col("days_apart").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).drop("kind_order")


def finding_rows(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """(statement_id, rank, row): the rows of each finding of ``audit``, one by one: a pair's two, a cluster's or a run's."""
    pairs = findings.filter("kind = 'paid_twice' and days_apart is not null").select("statement_id", "rank", F.explode(F.array("first_row", "last_row")).alias("row"))
    groups = findings.filter("kind = 'paid_twice' and days_apart is null").join(clusters(lines).select("statement_id", "cents", "leader", "row"), ["statement_id", "cents", "leader"])
    of_run = findings.filter("kind != 'paid_twice'").join(runs(lines).select("statement_id", "leader", "row"), ["statement_id", "leader"])
    return pairs.unionByName(groups.select("statement_id", "rank", "row")).unionByName(of_run.select("statement_id", "rank", "row"))
