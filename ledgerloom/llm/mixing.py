"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source's repetition rate is its target share of the output over its share of the input (both in UTF-8 bytes, one
added for each document). A document's copy count is a Poisson number with that mean, found by inverting the
distribution at a uniform number hashed from seed and id, so a rerun, or a task run again, gives the same copies. Documents
are exploded by their counts and dealt to partitions by a hash of id and copy: a global shuffle. Up to ``TABLE_RATE`` a source's
distribution is a table; beyond, each document sums it from twelve deviations below the mean, in units of its
first term there, which neither underflows nor grows with more than the root of the rate. Counts beyond ``CHUNK`` are
dealt out in chunks before they are exploded.

Edge cases: a null source is a source of its own; a null or empty text counts one byte, and a very long one is copied whole like any other; rows with one id (null included)
draw one number, so repeated rows get equal counts. An empty table gives an empty table. Input columns named like an
output column (``copy``, ``n_copies``, ``shuffle_key``) are replaced. No rate is too large; the two counts are ints, or bigints
where a source's mean is over a billion.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.scratch import written

#: Well beyond this rate the first probability underflows.
TABLE_RATE = 500
#: So many copies of a document at most are exploded in one place.
CHUNK = 10_000
OUTPUT = ("copy", "n_copies", "shuffle_key")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest of the parts; null parts count as a word of their own."""
    key = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def cumulative(rate: Column) -> Column:
    """The Poisson distribution function at 0, 1, ... until what is left is far below 2 ** -52."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("sums"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["sums"]


def _window(rate: Column) -> tuple[Column, Column]:
    """First and last count of a large rate's distribution; what is left out is far below 2 ** -52."""
    reach = 12 * F.sqrt(rate) + 20
    return F.floor(rate - reach).cast("bigint"), F.ceil(rate + reach).cast("bigint")


def window_total(rate: Column) -> Column:
    """The sum of a large rate's probabilities, in units of the window's first."""
    first, last = _window(rate)
    start = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"))

    return F.aggregate(F.sequence(first + 1, last), start, step)["sum"]


def large_count(rate: Column, total: Column, u: Column) -> Column:
    """The Poisson number at ``u``: how many counts have a distribution function of at most ``u``."""
    first, last = _window(rate)
    bar = u * total
    start = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"), (first + F.when(bar >= 1.0, 1).otherwise(0)).cast("bigint").alias("n"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        reached = acc["sum"] + p
        return F.struct(p.alias("p"), reached.alias("sum"), (acc["n"] + F.when(reached <= bar, 1).otherwise(0)).cast("bigint").alias("n"))

    return F.aggregate(F.sequence(first + 1, last), start, step)["n"]


def source_rates(df: DataFrame, targets: Mapping[str, float], other: float, volume: float, source: str, text: str) -> tuple[DataFrame, float]:
    """(source, rate, sums, total): one row for each source, with the sums up to TABLE_RATE and the total beyond; and the largest rate."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1
    weight = F.lit(float(other))
    for name, value in targets.items():
        weight = F.when(F.col("__source") == F.lit(name), F.lit(float(value))).otherwise(weight)
    stats = df.select(F.col(f"`{source}`").alias("__source"), size.alias("__size")).groupBy("__source").agg(F.sum("__size").alias("__bytes")).withColumn("__weight", weight)
    stats = written(stats, "mix-sources")
    total = stats.agg(F.sum("__bytes").cast("double").alias("b"), F.sum("__weight").alias("w")).first()
    rate = F.lit(0.0) if total["b"] is None else F.col("__weight") * F.lit(total["b"] * volume / total["w"]) / F.col("__bytes")
    rates = stats.withColumn("__rate", rate)
    most = rates.agg(F.max("__rate")).first()[0] or 0.0
    if most <= TABLE_RATE:
        return rates.withColumn("__sums", cumulative(F.col("__rate"))), most
    small = F.col("__rate") <= TABLE_RATE
    rates = rates.withColumn("__sums", F.when(small, cumulative(F.col("__rate")))).withColumn("__total", F.when(~small, window_total(F.col("__rate"))))
    return written(rates, "mix-rates"), most


def mix_sources(df: DataFrame, targets: Mapping[str, float] | None = None, other: float = 1.0, volume: float = 1.0, seed: int = 17, source: str = "source", text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The replicated, globally shuffled rows with all input columns, ``copy`` (from 1), ``n_copies`` and ``shuffle_key``.

    ``targets`` gives weights by source, ``other`` the weight of sources not named, ``volume`` the output's expected
    bytes over the input's. The rates' table is small where sources are few and is then broadcast by Spark's own size
    check; beyond that check the join is by key, where large keys are split at run time.
    """
    df = df.drop(*OUTPUT)
    rates, most = source_rates(df, targets or {}, other, volume, source, text)
    u = uniform(F.lit(seed), F.col(f"`{id_column}`"))
    count = F.size(F.filter("__sums", lambda c: c <= F.col("__u")))
    of_rate = ["__sums"]
    if most > TABLE_RATE:
        count = F.when(F.col("__sums").isNotNull(), count).otherwise(large_count(F.col("__rate"), F.col("__total"), F.col("__u")))
        of_rate = ["__sums", "__rate", "__total"]
    kind = "int" if most < 1e9 else "bigint"

    def counted(rates: DataFrame) -> DataFrame:
        joined = df.join(rates.select("__source", *of_rate), F.col(f"`{source}`").eqNullSafe(F.col("__source")), "inner")
        return joined.withColumn("__u", u).withColumn("n_copies", count.cast(kind)).drop("__source", "__u", *of_rate)

    one, n = F.lit(1).cast(kind), F.col("n_copies")
    if most <= CHUNK:
        copies = counted(rates).withColumn("copy", F.explode(F.when(n > 0, F.sequence(one, n))))
    else:
        few, many = F.col("__rate") <= CHUNK, F.col("__rate") > CHUNK
        copies = counted(rates.filter(few)).withColumn("copy", F.explode(F.when(n > 0, F.sequence(one, n))))
        chunks = counted(rates.filter(many)).withColumn("__from", F.explode(F.when(n > 0, F.sequence(one, n, F.lit(CHUNK).cast(kind)))))
        chunks = chunks.repartition("__from", f"`{id_column}`")
        last = F.least(F.col("__from") + F.lit(CHUNK - 1).cast(kind), n)
        copies = copies.unionByName(chunks.withColumn("copy", F.explode(F.sequence("__from", last))).drop("__from").select(copies.columns))
    key = F.md5(F.concat_ws(":", F.lit(seed + 1), F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("null")), F.col("copy")))
    return copies.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
