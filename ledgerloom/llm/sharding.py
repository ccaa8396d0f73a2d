"""Sharding by sampled splitters.

Records are ordered by a hash of their text, then by id, then by a number that tells equal ones apart, so equal texts lie
together (where a shard ends among them, they straddle its border). Keys are sampled with probability
proportional to size, quantiles of the sample are the splitters of many small ranges, and the exact bytes of each range
are then measured. Ranges that are overfull (a very frequent text, or an unlucky sample) are sampled again by themselves
and subdivided. Each record's exact byte position (its range's offset plus a running sum inside it) decides its shard,
so shards differ by less than one record each, whatever the sample was. No two keys are equal, so any range can be split,
even one of rows that repeat throughout.

Edge cases: a null text has no bytes (size 16, checksum 0) and sorts as the empty text does; null ids come first. Rows
equal in text and id are interchangeable. A long text is never cut. An empty table gives an empty table. Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerloom.scratch import release, written


FIXED_BYTES = 16
RANGES_PER_SHARD = 16
SAMPLES_PER_RANGE = 40
#: A range over this many times its fair share of bytes is subdivided, if it holds more than one record.
OVERFULL = 2.0
_FIRST = -(1 << 63)
KEY = ("h", "d", "m")

SCHEMA = "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"


def _splitters(keys: np.ndarray, weights: np.ndarray, pieces: int) -> list[tuple[int, ...]]:
    """Keys at the weighted quantiles 1/pieces, 2/pieces, ...; ``keys`` has a row for each key, in any order."""
    if not len(keys) or pieces < 2:
        return []
    order = np.lexsort(keys.T[::-1])
    reached = np.cumsum(weights[order])
    at = np.searchsorted(reached, reached[-1] * np.arange(1, pieces) / pieces)
    return sorted({tuple(key) for key in keys[order[np.minimum(at, len(order) - 1)]].tolist()})


def place_of(keys: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """The number of splitters at or below each key; keys and sorted splitters are given by component."""
    if len(keys) == 1:
        return np.searchsorted(splitters[0], keys[0], "right")
    out, end = np.searchsorted(splitters[0], keys[0], "left"), np.searchsorted(splitters[0], keys[0], "right")
    for i in np.unique(out[end > out]):
        tied = np.flatnonzero((out == i) & (end > out))
        out[tied] = i + place_of([k[tied] for k in keys[1:]], [s[i : end[tied[0]]] for s in splitters[1:]])
    return out


def _range_of(splitters: list[tuple[int, ...]]):
    """A function of the key's columns for the record's range."""
    parts = [np.array([s[i] for s in splitters], np.int64) for i in range(len(KEY))]

    @F.pandas_udf(T.IntegerType())
    def place(h: pd.Series, d: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series(place_of([c.to_numpy(np.int64) for c in (h, d, m)], parts).astype(np.int32))

    return place


def _sample(records: DataFrame, rate, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys drawn with the given probability (a column), their weights and ranges; the expected count is bounded."""
    drawn = records.withColumn("__p", F.least(F.lit(1.0), rate)).filter(F.rand(seed) < F.col("__p"))
    rows = drawn.select(*KEY, (F.col("size") / F.col("__p")).alias("w"), *(["part"] if "part" in records.columns else [F.lit(0).alias("part")])).toPandas()
    return rows[list(KEY)].to_numpy(np.int64), rows["w"].to_numpy(float), rows["part"].to_numpy()


def shard(df: DataFrame, shards: int = 40, id_column: str = "doc_id", text: str = "text", seed: int = 11) -> DataFrame:
    """One row for each record: (doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law ``bytes``."""
    spark = df.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    records = df.select(
        F.col(f"`{id_column}`").cast("bigint").alias("doc_id"),
        (F.octet_length(body) + FIXED_BYTES).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.conv(F.substring(F.md5(body), 1, 15), 16, 10).cast("bigint").alias("h"),
    ).withColumns({"d": F.coalesce("doc_id", F.lit(_FIRST)), "m": F.monotonically_increasing_id()})
    records = written(records, "shard-records")
    whole = records.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    if not whole["n"]:
        return spark.createDataFrame([], SCHEMA)
    total, ranges = whole["b"], shards * RANGES_PER_SHARD
    keys, weights, _ = _sample(records, F.col("size") * F.lit(ranges * SAMPLES_PER_RANGE / total), seed)
    splitters = _splitters(keys, weights, ranges)
    fair = total / ranges
    for again in range(1, 9):
        parted = records.withColumn("part", _range_of(splitters)(*KEY))
        measured = parted.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
        over = {r["part"]: r["b"] for r in measured if r["b"] > OVERFULL * fair and r["n"] > 1}
        if not over:
            break
        rate = F.col("size") * F.lit(SAMPLES_PER_RANGE / fair)
        keys, weights, parts = _sample(parted.filter(F.col("part").isin(list(over))), rate, seed + again)
        more = {s for part, b in over.items() for s in _splitters(keys[parts == part], weights[parts == part], int(np.ceil(b / fair)) + 1)}
        if not more - set(splitters):
            break
        splitters = sorted({*splitters, *more})
    # One row for each range: bounded by the number of ranges and their subdivisions, whatever the input's size.
    starts, b, n = [], 0, 0
    for r in sorted(measured, key=lambda r: r["part"]):
        starts.append((r["part"], b, n))
        b, n = b + r["b"], n + r["n"]
    offsets = spark.createDataFrame(starts, "part int, byte_offset bigint, row_offset bigint")
    inside = Window.partitionBy("part").orderBy(*KEY)
    before = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    at = parted.withColumn("__before", before).withColumn("__row", F.row_number().over(inside)).join(F.broadcast(offsets), "part")
    placed = at.select(
        "doc_id",
        "size",
        "text_crc32",
        F.expr(f"cast((byte_offset + __before) * {shards} div {total} as int)").alias("shard"),
        (F.col("row_offset") + F.col("__row") - 1).alias("place"),
    )
    placed = written(placed, "shard-placed")
    release(records)
    firsts = spark.createDataFrame(placed.groupBy("shard").agg(F.min("place").alias("first")).collect(), "shard int, first bigint")
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
