"""Chain verification as a stream: each new segment of a log is read once, and the log's tip is kept in state."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.operators.decisions import GENESIS, segment_lines

VERDICT = "log_id string, intact boolean, broken_at bigint, entries bigint, tip string"
STATE = "entries bigint, tip string, broken_at bigint"


def linked(line: str, tip: str) -> bool:
    """Whether a line names the digest of the line before it."""
    try:
        return json.loads(line).get("prev") == tip
    except (ValueError, AttributeError):
        return False


def _advance(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    entries, tip, broken = state.get if state.exists else (0, GENESIS, None)
    lines = sorted((int(n), line) for batch in batches for n, line in zip(batch["line_no"], batch["line"]))
    for number, line in lines:
        if broken is None and (number != entries + 1 or not linked(line, tip)):
            broken = number
        entries, tip = entries + 1, hashlib.sha256(line.encode()).hexdigest()
    state.update((entries, tip, broken))
    yield pd.DataFrame({"log_id": [key[0]], "intact": [broken is None], "broken_at": pd.array([broken], dtype="Int64"), "entries": [entries], "tip": [tip]})


def verify_stream(lines: DataFrame) -> DataFrame:
    """(log_id, intact, broken_at, entries, tip) of each log that grew, from a stream of (log_id, line_no, line).

    A log's lines arrive in order, any number at a time; one that skips a number breaks the chain, as does one that names another
    digest than that of the line before. What is kept of a log is its tip, its length and where it broke.
    """
    return lines.groupBy("log_id").applyInPandasWithState(_advance, VERDICT, STATE, "update", GroupStateTimeout.NoTimeout)


def follow(spark: SparkSession, root: str) -> DataFrame:
    """The stream of ``verify_stream`` over all logs of segments under a folder."""
    files = spark.readStream.option("recursiveFileLookup", "true").option("wholetext", True).option("pathGlobFilter", "[0-9]*.jsonl").text(root)
    return verify_stream(segment_lines(files.select(F.col("_metadata.file_path").alias("path"), "value")))
