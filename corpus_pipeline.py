"""A training-data pipeline over ``documents``: each stage is written as Parquet and reread as the next one's input.

Edge cases, for all stages: rows repeat as often as they came unless a stage says otherwise; an empty table gives an empty table;
columns besides those of ``documents`` stay, whatever their names; whole texts are treated, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import bpe_round_trip
from ledgerloom.llm.mixing import mix_sources
from ledgerloom.llm.order_minhash import drop_near_duplicates
from ledgerloom.llm.quality import quality_rules
from ledgerloom.llm.queries import TARGETS
from ledgerloom.llm.secret_scan import scan_secrets
from ledgerloom.scratch import release, written


def _with_text(made: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The columns of documents, with ``text`` in place of the old text and its length counted anew."""
    new = F.col(text)
    return made.select(*[new.alias("text") if c == "text" else F.coalesce(F.length(new), F.lit(0)).cast("bigint").alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failing lines go from the others. Null and empty texts are rejected (fewer than 50 words)."""
    made = quality_rules(docs, keep=[c for c in docs.columns if c != "text"], cleaned=True)
    return _with_text(made.filter("kept"), "cleaned_text", docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of least id; rows repeated with id and text count once.

    Null texts and null ids are in no group and stay; texts that share an id are told apart.
    """
    return drop_near_duplicates(docs).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays. A null text stays null."""
    made = scan_secrets(docs, keep=[c for c in docs.columns if c != "text"], redact=True)
    return _with_text(made, "redacted_text", docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, so that sources reach their target weights.

    A null source is a source of its own; rows that share an id draw one number, so they are repeated alike.
    """
    return mix_sources(docs, TARGETS).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of each mixed document; a null text encodes to nothing."""
    return bpe_round_trip(docs, keep=[c for c in docs.columns if c != "text"])


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("secret scans", secrets), ("mixing sources", mixing), ("BPE encoding", encoding)]

#: Hash-seeded sketches, token ratios and merges are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
