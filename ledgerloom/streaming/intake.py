"""Incremental intake: new statement files arrive as a stream, and only the statements they belong to are audited again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ledgerloom.plans.pipeline import audit_statements, parsed_files
from ledgerloom.scratch import release, written


def _taken(session: SparkSession, store: str, number: int) -> DataFrame:
    """(digest, first_taken) of all batches before this one."""
    schema = "digest string, statement_id string, batch int"
    where = session._jvm.org.apache.hadoop.fs.Path(f"{store}/taken")
    if not where.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return session.createDataFrame([], schema).select("digest", F.col("statement_id").alias("first_taken"))
    before = session.read.schema(schema).parquet(f"{store}/taken").filter(F.col("batch") < number)
    return before.groupBy("digest").agg(F.min("statement_id").alias("first_taken"))


def _told_apart(batch: DataFrame, taken: DataFrame) -> DataFrame:
    """(statement_id, digest, same_as): ``same_as`` is null for what is new, else the name under which these bytes were taken in."""
    first = F.min("statement_id").over(Window.partitionBy("digest"))
    seen = batch.select("statement_id", "digest").distinct().withColumn("first", first).join(taken, "digest", "left")
    same = F.coalesce("first_taken", F.when(F.col("first") != F.col("statement_id"), F.col("first")))
    return seen.select("statement_id", "digest", same.alias("same_as"))


def watch(spark: SparkSession, inbox: str, store: str, checkpoint: str, on_change: Callable[[DataFrame, int], None] | None = None, once: bool = True) -> StreamingQuery:
    """Follows ``inbox`` and keeps ``store``/lines, /states, /findings, /refusals, /taken and /rejected, partitioned by batch.

    A statement is one file and is complete when it arrives, so a batch's audit reads that batch's files only. What a file holds is
    known by its digest: a copy under another name, of an earlier batch or the same, is rejected and told with the name it was taken
    in by (an export that is audited twice would look like charges paid twice). The checkpoint keeps which files were read: a
    restarted job goes on where it stopped, and a batch that is repeated overwrites its own output.
    """
    files = spark.readStream.format("text").option("wholetext", True).load(inbox).select(F.col("_metadata.file_path").alias("statement_id"), F.col("value").alias("text"))

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        parsed: tuple[DataFrame, ...] = ()
        batch = written(batch.withColumn("digest", F.sha2("text", 256)), "intake")
        try:
            told = _told_apart(batch, _taken(session, store, number))
            told.filter("same_as is null").select("digest", "statement_id").write.mode("overwrite").parquet(f"{store}/taken/batch={number}")
            told.filter("same_as is not null").select("statement_id", "digest", "same_as").write.mode("overwrite").parquet(f"{store}/rejected/batch={number}")
            new = session.read.parquet(f"{store}/taken/batch={number}").select("statement_id")
            parsed = parsed_files(batch.join(new, "statement_id", "left_semi").select("statement_id", "text"))
            audit = audit_statements(parsed)
            for name, df in (("lines", parsed.lines), ("states", audit.states), ("findings", audit.findings), ("refusals", parsed.refusals)):
                df.write.mode("overwrite").parquet(f"{store}/{name}/batch={number}")
            if on_change:
                on_change(session.read.parquet(f"{store}/findings/batch={number}"), number)
        finally:
            for df in (batch, *parsed):
                release(df)

    writer = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
