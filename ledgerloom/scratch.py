"""Tables written once to the folder that driver and executors share, and reread: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: dict[str, list[str]] = {}
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` or the context's checkpoint folder names.

    Only on one machine (tests, a laptop) a folder is made where none is named.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not folder.isDefined():
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            # Driver and executors are one process here.
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="ledgerloom-"))
            folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = folder.get()
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is there goes when the application ends."""
    path = f"{scratch_root(spark)}/ledgerloom-{label}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = []
        atexit.register(_sweep, spark, app)
    _SCRATCH[app].append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_DROP_SHUFFLES)
    # What was shuffled for a table is of no use once the table is there.
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgerloom_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Deletes the table behind a frame from ``written`` that no later plan reads."""
    path = getattr(df, "_ledgerloom_path", None)
    if path:
        _delete(df.sparkSession, path)
        for paths in _SCRATCH.values():
            if path in paths:
                paths.remove(path)


def _sweep(spark: SparkSession, app: str) -> None:
    for path in _SCRATCH.pop(app, []):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return
