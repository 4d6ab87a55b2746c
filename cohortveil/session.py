"""Session helpers: recommended settings and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the jobs are designed for.  Joins are never
# hinted to broadcast; Spark decides from the size statistics of each side.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


# Rows and bytes of an Arrow batch: Spark's 10,000 whole texts would be held several times over,
# outside the JVM's heap and in each Python worker.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608",
}


def small_batches(spark: SparkSession) -> SparkSession:
    """Let Python workers get texts in batches of bounded size."""
    for key, value in BATCH_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return small_batches(spark)


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder serves a local master (one
    machine); any other master raises, since executors would each write to a disk
    of their own and a later read would miss rows without an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="cohortveil-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


_WRITTEN: dict[str, list[str]] = {}


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the cluster's checkpoint folder and read it back.

    A written table survives lost executors, can be pruned by column and has a
    known size, so joins to it are planned from that size.  ``drop_cuts`` removes
    the tables of a session that are no longer read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark_cuts(spark: SparkSession) -> int:
    """Number of tables written so far, to hand to ``drop_cuts``."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, ()))


def drop_cuts(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that ``cut`` wrote after mark ``since``; returns their number.

    Call it once a request's result has been written: lazy results read these tables.
    """
    written = _WRITTEN.get(spark.sparkContext.applicationId, [])
    gone, written[since:] = written[since:], []
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)
    return len(gone)
