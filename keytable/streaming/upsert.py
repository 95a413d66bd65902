"""Change streams: upserts and revision history per micro-batch.

Each batch is applied with the batch functions of ``operators``. Results go to versioned
folders named by the batch, and a batch that is run again overwrites its own version, so
a restart does not apply it twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from keytable.operators import revision, write


def _version(folder: str, batch: int) -> str:
    return f"{folder}/v{batch:012d}"


def latest(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version of a table (older than a batch)."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(root) if fs.exists(jvm.Path(s.getPath(), "_SUCCESS"))]
    found = sorted(n for n in names if n.startswith("v") and (before is None or int(n[1:]) < before))
    return spark.read.parquet(f"{folder}/{found[-1]}") if found else None


def upsert(stream: DataFrame, folder: str, keys: Sequence[str], *, order: str, mode: str = write.MERGE, history: str | None = None) -> DataStreamWriter:
    """Apply a stream of rows to the table in ``folder``; the last row per key by ``order``
    counts, also where an older one comes in a later batch. ``history`` is a folder for
    revision rows."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = write.last_changes(write.changes(batch, mode, F.unix_micros(F.col(order).cast("timestamp")) if dict(batch.dtypes)[order].startswith("timestamp") else F.col(order)), keys)
        base = latest(spark, folder, number)
        plain = rows.drop(write.OP, write.SEQ)
        if base is None:
            base = plain.limit(0)
        else:  # rows older than what the table has come too late
            had = base.select(*[F.col(k).alias(f"__key_{k}") for k in keys], F.col(order).alias("__had"))
            rows = rows.join(had, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys], "left").where(F.col("__had").isNull() | (F.col(order) >= F.col("__had"))).select(*rows.columns)
            plain = rows.drop(write.OP, write.SEQ)
        if history is not None:
            revision.diff_changes(base, plain, keys, ignore=[order]).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(_version(history, number))
        write.apply(base, rows, keys).write.mode("overwrite").parquet(_version(folder, number))

    return stream.writeStream.foreachBatch(one)


def run_available(writer: DataStreamWriter, checkpoint: str, then: Callable[[], None] | None = None) -> None:
    """Process what is there and stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if then:
        then()
