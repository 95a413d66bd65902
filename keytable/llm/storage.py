"""Shared scratch space and small helpers used by every operator here."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session. Only a local master, whose executors are the driver, may do without: there
    a temporary folder is chosen and set, so that later calls agree."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="keytable-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Folders written and not yet removed, in the order of their making.
_written: list[str] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch folders; frames that read them are then of no use."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        if path in _written:
            _written.remove(path)


@contextmanager
def scope(spark: SparkSession, *, keep: tuple[str, ...] = ()) -> Iterator[None]:
    """Scratch folders that are written inside go at its end, but for those of ``keep``.
    What was computed inside has to be written or collected by then."""
    before = set(_written)
    try:
        yield
    finally:
        remove(spark, [p for p in _written if p not in before and p not in keep])


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage,
    survives lost executors, and is computed once. See ``scope`` for its removal."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, tag: str, **values: Column) -> tuple[DataFrame, dict[str, int]]:
    """``materialize`` and the given aggregates of all rows (null: 0), taken by the job that
    writes them: a job of their own would cost the driver another plan, its broadcasts
    (4 MB of heap each) and threads."""
    seen = Observation()
    columns = [v.alias(k) for k, v in values.items()]
    written = materialize(df.observe(seen, *columns), tag)
    found = seen.get or written.agg(*columns).first().asDict()
    return written, {k: found[k] or 0 for k in values}


#: A table of at most so many bytes, as counted, is broadcast; larger ones are shuffled.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, *, row_bytes: int, rows: int | None = None) -> bool:
    """Whether a table of rows of at most ``row_bytes`` bytes may be broadcast; ``rows`` is
    how many it has, if that is known."""
    return (df.count() if rows is None else rows) * row_bytes <= BROADCAST_BYTES


#: A key that stands for more than this share of all rows is joined apart.
HOT_SHARE = 1 / 10_000


def join_hot(rows: DataFrame, table: DataFrame, key: str, weight: str, tag: str) -> DataFrame:
    """``rows`` joined to ``table``, which has one row per key and in column ``weight`` how
    many rows have it, and is written as ``tag``. A small table is broadcast. Of a larger one, keys of more than ``HOT_SHARE`` of the rows (so fewer than
    1 / HOT_SHARE keys) are broadcast, the others shuffled: no task gets a hot key."""
    table, seen = observed(table, tag, rows=F.count("*"), total=F.sum(weight))
    if small(table, row_bytes=512, rows=seen["rows"]):
        return rows.join(F.broadcast(table.drop(weight)), key)
    hot = table.where(F.col(weight) > F.lit(seen["total"] * HOT_SHARE)).drop(weight)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(weight) <= F.lit(seen["total"] * HOT_SHARE)).drop(weight), key)
    joined = rows.join(F.broadcast(hot), key)
    return joined.unionByName(rest.select(*joined.columns))


def text_column(df: DataFrame, name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows in this session, so that neither the
    JVM nor a Python worker holds many long texts at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
