"""Secondary indexes: derived from the base, looked up by join.

An index is always computed from the base rows, so it can't be stale. With one key, the
last write (by ``order``) of a key wins; with two, of each pair. The index's name is part
of its key, so indexes that share a table do not collide.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytable.functions import codec
from keytable.model import PARTITION_KEY, ROW_KEY, Entity, Index, KeyPart

REF_PARTITION, REF_ROW = "RefPartitionKey", "RefRowKey"


def index_table(entity: Entity, index: Index) -> str:
    return index.table or f"{entity.stored_name}{entity.index_postfix}"


def find_index(entity: Entity, name: str) -> Index:
    for index in entity.indexes:
        if index.name == name:
            return index
    raise KeyError(f"{entity.name} has no index {name}")


def _text(entity: Entity, member: str, source: Column | None = None) -> Column:
    return entity.part_column("", KeyPart(member), source)


def _keys(entity: Entity, index: Index, source: Column | None = None) -> tuple[Column, Column]:
    parts = [_text(entity, x) if source is None or i else _text_of(source) for i, x in enumerate(index.first)]
    first = codec.join_parts([F.lit(index.prefix or index.name), *parts], entity.separator)
    return first, codec.join_parts([_text(entity, x) for x in index.second], entity.separator)


def _text_of(element: Column) -> Column:
    return F.coalesce(element.cast("string"), F.lit(""))


def derive(entity: Entity, index: Index, base: DataFrame, *, order: Sequence[Column] = (), current: DataFrame | None = None) -> DataFrame:
    """The index rows of ``base``: keys, references, and (covering) all other columns.
    ``order`` is the order of writes; among rows of equal order one that the index
    ``current`` refers to stays, else the largest base key wins. Rows that a column
    is_revision marks are not indexed."""
    if "is_revision" in base.columns:
        base = base.where(~F.coalesce("is_revision", F.lit(False)))
    rows = base
    source = None
    if index.split:  # one row per distinct element
        rows = rows.withColumn("__element", F.explode(F.array_distinct(F.col(index.first[0]))))
        source = F.col("__element")
    first, second = _keys(entity, index, source)
    refs = [entity.key_column(PARTITION_KEY).alias(REF_PARTITION), entity.key_column(ROW_KEY).alias(REF_ROW)]
    kept = [c for c in base.columns if not c.startswith("__")] if index.covering else []
    keyed = rows.select(first.alias(PARTITION_KEY), second.alias(ROW_KEY), *refs, *[F.col(c) for c in kept], *[c.alias(f"__o{i}") for i, c in enumerate(order)])
    # the last write as one aggregate with a partial step, which a hot key needs
    stood = []
    if current is not None:
        ids = [PARTITION_KEY, ROW_KEY, REF_PARTITION, REF_ROW]
        before = current.select(*[F.col(c).alias(f"__was_{c}") for c in ids], F.lit(True).alias("__stood")).distinct()
        keyed = keyed.join(before, [F.col(c) == F.col(f"__was_{c}") for c in ids], "left")
        stood = [F.coalesce("__stood", F.lit(False))]
    rank = F.struct(*[F.col(f"__o{i}") for i in range(len(order))], *stood, F.col(REF_PARTITION), F.col(REF_ROW))
    columns = [REF_PARTITION, REF_ROW, *kept]
    last = keyed.groupBy(PARTITION_KEY, ROW_KEY).agg(F.max_by(F.struct(*columns), rank).alias("__last"))
    return last.select(PARTITION_KEY, ROW_KEY, *[F.col(f"__last.{c}").alias(c) for c in columns])


def probe(entity: Entity, index: Index, values: Sequence[object]) -> Column:
    """The condition on index rows for these key values: the first ones for the key, the
    rest for the second key."""
    n, k = len(index.first), len(index.second)
    if len(values) != n + k:
        raise ValueError(f"index {index.name} takes {n + k} values")
    text = lambda m, v: entity.part_text("", KeyPart(m), v)
    first = entity.separator.join([index.prefix or index.name, *(text(x, v) for x, v in zip(index.first, values[:n], strict=True))])
    second = entity.separator.join(text(x, v) for x, v in zip(index.second, values[n:], strict=True))
    return (F.col(PARTITION_KEY) == first) & (F.col(ROW_KEY) == second)


def lookup(entity: Entity, index: Index, rows: DataFrame, base: DataFrame, values: Sequence[object]) -> DataFrame:
    """The base columns of the row that the index has for these values; a covering index
    needs no base read, a narrow one a join on the references."""
    found = rows.where(probe(entity, index, values))
    return found.select(*base.columns) if index.covering else dereference(entity, found, base)


def dereference(entity: Entity, found: DataFrame, base: DataFrame) -> DataFrame:
    """The base rows that index rows refer to."""
    keyed = base.withColumn("__pk", entity.key_column(PARTITION_KEY)).withColumn("__rk", entity.key_column(ROW_KEY))
    refs = found.select(F.col(REF_PARTITION).alias("__pk"), F.col(REF_ROW).alias("__rk"))
    return keyed.join(refs, ["__pk", "__rk"], "left_semi").select(*base.columns)


def join_by_index(entity: Entity, rows: DataFrame, base: DataFrame, probes: DataFrame, index: Index) -> DataFrame:
    """The probe rows (columns named as the index's members) with what the index finds
    for each."""
    first, second = _keys(entity, index)
    wanted = probes.select(first.alias("__p"), second.alias("__r"), *[F.col(c).alias(f"probe_{c}") for c in probes.columns])
    hits = wanted.join(rows, (F.col("__p") == F.col(PARTITION_KEY)) & (F.col("__r") == F.col(ROW_KEY))).drop("__p", "__r")
    if index.covering:
        return hits.drop(PARTITION_KEY, ROW_KEY, REF_PARTITION, REF_ROW)
    keyed = base.withColumn("__pk", entity.key_column(PARTITION_KEY)).withColumn("__rk", entity.key_column(ROW_KEY))
    hits = hits.select(F.col(REF_PARTITION).alias("__pk"), F.col(REF_ROW).alias("__rk"), *[c for c in hits.columns if c.startswith("probe_")])
    return hits.join(keyed, ["__pk", "__rk"]).drop("__pk", "__rk")


def first_hit(found: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Rows of several lookups; per key that of the first lookup that has one."""
    marked = [df.withColumn("__probe", F.lit(i)) for i, df in enumerate(found)]
    every = reduce(lambda a, b: a.unionByName(b), marked)
    columns = [c for c in found[0].columns if c not in key]
    best = every.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct("__probe", *columns)).alias("__first"))
    return best.select(*[F.col(f"__first.{c}").alias(c) if c in columns else F.col(c) for c in found[0].columns])


def distinct_by(df: DataFrame, key: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """One row per key: the first one by ``order``, or any."""
    if not order:
        return df.dropDuplicates(list(key))
    nth = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("__nth", nth).where("__nth = 1").drop("__nth")
