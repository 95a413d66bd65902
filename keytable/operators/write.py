"""Unit of work: change sets applied to base tables as pure DataFrame functions.

A change set has the base's columns, ``OP`` (what to do) and ``SEQ`` (in which order).
Of several changes to one key the last one counts, so applying is idempotent. The result
is a new table; writing it is one Spark job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OP, SEQ = "_op", "_seq"
ADD, MERGE, REPLACE, UPDATE, DELETE = "add", "merge", "replace", "update", "delete"
BATCH_ROWS = 100


def changes(df: DataFrame, op: str | Column, seq: Column | None = None) -> DataFrame:
    """``df`` as a change set."""
    return df.withColumn(OP, F.lit(op) if isinstance(op, str) else op).withColumn(SEQ, seq.cast("long") if seq is not None else F.lit(0).cast("long"))


def last_changes(change_set: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last change of every key, as an aggregate with a partial step, so that a hot
    key is combined before the shuffle."""
    rest = [c for c in change_set.columns if c not in keys]
    last = change_set.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(SEQ, OP)).alias("__last"))
    return last.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest]).select(*change_set.columns)


def matching(df: DataFrame, keyed: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``df`` semi- or anti-joined to the keys of another frame; null key parts are equal."""
    named = keyed.select(*[F.col(k).alias(f"__key_{k}") for k in keys])
    return df.join(named, _same(keys, "__key_"), how)


def _same(keys: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys]


def insert(base: DataFrame, new: DataFrame, keys: Sequence[str], *, on_conflict: str = "error") -> DataFrame:
    """Base and new rows. A key that the base or another new row has fails the job
    (``error``), or the base row and any one new row stay (``ignore``)."""
    if on_conflict == "ignore":
        return base.unionByName(matching(new.dropDuplicates(list(keys)), base, keys, "left_anti").select(*base.columns))
    known = base.select(*[F.col(k).alias(f"__key_{k}") for k in keys], F.lit(True).alias("__known"))
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(0)))
    checked = new.withColumn("__nth", nth).join(known, _same(keys, "__key_"), "left").withColumn("__there", F.col("__known") | (F.col("__nth") > 1))
    text = F.concat(F.lit("key exists: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    checked = checked.withColumn(keys[0], F.when(F.col("__there"), F.raise_error(text)).otherwise(F.col(keys[0])).cast(base.schema[keys[0]].dataType))
    return base.unionByName(checked.select(*base.columns))


def merge(base: DataFrame, new: DataFrame, keys: Sequence[str], *, set_null: Sequence[str] = (), insert_new: bool = True) -> DataFrame:
    """Upsert by column: null or absent columns keep the old value, but for those in
    ``set_null``. Without ``insert_new`` only existing rows change. Of several new rows of
    one key any one counts; change sets have an order."""
    n = new.dropDuplicates(list(keys)).select(*[F.col(c).alias(f"__new_{c}") for c in new.columns], F.lit(True).alias("__is_new"))
    o = base.withColumn("__is_old", F.lit(True))
    both = o.join(n, _same(keys, "__new_"), "full_outer" if insert_new else "left")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(c)
        if c in set_null:
            return F.when(F.col("__is_new"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c)
        return F.coalesce(F.col(f"__new_{c}"), F.col(c)).cast(base.schema[c].dataType).alias(c)

    return both.select(*[value(c) for c in base.columns])


def update(base: DataFrame, new: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """Merge into existing rows only."""
    return merge(base, new, keys, insert_new=False, **options)


def replace(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert by row: a row of a known key is replaced whole, by any one of several."""
    filled = new.dropDuplicates(list(keys)).select(*[F.col(c) if c in new.columns else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in base.columns])
    return matching(base, new, keys, "left_anti").select(*base.columns).unionByName(filled)


def delete(base: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return matching(base, gone, keys, "left_anti").select(*base.columns)


def delete_by_key(base: DataFrame, **values: object) -> DataFrame:
    """Without the row of one key."""
    hit = F.lit(True)
    for name, value in values.items():
        hit = hit & F.col(name).eqNullSafe(F.lit(value))
    return base.where(~hit)


def apply(base: DataFrame, change_set: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All kinds of changes in one join: the last change of each key decides."""
    return apply_last(base, last_changes(change_set, keys), keys)


def apply_last(base: DataFrame, last: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changes of which there is one per key."""
    n = last.select(*[F.col(c).alias(f"__new_{c}") for c in last.columns if c not in (OP, SEQ)], OP)
    both = base.withColumn("__is_old", F.lit(True)).join(n, _same(keys, "__new_"), "full_outer")
    conflict = (F.col(OP) == ADD) & F.col("__is_old")
    text = F.concat(F.lit("key exists: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    kept = both.where(F.col(OP).isNull() | (F.col(OP) != DELETE) & ((F.col(OP) != UPDATE) | F.col("__is_old")))

    def value(c: str) -> Column:
        if f"__new_{c}" not in n.columns:
            return F.when(F.col(OP) == REPLACE, F.lit(None)).otherwise(F.col(c)).cast(base.schema[c].dataType).alias(c)
        new = F.col(f"__new_{c}")
        chosen = F.when(F.col(OP).isNull(), F.col(c)).when(F.col(OP).isin(ADD, REPLACE), new).otherwise(F.coalesce(new, F.col(c)))
        if c == keys[0]:
            chosen = F.when(conflict, F.raise_error(text)).otherwise(chosen)
        return chosen.cast(base.schema[c].dataType).alias(c)

    return kept.select(*[value(c) for c in base.columns])


def batch_numbers(df: DataFrame, partition: str, order: Sequence[str], rows: int = BATCH_ROWS) -> DataFrame:
    """Batches of at most ``rows`` rows within a partition key, numbered from 0."""
    nth = F.row_number().over(W.partitionBy(partition).orderBy(*order)) - 1
    return df.withColumn("batch", F.expr("cast(0 as long)") + F.floor(nth / rows))


def etag(df: DataFrame) -> Column:
    """A tag of a row's content, for optimistic concurrency."""
    return F.concat(F.lit('W/"'), F.hex(F.xxhash64(*df.columns)), F.lit('"'))


def check_etags(base: DataFrame, new: DataFrame, keys: Sequence[str], expected: str = "ETag") -> DataFrame:
    """``new`` without its tags; the job fails when a row's tag is neither ``*`` nor that
    of the base row."""
    tags = base.select(*keys, etag(base).alias("__etag"))
    joined = new.join(tags, list(keys), "left")
    ok = F.col(expected).isNull() | (F.col(expected) == "*") | F.col(expected).eqNullSafe(F.col("__etag"))
    checked = F.when(ok, F.col(keys[0])).otherwise(F.raise_error(F.lit("precondition failed: the row has changed")))
    return joined.withColumn(keys[0], checked.cast(new.schema[keys[0]].dataType)).drop(expected, "__etag").select(*[c for c in new.columns if c != expected])
