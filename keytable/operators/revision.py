"""Revision history: what each change changed.

A head row is the current state. When it changes, a revision row keeps the columns that
differ from the head before; equal ones are null, and ``changed`` names the others. A
change of nothing leaves no revision; a first version is kept whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEAD, REVISION = "HEAD", "REV"


def revision_key(partition_key: Column) -> Column:
    """The partition key of the history of a head."""
    return F.replace(partition_key, F.lit(HEAD), F.lit(REVISION))


def _differences(new: dict[str, Column], old: dict[str, Column], known: Column) -> dict[str, Column]:
    """Per column: whether it differs, binary values by content; without a head before,
    every column that has a value does."""
    return {c: F.when(known, ~new[c].eqNullSafe(old[c])).otherwise(new[c].isNotNull()) for c in new}


def _diff(rows: DataFrame, keep: Sequence[str], new: dict[str, Column], old: dict[str, Column], known: Column, veto: Column | None) -> DataFrame:
    differs = _differences(new, old, known)
    any_change = reduce(or_, differs.values(), F.lit(False))
    rows = rows.where((any_change | ~known) & (veto if veto is not None else F.lit(True)))
    names = F.filter(F.array(*[F.when(d, F.lit(c)) for c, d in differs.items()]), lambda x: x.isNotNull())
    return rows.select(*keep, *[F.when(d, new[c]).alias(c) for c, d in differs.items()], F.concat_ws(",", names).alias("changed"))


def diff_history(events: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], *, veto: Column | None = None) -> DataFrame:
    """Revisions of a log of versions: each version against the one before. ``veto`` is
    a condition over the values and old_<value>; versions that fail it leave none."""
    window = W.partitionBy(*keys).orderBy(*order)
    rows = events.withColumns({f"old_{c}": F.lag(c).over(window) for c in values} | {"__nth": F.row_number().over(window)})
    new, old = {c: F.col(c) for c in values}, {c: F.col(f"old_{c}") for c in values}
    return _diff(rows, [*keys, *order], new, old, F.col("__nth") > 1, veto)


def diff_changes(heads: DataFrame, changed: DataFrame, keys: Sequence[str], *, veto: Column | None = None, ignore: Sequence[str] = ()) -> DataFrame:
    """Revisions of a change set against the current heads. Columns that key transforms
    change can be left out with ``ignore``."""
    values = [c for c in changed.columns if c not in keys and c not in ignore]
    before = heads.select(*[F.col(k).alias(f"__key_{k}") for k in keys], *[F.col(c).alias(f"old_{c}") for c in values], F.lit(True).alias("__known"))
    rows = changed.join(before, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys], "left")
    new, old = {c: F.col(c) for c in values}, {c: F.col(f"old_{c}") for c in values}
    return _diff(rows, list(keys), new, old, F.coalesce("__known", F.lit(False)), veto)


def save_with_history(heads: DataFrame, changed: DataFrame, keys: Sequence[str], *, deleted: DataFrame | None = None, veto: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(new heads, revision rows). The head is written even where the veto leaves no
    revision; a deleted row leaves a tombstone (``deleted`` true)."""
    from keytable.operators import write

    revisions = diff_changes(heads, changed, keys, veto=veto).withColumn("deleted", F.lit(False))
    heads_after = write.merge(heads, changed, keys)
    if deleted is not None:
        gone = heads.join(deleted.select(*keys), list(keys), "left_semi")
        empty = [F.lit(None).cast(revisions.schema[c].dataType).alias(c) for c in revisions.columns if c not in keys and c not in ("changed", "deleted")]
        revisions = revisions.unionByName(gone.select(*keys, *empty, F.lit("").alias("changed"), F.lit(True).alias("deleted")))
        heads_after = write.delete(heads_after, deleted, keys)
    return heads_after, revisions


def restore(revisions: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], *, versions: DataFrame | None = None) -> DataFrame:
    """Every version whole again: the last value that was kept of each column. A null
    that a revision names as changed is a null. ``versions`` (keys and order of all
    versions) adds those that changed nothing and so left no revision."""
    if versions is not None:
        known = revisions.select(*[F.col(c).alias(f"__{c}") for c in (*keys, *order)], *values, "changed")
        on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*keys, *order)]
        revisions = versions.select(*keys, *order).join(known, on, "left").withColumn("changed", F.coalesce("changed", F.lit("")))
    window = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    named = lambda c: F.array_contains(F.split("changed", ","), c)
    last = {c: F.last(F.when(named(c), F.struct(F.col(c).alias("v"))), ignorenulls=True).over(window)["v"] for c in values}
    return revisions.select(*keys, *order, *[v.alias(c) for c, v in last.items()])
