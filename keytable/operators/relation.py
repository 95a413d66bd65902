"""One-to-many collections as joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytable.model import Collection


def children_of(child: DataFrame, collection: Collection, parent: Mapping[str, object]) -> DataFrame:
    """The children of one parent given by its values."""
    out = child
    for mine, theirs in collection.on:
        out = out.where(F.col(mine) == F.lit(parent[theirs]))
    return out


def join_children(parents: DataFrame, child: DataFrame, collection: Collection, *, how: str = "inner", prefix: str = "") -> DataFrame:
    """Every parent with each of its children; child columns named ``prefix`` + name."""
    renamed = child.select(*[F.col(c).alias(f"{prefix}{c}") for c in child.columns])
    clash = set(parents.columns) & set(renamed.columns)
    shared = {mine for mine, theirs in collection.on if f"{prefix}{mine}" == theirs}
    if clash - shared:
        raise ValueError(f"columns of parent and child clash: {sorted(clash - shared)}; give a prefix")
    temporary = renamed.select(*[F.col(c).alias(f"__child_{c}") if c in clash else F.col(c) for c in renamed.columns])
    on = [F.col(theirs) == F.col(f"__child_{prefix}{mine}" if f"{prefix}{mine}" in clash else f"{prefix}{mine}") for mine, theirs in collection.on]
    return parents.join(temporary, on, how).drop(*[f"__child_{c}" for c in clash])


def nest_children(parents: DataFrame, child: DataFrame, collection: Collection, columns: Sequence[str] | None = None) -> DataFrame:
    """Every parent with its children as an array of structs (empty without any). For
    parents whose children fit a row; ``join_children`` has no such bound."""
    columns = list(columns or child.columns)
    keys = [f"__k{i}" for i in range(len(collection.on))]
    grouped = child.groupBy(*[F.col(mine).alias(k) for k, (mine, _) in zip(keys, collection.on, strict=True)]).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(collection.name))
    on = [F.col(theirs) == F.col(k) for k, (_, theirs) in zip(keys, collection.on, strict=True)]
    empty = F.filter(F.array(F.lit(None).cast(grouped.schema[collection.name].dataType.elementType)), lambda x: x.isNotNull())
    return parents.join(grouped, on, "left").withColumn(collection.name, F.coalesce(collection.name, empty)).drop(*keys)


def count_children(parents: DataFrame, child: DataFrame, collection: Collection, name: str) -> DataFrame:
    """Every parent with the number of its children; counted before the join."""
    keys = [f"__k{i}" for i in range(len(collection.on))]
    counts = child.groupBy(*[F.col(mine).alias(k) for k, (mine, _) in zip(keys, collection.on, strict=True)]).agg(F.count("*").alias(name))
    on = [F.col(theirs) == F.col(k) for k, (_, theirs) in zip(keys, collection.on, strict=True)]
    return parents.join(counts, on, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long"))).drop(*keys)
