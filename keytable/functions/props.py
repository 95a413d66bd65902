"""Property encoders: JSON, maps, enumerations, addresses, defaults, long values."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keytable.functions.codec import ColumnFunction

SIZE_LIMIT = 64000  # bytes of a value before a reducer is asked


def json_text(value: Column) -> Column:
    """A struct, map or array as JSON text."""
    return F.to_json(value)


def json_binary(value: Column) -> Column:
    """The same as UTF-8 bytes."""
    return F.encode(F.to_json(value), "UTF-8")


def parse_json(stored: Column, schema: T.DataType | str, *, binary: bool = False) -> Column:
    """A value from JSON text or (``binary``) UTF-8 bytes; what can't be read is null."""
    return F.from_json(F.decode(stored, "UTF-8") if binary else stored, schema)


def enum_code(name: Column, codes: Mapping[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for n, c in codes.items() for x in (n, c)]), name)


def enum_name(code: Column, codes: Mapping[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for n, c in codes.items() for x in (c, n)]), code)


def absolute_uri(value: Column) -> Column:
    """An address if it has a scheme and a host, else null; scheme and host lower-case."""
    scheme, host = F.try_parse_url(value, F.lit("PROTOCOL")), F.try_parse_url(value, F.lit("HOST"))
    rest = F.regexp_extract(value, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    named = F.regexp_extract(value, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.when(scheme.isNotNull() & host.isNotNull(), F.concat(F.lower(scheme), F.lit("://"), F.lower(named), F.when(rest == "", F.lit("/")).otherwise(rest)))


def map_to_columns(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """The map column as one column per key, named name__key; absent keys are null."""
    return df.select(*[F.col(c) for c in df.columns if c != name], *[F.col(name).getItem(k).alias(f"{name}__{k}") for k in keys])


def columns_to_map(df: DataFrame, name: str) -> DataFrame:
    """Columns name__key gathered in a map column; nulls are left out."""
    mine = [c for c in df.columns if c.startswith(f"{name}__")]
    if not mine:
        return df.withColumn(name, F.lit(None).cast("map<string,string>"))
    full = F.create_map(*[x for c in mine for x in (F.lit(c[len(name) + 2 :]), F.col(c).cast("string"))])
    return df.select(*[F.col(c) for c in df.columns if c not in mine], F.map_filter(full, lambda _, v: v.isNotNull()).alias(name))


def compose(df: DataFrame, name: str, composer: ColumnFunction) -> DataFrame:
    """A property made from the row's columns by a function of the map of name__key
    columns."""
    gathered = columns_to_map(df, f"{name}")
    return gathered.withColumn(name, composer(F.col(name)))


def compose_entity(df: DataFrame, name: str, composer: Callable[[Column, Column], Column]) -> DataFrame:
    """A property made by a function of the entity (a struct of the other columns) and of
    the map of name__key columns."""
    gathered = columns_to_map(df, name)
    entity = F.struct(*[c for c in gathered.columns if c != name])
    return gathered.withColumn(name, composer(entity, F.col(name)))


def add_properties(df: DataFrame, extra: Column, into: str = "extra") -> DataFrame:
    """Further properties in the map column ``into``; declared columns win, so keys of
    their names are left out, and keys already there are replaced."""
    declared = F.array(*[F.lit(c) for c in df.columns if c != into])
    added = F.map_filter(F.coalesce(extra, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(declared, k))
    if into not in df.columns:
        return df.withColumn(into, added)
    old = F.map_filter(F.coalesce(F.col(into), F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(added, k))
    return df.withColumn(into, F.map_concat(old, added))


def reduce_size(value: Column, reducer: ColumnFunction, limit: int = SIZE_LIMIT) -> Column:
    """``reducer(value)`` for values of more than ``limit`` bytes, others as they are."""
    return F.when(F.octet_length(value) > limit, reducer(value)).otherwise(value)


def property_bag(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """All columns (or some) as a map of texts without nulls."""
    chosen = list(columns or df.columns)
    return F.map_filter(F.create_map(*[x for c in chosen for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull())
