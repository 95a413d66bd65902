"""Entities: a schema with composite keys, encodings, properties, indexes, relations.

An ``Entity`` is an immutable value; every ``with_...`` returns a changed copy. It
declares how logical columns relate to a keyed table, and the operators read it. Logical
columns are kept as they are in DataFrames, so predicates on them reach the scan; key
columns are computed only where a result or a stored table shows them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keytable.functions import codec
from keytable.functions.codec import SEPARATOR, ColumnFunction, Padding

PARTITION_KEY, ROW_KEY = "PartitionKey", "RowKey"


_TYPES = {
    "string": T.StringType(), "boolean": T.BooleanType(), "short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(),
    "binary": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(),
}


def schema_of(fields: str) -> T.StructType:
    """A schema from "name type, name type" of plain types; needs no session."""
    pairs = [f.split() for f in fields.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


@dataclass(frozen=True)
class KeyPart:
    member: str
    padding: Padding | None = None


@dataclass(frozen=True)
class Index:
    """A secondary index on ``first`` (and ``second``) members. With one key, the last
    write of a key wins; with two, of a pair. ``covering`` copies all columns. ``split``
    is an array column: one index row per element."""

    name: str
    first: tuple[str, ...]
    second: tuple[str, ...] = ()
    covering: bool = False
    table: str | None = None
    prefix: str | None = None
    split: bool = False


@dataclass(frozen=True)
class Collection:
    """Children of a parent: ``on`` maps child members to parent members."""

    name: str
    child: str
    on: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Entity:
    name: str
    schema: T.StructType
    partition: tuple[KeyPart, ...] = ()
    row: tuple[KeyPart, ...] = ()
    separator: str = SEPARATOR
    #: (member, key name or None for both) -> (text function for literals, Column function)
    transforms: Mapping[tuple[str, str | None], tuple[Callable[[object], object], ColumnFunction]] = field(default_factory=dict)
    #: member -> (text function, encoder, decoder)
    encoders: Mapping[str, tuple[Callable[[str], str], ColumnFunction, ColumnFunction | None]] = field(default_factory=dict)
    enums: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    defaults: Mapping[str, object] = field(default_factory=dict)
    indexes: tuple[Index, ...] = ()
    collections: tuple[Collection, ...] = ()
    ignored_tables: tuple[str, ...] = ()
    #: the table that holds the rows, if it isn't named as the entity
    table: str | None = None
    index_postfix: str = "Index"
    #: GeoJSON members with a spatial index
    spatial: tuple[str, ...] = ()
    #: whether changes are kept, and the condition (SQL text over members and old_<member>)
    #: under which they are
    tracked: bool = False
    track_filter: str | None = None
    #: whether a filter on later parts of a key alone is refused
    strict_keys: bool = False

    # --- declaration ---------------------------------------------------------

    def with_keys(self, partition: Sequence[str], row: Sequence[str] = (), padding: Mapping[str, Padding] | None = None) -> Entity:
        parts = lambda names: tuple(KeyPart(n, (padding or {}).get(n)) for n in names)
        self._known([*partition, *row])
        return replace(self, partition=parts(partition), row=parts(row))

    def with_separator(self, separator: str) -> Entity:
        return replace(self, separator=separator)

    def with_key_transform(self, member: str, text: Callable[[object], object], column: ColumnFunction, key: str | None = None) -> Entity:
        """Change a member inside keys (of one or both keys), not as a column."""
        self._known([member])
        return replace(self, transforms={**self.transforms, (member, key): (text, column)})

    def with_encoding(self, member: str, text: Callable[[str], str], encoder: ColumnFunction, decoder: ColumnFunction | None = None) -> Entity:
        self._known([member])
        return replace(self, encoders={**self.encoders, member: (text, encoder, decoder)})

    def with_base64(self, member: str) -> Entity:
        import base64

        return self.with_encoding(member, lambda s: base64.b64encode(s.encode()).decode(), codec.base64_text, codec.unbase64_text)

    def with_enum(self, member: str, codes: Mapping[str, int]) -> Entity:
        """The member is stored as a whole number; predicates may use names."""
        self._known([member])
        return replace(self, enums={**self.enums, member: dict(codes)})

    def with_defaults(self, defaults: Mapping[str, object]) -> Entity:
        """Values that are not written (stored as null)."""
        self._known(list(defaults))
        return replace(self, defaults={**self.defaults, **defaults})

    def with_index(self, name: str, first: Sequence[str], second: Sequence[str] = (), **options) -> Entity:
        self._known([*first, *second])
        if any(i.name == name for i in self.indexes):
            raise ValueError(f"index {name} is declared twice")
        return replace(self, indexes=(*self.indexes, Index(name, tuple(first), tuple(second), **options)))

    def with_table(self, name: str, index_postfix: str | None = None) -> Entity:
        """The table that holds the rows; indexes without a table of their own are named by
        it and the postfix."""
        return replace(self, table=name, index_postfix=self.index_postfix if index_postfix is None else index_postfix)

    def with_spatial_index(self, geometry: str) -> Entity:
        """A spatial index of a GeoJSON member, kept by every save."""
        self._known([geometry])
        return replace(self, spatial=(*self.spatial, geometry))

    def with_revision_tracking(self, only: str | None = None) -> Entity:
        """Every save keeps what its changes changed, or those for which ``only`` holds."""
        return replace(self, tracked=True, track_filter=only)

    def with_collection(self, name: str, child: str, on: Mapping[str, str]) -> Entity:
        return replace(self, collections=(*self.collections, Collection(name, child, tuple(on.items()))))

    def _known(self, members: Sequence[str]) -> None:
        for name in members:
            if name not in self.schema.fieldNames():
                raise KeyError(f"{self.name} has no member {name}")

    # --- use -----------------------------------------------------------------

    @property
    def stored_name(self) -> str:
        return self.table or self.name

    def keys(self) -> list[tuple[str, tuple[KeyPart, ...]]]:
        return [(PARTITION_KEY, self.partition), (ROW_KEY, self.row)]

    def member(self, name: str) -> Column:
        """A member as a Column. The key names themselves stand for the encoded keys."""
        if name in (PARTITION_KEY, ROW_KEY) and name not in self.schema.fieldNames():
            return self.key_column(name)
        self._known([name])
        return F.col(name)

    def coded(self, member: str, value: object) -> object:
        """An enum's name as its number, other values as they are."""
        codes = self.enums.get(member)
        return codes[value] if codes and isinstance(value, str) else value

    def _transform(self, key: str, member: str) -> tuple[Callable, ColumnFunction] | None:
        return self.transforms.get((member, key)) or self.transforms.get((member, None))

    def part_column(self, key: str, part: KeyPart, source: Column | None = None) -> Column:
        """The encoded part as a Column: of the member, or of ``source`` in its place."""
        change, encoder = self._transform(key, part.member), self.encoders.get(part.member)
        kind = self.schema[part.member].dataType
        column = F.col(part.member) if source is None else source
        return codec.encode_part(column, kind, transform=change[1] if change else None, padding=part.padding, encoder=encoder[1] if encoder else None, separator=self.separator)

    def part_text(self, key: str, part: KeyPart, value: object, *, prefix: bool = False) -> str:
        """The encoded part of a literal; a prefix is neither padded nor encoded."""
        change, encoder = self._transform(key, part.member), self.encoders.get(part.member)
        text = change[0](value) if change else self.coded(part.member, value)
        text = "" if text is None else ("true" if text else "false") if isinstance(text, bool) else str(text)
        if prefix:
            return text
        if part.padding:
            fill = self.separator[0]
            return text.rjust(part.padding.length, fill) if part.padding.side == "left" else text.ljust(part.padding.length, fill)
        return encoder[0](text) if encoder else text

    def key_column(self, name: str) -> Column:
        parts = dict(self.keys())[name]
        return codec.join_parts([self.part_column(name, p) for p in parts], self.separator)

    def encode(self, df: DataFrame, *, drop_members: bool = False) -> DataFrame:
        """``df`` with its keys in front, as a stored table has them; key members that no
        transform changed may be dropped, since they can be decoded."""
        keys = [self.key_column(n).alias(n) for n, _ in self.keys()]
        gone = {p.member for _, parts in self.keys() for p in parts if not any(m == p.member for m, _ in self.transforms)} if drop_members else set()
        return df.select(*keys, *[F.col(c) for c in df.columns if c not in gone])

    def decode(self, df: DataFrame) -> DataFrame:
        """The key members read back from the keys; transformed ones stay as stored.
        RefPartitionKey and RefRowKey, as covering indexes have them, come before the
        keys themselves."""
        out = {}
        for name, parts in self.keys():
            if not parts:
                continue
            key = F.col(f"Ref{name}") if f"Ref{name}" in df.columns else F.col(name)
            pieces = self._fixed_parts(key, parts) or codec.split_parts(key, len(parts), self.separator)
            for part, text in zip(parts, pieces, strict=True):
                if any(m == part.member for m, _ in self.transforms):
                    continue
                if part.padding:
                    text = codec.unpad(text, part.padding, self.separator)
                elif (encoder := self.encoders.get(part.member)) and encoder[2]:
                    text = encoder[2](text)
                out[part.member] = codec.parse_part(text, self.schema[part.member].dataType)
        rest = [F.col(c) for c in df.columns if c not in out and c not in (PARTITION_KEY, ROW_KEY)]
        return df.select(*[c.alias(n) for n, c in out.items()], *rest)

    def from_keys(self, df: DataFrame, partition: Column | str, row: Column | str = "") -> DataFrame:
        """``df`` with its key members set from explicit keys, given as literals or
        Columns, in place of any it has."""
        lit = lambda k: F.lit(k) if isinstance(k, str) else k
        members = {p.member for _, parts in self.keys() for p in parts}
        rest = df.select(*[c for c in df.columns if c not in members], lit(partition).alias(PARTITION_KEY), lit(row).alias(ROW_KEY))
        return self.decode(rest)

    def _fixed_parts(self, key: Column, parts: tuple[KeyPart, ...]) -> list[Column] | None:
        """Padded leading parts are cut by their width, since fill and separator share a
        character; only a last part may be unpadded."""
        if len(parts) < 2 or not any(p.padding for p in parts) or not all(p.padding for p in parts[:-1]):
            return None
        out, at = [], 1
        for p in parts[:-1]:
            out.append(F.substring(key, at, p.padding.length))
            at += p.padding.length + len(self.separator)
        return [*out, F.substr(key, F.lit(at))]

    def assert_partition(self, df: DataFrame) -> DataFrame:
        """``df``, failing when a row has no partition key: nulls in all of its parts."""
        if not self.partition:
            return df
        member = self.partition[0].member
        missing = reduce(and_, [F.col(p.member).isNull() for p in self.partition])
        checked = F.when(missing, F.raise_error(F.lit(f"{self.name}: PartitionKey is null"))).otherwise(F.col(member))
        return df.withColumn(member, checked.cast(self.schema[member].dataType))

    def drop_defaults(self, df: DataFrame) -> DataFrame:
        """Configured default values become null, as they are not written."""
        return df.withColumns({c: F.nullif(F.col(c), F.lit(v)) for c, v in self.defaults.items()}) if self.defaults else df

    def enum_names(self, member: str) -> Column:
        """The names of an enum member's numbers."""
        pairs = [F.lit(x) for name, code in self.enums[member].items() for x in (code, name)]
        return F.element_at(F.create_map(*pairs), F.col(member))

    def enum_codes(self, member: str) -> Column:
        pairs = [F.lit(x) for name, code in self.enums[member].items() for x in (name, code)]
        return F.element_at(F.create_map(*pairs), F.col(member))
