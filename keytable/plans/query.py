"""Queries over an entity: four slots (filter, columns, limit, table) and terminals.

A query is immutable and lazy; ``df()`` is the DataFrame it stands for. As in a keyed
table's query there is one limit, applied after all filters whatever the order of calls
(two limits: the smaller one). Without ``ordered`` a limit takes any rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keytable.functions.codec import parse_part, split_parts, successor
from keytable.model import PARTITION_KEY, ROW_KEY, Entity, KeyPart
from keytable.plans.predicate import And, Compare, Const, Or, Predicate, Raw, conjuncts, filter_string, literal, parse_filter


class NotFoundError(LookupError):
    """A row was asked for and there is none."""


class TooManyError(LookupError):
    """One row was asked for and there are several."""


#: More ways than this to read a key bring no conditions on its members.
MOST_SPLITS = 16


def splits(text: str, separator: str, parts: int) -> list[list[str]]:
    """All ways to read a joined key as so many parts; none if they are very many."""
    at = [i for i in range(len(text)) if text.startswith(separator, i)]
    out = []
    for cuts in itertools.combinations(at, parts - 1) if math.comb(len(at), parts - 1) <= 1000 else ():
        if all(b - a >= len(separator) for a, b in zip(cuts, cuts[1:], strict=False)):
            begins, ends = [0, *(c + len(separator) for c in cuts)], [*cuts, len(text)]
            out.append([text[a:b] for a, b in zip(begins, ends, strict=True)])
    return out


def whole_text(text: str, separator: str) -> str:
    """``text`` without an end that could be the beginning of a separator."""
    for n in range(min(len(separator) - 1, len(text)), 0, -1):
        if text.endswith(separator[:n]):
            return whole_text(text[:-n], separator)
    return text


@dataclass(frozen=True)
class Query:
    entity: Entity
    source: Callable[[str], DataFrame]
    table: str | None = None
    predicate: Predicate = Const(True)
    prefixes: tuple[str, ...] = ()
    raw: tuple[str, ...] = ()
    columns: tuple[Column | str, ...] = ()
    top: int | None = None
    order: bool = False

    # --- building ------------------------------------------------------------

    def where(self, predicate: Predicate | Column) -> Query:
        added = Raw(predicate) if isinstance(predicate, Column) else predicate
        return replace(self, predicate=And(tuple([*conjuncts(self.predicate), *conjuncts(added)])) if conjuncts(self.predicate) else added)

    def where_key(self, **values: object) -> Query:
        """Equality on key members; with ``strict_keys`` only leading parts of a key."""
        if self.entity.strict_keys:
            for _, parts in self.entity.keys():
                given = [p.member in values for p in parts]
                if sorted(given, reverse=True) != given:
                    raise ValueError("only leading parts of a key can be given")
        out = self
        for name, value in values.items():
            out = out.where(Compare(name, "eq", value))
        return out

    def with_prefix(self, *prefixes: str) -> Query:
        """PartitionKey starts with one of the prefixes (of all calls together)."""
        return replace(self, prefixes=(*self.prefixes, *prefixes))

    def with_filter(self, text: str) -> Query:
        """And a filter string; empty text changes nothing."""
        return replace(self, raw=(*self.raw, text)) if text.strip() else self

    def from_table(self, name: str) -> Query:
        return replace(self, table=name)

    def select(self, *columns: Column | str) -> Query:
        """Members, renamed members or any expressions; none of them: all members."""
        return replace(self, columns=columns)

    def select_struct(self, fields: Mapping[str, Column | str]) -> Query:
        """Columns under new names."""
        return self.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in fields.items()])

    def project(self, schema: T.StructType) -> Query:
        """The columns of a narrower row type, cast to its types; missing ones are null."""
        known = self.entity.schema.fieldNames()
        return self.select(*[(F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def take(self, n: int) -> Query:
        if n <= 0:
            raise ValueError("take needs a positive number")
        return replace(self, top=n if self.top is None else min(n, self.top))

    def ordered(self) -> Query:
        """By PartitionKey and RowKey, the order of a keyed table."""
        return replace(self, order=True)

    # --- lowering ------------------------------------------------------------

    def condition(self) -> Predicate:
        parts = conjuncts(self.predicate)
        for text in self.raw:
            parts += conjuncts(parse_filter(text))
        return And(tuple(self._from_keys(p) for p in parts)) if parts else Const(True)

    def _from_keys(self, predicate: Predicate) -> Predicate:
        """A condition on an encoded key as one on its members where the key's parts can
        be read back, so that it reaches the scan; the key itself is still compared."""
        if not isinstance(predicate, Compare) or predicate.op != "eq" or predicate.member not in (PARTITION_KEY, ROW_KEY) or not isinstance(predicate.value, str):
            return predicate
        parts = dict(self.entity.keys())[predicate.member]
        plain = [p for p in parts if not p.padding and p.member not in self.entity.encoders and not any(m == p.member for m, _ in self.entity.transforms)]
        # a value may hold the separator, so every way to read the key counts
        ways = splits(predicate.value, self.entity.separator, len(parts)) if parts and len(plain) == len(parts) else []
        known = [k for w in ways if (k := self._members(parts, w)) is not None]
        if not known or len(known) > MOST_SPLITS or not all(known):
            return predicate
        either = [And(tuple(k)) for k in known]
        return And((predicate, *known[0]) if len(known) == 1 else (predicate, Or(tuple(either))))

    def _members(self, parts: tuple[KeyPart, ...], texts: Sequence[str]) -> list[Predicate] | None:
        """Conditions on the members of a key that reads as these texts; None if none can."""
        found: list[Predicate] = []
        for part, text in zip(parts, texts, strict=True):
            kind = self.entity.schema[part.member].dataType
            if isinstance(kind, T.StringType) and text:
                found.append(Compare(part.member, "eq", text))
            elif isinstance(kind, (T.IntegerType, T.LongType)) and text:
                if not (text.isascii() and text.lstrip("-").isdigit()):
                    return None
                found.append(Compare(part.member, "eq", int(text)))
        return found

    def df(self) -> DataFrame:
        rows = self.source(self.table or self.entity.name)
        condition = self.condition()
        for part in conjuncts(condition):
            rows = rows.filter(part.column(self.entity))
        if self.prefixes:
            rows = rows.filter(self._prefix_condition())
        if self.order:
            rows = rows.orderBy(*[self.entity.key_column(n) for n, parts in self.entity.keys() if parts])
        if self.top is not None:
            rows = rows.limit(self.top)
        return rows.select(*[self.entity.member(c).alias(c) if isinstance(c, str) else c for c in self.columns]) if self.columns else rows

    def _prefix_condition(self) -> Column:
        """Any prefix: on the key itself, with what it says about the first two members,
        which the scan can use."""
        key = self.entity.key_column(PARTITION_KEY)
        either = None
        for prefix in self.prefixes:
            one = key.startswith(prefix)
            if (more := self._prefix_members(prefix)) is not None:
                one = one & more
            either = one if either is None else either | one
        return either if either is not None else F.lit(True)

    def _prefix_members(self, prefix: str) -> Column | None:
        parts, separator = self.entity.partition, self.entity.separator
        plain = lambda p: not p.padding and p.member not in self.entity.encoders and not any(m == p.member for m, _ in self.entity.transforms) and isinstance(self.entity.schema[p.member].dataType, T.StringType)
        if not parts or not plain(parts[0]):
            return None
        first, found, rest = prefix.partition(separator)
        member = F.col(parts[0].member)
        if not found:  # the end may belong to a separator
            first = whole_text(first, separator) if len(parts) > 1 else first
            return member.startswith(first) if first else None
        if not first:
            return None
        # the first member ends at the first separator, or holds it itself
        second = whole_text(rest.partition(separator)[0], separator) if len(parts) > 1 and plain(parts[1]) else ""
        ends = member == first
        if second:
            ends = ends & F.col(parts[1].member).startswith(second)
        return member.startswith(first) & ((member != first) | ends)

    def filter_string(self) -> str:
        """The filter of a keyed table that this query stands for."""
        text = filter_string(self.predicate, self.entity)
        ranges = [f"({PARTITION_KEY} ge {literal(p)} and {PARTITION_KEY} lt {literal(successor(p))})" for p in self.prefixes]
        pieces = ([" or ".join(ranges) if len(ranges) == 1 else "(" + " or ".join(ranges) + ")"] if ranges else []) + ([text] if text else []) + [f"({r})" for r in self.raw]
        return " and ".join(f"({p})" if len(pieces) > 1 and " or " in p and not p.startswith("(") else p for p in pieces)

    def explain(self) -> str:
        """The physical plan as text."""
        df = self.df()
        mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        return df._jdf.queryExecution().explainString(mode)

    # --- terminals -----------------------------------------------------------

    def to_list(self, predicate: Predicate | None = None) -> list[Row]:
        return self._and(predicate).df().collect()

    def to_objects(self, factory: Callable[..., Any], predicate: Predicate | None = None) -> Iterator[Any]:
        """Rows made into objects, ``factory(**columns)``, one partition at a time; the
        only place where rows become Python objects."""
        for row in self._and(predicate).df().toLocalIterator():
            yield factory(**row.asDict())

    def take_list(self, n: int) -> list[Row]:
        return self.take(n).df().collect()

    def first(self, predicate: Predicate | None = None) -> Row:
        found = self.first_or_default(predicate)
        if found is None:
            raise NotFoundError(f"{self.entity.name}: no row")
        return found

    def first_or_default(self, predicate: Predicate | None = None) -> Row | None:
        rows = self._and(predicate).take(1).df().collect()
        return rows[0] if rows else None

    def single(self, predicate: Predicate | None = None) -> Row:
        found = self.single_or_default(predicate)
        if found is None:
            raise NotFoundError(f"{self.entity.name}: no row")
        return found

    def single_or_default(self, predicate: Predicate | None = None) -> Row | None:
        rows = self._and(predicate).take(2).df().collect()
        if len(rows) > 1:
            raise TooManyError(f"{self.entity.name}: more than one row")
        return rows[0] if rows else None

    def count(self) -> int:
        return self.df().count()

    def exists(self, predicate: Predicate | None = None) -> bool:
        return bool(self._and(predicate).take(1).df().collect())

    def _and(self, predicate: Predicate | None) -> Query:
        return self if predicate is None else self.where(predicate)

    # --- by key --------------------------------------------------------------

    def find(self, partition: Sequence[object] | str, row: Sequence[object] | str = ()) -> DataFrame:
        """The row of a key (one row at most): parts, or whole encoded keys."""
        query = self
        for name, given in ((PARTITION_KEY, partition), (ROW_KEY, row)):
            parts = dict(self.entity.keys())[name]
            if isinstance(given, str):
                if parts:
                    query = query.where(Compare(name, "eq", given))
            else:
                if len(given) != len(parts):
                    raise ValueError(f"{name} has {len(parts)} parts")
                for part, value in zip(parts, given, strict=True):
                    query = query.where(Compare(part.member, "eq", value))
        return query.take(1).df()

    def find_properties(self, partition: Sequence[object] | str, row: Sequence[object] | str = (), columns: Sequence[str] = ()) -> dict[str, Any]:
        """The row of a key as a dictionary, empty if there is none."""
        found = self.find(partition, row)
        rows = (found.select(*columns) if columns else found).collect()
        return rows[0].asDict() if rows else {}

    def page(self, size: int, after: tuple[str, str] | None = None) -> tuple[DataFrame, Callable[[list[Row]], tuple[str, str] | None]]:
        """The next ``size`` rows in key order after a token, with their keys, and a
        function that gives the token of a full page's last row."""
        rows = self.entity.encode(self.df())
        if after is not None:
            rows = rows.filter((F.col(PARTITION_KEY) > after[0]) | ((F.col(PARTITION_KEY) == after[0]) & (F.col(ROW_KEY) > after[1])))

        def token(page: list[Row]) -> tuple[str, str] | None:
            return (page[-1][PARTITION_KEY], page[-1][ROW_KEY]) if len(page) == size else None

        return rows.orderBy(PARTITION_KEY, ROW_KEY).limit(size), token


def decode_key(key: Column, kinds: Sequence[T.DataType], separator: str = "__") -> list[Column]:
    """The parts of an encoded key in their types."""
    return [parse_part(text, kind) for text, kind in zip(split_parts(key, len(kinds), separator), kinds, strict=True)]
