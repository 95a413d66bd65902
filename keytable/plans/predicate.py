"""Predicates over an entity's members.

A predicate is a small tree that lowers in two ways: to a Column on the members
themselves, which Catalyst pushes into the scan, and to the filter string of a keyed
table, where equality on key members becomes equality or a range on PartitionKey and
RowKey. A parser reads filter strings back into trees.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from keytable.functions.codec import successor

if TYPE_CHECKING:
    from keytable.model import Entity

SYMBOLS = {"eq": "==", "ne": "!=", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}


class Predicate:
    """Base of the tree; ``&``, ``|`` and ``~`` combine predicates."""

    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)

    def column(self, entity: Entity) -> Column:
        raise NotImplementedError

    def render(self, entity: Entity) -> str:
        raise NotImplementedError


def literal(value: object) -> str:
    """A value as it stands in a filter string."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value) if -(2**31) <= value < 2**31 else f"{value}L"
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, uuid.UUID):
        return f"guid'{value}'"
    if isinstance(value, dt.datetime):
        utc = value.astimezone(dt.UTC) if value.tzinfo else value
        return f"datetime'{utc.strftime('%Y-%m-%dT%H:%M:%S.%f')}Z'"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    return "'" + str(value).replace("'", "''") + "'"


def _operand(value: object) -> object:
    return str(value) if isinstance(value, uuid.UUID) else bytes(value) if isinstance(value, bytearray) else value


@dataclass(frozen=True)
class Compare(Predicate):
    """member op value; null values mean is (not) null."""

    member: str
    op: str
    value: object

    def column(self, entity: Entity) -> Column:
        c, v = entity.member(self.member), entity.coded(self.member, _operand(self.value))
        if v is None:
            if self.op not in ("eq", "ne"):
                return F.lit(None).cast("boolean")
            return c.isNull() if self.op == "eq" else c.isNotNull()
        return {"eq": c == v, "ne": c != v, "gt": c > v, "ge": c >= v, "lt": c < v, "le": c <= v}[self.op]

    def render(self, entity: Entity) -> str:
        return f"{self.member} {self.op} {literal(entity.coded(self.member, self.value))}"


@dataclass(frozen=True)
class In(Predicate):
    """The member is one of the values; of none it never is."""

    member: str
    values: tuple

    def column(self, entity: Entity) -> Column:
        values = [entity.coded(self.member, _operand(v)) for v in self.values]
        return entity.member(self.member).isin(values) if values else F.lit(False)

    def render(self, entity: Entity) -> str:
        return "(" + " or ".join(f"{self.member} eq {literal(entity.coded(self.member, v))}" for v in self.values) + ")" if self.values else "false"


@dataclass(frozen=True)
class StartsWith(Predicate):
    member: str
    prefix: str

    def column(self, entity: Entity) -> Column:
        c = entity.member(self.member)
        return c.startswith(self.prefix) if self.prefix else c.isNotNull()

    def render(self, entity: Entity) -> str:
        if not self.prefix:
            return f"{self.member} ne null"
        return f"({self.member} ge {literal(self.prefix)} and {self.member} lt {literal(successor(self.prefix))})"


@dataclass(frozen=True)
class Flag(Predicate):
    """A bare boolean member."""

    member: str

    def column(self, entity: Entity) -> Column:
        return entity.member(self.member)

    def render(self, entity: Entity) -> str:
        return self.member


@dataclass(frozen=True)
class Const(Predicate):
    value: bool

    def column(self, entity: Entity) -> Column:
        return F.lit(self.value)

    def render(self, entity: Entity) -> str:
        return "true" if self.value else "false"


@dataclass(frozen=True)
class Raw(Predicate):
    """Any Column, for what the tree has no node for."""

    expression: Column

    def column(self, entity: Entity) -> Column:
        return self.expression

    def render(self, entity: Entity) -> str:
        raise ValueError("a raw column has no filter string")


@dataclass(frozen=True)
class Not(Predicate):
    inner: Predicate

    def column(self, entity: Entity) -> Column:
        return ~self.inner.column(entity)

    def render(self, entity: Entity) -> str:
        return f"not ({self.inner.render(entity)})"


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...]

    def column(self, entity: Entity) -> Column:
        return reduce(and_, (p.column(entity) for p in self.parts))

    def render(self, entity: Entity) -> str:
        parts = [q for q in self.parts if not (isinstance(q, Const) and q.value)]
        return " and ".join(f"({q.render(entity)})" if isinstance(q, Or) else q.render(entity) for q in parts) or "true"


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...]

    def column(self, entity: Entity) -> Column:
        return reduce(or_, (p.column(entity) for p in self.parts))

    def render(self, entity: Entity) -> str:
        return " or ".join(f"({p.render(entity)})" if isinstance(p, And) else p.render(entity) for p in self.parts)


class Member:
    """``m("name") == 5`` and the like."""

    def __init__(self, name: str):
        self.name = name

    def __eq__(self, value: object) -> Predicate:  # type: ignore[override]
        return Compare(self.name, "eq", value)

    def __ne__(self, value: object) -> Predicate:  # type: ignore[override]
        return Compare(self.name, "ne", value)

    def __gt__(self, value: object) -> Predicate:
        return Compare(self.name, "gt", value)

    def __ge__(self, value: object) -> Predicate:
        return Compare(self.name, "ge", value)

    def __lt__(self, value: object) -> Predicate:
        return Compare(self.name, "lt", value)

    def __le__(self, value: object) -> Predicate:
        return Compare(self.name, "le", value)

    __hash__ = None  # type: ignore[assignment]

    def compare_to(self, value: str) -> Comparison:
        """Ordering of strings, to be compared with 0."""
        return Comparison(self.name, value)

    def startswith(self, prefix: str) -> Predicate:
        return StartsWith(self.name, prefix)

    def isin(self, values: Sequence) -> Predicate:
        return In(self.name, tuple(values))

    def istrue(self) -> Predicate:
        return Flag(self.name)


class Comparison:
    """``m("a").compare_to("x") > 0`` means a > "x"."""

    def __init__(self, name: str, value: str):
        self.name, self.value = name, value

    def _op(self, op: str, zero: int) -> Predicate:
        if zero != 0:
            raise ValueError("a comparison of strings is itself compared with 0")
        return Compare(self.name, op, self.value)

    def __gt__(self, zero: int) -> Predicate:
        return self._op("gt", zero)

    def __ge__(self, zero: int) -> Predicate:
        return self._op("ge", zero)

    def __lt__(self, zero: int) -> Predicate:
        return self._op("lt", zero)

    def __le__(self, zero: int) -> Predicate:
        return self._op("le", zero)

    def __eq__(self, zero: object) -> Predicate:  # type: ignore[override]
        return self._op("eq", zero)  # type: ignore[arg-type]

    def __ne__(self, zero: object) -> Predicate:  # type: ignore[override]
        return self._op("ne", zero)  # type: ignore[arg-type]

    __hash__ = None  # type: ignore[assignment]


m = Member


def compare_strings(name: str, value: str) -> Comparison:
    return Comparison(name, value)


def conjuncts(predicate: Predicate) -> list[Predicate]:
    if isinstance(predicate, And):
        return [c for p in predicate.parts for c in conjuncts(p)]
    return [] if isinstance(predicate, Const) and predicate.value else [predicate]


def filter_string(predicate: Predicate, entity: Entity) -> str:
    """The filter string: in the top-level conjunction, equalities on the members of a
    key become one condition on that key - equality if all its parts are given, a prefix
    range if only leading ones are - and the rest follows as it is."""
    rest = conjuncts(predicate)
    out = []
    for name, parts in entity.keys():
        if not parts:
            continue
        given: dict[str, Compare] = {}
        for c in rest:
            if isinstance(c, Compare) and c.op == "eq" and c.value is not None and any(p.member == c.member for p in parts) and c.member not in given:
                given[c.member] = c
        lead = []
        for p in parts:
            if p.member not in given:
                break
            lead.append(p)
        prefix_of = next((c for c in rest if isinstance(c, StartsWith) and c.prefix and len(lead) < len(parts) and c.member == parts[len(lead)].member), None)
        if not lead and prefix_of is None:
            continue
        texts = [entity.part_text(name, p, given[p.member].value) for p in lead]
        used = [given[p.member] for p in lead]
        if prefix_of is not None:
            texts.append(entity.part_text(name, parts[len(lead)], prefix_of.prefix, prefix=True))
            used.append(prefix_of)
        joined = entity.separator.join(texts)
        if len(lead) == len(parts):
            out.append(f"{name} eq {literal(joined)}")
        else:
            out.append(f"{name} ge {literal(joined)} and {name} lt {literal(successor(joined))}")
        rest = [c for c in rest if not any(c is u for u in used)]
    tail = (rest[0] if len(rest) == 1 and not out else And(tuple(rest))).render(entity) if rest else ""
    return " and ".join([*out, *([tail] if tail else [])])


# --- filter strings to trees -------------------------------------------------

_TOKENS = re.compile(
    r"\s*(?:(?P<open>\()|(?P<close>\))|(?P<typed>(?:guid|datetime|X|binary)'(?:[^']|'')*')|(?P<string>'(?:[^']|'')*')"
    r"|(?P<number>-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?L?)|(?P<word>[A-Za-z_][A-Za-z0-9_.]*))"
)


def parse_filter(text: str) -> Predicate:
    """The tree of a filter string: or, and, not, comparisons (eq ne gt ge lt le) of a
    member and a literal in either order, bare boolean members, parentheses. Empty
    text filters nothing."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while text[at:].strip():
        found = _TOKENS.match(text, at)
        if not found:
            raise ValueError(f"filter can't be read from {text[at:]!r} on")
        tokens.append((found.lastgroup or "", found[found.lastgroup or 0]))
        at = found.end()
    if not tokens:
        return Const(True)
    tree, rest = _either(tokens)
    if rest:
        raise ValueError(f"filter has more than one expression: {rest[0][1]!r}")
    return tree


def _is(tokens: list[tuple[str, str]], word: str) -> bool:
    return bool(tokens) and tokens[0] == ("word", word)


def _either(tokens: list) -> tuple[Predicate, list]:
    left, tokens = _both(tokens)
    while _is(tokens, "or"):
        right, tokens = _both(tokens[1:])
        left = Or((left, right))
    return left, tokens


def _both(tokens: list) -> tuple[Predicate, list]:
    left, tokens = _single(tokens)
    while _is(tokens, "and"):
        right, tokens = _single(tokens[1:])
        left = And((left, right))
    return left, tokens


def _single(tokens: list) -> tuple[Predicate, list]:
    if _is(tokens, "not"):
        inner, tokens = _single(tokens[1:])
        return Not(inner), tokens
    if tokens and tokens[0][0] == "open":
        inner, tokens = _either(tokens[1:])
        if not tokens or tokens[0][0] != "close":
            raise ValueError("a parenthesis is not closed")
        return inner, tokens[1:]
    if not tokens:
        raise ValueError("the filter ends too early")
    left, tokens = tokens[0], tokens[1:]
    if tokens and tokens[0][0] == "word" and tokens[0][1] in SYMBOLS:
        op, right, tokens = tokens[0][1], tokens[1] if len(tokens) > 1 else None, tokens[2:]
        if right is None:
            raise ValueError("a comparison ends too early")
        if _is_member(left) and not _is_member(right):
            return Compare(left[1], op, _value(right)), tokens
        if _is_member(right) and not _is_member(left):
            turned = {"gt": "lt", "lt": "gt", "ge": "le", "le": "ge"}.get(op, op)
            return Compare(right[1], turned, _value(left)), tokens
        raise ValueError("a comparison takes one member and one literal")
    if left == ("word", "true") or left == ("word", "false"):
        return Const(left[1] == "true"), tokens
    if _is_member(left):
        return Flag(left[1]), tokens
    raise ValueError(f"{left[1]!r} is no condition")


def _is_member(token: tuple[str, str]) -> bool:
    return token[0] == "word" and token[1] not in ("true", "false", "null", "and", "or", "not", *SYMBOLS)


def _value(token: tuple[str, str]) -> object:
    kind, text = token
    if kind == "string":
        return text[1:-1].replace("''", "'")
    if kind == "number":
        return float(text) if re.search(r"[.eE]", text) else int(text.rstrip("L"))
    if kind == "typed":
        name, _, body = text.partition("'")
        body = body[:-1]
        if name == "guid":
            return str(uuid.UUID(body))
        if name == "datetime":
            found = dt.datetime.fromisoformat(body.replace("Z", "+00:00"))
            return found.astimezone(dt.UTC).replace(tzinfo=None) if found.tzinfo else found
        return bytes.fromhex(body)
    return {"true": True, "false": False, "null": None}[text]
