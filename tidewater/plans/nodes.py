"""Statements and expressions, shared by the pipeline language and the SQL subset."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class LanguageError(ValueError):
    """A statement that can't be read or doesn't fit the catalog."""


# -- expressions ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Lit:
    value: Any
    kind: str  # int, float, str, bool, null


@dataclass(frozen=True)
class Field:
    name: str
    alias: str | None = None
    hops: tuple[str, ...] = ()  # further names of a link path


@dataclass(frozen=True)
class Path:
    base: Any
    steps: tuple[str | int, ...]


@dataclass(frozen=True)
class Binary:
    op: str  # = != < > <= >= and or + - * / ?? like
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    arg: Any


@dataclass(frozen=True)
class IsNull:
    arg: Any
    negated: bool = False


@dataclass(frozen=True)
class InList:
    arg: Any
    items: tuple
    negated: bool = False


@dataclass(frozen=True)
class InQuery:
    arg: Any
    query: Query
    negated: bool = False


@dataclass(frozen=True)
class Exists:
    query: Query
    negated: bool = False


@dataclass(frozen=True)
class Case:
    branches: tuple[tuple[Any, Any], ...]
    otherwise: Any = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Cast:
    arg: Any
    to: str


@dataclass(frozen=True)
class Agg:
    name: str  # count, sum, avg, min, max
    arg: Any  # None: *
    distinct: bool = False
    raw: bool = False


@dataclass(frozen=True)
class Over:
    name: str
    arg: Any
    partition: tuple
    order: tuple[tuple[Any, bool], ...]


@dataclass(frozen=True)
class Nested:
    """A child query in a projection; ``link``: the alias and link that give its table and correlation."""

    query: Query
    link: tuple[str, str] | None = None


# -- statements ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left, right, cross
    table: str
    alias: str
    on: Any = None


@dataclass(frozen=True)
class Item:
    expr: Any
    name: str | None
    text: str


@dataclass
class Query:
    table: str
    alias: str | None = None
    joins: list[Join] = field(default_factory=list)
    distinct: bool = False
    filter: Any = None
    group: list[Item] | None = None
    having: Any = None
    order: list[tuple[Any, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    items: list[Item] | None = None
    sql: bool = False

    __hash__ = object.__hash__


@dataclass
class Scalar:
    """An aggregate of a whole query."""

    agg: str
    query: Query
    distinct: bool = False
    raw: bool = False


@dataclass
class Union:
    left: Any
    right: Any
    all: bool = False


@dataclass
class ColumnDef:
    name: str
    kind: str
    required: bool = False
    unique: bool = False
    auto: bool = False
    default: Any = None


@dataclass
class CreateType:
    name: str
    columns: list[ColumnDef]
    if_not_exists: bool = False


@dataclass
class Insert:
    table: str
    rows: list[dict[str, Any]]
    returning: bool = False


@dataclass
class Upsert:
    table: str
    key: str
    row: dict[str, Any]
    on_conflict: dict[str, Any] | None = None
    returning: bool = False


@dataclass
class Update:
    query: Query
    sets: dict[str, Any]
    returning: bool = False


@dataclass
class Delete:
    query: Query
    returning: bool = False


@dataclass
class Statement:
    """Any other statement: its verb and what it names."""

    verb: str
    args: dict[str, Any] = field(default_factory=dict)
