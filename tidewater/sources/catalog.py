"""Tables, links and views: declared types stored as Parquet segments, and external DataFrames.

A stored table is a list of segment folders.  An insert adds one, and many small
ones are merged by levels; an update or a delete writes the table anew beside the old one and swaps the list, so readers
of the old version aren't disturbed and a roll-back is the old list.  Every row
has a materialised identity ``__rid``.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from copy import deepcopy
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.documents import canonical
from tidewater.functions.semantics import SPARK
from tidewater.plans.nodes import Call, Cast, ColumnDef, LanguageError, Lit

RID = "__rid"
#: Segments of one level that are merged into one of the next.
MERGED = 16
_TYPES = {"int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "str": T.StringType(), "datetime": T.TimestampType(), "uuid": T.BinaryType(), "bytes": T.BinaryType(), "json": T.StringType()}


@dataclass
class Link:
    owner: str
    name: str
    target: str
    local: str
    key: str


@dataclass
class View:
    name: str
    text: str
    sql: bool
    reads: list[str]
    dirty: bool = False


@dataclass
class Table:
    """A declared type and where its rows are."""

    name: str
    columns: list[ColumnDef]
    segments: list[str] = field(default_factory=list)
    next_rid: int = 0
    next_auto: int = 1
    indexes: dict[str, bool] = field(default_factory=dict)  # column or path text: whether unique

    @property
    def kinds(self) -> dict[str, str]:
        return {c.name: c.kind for c in self.columns}

    rid = (RID,)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(RID, T.LongType()), *(T.StructField(c.name, _TYPES[c.kind]) for c in self.columns)])


@dataclass
class External:
    """A DataFrame under a name; ``rid`` are columns that identify a row, or none where it has no key."""

    name: str
    df: DataFrame
    kinds: dict[str, str]
    rid: tuple[str, ...]
    unique: frozenset = frozenset()
    keyed: bool = True

    def dataframe(self) -> DataFrame:
        return self.df


def kind_of(t: T.DataType) -> str | None:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return {"string": "str", "binary": "bytes"}.get(t.simpleString())


class Bound:
    """A stored table with a session to read it."""

    def __init__(self, catalog: Catalog, table: Table):
        self.catalog, self.table, self.kinds, self.rid, self.keyed = catalog, table, table.kinds, table.rid, True

    def dataframe(self) -> DataFrame:
        spark, t = self.catalog.spark, self.table
        if not t.segments:
            return spark.createDataFrame([], t.schema)
        return spark.read.schema(t.schema).parquet(*t.segments)


class Catalog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.tables: dict[str, Table] = {}
        self.external: dict[str, External] = {}
        self.links: dict[tuple[str, str], Link] = {}
        self.views: dict[str, View] = {}
        self.join_rows: int | None = None  # most rows of a join, where it is guarded
        self._load()

    # -- state on disk, and versions for transactions --

    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return jvm, where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[tuple[int, Any]]:
        """(number, file) of the saved versions, the newest first."""
        _, where, fs = self._file("")
        found = [f.getPath() for f in fs.listStatus(where)] if fs.exists(where) else []
        names = [(re.fullmatch(r"catalog-([0-9]+)[.]json", f.getName()), f) for f in found]
        return sorted(((int(m[1]), f) for m, f in names if m), key=lambda x: -x[0])

    def _load(self) -> None:
        versions = self._versions()
        self.version = versions[0][0] if versions else 0
        if not versions:
            return
        jvm, _, fs = self._file("")
        stream = fs.open(versions[0][1])
        state = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        for t in state["tables"]:
            columns = [ColumnDef(**{**c, "default": Lit(**c["default"]) if c["default"] else None}) for c in t.pop("columns")]
            self.tables[t["name"]] = Table(columns=columns, **t)
        self.links = {(x["owner"], x["name"]): Link(**x) for x in state["links"]}
        self.views = {x["name"]: View(**x) for x in state["views"]}

    def save(self) -> None:
        """Write the next version whole and rename it into place, so that there is always one to load; keep the one before."""
        state = {"tables": [asdict(t) for t in self.tables.values()], "links": [asdict(x) for x in self.links.values()], "views": [asdict(v) for v in self.views.values()]}
        _, new, fs = self._file(f"catalog-{uuid.uuid4().hex}.new")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self.version += 1
        _, where, _ = self._file(f"catalog-{self.version:09d}.json")
        if not fs.rename(new, where):
            raise LanguageError(f"the catalog in {self.path} was changed by another engine")
        _, old, _ = self._file(f"catalog-{self.version - 2:09d}.json")
        fs.delete(old, False)

    def snapshot(self):
        return deepcopy((self.tables, self.links, self.views))

    def restore(self, state) -> None:
        self.tables, self.links, self.views = state

    # -- look-ups --

    def register(self, name: str, df: DataFrame, key: tuple[str, ...] | list[str] = (), json_columns: tuple[str, ...] = ()) -> None:
        """Make a DataFrame a read-only table; ``key`` identifies its rows.  Columns of other types aren't seen.

        Without a key a hash of the row only breaks ties, and symmetric aggregates over joins are refused.
        """
        kinds = {}
        for f in df.schema.fields:
            kind = "json" if f.name in json_columns else kind_of(f.dataType)
            if kind:
                kinds[f.name] = kind
        cols = [F.col(f"`{c}`").cast(SPARK[k]).alias(c) if df.schema[c].dataType.simpleString() != SPARK[k] else F.col(f"`{c}`") for c, k in kinds.items()]
        df = df.select(*cols)
        if not (keyed := bool(key)):
            df, key = df.withColumn(RID, F.xxhash64(*(F.col(f"`{c}`") for c in kinds))), (RID,)
        self.external[name] = External(name, df, kinds, tuple(key), frozenset(key) if len(key) == 1 and keyed else frozenset(), keyed)

    def table(self, name: str):
        if name in self.external:
            return self.external[name]
        return Bound(self, self.stored(name))

    def stored(self, name: str) -> Table:
        if name in self.external:
            raise LanguageError(f"table '{name}' is external and read-only")
        if name not in self.tables:
            raise LanguageError(f"table '{name}' not found")
        return self.tables[name]

    def names(self) -> list[str]:
        return sorted([*self.tables, *self.external])

    def link(self, owner: str, name: str) -> Link:
        if (owner, name) not in self.links:
            raise LanguageError(f"link '{name}' not found on owner type '{owner}'")
        return self.links[owner, name]

    def is_unique(self, table: str, column: str) -> bool:
        if table in self.external:
            return column in self.external[table].unique
        t = self.stored(table)
        return any(c.name == column and c.unique for c in t.columns) or t.indexes.get(column, False)

    # -- writing --

    def new_segment(self, table: str, level: int | str = 0) -> str:
        return f"{self.path}/{table}/{level}-{uuid.uuid4().hex}"

    def append(self, t: Table, rows: list[dict[str, Any]]) -> list[tuple]:
        """Add complete rows, by column; returns them with their identities.  Segments of one level are merged when they're many."""
        out = []
        for row in rows:
            out.append((t.next_rid, *(row[c.name] for c in t.columns)))
            t.next_rid += 1
        new = self.spark.createDataFrame(out, t.schema)
        self.check_new(t, new)
        path = self.new_segment(t.name)
        new.coalesce(1).write.parquet(path)
        t.segments = [*t.segments, path]
        level = 0
        while len(tail := t.segments[-MERGED:]) == MERGED and all(f"/{level}-" in p[-40:] for p in tail):
            level += 1
            path = self.new_segment(t.name, level)
            self.spark.read.schema(t.schema).parquet(*tail).coalesce(1 + MERGED ** max(level - 4, 0)).write.parquet(path)
            t.segments = [*t.segments[:-MERGED], path]
        return out

    def load(self, t: Table, df: DataFrame) -> int:
        """Add the rows of a DataFrame as one segment; their identities are made once, when it is written."""
        given = {f.name: kind_of(f.dataType) for f in df.schema.fields}
        cols, at = [], F.monotonically_increasing_id()
        for c in t.columns:
            if c.name not in given:
                cols.append((at + t.next_auto).alias(c.name) if c.auto else F.lit(None if c.default is None else coerce(c.default, c.kind, c.name)).cast(SPARK[c.kind]).alias(c.name))
            elif given[c.name] == c.kind or c.kind == "json" and given[c.name] == "str" or (given[c.name], c.kind) == ("int", "float"):
                cols.append(F.col(f"`{c.name}`").cast(SPARK[c.kind]).alias(c.name))
            else:
                raise LanguageError(f"column '{c.name}' is {c.kind}, the rows have {given[c.name]}")
        path = self.new_segment(t.name, "all")
        df.select((at + t.next_rid).alias(RID), *cols).write.parquet(path)
        new = self.spark.read.schema(t.schema).parquet(path)
        said = new.agg(F.count(F.lit(1)), F.max(RID), *(F.count(F.when(F.col(f"`{c.name}`").isNull(), 1)) if c.required else F.max(F.col(f"`{c.name}`")) for c in t.columns if c.required or c.auto)).first()
        for c, n in zip((c for c in t.columns if c.required or c.auto), said[2:], strict=True):
            if c.required and n:
                raise LanguageError(f"column '{c.name}' is required")
            if c.auto and n is not None and not c.required:
                t.next_auto = max(t.next_auto, n + 1)
        t.segments = [*t.segments, path]
        t.next_rid = max(t.next_rid, (said[1] or 0) + 1)
        self.check_unique(t)
        return said[0]

    def replace(self, t: Table, df: DataFrame) -> None:
        path = self.new_segment(t.name, "all")
        df.select(*t.schema.names).write.parquet(path)
        t.segments = [path]

    @staticmethod
    def _unique_column(name: str):
        from tidewater.functions.semantics import dynamic

        if name.startswith("["):
            base, *steps = json.loads(name)
            return dynamic(F.col(f"`{base}`"), tuple(steps)).col
        return F.col(f"`{name}`")

    def _unique(self, t: Table) -> list[str]:
        return sorted({c.name for c in t.columns if c.unique} | {k for k, unique in t.indexes.items() if unique})

    def check_new(self, t: Table, new: DataFrame) -> None:
        """Refuse rows of a statement that repeat a value of a unique column, of each other or of the table."""
        for name in self._unique(t):
            keys = new.select(self._unique_column(name).alias("__k")).where("__k IS NOT NULL")
            held = Bound(self, t).dataframe().select(self._unique_column(name).alias("__k"))
            # the rows of one statement, bounded by its text
            if keys.groupBy("__k").count().where("count > 1").take(1) or t.segments and held.join(F.broadcast(keys), "__k", "left_semi").take(1):
                raise LanguageError(f"'{t.name}.{name}' is unique and has that value already")

    def check_unique(self, t: Table, columns: set[str] | None = None) -> None:
        df = Bound(self, t).dataframe()
        for name in self._unique(t):
            if columns is None or name in columns or name.startswith("["):
                col = self._unique_column(name)
                if df.where(col.isNotNull()).groupBy(col).count().where("count > 1").take(1):
                    raise LanguageError(f"'{t.name}.{name}' is unique and would have a value twice")

    def dirty(self, table: str) -> None:
        """Mark the views that read a table, and those that read them."""
        for v in self.views.values():
            if table in v.reads and not v.dirty:
                v.dirty = True
                self.dirty(v.name)


def coerce(e, kind: str, column: str) -> Any:
    """A literal as a column stores it."""
    import datetime

    if isinstance(e, Cast):
        if not isinstance(e.arg, Lit):
            raise LanguageError(f"column '{column}' takes a literal")
        e = Lit(e.arg.value, "str") if e.to in ("uuid", "bytes") else e.arg
    if isinstance(e, Call) or not isinstance(e, Lit):
        raise LanguageError(f"column '{column}' takes a literal")
    v, have = e.value, e.kind
    if have == "null":
        return None
    if kind == have:
        return v
    if kind == "float" and have == "int":
        return float(v)
    if kind == "int" and have == "float" and math.isfinite(v) and v == int(v):
        return int(v)
    if kind == "json" and have == "str":
        return canonical(v)
    if kind == "datetime" and have == "int":
        return datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(microseconds=v)
    if kind == "uuid" and have == "str":
        try:
            return bytearray(uuid.UUID(v).bytes)
        except ValueError:
            raise LanguageError(f"column '{column}' is uuid, got {v!r}") from None
    if kind == "bytes" and have == "str":
        if v.startswith("\\x") and len(v) % 2 == 0:
            return bytearray(bytes.fromhex(v[2:]))
        raise LanguageError(f"column '{column}' is bytes: expected \\x and an even number of hexadecimal digits")
    raise LanguageError(f"type mismatch for column '{column}': expected {kind}, got {have}")
