"""Statements of either dialect, run on Spark."""

from __future__ import annotations

import json
from contextlib import contextmanager
from dataclasses import dataclass, fields, is_dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import semantics as S
from tidewater.functions.documents import canonical_text
from tidewater.operators.compile import Compiler, Result, Scope, Source, quoted, walk
from tidewater.parser import parse
from tidewater.plans.nodes import (
    ColumnDef, CreateType, Delete, Exists, Field, Insert, InQuery, LanguageError, Lit, Nested, Path, Query, Scalar, Statement, Union, Update, Upsert,
)
from tidewater.sources.catalog import RID, Bound, Catalog, Link, Table, View, coerce
from tidewater.sqlparser import parse_sql


#: Session settings under which the language's rules hold.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.caseSensitive": "true", "spark.sql.ansi.enabled": "true"}


@dataclass
class Modified:
    """How many rows a statement changed."""

    count: int


@dataclass
class Message:
    """What a statement without rows did."""

    text: str


def tables_of(q) -> set[str]:
    """All tables that a query reads; for a link block, those of its parent's links are added by the catalog."""
    if isinstance(q, Union):
        return tables_of(q.left) | tables_of(q.right)
    if isinstance(q, Scalar):
        return tables_of(q.query)
    found = {q.table, *(j.table for j in q.joins)} - {""}
    exprs = [q.filter, q.having, *(e for e, _ in q.order), *(i.expr for i in q.items or []), *(i.expr for i in q.group or []), *(j.on for j in q.joins)]
    for e in exprs:
        if isinstance(e, Nested):
            found |= tables_of(e.query)
            continue
        for x in walk(e) if e is not None else []:
            if isinstance(x, (InQuery, Exists)):
                found |= tables_of(x.query)
    return found


class _Slot:
    """A literal that knows its place among a prepared statement's values, through signs too."""

    at = 0
    minus = False

    def __abs__(self):
        return self

    def __neg__(self):
        out = type(self)(-type(self).__mro__[2](self))
        out.at, out.minus = self.at, not self.minus
        return out


class _Int(_Slot, int):
    pass


class _Float(_Slot, float):
    pass


class _Str(_Slot, str):
    pass


def _filled(node, values: tuple):
    """A statement with its slots' values."""
    if isinstance(node, _Slot):
        return -values[node.at] if node.minus else values[node.at]
    if is_dataclass(node):
        return replace(node, **{f.name: _filled(getattr(node, f.name), values) for f in fields(node)})
    if isinstance(node, (list, tuple)):
        return type(node)(_filled(x, values) for x in node)
    if isinstance(node, dict):
        return {k: _filled(v, values) for k, v in node.items()}
    return node


class Prepared:
    """A statement with its literals as slots, in the order in which they're written; it is parsed once."""

    def __init__(self, engine: Engine, text: str, sql: bool):
        from tidewater.lexer import tokens

        self.engine, self.sql, self.kinds, slots, parts, at = engine, sql, [], [], [], 0
        for t in tokens(text, sql):
            if t.kind in ("int", "float", "str"):
                slot = {"int": _Int, "float": _Float, "str": _Str}[t.kind](t.value)
                slot.at = len(slots)
                slots.append(slot)
                self.kinds.append(type(t.value))
                parts += [text[at : t.start], f"${len(slots)}"]
                at = t.end
        self.text = "".join([*parts, text[at:]])
        self.statement = (parse_sql if sql else parse)(self.text, slots)

    def execute(self, *values: Any):
        if len(values) != len(self.kinds):
            raise LanguageError(f"{len(self.kinds)} literals are needed, {len(values)} were given")
        # a value of another type, or one that syntax may refuse, is read as it would be in the text
        if any(type(v) is not k or v == 0 or k is not str and not v > 0 for v, k in zip(values, self.kinds, strict=True)):
            return self.engine.execute(self.text, list(values), sql=self.sql)
        return self.engine.perform(lambda: _filled(self.statement, values), self.sql)


class Engine:
    """A catalog in a folder and the session that reads and writes it.

    path: a folder that the driver and all executors share; by default a new
    one below spark.checkpoint.dir.  join_rows: a guard against joins that blow
    up; a query whose join has more rows is refused, at the price of counting
    that far first.  By default joins have no bound.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, join_rows: int | None = None):
        if path is None:
            import tempfile
            import uuid

            root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
            if not root:
                if not spark.sparkContext.master.startswith("local"):
                    raise LanguageError("give the engine a folder that all executors share, or set spark.checkpoint.dir")
                root = "file://" + tempfile.mkdtemp(prefix="tidewater-")
            path = f"{root}/tidewater/store-{uuid.uuid4().hex}"
        self.spark, self.catalog = spark, Catalog(spark, path)
        self.catalog.join_rows = join_rows
        self.saved, self.aborted = None, False

    @contextmanager
    def settings(self):
        """The settings that the language's rules need while a plan is analysed; the session has its own before and after."""
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in SETTINGS}
        for k, v in SETTINGS.items():
            conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def register(self, name: str, df: DataFrame, key=(), json_columns=()) -> None:
        with self.settings():
            self.catalog.register(name, df, tuple(key), tuple(json_columns))

    def load(self, name: str, df: DataFrame) -> Modified:
        """Add all rows of a DataFrame to a declared type, by column name; columns that it lacks are missing or counted on."""
        with self.settings():
            t = self.writable(name)

            def change():
                return self.catalog.load(t, df)

            rows = self.guarded(t, change)
            self.changed(name)
            return Modified(rows)

    def prepare(self, text: str, sql: bool = False) -> Prepared:
        return Prepared(self, text, sql)

    def execute_sql(self, text: str, params: list[Any] | None = None):
        return self.execute(text, params, sql=True)

    def execute(self, text: str, params: list[Any] | None = None, sql: bool = False):
        """A DataFrame for a query, Modified for a change without returning, else a Message."""
        return self.perform(lambda: (parse_sql if sql else parse)(text, params), sql)

    def perform(self, made, sql: bool):
        """Run the statement that ``made`` gives; an error aborts an open transaction."""
        try:
            statement = made()
            if self.aborted and not (isinstance(statement, Statement) and statement.verb == "rollback"):
                raise LanguageError("the transaction is aborted; roll back first")
            with self.settings():
                return self.run(statement, sql)
        except Exception:
            self.aborted = self.saved is not None
            raise

    def dataframe(self, text: str, params: list[Any] | None = None, sql: bool = False) -> DataFrame:
        out = self.execute(text, params, sql)
        if not isinstance(out, DataFrame):
            raise LanguageError("the statement returns no rows")
        return out

    # -- dispatch --

    def run(self, s, sql: bool):
        if isinstance(s, (Query, Union, Scalar)):
            return self.compiled(s).df
        if isinstance(s, Insert):
            return self.insert(s)
        if isinstance(s, Upsert):
            return self.upsert(s)
        if isinstance(s, Update):
            return self.update(s)
        if isinstance(s, Delete):
            return self.delete(s)
        if isinstance(s, CreateType):
            return self.create(s)
        return getattr(self, "do_" + s.verb.replace(" ", "_"))(sql=sql, **s.args)

    def compiled(self, q) -> Result:
        for name in sorted(self.reads(q)):
            self.fresh(name)
        return Compiler(self.catalog).any(q)

    def reads(self, q) -> set[str]:
        found = tables_of(q)
        return found | {link.target for link in self.catalog.links.values() if link.owner in found}

    def fresh(self, name: str) -> None:
        view = self.catalog.views.get(name)
        if view and view.dirty:
            self.refresh(view)

    # -- rows --

    def changed(self, table: str) -> None:
        self.catalog.dirty(table)
        if self.saved is None:
            self.catalog.save()

    def writable(self, name: str) -> Table:
        if name in self.catalog.views:
            raise LanguageError(f"'{name}' is a materialized view")
        return self.catalog.stored(name)

    def complete(self, t: Table, given: dict[str, Any]) -> dict[str, Any]:
        if unknown := [c for c in given if c not in t.kinds]:
            raise LanguageError(f"column '{unknown[0]}' not found")
        row = {}
        for c in t.columns:
            if c.name in given:
                row[c.name] = coerce(given[c.name], c.kind, c.name)
            elif c.auto:
                row[c.name] = t.next_auto
            else:
                row[c.name] = coerce(c.default, c.kind, c.name) if c.default is not None else None
            if c.auto and row[c.name] is not None:
                t.next_auto = max(t.next_auto, row[c.name] + 1)
            if c.required and row[c.name] is None and not c.auto:
                raise LanguageError(f"column '{c.name}' is required")
        return row

    def guarded(self, t: Table, change):
        """Make a change and check the unique columns; on an error the table is as before."""
        before = (t.segments, t.next_rid, t.next_auto)
        try:
            return change()
        except Exception:
            t.segments, t.next_rid, t.next_auto = before
            raise

    def returned(self, t: Table, df: DataFrame) -> DataFrame:
        return df.orderBy(RID).select(*(quoted(c.name) for c in t.columns))

    def insert(self, s: Insert):
        t = self.writable(s.table)

        def change():
            return self.catalog.append(t, [self.complete(t, r) for r in s.rows])

        rows = self.guarded(t, change)
        self.changed(t.name)
        return self.returned(t, self.spark.createDataFrame(rows, t.schema)) if s.returning else Modified(len(rows))

    def scope(self, t: Table) -> Scope:
        return Scope([Source(t.name, None, "", t.kinds, [RID])])

    def assigned(self, t: Table, scope: Scope, compiler: Compiler, name: str, e):
        if name not in t.kinds:
            raise LanguageError(f"column '{name}' not found")
        kind = t.kinds[name]
        if isinstance(e, Lit):
            return F.lit(coerce(e, kind, name)).cast(S.SPARK[kind])
        v = compiler.value(e, scope)
        if v.kind == "dyn":
            v = S.Typed(v.lane(kind), kind)
        if v.kind == kind or v.kind == "null":
            return v.col.cast(S.SPARK[kind])
        if (v.kind, kind) == ("int", "float"):
            return v.col.cast("double")
        if (v.kind, kind) == ("float", "int"):
            exact = v.col.try_cast("bigint")
            return F.when(exact.cast("double") == v.col, exact).otherwise(F.raise_error(F.lit(f"column '{name}' is int")).cast("bigint"))
        if (v.kind, kind) == ("str", "json"):
            return canonical_text(v.col)
        if (v.kind, kind) == ("int", "datetime"):
            return F.timestamp_micros(v.col)
        raise LanguageError(f"type mismatch for column '{name}': expected {kind}, got {v.kind}")

    def matching(self, t: Table, q: Query) -> tuple[DataFrame, DataFrame]:
        """The table's rows, and the identities of those that a filter keeps."""
        for name in sorted(tables_of(q)):
            self.fresh(name)
        df = Bound(self.catalog, t).dataframe()
        hits = Compiler(self.catalog).filtered(df, Scope([Source(t.name, q.alias, "", t.kinds, [RID])]), q.filter).select(RID)
        return df, hits

    def update(self, s: Update):
        t = self.writable(s.query.table)
        df, hits = self.matching(t, s.query)
        if not t.segments:
            return self.returned(t, df) if s.returning else Modified(0)
        compiler, scope = Compiler(self.catalog), Scope([Source(t.name, s.query.alias, "", t.kinds, [RID])])
        new = {c: self.assigned(t, scope, compiler, c, e) for c, e in s.sets.items()}

        def change():
            # the identities are a table of their own, read for the change, the count and the rows returned
            path = self.catalog.new_segment(t.name, "hits")
            hits.write.parquet(path)
            keep = self.spark.read.schema(hits.schema).parquet(path)
            marked = df.join(keep.withColumn("__hit", F.lit(True)), RID, "left")
            cols = [F.when(F.col("__hit"), new[c.name]).otherwise(quoted(c.name)).alias(c.name) if c.name in new else quoted(c.name) for c in t.columns]
            self.catalog.replace(t, marked.select(RID, *cols))
            self.catalog.check_unique(t, set(s.sets))
            return keep.count(), keep

        count, keep = self.guarded(t, change)
        self.changed(t.name)
        return self.returned(t, Bound(self.catalog, t).dataframe().join(keep, RID, "left_semi")) if s.returning else Modified(count)

    def delete(self, s: Delete):
        t = self.writable(s.query.table)
        df, hits = self.matching(t, s.query)
        gone = df.join(hits, RID, "left_semi")
        count = gone.count()
        if t.segments and count:
            self.catalog.replace(t, df.join(hits, RID, "left_anti"))
        self.changed(t.name)
        return self.returned(t, gone) if s.returning else Modified(count)

    def upsert(self, s: Upsert):
        t = self.writable(s.table)
        if not self.catalog.is_unique(t.name, s.key):
            raise LanguageError(f"upsert needs a unique column; add one with `alter {t.name} add unique .{s.key}`")
        if s.key not in s.row:
            raise LanguageError(f"upsert needs a value for its key '{s.key}'")
        key = S.literal(coerce(s.row[s.key], t.kinds[s.key], s.key), t.kinds[s.key])
        found = Bound(self.catalog, t).dataframe().where(quoted(s.key) == key.col).take(1)
        if not found:
            return self.insert(Insert(s.table, [s.row], s.returning))
        sets = s.on_conflict if s.on_conflict is not None else {c: e for c, e in s.row.items() if c != s.key}
        from tidewater.plans.nodes import Binary

        return self.update(Update(Query(s.table, filter=Binary("=", Field(s.key), s.row[s.key])), sets, s.returning))

    # -- definitions --

    def outside(self, verb: str) -> None:
        if self.saved is not None:
            raise LanguageError(f"{verb}: definitions can't be rolled back, so end the transaction first")

    def create(self, s: CreateType):
        self.outside("create table")
        if s.name in self.catalog.names():
            if s.if_not_exists:
                return Message(f"type '{s.name}' already exists (skipped)")
            raise LanguageError(f"type '{s.name}' already exists")
        names = [c.name for c in s.columns]
        if len(set(names)) < len(names) or any(n.startswith("__") for n in names):
            raise LanguageError("column names must differ and not begin with two underscores")
        for c in s.columns:
            if c.default is not None:
                coerce(c.default, c.kind, c.name)
        self.catalog.tables[s.name] = Table(s.name, s.columns)
        self.catalog.save()
        return Message(f"type '{s.name}' created")

    def do_add_column(self, table: str, column: ColumnDef, sql: bool):
        self.outside("alter table add column")
        t = self.writable(table)
        if column.name in t.kinds:
            raise LanguageError(f"column '{column.name}' already exists")
        if column.required and t.segments and Bound(self.catalog, t).dataframe().take(1):
            raise LanguageError(f"'{table}' has rows, which would lack the required column '{column.name}'")
        t.columns = [*t.columns, column]
        self.changed(table)
        return Message(f"column '{column.name}' added to '{table}'")

    def do_drop_column(self, table: str, name: str, quiet: bool, sql: bool):
        self.outside("alter table drop column")
        t = self.writable(table)
        if name not in t.kinds:
            if quiet:
                return Message(f"column '{name}' does not exist (skipped)")
            raise LanguageError(f"column '{name}' not found")
        df = Bound(self.catalog, t).dataframe()
        t.columns = [c for c in t.columns if c.name != name]
        if t.segments:  # written anew, so that a later column of that name starts empty
            self.catalog.replace(t, df)
        t.indexes.pop(name, None)
        self.changed(table)
        return Message(f"column '{name}' dropped from '{table}'")

    @staticmethod
    def target_name(target) -> str:
        return json.dumps([target.base.name, *target.steps]) if isinstance(target, Path) else target.name

    def do_add_index(self, table: str, target, unique: bool, quiet: bool, sql: bool):
        self.outside("create index")
        t, name = self.writable(table), self.target_name(target)
        column = target.base.name if isinstance(target, Path) else name
        if column not in t.kinds or isinstance(target, Path) and t.kinds[column] != "json":
            raise LanguageError(f"column '{column}' not found or no document")
        if name in t.indexes or any(c.name == name and c.unique for c in t.columns):
            if unique and not quiet:
                raise LanguageError(f"'{table}.{name}' already has an index")
            return Message(f"index on '{table}.{name}' exists")
        t.indexes[name] = unique
        if unique:
            try:
                self.catalog.check_unique(t, {name})
            except LanguageError:
                del t.indexes[name]
                raise
        self.catalog.save()
        return Message(f"index on '{table}.{name}' created")

    def do_drop_index(self, table: str, target, quiet: bool, sql: bool):
        self.outside("drop index")
        if not isinstance(target, Path):
            raise LanguageError("only an index on a path can be dropped")
        t, name = self.writable(table), self.target_name(target)
        if name not in t.indexes and not quiet:
            raise LanguageError(f"index {name} not found")
        t.indexes.pop(name, None)
        self.catalog.save()
        return Message("index dropped")

    def do_drop_type(self, name: str, quiet: bool, sql: bool):
        self.outside("drop table")
        if name in self.catalog.views:
            raise LanguageError(f"'{name}' is a materialized view; use 'drop view {name}'")
        if name not in self.catalog.tables:
            if quiet:
                return Message(f"type '{name}' does not exist (skipped)")
            raise LanguageError(f"table '{name}' not found")
        del self.catalog.tables[name]
        self.catalog.links = {k: v for k, v in self.catalog.links.items() if name not in (v.owner, v.target)}
        self.catalog.save()
        return Message(f"type '{name}' dropped")

    def do_link(self, owner: str, name: str, target: str, local: str, key: str, sql: bool):
        self.outside("create link")
        kinds = self.catalog.table(owner).kinds
        if local not in kinds or key not in self.catalog.table(target).kinds:
            raise LanguageError(f"link '{name}': a key column is not found")
        if name in kinds or (owner, name) in self.catalog.links:
            raise LanguageError(f"'{name}' is already a column or link of '{owner}'")
        self.catalog.links[owner, name] = Link(owner, name, target, local, key)
        self.catalog.save()
        return Message(f"link '{name}' created on '{owner}'")

    def do_drop_link(self, owner: str, name: str, quiet: bool, sql: bool):
        self.outside("drop link")
        if (owner, name) not in self.catalog.links:
            if quiet:
                return Message(f"link '{name}' on '{owner}' does not exist (skipped)")
            raise LanguageError(f"link '{name}' not found on owner type '{owner}'")
        del self.catalog.links[owner, name]
        self.catalog.save()
        return Message(f"link '{name}' dropped from '{owner}'")

    # -- views --

    def do_materialize(self, name: str, query, text: str, sql: bool):
        self.outside("create table")
        if name in self.catalog.names():
            raise LanguageError(f"type '{name}' already exists")
        r = self.compiled(query)
        self.catalog.tables[name] = Table(name, [ColumnDef(n, k) for n, k in zip(r.names, r.kinds, strict=True)])
        self.catalog.views[name] = View(name, text, sql, sorted(self.reads(query)), True)
        self.refresh(self.catalog.views[name])
        return Message(f"view '{name}' created")

    def refresh(self, view: View) -> None:
        query = (parse_sql if view.sql else parse)(view.text)
        r, t = self.compiled(query), self.catalog.tables[view.name]
        if [c.kind for c in t.columns] != r.kinds:
            raise LanguageError(f"view '{view.name}': its rows no longer fit its columns")
        self.catalog.replace(t, r.df.withColumn(RID, F.monotonically_increasing_id()))
        view.dirty = False
        if self.saved is None:
            self.catalog.save()

    def do_refresh(self, name: str, sql: bool):
        if name not in self.catalog.views:
            raise LanguageError(f"view '{name}' not found")
        self.refresh(self.catalog.views[name])
        self.catalog.dirty(name)
        return Message(f"view '{name}' refreshed")

    def do_drop_view(self, name: str, quiet: bool, sql: bool):
        self.outside("drop table")
        if name not in self.catalog.views:
            if quiet:
                return Message(f"view '{name}' does not exist (skipped)")
            raise LanguageError(f"view '{name}' not found")
        del self.catalog.views[name], self.catalog.tables[name]
        self.catalog.save()
        return Message(f"view '{name}' dropped")

    # -- transactions --

    def do_begin(self, sql: bool):
        if self.saved is not None:
            raise LanguageError("a transaction is already open")
        self.saved = self.catalog.snapshot()
        return Message("transaction begun")

    def do_commit(self, sql: bool):
        if self.saved is None:
            raise LanguageError("no transaction is open")
        self.saved = None
        self.catalog.save()
        return Message("transaction committed")

    def do_rollback(self, sql: bool):
        if self.saved is None:
            raise LanguageError("no transaction is open")
        self.catalog.restore(self.saved)
        self.saved, self.aborted = None, False
        return Message("transaction rolled back")

    # -- introspection --

    def do_schema(self, sql: bool):
        rows = [(n, len(self.catalog.table(n).kinds)) for n in self.catalog.names()]
        return self.spark.createDataFrame(rows, "name string, columns bigint")

    def cardinality(self, link: Link) -> str:
        return "to-one" if self.catalog.is_unique(link.target, link.key) else "to-many"

    def do_schema_links(self, sql: bool):
        rows = [(x.owner, x.name, x.target, x.local, x.key, self.cardinality(x)) for _, x in sorted(self.catalog.links.items())]
        return self.spark.createDataFrame(rows, "owner string, name string, target string, local_key string, target_key string, cardinality string")

    def do_describe(self, name: str, sql: bool):
        t = self.catalog.table(name)
        required = {c.name for c in self.catalog.tables[name].columns if c.required} if name in self.catalog.tables else set()
        plain = self.catalog.tables[name].indexes if name in self.catalog.tables else {}
        rows = [(c, k, c not in required, "unique" if self.catalog.is_unique(name, c) else "index" if c in plain else "") for c, k in t.kinds.items()]
        links = sorted(self.catalog.links.items())
        shown = lambda x, arrow, end: f"{arrow} {end} ({self.cardinality(x)}, {x.local} -> {x.key})"
        rows += [(x.name, "link", None, shown(x, "->", x.target)) for _, x in links if x.owner == name]
        rows += [(f"{x.owner}.{x.name}", "link", None, shown(x, "<-", x.owner)) for _, x in links if x.target == name and x.owner != name]
        return self.spark.createDataFrame(rows, "column string, type string, nullable boolean, index string")

    def do_explain(self, inner, sql: bool):
        if not isinstance(inner, (Query, Union, Scalar)):
            lines = [f"{type(inner).__name__} {getattr(inner, 'table', '') or getattr(getattr(inner, 'query', None), 'table', '')}".strip()]
        else:
            lines = self.compiled(inner).df._jdf.queryExecution().executedPlan().toString().split("\n")
        return self.spark.createDataFrame([(x,) for x in lines if x], "plan string")
