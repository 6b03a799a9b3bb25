"""Queries to DataFrames: names, kinds and the language's rules become one declarative plan for Catalyst."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, is_dataclass, replace
from functools import reduce
from itertools import count
from operator import mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import semantics as S
from tidewater.functions.semantics import Dynamic, Typed
from tidewater.plans.nodes import (
    Agg, Binary, Call, Case, Cast, Exists, Field, InList, InQuery, IsNull, Item, Join, LanguageError, Lit, Nested, Not, Over, Path, Query, Scalar, Union,
)

COMPARISONS = ("=", "!=", "<", ">", "<=", ">=")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Source:
    """A table in scope; its columns stand under ``prefix + name`` in the DataFrame."""

    table: str
    alias: str | None
    prefix: str
    kinds: dict[str, str]
    rid: list[str]
    keyed: bool = True  # whether rid tells repeated rows apart
    outer: bool = False  # whether it is of the query around a subquery expression

    def column(self, name: str) -> Typed:
        col = quoted(self.prefix + name)
        return Typed(col.outer() if self.outer else col, self.kinds[name], None, frozenset([self.alias or self.table]))

    def rid_columns(self) -> list[Column]:
        return [quoted(self.prefix + c) for c in self.rid]


@dataclass
class Scope:
    sources: list[Source]
    outer: Scope | None = None
    extra: dict = field(default_factory=dict)  # expressions that are columns already
    joined: bool = False
    once: frozenset = frozenset()  # aliases whose rows a join can't repeat

    def find(self, f: Field) -> Typed:
        if f in self.extra:
            return self.extra[f]
        if f.alias is not None:
            scope: Scope | None = self
            while scope:
                for s in scope.sources:
                    if (s.alias or s.table) == f.alias:
                        if f.name not in s.kinds:
                            raise LanguageError(f"column '{f.alias}.{f.name}' not found")
                        return s.column(f.name)
                scope = scope.outer
            raise LanguageError(f"unknown alias '{f.alias}'")
        own = [s for s in self.sources if f.name in s.kinds]
        if len(own) > 1:
            raise LanguageError(f"column '{f.name}' is ambiguous: " + ", ".join(f"{s.alias}.{f.name}" for s in own))
        above = self.outer and any(f.name in s.kinds for s in self.outer.sources)
        if own and above and own[0].alias is not None:
            raise LanguageError(f"column '{f.name}' is in the inner and the outer query; qualify it with an alias")
        if own:
            return own[0].column(f.name)
        if above:
            return self.outer.find(f)
        raise LanguageError(f"column '{f.name}' not found")

    def is_outer(self, f: Field) -> bool:
        if f.alias is not None:
            return all((s.alias or s.table) != f.alias for s in self.sources)
        return all(f.name not in s.kinds for s in self.sources)


@dataclass
class Packed:
    """A query's filtered rows; a row stands for ``weights[alias]`` rows of each source."""

    df: DataFrame
    scope: Scope
    weights: dict[str, Column]


@dataclass
class Result:
    df: DataFrame
    names: list[str]
    kinds: list[str]


def children(e) -> list:
    """Direct subexpressions, not those of subqueries."""
    match e:
        case Binary():
            return [e.left, e.right]
        case Not() | IsNull() | Cast():
            return [e.arg]
        case InList():
            return [e.arg, *e.items]
        case InQuery():
            return [e.arg]
        case Case():
            return [x for b in e.branches for x in b] + ([e.otherwise] if e.otherwise is not None else [])
        case Call():
            return list(e.args)
        case Path():
            return [e.base]
        case Agg():
            return [e.arg] if e.arg is not None else []
        case Over():
            return [*([e.arg] if e.arg is not None else []), *e.partition, *(x for x, _ in e.order)]
    return []


def walk(e):
    yield e
    for c in children(e):
        yield from walk(c)


def has_subquery(e) -> bool:
    return any(isinstance(x, (InQuery, Exists)) for x in walk(e))


def all_fields(e, known: dict):
    """Fields anywhere in expressions, those of subqueries too, but not of expressions that are known."""
    if isinstance(e, (list, tuple)):
        for x in e:
            yield from all_fields(x, known)
    elif is_dataclass(e) and e not in known:
        if isinstance(e, Field):
            yield e
        for f in fields(e):
            yield from all_fields(getattr(e, f.name), known)


def conjuncts(e) -> list:
    if e is None:
        return []
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, Binary) and e.op == "and" else [e]


def identity(t: Typed) -> list[Column]:
    """What tells values apart in groups, distinct rows and joins: negative zero is a float of its own, which Spark's keys aren't."""
    return [t.col, S.minus_zero(t.col)] if t.kind == "float" else [t.col]


def distinct_rows(df: DataFrame, names: list[str], kinds: list[str]) -> DataFrame:
    floats = [n for n, k in zip(names, kinds, strict=True) if k == "float"]
    if not floats:
        return df.distinct()
    once = df.withColumns({f"__zero{i}": S.minus_zero(quoted(n)) for i, n in enumerate(floats)}).distinct()
    return once.select(*(S.with_zero(quoted(n), F.col(f"__zero{floats.index(n)}")).alias(n) if n in floats else quoted(n) for n in names))


def both(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


class Compiler:
    def __init__(self, catalog):
        self.catalog = catalog
        self.numbers = count()

    # -- expressions -------------------------------------------------------------------------------------

    def value(self, e, scope: Scope) -> Typed:
        """An expression as a column; conditions in it are two-valued."""
        if e in scope.extra:
            return scope.extra[e]
        match e:
            case Lit():
                return S.literal(e.value, e.kind)
            case Field():
                if e.hops:
                    raise LanguageError(f"'{e.alias}.{e.name}.{'.'.join(e.hops)}' follows a link, which only a projected field may do; join the linked type here")
                return scope.find(e)
            case Path():
                base = self.value(e.base, scope)
                if base.kind != "json":
                    raise LanguageError(f"'->' takes a document, not {base.kind}")
                return replace(S.dynamic(base.col, e.steps), source=base.source)
            case Binary(op="??"):
                a, b = self.value(e.left, scope), self.value(e.right, scope)
                kind = b.kind if a.kind in ("null", "dyn") else a.kind
                if a.kind == "int" and b.kind == "float":
                    kind = "float"
                cols = [x.lane(kind) if isinstance(x, Dynamic) else x.col.cast(S.SPARK[kind]) for x in (a, b)]
                return Typed(F.coalesce(*cols), kind, None, a.source | b.source)
            case Binary(op="+" | "-" | "*" | "/"):
                a, b = self.value(e.left, scope), self.value(e.right, scope)
                return replace(S.arithmetic(e.op, a, b), source=a.source | b.source)
            case Binary() | Not() | IsNull() | InList():
                return Typed(self.condition(e, scope, False), "bool", None, self.sources_of(e, scope))
            case Case():
                picked = [(self.condition(w, scope, False), self.value(t, scope)) for w, t in e.branches]
                last = self.value(e.otherwise, scope) if e.otherwise is not None else S.literal(None, "null")
                kinds = {t.kind for t in [*(t for _, t in picked), last]} - {"null"}
                kind = "float" if kinds == {"int", "float"} else next(iter(kinds)) if len(kinds) == 1 else "str"
                if len(kinds) > 1 and kinds != {"int", "float"}:
                    raise LanguageError(f"the branches of a case have different types: {', '.join(sorted(kinds))}")
                as_kind = lambda t: t.col if kind == "dyn" else t.col.cast(S.SPARK[kind])
                out = reduce(lambda acc, b: acc.when(b[0], as_kind(b[1])), picked, F)
                return Typed(out.otherwise(as_kind(last)), "str" if kind == "dyn" else kind, None, self.sources_of(e, scope))
            case Cast():
                a = self.value(e.arg, scope)
                return replace(S.cast(a, e.to), source=a.source)
            case Call():
                args = [self.value(a, scope) for a in e.args]
                return replace(S.call(e.name, args), source=frozenset().union(*(a.source for a in args)))
            case Agg():
                raise LanguageError("an aggregate can't stand here")
            case Over():
                raise LanguageError("a window function stands alone as a projected field, and not in a grouped query")
            case InQuery() | Exists():
                raise LanguageError("subqueries belong in a filter")
        raise LanguageError(f"unsupported expression {type(e).__name__}")

    def sources_of(self, e, scope: Scope) -> frozenset:
        found = [scope.find(x).source for x in walk(e) if isinstance(x, Field) and not x.hops]
        return frozenset().union(*found)

    def condition(self, e, scope: Scope, positive: bool, join: bool = False) -> Column:
        """A predicate.  ``positive``: null does as well as false here.  ``join``: missing equals missing."""
        sure = (lambda c: c) if positive else (lambda c: F.coalesce(c, F.lit(False)))
        if e in scope.extra:
            return sure(scope.extra[e].col)
        match e:
            case Binary(op="and"):
                return self.condition(e.left, scope, positive, join) & self.condition(e.right, scope, positive, join)
            case Binary(op="or"):
                out = self.condition(e.left, scope, positive, join) | self.condition(e.right, scope, positive, join)
                # a bare missing bool makes the whole of an or false
                bare = [self.value(x, scope).col.isNotNull() for x in (e.left, e.right) if isinstance(x, (Field, Path, Cast))]
                return both([*bare, out])
            case Not():
                return ~self.condition(e.arg, scope, False, join)
            case Binary() if e.op in COMPARISONS:
                a, b = self.value(e.left, scope), self.value(e.right, scope)
                return S.join_compare(e.op, a, b) if join else sure(S.compare(e.op, a, b))
            case Binary(op="like"):
                return sure(S.like(self.value(e.left, scope), self.value(e.right, scope)))
            case IsNull():
                a = self.value(e.arg, scope)
                return a.col.isNotNull() if e.negated else a.col.isNull()
            case InList():
                a = self.value(e.arg, scope)
                items = [self.value(i, scope) for i in e.items if not (isinstance(i, Lit) and i.kind == "null")]
                if items and all(i.literal is not None and i.kind == a.kind and a.kind in ("int", "str", "bool") for i in items):
                    out = a.col.isin([i.literal for i in items])
                else:
                    out = reduce(lambda x, y: x | y, [F.coalesce(S.compare("=", a, i), F.lit(False)) for i in items], F.lit(False))
                if e.negated:
                    out = a.col.isNotNull() & ~F.coalesce(out, F.lit(False))
                return sure(out)
            case Lit(kind="bool"):
                return F.lit(e.value)
            case Lit(kind="null"):
                return F.lit(False)
        t = self.value(e, scope)
        if isinstance(t, Dynamic):
            t = Typed(t.lane("bool"), "bool")
        if t.kind != "bool":
            raise LanguageError(f"a condition must be bool, not {t.kind}")
        return sure(t.col)

    def sort_keys(self, order, scope: Scope) -> list[Column]:
        out = []
        for e, desc in order:
            t = self.value(e, scope)
            if isinstance(t, Dynamic):
                rank = F.when(t.col.isNull(), F.lit(None)).when(t.numeric, 0).when(t.boolean, 1).when(t.is_text, 2).otherwise(3)
                cols = [rank, t.lane("float"), t.col]
            else:
                cols = [t.col]
            out += [c.desc_nulls_last() if desc else c.asc_nulls_last() for c in cols]
        return out

    # -- scans, joins, filters ---------------------------------------------------------------------------

    def scan(self, table: str, alias: str | None, prefix: str) -> tuple[DataFrame, Source]:
        t = self.catalog.table(table)
        df = t.dataframe()
        return df.select(*(quoted(c).alias(prefix + c) for c in df.columns)), Source(table, alias, prefix, dict(t.kinds), list(t.rid), t.keyed)

    def sources(self, q: Query, outer: Scope | None, prefix: str) -> tuple[DataFrame, Scope]:
        if not q.joins:
            df, s = self.scan(q.table, q.alias, prefix)
            return df, Scope([s], outer)
        aliases = [q.alias or q.table, *(j.alias for j in q.joins)]
        if len(set(aliases)) < len(aliases):
            raise LanguageError("an alias is used twice")
        df, s = self.scan(q.table, q.alias or q.table, f"{prefix}{aliases[0]}.")
        scope = Scope([s], outer, joined=True)
        for j in q.joins:
            right, r = self.scan(j.table, j.alias, f"{prefix}{j.alias}.")
            df = self.join(df, scope, right, r, j)
            # a right join is a left join of swapped inputs, so its columns come first
            scope.sources = [r, *scope.sources] if j.kind == "right" else [*scope.sources, r]
        scope.once = self.unrepeated(scope.sources, q.joins)
        most = self.catalog.join_rows
        if most is not None and df.limit(most + 1).count() > most:
            raise LanguageError(f"the join has more than {most} rows, which this engine refuses")
        return df, scope

    def unrepeated(self, sources: list[Source], joins: list[Join]) -> frozenset:
        """Aliases from which all other sources are reached over equalities with their declared keys: a row of one meets one row of each at most."""

        def place(f) -> tuple[str, str, str] | None:
            own = [s for s in sources if isinstance(f, Field) and not f.hops and f.name in s.kinds and f.alias in (None, s.alias or s.table)]
            return (own[0].alias or own[0].table, f.name, own[0].kinds[f.name]) if len(own) == 1 else None

        keys = {s.alias or s.table: getattr(self.catalog.table(s.table), "unique", frozenset()) for s in sources}
        steps = []
        for c in (c for j in joins for c in conjuncts(j.on)):
            a, b = (place(c.left), place(c.right)) if isinstance(c, Binary) and c.op == "=" else (None, None)
            if a and b and a[2] == b[2]:
                steps += [(x[0], y[0]) for x, y in ((a, b), (b, a)) if y[1] in keys[y[0]]]
        out = []
        for start in keys:
            reached, before = {start}, 0
            while len(reached) > before:
                before = len(reached)
                reached |= {y for x, y in steps if x in reached}
            if len(reached) == len(sources):
                out.append(start)
        return frozenset(out)

    def join(self, left: DataFrame, scope: Scope, right: DataFrame, source: Source, j: Join) -> DataFrame:
        if j.kind == "cross":
            return left.crossJoin(right)
        on = self.condition(j.on, Scope([*scope.sources, source], scope.outer, scope.extra, True), True, join=True)
        return right.join(left, on, "left") if j.kind == "right" else left.join(right, on, j.kind)

    def filtered(self, df: DataFrame, scope: Scope, e) -> DataFrame:
        subqueries = []
        for c in conjuncts(e):
            if has_subquery(c):
                subqueries.append(c)
            else:
                df = df.where(self.condition(c, scope, True))
        for c in subqueries:
            df = self.subquery_conjunct(df, scope, c)
        return df

    def subquery_conjunct(self, df: DataFrame, scope: Scope, c) -> DataFrame:
        inner, negated = (c.arg, True) if isinstance(c, Not) else (c, False)
        # not (x not in Q) holds for a missing x, which no join with Q finds
        twice = negated and isinstance(inner, InQuery) and inner.negated
        if isinstance(inner, (InQuery, Exists)) and not twice:
            if isinstance(inner, InQuery) and inner.negated:
                df = df.where(self.value(inner.arg, scope).col.isNotNull())
            right, on, correlated = self.inner_side(inner, scope)
            if isinstance(inner, Exists) and not correlated:
                flag = right.limit(1).agg((F.count(F.lit(1)) > 0).alias("__any"))
                keep = F.col("__any") if inner.negated == negated else ~F.col("__any")
                return df.crossJoin(F.broadcast(flag)).where(keep).drop("__any")
            return df.join(right, on, "left_semi" if inner.negated == negated else "left_anti")
        # elsewhere a subquery is an expression, which becomes an existence join; the rows around it get names that it can't have
        mark = f"__o{next(self.numbers)}."
        named = df.select(*(quoted(x).alias(mark + x) for x in df.columns))
        here = Scope([replace(s, prefix=mark + s.prefix) for s in scope.sources], scope.outer, {}, scope.joined)
        around = Scope([replace(s, outer=True) for s in here.sources], scope.outer, {}, scope.joined)
        for x in walk(c):
            if isinstance(x, (InQuery, Exists)):
                right, on, _ = self.inner_side(x, around)
                col = right.where(on).exists()
                if x.negated:
                    col = ~col
                    if isinstance(x, InQuery):
                        col = self.value(x.arg, here).col.isNotNull() & col
                here.extra[x] = Typed(col, "bool")
        return named.where(self.condition(c, here, True)).select(*(quoted(mark + x).alias(x) for x in df.columns))

    def inner_side(self, x: InQuery | Exists, outer: Scope) -> tuple[DataFrame, Column, bool]:
        """The inner query's rows with what the join needs, the join's condition, and whether it is correlated."""
        q = x.query
        prefix = f"__q{next(self.numbers)}."
        df, scope = self.sources(q, outer, prefix)
        own, linked = [], []
        for c in conjuncts(q.filter):
            fields = [f for f in walk(c) if isinstance(f, Field)]
            (linked if any(scope.is_outer(f) for f in fields) else own).append(c)
        item = None
        if isinstance(x, InQuery):
            if not q.items or len(q.items) != 1:
                raise LanguageError("a subquery of in projects one column")
            item = q.items[0].expr
        if not linked:
            if q.group or q.distinct or q.limit is not None or q.offset is not None:
                r = self.query(q, prefix=prefix)
                right = r.df.select(quoted(r.names[0]).alias(prefix + "v")) if item is not None else r.df
                value = Typed(quoted(prefix + "v"), r.kinds[0])
            else:
                right = self.filtered(df, scope, reduce(lambda a, b: Binary("and", a, b), own) if own else None)
                value = self.value(item, Scope(scope.sources)) if item is not None else None
                if item is not None:
                    right = right.select(value.col.alias(prefix + "v"))
                    value = replace(value, col=quoted(prefix + "v"))
            if item is None:
                return right, F.lit(True), False
            return right.where(quoted(prefix + "v").isNotNull()), S.compare("=", self.value(x.arg, outer), value), False
        if q.group or q.distinct and (q.limit is not None or q.offset):
            raise LanguageError("a subquery that reads the query around it takes no group, and no limit of distinct rows")
        right = self.filtered(df, scope, reduce(lambda a, b: Binary("and", a, b), own) if own else None)
        if q.limit is not None or q.offset is not None:
            keys = []
            for c in linked:
                sides = [c.left, c.right] if isinstance(c, Binary) and c.op == "=" else []
                mine = [s for s in sides if all(not scope.is_outer(f) for f in walk(s) if isinstance(f, Field))]
                if len(mine) != 1:
                    raise LanguageError("limit in a correlated subquery needs equalities with the outer query")
                keys.append(self.value(mine[0], scope).col)
            w = Window.partitionBy(*keys).orderBy(*self.sort_keys(q.order, scope), *scope.sources[0].rid_columns())
            low = q.offset or 0
            right = right.withColumn("__rn", F.row_number().over(w)).where(f"__rn > {low}" + (f" and __rn <= {low + q.limit}" if q.limit is not None else "")).drop("__rn")
        on = [self.condition(c, scope, True) for c in linked]
        used = {f for c in linked for f in walk(c) if isinstance(f, Field) and not scope.is_outer(f)}
        keep = {s.prefix + f.name for f in used for s in scope.sources if (s.alias or s.table) == f.alias or f.alias is None and f.name in s.kinds}
        if item is not None:
            value = self.value(item, Scope(scope.sources))
            right = right.select(*(quoted(k) for k in sorted(keep)), value.col.alias(prefix + "v")).where(quoted(prefix + "v").isNotNull())
            on.append(S.compare("=", self.value(x.arg, outer), replace(value, col=quoted(prefix + "v"))))
        else:
            right = right.select(*(quoted(k) for k in sorted(keep)))
        return right, both(on), True

    # -- queries -----------------------------------------------------------------------------------------

    def any(self, q) -> Result:
        match q:
            case Union():
                return self.union(q)
            case Scalar():
                return self.scalar(q)
        return self.query(q)

    def union(self, q: Union) -> Result:
        a, b = self.any(q.left), self.any(q.right)
        if len(a.names) != len(b.names):
            raise LanguageError(f"the sides of a union have {len(a.names)} and {len(b.names)} columns")
        if any(x != y for x, y in zip(a.kinds, b.kinds, strict=True)):
            raise LanguageError("the sides of a union have different types")
        df = a.df.union(b.df)
        return Result(df if q.all else distinct_rows(df, a.names, a.kinds), a.names, a.kinds)

    def expand(self, q: Query, scope: Scope) -> list[Item]:
        if q.items is not None:
            return q.items
        return [Item(Field(c, s.alias if scope.joined else None), f"{s.alias}.{c}" if scope.joined else c, c) for s in scope.sources for c in s.kinds]

    def heading(self, i: Item, scope: Scope, q: Query) -> str:
        if i.name is not None:
            return i.name
        e = i.expr
        if isinstance(e, Field) and not e.hops:
            return f"{e.alias}.{e.name}" if e.alias and scope.joined else e.name
        if isinstance(e, (Over, Case, InQuery, Exists)):
            return "?"
        if isinstance(e, Cast):
            return f"{e.to}({re.sub(r'^cast[(](.*),[^,]*[)]$', r'\1', i.text)})"
        return i.text

    def output(self, df: DataFrame, columns: list[tuple[str, Typed]]) -> Result:
        names: list[str] = []
        for name, _ in columns:
            fresh, n = name, 1
            while fresh in names:
                fresh, n = f"{name}_{n}", n + 1
            names.append(fresh)
        kinds = ["str" if t.kind in ("dyn", "null") else t.kind for _, t in columns]
        cols = [t.col.cast("string") if t.kind == "null" else t.col for _, t in columns]
        return Result(df.select(*(c.alias(n) for c, n in zip(cols, names, strict=True))), names, kinds)

    def sliced(self, df: DataFrame, q: Query) -> DataFrame:
        if q.offset:
            df = df.offset(q.offset)
        return df if q.limit is None else df.limit(q.limit)

    def query(self, q: Query, outer: Scope | None = None, prefix: str = "") -> Result:
        df, scope = self.sources(q, outer, prefix)
        df = self.filtered(df, scope, q.filter)
        items = self.expand(q, scope)
        if q.group is not None or q.having is not None:
            return self.grouped(df, scope, q, items)
        if any(isinstance(x, Agg) for i in items for x in walk(i.expr)):
            raise LanguageError("a projection with aggregates needs a group; without one write the aggregate around the query")
        if any(isinstance(i.expr, Nested) for i in items):
            if q.distinct or scope.joined:
                raise LanguageError("the parent of a nested projection is a plain aliased table, without join, group or distinct")
        rids = [c for s in scope.sources for c in s.rid_columns()]
        keys = self.sort_keys(q.order, scope)
        if q.distinct:
            return self.distinct(df, scope, q, items, keys, rids)
        # windows, links and nested results are made of the rows that are left, and deal them anew
        dealt = any(isinstance(i.expr, (Over, Nested)) or any(isinstance(x, Field) and x.hops for x in walk(i.expr)) for i in items)
        if q.limit is not None or q.offset or keys and not dealt:
            df = self.sliced(df.orderBy(*keys, *rids), q)
        return self.projected(df, scope, q, items, [*keys, *rids] if keys and dealt else [])

    def projected(self, df: DataFrame, scope: Scope, q: Query, items: list[Item], order: list[Column]) -> Result:
        df = self.linked(df, scope, items)
        columns = []
        for i in items:
            if isinstance(i.expr, Over):
                t = self.window(i.expr, scope)
            elif isinstance(i.expr, Nested):
                df, t = self.nested(df, scope, i.expr, i.name)
            else:
                t = self.value(i.expr, scope)
            columns.append((self.heading(i, scope, q), t))
        if order:
            df = df.withColumns({f"__out{n}": t.col for n, (_, t) in enumerate(columns)}).orderBy(*order)
            columns = [(name, replace(t, col=F.col(f"__out{n}"))) for n, (name, t) in enumerate(columns)]
        return self.output(df, columns)

    def distinct(self, df, scope, q, items, keys, rids) -> Result:
        df = self.linked(df, scope, items)
        columns = [(self.heading(i, scope, q), self.window(i.expr, scope) if isinstance(i.expr, Over) else self.value(i.expr, scope)) for i in items]
        if not keys and q.limit is None and not q.offset:
            r = self.output(df, columns)
            return Result(distinct_rows(r.df, r.names, r.kinds), r.names, r.kinds)
        # the first row of each value in sort order stands for it
        first = df.withColumn("__first", F.row_number().over(Window.partitionBy(*(c for _, t in columns for c in identity(t))).orderBy(*keys, *rids))).where("__first = 1")
        return self.output(self.sliced(first.orderBy(*keys, *rids), q), columns)

    # -- aggregates --------------------------------------------------------------------------------------

    def operand(self, a: Agg, scope: Scope) -> Typed:
        t = self.value(a.arg, scope)
        if isinstance(t, Dynamic):
            t = Typed(t.col, "str", None, t.source) if a.name == "count" else Typed(t.lane("float"), "float", None, t.source)
        if a.name in ("sum", "avg") and t.kind not in ("int", "float", "null"):
            raise LanguageError(f"type mismatch: '{a.name}' takes numbers, not {t.kind}")
        return t

    def aggregate(self, a: Agg, scope: Scope) -> tuple[Column, str]:
        if a.arg is None:
            return F.count(F.lit(1)), "int"
        if isinstance(a.arg, Field) and a.name == "count" and not a.distinct and a.arg.alias is None and len(scope.sources) == 1 and a.arg.name == scope.sources[0].table and a.arg.name not in scope.sources[0].kinds:
            return F.count(F.lit(1)), "int"
        t = self.operand(a, scope)
        c = t.col
        if a.name == "count":
            return (F.countDistinct(*identity(t)) if a.distinct else F.count(c)), "int"
        if a.name == "avg":
            return F.avg(c), "float"
        if a.name == "sum":
            if t.kind == "float":
                return F.sum(c), "float"
            return F.sum(c.cast("decimal(38,0)")).cast("bigint"), "int"
        return (F.min if a.name == "min" else F.max)(c), t.kind

    def symmetric(self, a: Agg, scope: Scope, sql: bool) -> bool:
        return len(scope.sources) > 1 and a.name in ("sum", "avg", "count") and a.arg is not None and not (a.distinct or a.raw or sql)

    def packed(self, q: Query, scope: Scope, reads: list, apart: str | None = None, partial: dict[str, dict[str, tuple[Column, Column]]] | None = None) -> Packed:
        """The query's filtered rows, for which rows of a source that agree in all that is read of them become one before they are joined.

        reads: expressions that the result is asked for.  apart: a source whose rows stay as they are.  partial: by alias
        and name, a value of such rows together and the same of a row alone.
        """
        inner = all(j.kind in ("inner", "cross") for j in q.joins)
        by = {s.alias: s for s in scope.sources}
        known: dict = {}  # values of one source, which are made before its rows become one
        alone: dict[str, list[Column]] = {a: [] for a in by}  # conditions on one source
        kept: dict[str, dict[str, Typed]] = {a: {} for a in by}

        def make(e, at: Scope) -> None:
            if isinstance(e, (Field, Lit)) or e in known or len(reach := self.sources_of(e, at)) != 1:
                return
            t, name = self.value(e, at), f"__made{len(known)}"
            if t.kind not in ("dyn", "null"):
                (alias,) = reach
                kept[alias][name], known[e] = t, replace(t, col=F.col(name))

        def split(e, at: Scope, join: bool) -> list:
            """What is left of a condition without those on one source.  Below an outer join all is left."""
            left = []
            for c in conjuncts(e):
                plain = not has_subquery(c)
                if inner and plain and len(reach := self.sources_of(c, at)) == 1:
                    alone[next(iter(reach))].append(self.condition(c, at, True, join))
                    continue
                left.append(c)
                for x in walk(c) if inner and plain else []:
                    for side in (x.left, x.right) if isinstance(x, Binary) and x.op in COMPARISONS else ():
                        make(side, at)
            return left

        order, ons = [by[q.alias or q.table]], []
        for j in q.joins:
            order.append(by[j.alias])
            ons.append(split(j.on, Scope(list(order), None, {}, True), True))
        rest = split(q.filter, scope, False)
        for e in reads if inner else []:
            make(e, scope)
        names: dict[str, set[str]] = {a: set() for a in by}
        # a subquery's condition is compiled without what is known
        for f in [*all_fields([ons, rest, reads], known), *all_fields([c for c in rest if has_subquery(c)], {})]:
            for a, s in by.items():
                if f.name in s.kinds and f.alias in (None, a):
                    names[a].add(f.name)
        if apart is not None:
            names[apart] |= set(by[apart].rid)

        # a product of two such numbers that a bigint doesn't hold is refused, as the number of the join's rows would be
        whole = "bigint" if len(by) == 2 else "decimal(20,0)"

        def rows(s: Source) -> DataFrame:
            df = reduce(DataFrame.where, alone[s.alias], self.scan(s.table, s.alias, s.prefix)[0])
            cols = {s.prefix + n: Typed(quoted(s.prefix + n), s.kinds.get(n, "")) for n in sorted(names[s.alias])} | kept[s.alias]
            values = (partial or {}).get(s.alias, {})
            unique = getattr(self.catalog.table(s.table), "unique", frozenset())
            if s.alias == apart or unique & names[s.alias] or s.keyed and set(s.rid) <= names[s.alias]:
                return df.select(*(t.col.alias(n) for n, t in cols.items()), F.lit(1).cast(whole).alias(f"__rows.{s.alias}"), *(row.alias(n) for n, (_, row) in values.items()))
            keys = {n: [f"__by{i}_{k}" for k in range(len(identity(t)))] for i, (n, t) in enumerate(cols.items())}
            df = df.groupBy(*(c.alias(k) for n, t in cols.items() for c, k in zip(identity(t), keys[n], strict=True)))
            df = df.agg(F.count(F.lit(1)).cast(whole).alias(f"__rows.{s.alias}"), *(together.alias(n) for n, (together, _) in values.items()))
            df = df.where(quoted(f"__rows.{s.alias}") > 0)  # of an empty source no row, also where nothing is read of it
            return df.select(*(S.with_zero(*map(F.col, k)).alias(n) if len(k) > 1 else F.col(k[0]).alias(n) for n, k in keys.items()), quoted(f"__rows.{s.alias}"), *values)

        together = lambda parts: reduce(lambda a, b: Binary("and", a, b), parts) if parts else None
        df, at = rows(order[0]), Scope([order[0]], None, known, True)
        for j, s, on in zip(q.joins, order[1:], ons, strict=True):
            j = replace(j, on=together(on)) if on else replace(j, kind="cross")
            df = self.join(df, at, rows(s), s, j)
            at.sources = [*at.sources, s]
        at = replace(scope, extra=known)
        return Packed(self.filtered(df, at, together(rest)), at, {a: F.coalesce(quoted(f"__rows.{a}"), F.lit(1)) for a in by})

    def weighed(self, q: Query, scope: Scope, aggs: dict[int, Agg]) -> DataFrame:
        """One row a group with aggregates of joined rows, each made of its source's values and the numbers of rows that they meet."""
        number = lambda t: t.col if t.kind == "float" else t.col.cast("decimal(38,0)")
        inner = all(j.kind in ("inner", "cross") for j in q.joins)
        reads, partial, owner, kinds = [i.expr for i in q.group or []], {}, {}, {}
        for n, a in aggs.items():
            if a.arg is None:
                continue
            t = self.operand(a, scope)
            kinds[n] = t.kind
            # of a row that an outer join doesn't find only columns are sure to be missing
            if a.name == "count" and a.distinct or len(t.source) != 1 or not (inner or isinstance(a.arg, (Field, Path))):
                reads.append(a.arg)
                continue
            (owner[n],) = t.source
            value = ((F.min if a.name == "min" else F.max)(t.col), t.col) if a.name in ("min", "max") else (F.sum(number(t)), number(t)) if a.name != "count" else None
            own = partial.setdefault(owner[n], {})
            if value:
                own[f"__value{n}"] = value
            if a.name in ("count", "avg"):
                own[f"__there{n}"] = (F.count(t.col), t.col.isNotNull().cast("bigint"))
        p = self.packed(q, scope, reads, None, partial)
        out = []
        for n, a in aggs.items():
            times = reduce(mul, [w for alias, w in p.weights.items() if alias != owner.get(n)])
            if a.arg is None:
                col = F.coalesce(F.sum(times), F.lit(0)).cast("bigint")
            elif a.name == "count" and a.distinct:
                col = self.aggregate(a, p.scope)[0]
            else:
                if n in owner:
                    value, there = F.col(f"__value{n}"), F.col(f"__there{n}")
                else:
                    t = self.operand(a, p.scope)
                    value, there = t.col if a.name in ("min", "max", "count") else number(t), t.col.isNotNull().cast("bigint")
                if a.name in ("min", "max"):
                    col = (F.min if a.name == "min" else F.max)(value)
                elif a.name == "count":
                    col = F.coalesce(F.sum(there * times), F.lit(0)).cast("bigint")
                else:
                    col = F.sum(value * times.cast("double")) if kinds[n] == "float" else F.sum(value * times)
                    if a.name == "avg":
                        col = col.cast("double") / F.nullif(F.sum(there * times).cast("double"), F.lit(0.0))
                    elif kinds[n] != "float":
                        col = col.cast("bigint")
            out.append(col.alias(f"__agg{n}"))
        return p.df.groupBy(*(c.alias(n) for n, c in self.key_columns(q, p.scope).items())).agg(*out)

    def key_columns(self, q: Query, scope: Scope) -> dict[str, Column]:
        return {f"__key{i}_{j}": c for i, item in enumerate(q.group or []) for j, c in enumerate(identity(self.value(item.expr, scope)))}

    def aggregated(self, df: DataFrame, scope: Scope, aggs: list[Agg], keys: list[Typed], q: Query) -> tuple[DataFrame, list[Typed], list[Typed]]:
        """One row a group: the keys, and the aggregates in their order.

        A symmetric aggregate takes each row of its source once in a group: rows
        are grouped by the key and that row first.  Each source with such
        aggregates, and all others together, are aggregated apart, with map-side
        combination, and meet on the key.

        Where a join can repeat the rows of all its sources, only the product of
        their numbers bounds its rows; then the joined rows aren't made, but those
        of sources whose equal rows are one (see packed).
        """
        columns = self.key_columns(q, scope)
        # a guard on the join's rows bounds them and needs them as they are
        many = bool(q.joins) and not scope.once and self.catalog.join_rows is None
        out_keys = [Typed(S.with_zero(F.col(f"__key{i}_0"), F.col(f"__key{i}_1")) if k.kind == "float" else F.col(f"__key{i}_0"), "str" if k.kind == "dyn" else k.kind) for i, k in enumerate(keys)]
        kinds: dict[int, str] = {}
        plain, apart = {}, {}
        for n, a in enumerate(aggs):
            col, kinds[n] = self.aggregate(a, scope)
            if not self.symmetric(a, scope, q.sql):
                plain[n] = col
                continue
            reads = self.value(a.arg, scope).source
            if len(reads) != 1:
                raise LanguageError(f"'{a.name}' over a join must read exactly one source; use {a.name}(raw ...)")
            if reads <= scope.once:  # each row once as it is
                plain[n] = col
            else:
                apart.setdefault(next(iter(reads)), []).append(n)
        parts = []
        if plain:
            parts.append(self.weighed(q, scope, {n: aggs[n] for n in plain}) if many else df.groupBy(*(c.alias(n) for n, c in columns.items())).agg(*(c.alias(f"__agg{n}") for n, c in plain.items())))
        for alias, own in apart.items():
            source = next(s for s in scope.sources if (s.alias or s.table) == alias)
            if not source.keyed:
                raise LanguageError(f"'{source.table}' has no key that tells its rows apart; register it with one or use {aggs[own[0]].name}(raw ...)")
            rid = source.rid_columns()
            there = reduce(lambda x, y: x | y, [c.isNotNull() for c in rid])
            p = self.packed(q, scope, [*(i.expr for i in q.group or []), *(aggs[n].arg for n in own)], alias) if many else Packed(df, scope, {})
            values = {n: self.value(aggs[n].arg, p.scope) for n in own}
            lanes = {n: t.lane("float") if isinstance(t, Dynamic) and aggs[n].name != "count" else t.col for n, t in values.items()}
            rows = p.df.groupBy(*(c.alias(n) for n, c in self.key_columns(q, p.scope).items()), *(c.alias(f"__rid{i}") for i, c in enumerate(rid)))
            rows = rows.agg(*(F.first(F.when(there, c)).alias(f"__one{n}") for n, c in lanes.items()))
            inner = Scope([Source("", None, "", {f"__one{n}": "float" if isinstance(t, Dynamic) and aggs[n].name != "count" else "str" if t.kind == "dyn" else t.kind for n, t in values.items()}, [])])
            once = [self.aggregate(replace(aggs[n], arg=Field(f"__one{n}")), inner)[0].alias(f"__agg{n}") for n in own]
            parts.append(rows.groupBy(*columns).agg(*once))
        if not parts:
            p = self.packed(q, scope, [i.expr for i in q.group or []]) if many else Packed(df, scope, {})
            return p.df.select(*(c.alias(n) for n, c in self.key_columns(q, p.scope).items())).distinct(), out_keys, []
        out = parts[0]
        for k, part in enumerate(parts[1:]):
            if not columns:
                out = out.crossJoin(F.broadcast(part))  # one row each
                continue
            part = part.withColumnsRenamed({c: f"{c}_{k}" for c in columns})
            out = out.join(part, both([F.col(c).eqNullSafe(F.col(f"{c}_{k}")) for c in columns])).drop(*(f"{c}_{k}" for c in columns))
        return out, out_keys, [Typed(F.col(f"__agg{n}"), kinds[n]) for n in range(len(aggs))]

    def grouped(self, df: DataFrame, scope: Scope, q: Query, items: list[Item]) -> Result:
        group = q.group or []
        keys = [self.value(i.expr, scope) for i in group]
        exprs = [*(i.expr for i in items), *([q.having] if q.having is not None else []), *(e for e, _ in q.order)]
        if any(isinstance(x, (Over, Nested)) for e in exprs for x in ([e] if isinstance(e, Nested) else walk(e))):
            raise LanguageError("a grouped query takes no windows and no nested results")
        aggs = list(dict.fromkeys(x for e in exprs for x in walk(e) if isinstance(x, Agg)))
        out, out_keys, made = self.aggregated(df, scope, aggs, keys, q)
        extra: dict = {}
        for i, k, t in zip(group, keys, out_keys, strict=True):
            extra[i.expr] = t
            if isinstance(i.expr, Field):  # with and without its alias
                owner = next((s for s in scope.sources if (s.alias or s.table) in k.source), None)
                extra[Field(i.expr.name)] = extra[Field(i.expr.name, owner.alias)] = t
        extra |= dict(zip(aggs, made, strict=True))
        after = Scope([], None, extra, scope.joined)
        if q.having is not None:
            out = out.where(self.condition(q.having, after, True))
        columns = []
        for i in items:
            columns.append((self.heading(i, scope, q), self.value(i.expr, after)))
            if i.name is not None:
                after.extra.setdefault(Field(i.name), columns[-1][1])
        if q.distinct:
            r = self.output(out, columns)
            out, after = distinct_rows(r.df, r.names, r.kinds), Scope([], None, {Field(n): Typed(quoted(n), k) for n, k in zip(r.names, r.kinds, strict=True)})
            columns = [(n, Typed(quoted(n), k)) for n, k in zip(r.names, r.kinds, strict=True)]
        if q.order or q.limit is not None or q.offset:
            ties = [t.col.asc_nulls_last() for t in out_keys] if not q.distinct else []
            out = self.sliced(out.orderBy(*self.sort_keys(q.order, after), *ties), q)
        return self.output(out, columns)

    def scalar(self, s: Scalar) -> Result:
        q = s.query
        item = q.items[0].expr if q.items else None
        if q.items and len(q.items) > 1 or isinstance(item, Nested) or (item is None and s.agg != "count"):
            raise LanguageError(f"{s.agg} of a query takes one projected expression")
        if q.distinct or q.limit is not None or q.offset:
            r = self.query(q)
            a = Agg(s.agg, Field(r.names[0]) if item is not None else None, s.distinct, True)
            scope = Scope([Source("", None, "", dict(zip(r.names, r.kinds, strict=True)), [])])
            col, kind = self.aggregate(a, scope)
            return self.output(r.df.agg(col.alias("__agg")), [(s.agg, Typed(F.col("__agg"), kind))])
        df, scope = self.sources(q, None, "")
        df = self.filtered(df, scope, q.filter)
        a = Agg(s.agg, item, s.distinct, s.raw)
        df, _, made = self.aggregated(df, scope, [a], [], q)
        return self.output(df, [(s.agg, made[0])])

    # -- windows -----------------------------------------------------------------------------------------

    def window(self, e: Over, scope: Scope) -> Typed:
        keys = self.sort_keys(e.order, scope)
        rids = [c for s in scope.sources for c in s.rid_columns()]
        w = Window.partitionBy(*(c for p in e.partition for c in identity(self.value(p, scope))))
        if e.name in ("rank", "dense_rank"):
            fn = (F.rank if e.name == "rank" else F.dense_rank)()
            return Typed(fn.over(w.orderBy(*(keys or [F.lit(1)]))).cast("bigint"), "int")
        if e.name == "row_number":
            return Typed(F.row_number().over(w.orderBy(*keys, *rids)).cast("bigint"), "int")
        if keys:  # a running frame of rows
            w = w.orderBy(*keys, *rids).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if e.arg is None:
            return Typed(F.count(F.lit(1)).over(w), "int")
        t = self.value(e.arg, scope)
        if isinstance(t, Dynamic):
            t = Typed(t.lane("float"), "float")
        if e.name == "sum" and t.kind == "int":
            return Typed(F.sum(t.col.cast("decimal(38,0)")).over(w).cast("bigint"), "int")
        fn = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max}[e.name]
        return Typed(fn(t.col).over(w), {"avg": "float", "count": "int"}.get(e.name, t.kind))

    # -- links and nested results ------------------------------------------------------------------------

    def linked(self, df: DataFrame, scope: Scope, items: list[Item]) -> DataFrame:
        """Left joins for the link paths of a projection; a hop must be to one row."""
        joined: dict[tuple, Source] = {}
        for i in items:
            for f in walk(i.expr) if not isinstance(i.expr, Nested) else []:
                if not isinstance(f, Field) or not f.hops or f in scope.extra:
                    continue
                at = next((s for s in scope.sources if (s.alias or s.table) == f.alias), None)
                if at is None:
                    raise LanguageError(f"unknown alias '{f.alias}'")
                path: tuple = (f.alias,)
                for hop in (f.name, *f.hops[:-1]):
                    link = self.catalog.link(at.table, hop)
                    if not self.catalog.is_unique(link.target, link.key):
                        raise LanguageError(f"'{hop}' of '{at.table}' can lead to several rows, as '{link.target}.{link.key}' isn't unique; read it with a block")
                    path = (*path, hop)
                    if path not in joined:
                        right, s = self.scan(link.target, None, "__link." + ".".join(path) + ".")
                        df = df.join(right, at.column(link.local).col == s.column(link.key).col, "left")
                        joined[path] = s
                    at = joined[path]
                scope.extra[f] = at.column(f.hops[-1])
        return df

    def nested(self, df: DataFrame, scope: Scope, e: Nested, name: str) -> tuple[DataFrame, Typed]:
        """A JSON array of the children of each row, by one grouped child query and a left join."""
        q, parent = e.query, scope.sources[0]
        if e.link:
            alias, link_name = e.link
            if alias != parent.alias:
                raise LanguageError(f"unknown alias '{alias}'")
            link = self.catalog.link(parent.table, link_name)
            if self.catalog.is_unique(link.target, link.key):
                raise LanguageError(f"'{link_name}' of '{parent.table}' leads to one row; read it with a path")
            q = replace(q, table=link.target, alias=q.alias or f"__{link_name}")
            equality = [(Field(link.key, q.alias), Field(link.local, alias))]
            rest = conjuncts(q.filter)
        if q.joins or q.group or q.distinct or q.items is None:
            raise LanguageError(f"nested projection `{name}` takes a plain aliased table with a projection")
        prefix = f"__n{next(self.numbers)}."
        child, source = self.scan(q.table, q.alias, prefix)
        inner = Scope([source], Scope([parent], None))
        if not e.link:
            equality, rest = [], []
            for c in conjuncts(q.filter):
                fields = [f for f in walk(c) if isinstance(f, Field)]
                outside = [f for f in fields if inner.is_outer(f)]
                if not outside:
                    rest.append(c)
                elif isinstance(c, Binary) and c.op == "=" and isinstance(c.left, Field) and isinstance(c.right, Field) and len(outside) == 1:
                    equality.append((c.right, c.left) if inner.is_outer(c.left) else (c.left, c.right))
                else:
                    raise LanguageError(f"nested projection `{name}`: conditions on the parent belong to the outer query")
        if len(equality) != 1:
            raise LanguageError(f"the children of '{name}' are found by one equality of a column of '{q.alias}' with one of the parent")
        own, other = inner.find(equality[0][0]), scope.find(equality[0][1])
        alone = Scope([source], None)
        child = self.filtered(child, alone, reduce(lambda a, b: Binary("and", a, b), rest) if rest else None)
        child = child.where(own.col.isNotNull())
        order = Window.partitionBy(own.col).orderBy(*self.sort_keys(q.order, alone), *source.rid_columns())
        child = child.withColumn(prefix + "rn", F.row_number().over(order))
        low, rn = q.offset or 0, quoted(prefix + "rn")
        if low or q.limit is not None:
            child = child.where((rn > low) if q.limit is None else (rn > low) & (rn <= low + q.limit))
        child = self.linked(child, alone, q.items)
        parts = []
        for i in q.items:
            if isinstance(i.expr, Nested):
                child, t = self.nested(child, alone, i.expr, i.name)
            else:
                t = self.value(i.expr, alone)
            parts.append((i.name or (i.expr.name if isinstance(i.expr, Field) and not i.expr.hops else i.text), t))
        key, array = prefix + "key", prefix + "array"
        rows = child.select(own.col.alias(key), rn.alias("__rn"), json_object(parts).alias("__obj"))
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rn", "__obj"))), lambda x: x["__obj"]), ",")
        arrays = rows.groupBy(quoted(key)).agg(F.concat(F.lit("["), listed, F.lit("]")).alias(array))
        on = other.col == quoted(key) if own.kind == other.kind else F.lit(False)
        return df.join(arrays, on, "left"), Typed(F.coalesce(quoted(array), F.lit("[]")), "json")


def json_value(t: Typed) -> Column:
    """A value as JSON text; missing and non-finite as null, times and bytes as strings."""
    text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"\A\[|\]\z", "")
    if isinstance(t, Dynamic):
        out = t.raw
    elif t.kind == "float":
        out = F.when(F.isnan(t.col) | (F.abs(t.col) == float("inf")), F.lit("null")).otherwise(t.col.cast("string"))
    elif t.kind in ("int", "bool", "json"):
        out = t.col.cast("string")
    elif t.kind == "null":
        out = F.lit(None)
    else:
        out = text(S.text_of(t))
    return F.when(t.col.isNull(), F.lit("null")).otherwise(out)


def json_object(parts: list[tuple[str, Typed]]) -> Column:
    """An object with sorted keys."""
    import json

    pieces = []
    for n, (name, t) in enumerate(sorted(parts, key=lambda p: p[0].encode())):
        pieces += [F.lit(("," if n else "{") + json.dumps(name, ensure_ascii=False) + ":"), json_value(t)]
    return F.concat(*pieces, F.lit("}"))
