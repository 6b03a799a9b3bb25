"""Comparison, arithmetic and scalar functions of the language as Spark columns.

A filter is two-valued: a comparison with a missing operand is false.  Where a
predicate only decides whether a row stays, null does as well as false and is
left, so that Parquet filters are pushed down; below a ``not`` and in values it
is made false.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.plans.nodes import LanguageError

#: How a kind is stored.
SPARK = {"int": "bigint", "float": "double", "bool": "boolean", "str": "string", "datetime": "timestamp", "uuid": "binary", "bytes": "binary", "json": "string"}
#: Integers up to here are exact as floats.
EXACT = 1 << 53


@dataclass
class Typed:
    """A column with its kind; ``literal`` is set for constants.  Kind dyn: a value inside a document, as a Dynamic."""

    col: Column
    kind: str
    literal: object = None
    source: frozenset = frozenset()  # aliases that it reads


@dataclass
class Dynamic(Typed):
    """A JSON value.  col: its text, null for a missing value or a JSON null; raw: the same as it stands in the document."""

    raw: Column = None
    is_null: Column = None  # whether it is a JSON null, which only json_type asks

    @property
    def is_text(self) -> Column:
        return self.raw.startswith('"')

    @property
    def numeric(self) -> Column:
        return self.raw.rlike(r"\A-?[0-9]")

    @property
    def nested(self) -> Column:
        return self.raw.rlike(r"\A[\[{]")

    @property
    def boolean(self) -> Column:
        return self.raw.isin("true", "false")

    def lane(self, kind: str) -> Column:
        """The value where it is of the kind, else null; an int is a float too.  Text is quoted, so no number."""
        if kind == "int":
            return self.raw.try_cast("bigint")
        if kind == "float":
            return self.raw.try_cast("double")
        if kind == "bool":
            return F.when(self.raw == "true", F.lit(True)).when(self.raw == "false", F.lit(False))
        if kind == "json":
            return F.when(self.nested, self.raw)
        return F.when(self.is_text, self.col)


def literal(value, kind: str) -> Typed:
    if kind == "null":
        return Typed(F.lit(None), "null", None)
    return Typed(F.lit(value).cast(SPARK[kind]), kind, value)


def dynamic(doc: Column, steps: tuple) -> Dynamic:
    """The value at a path of a canonical document; null where it is missing or a JSON null."""
    path = "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)
    # below a wildcard a single match is written as it stands, with its quotes
    raw = F.get_json_object(F.concat(F.lit("["), doc, F.lit("]")), "$[*]" + path)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(doc), "$" + path.replace("'", '"'), "variant"))
    return Dynamic(F.get_json_object(doc, "$" + path), "dyn", None, frozenset(), raw, kind == "VOID")


def _nan_safe(col: Column, *floats: Typed) -> Column:
    for f in floats:
        if f.literal is None:
            col = col & ~F.isnan(f.col)
    return col


def _int_float(op: str, i: Typed, f: Typed) -> Column:
    """An int against a float, exactly at any size."""
    if i.literal is not None and abs(i.literal) <= EXACT:
        a = F.lit(float(i.literal))
        plain = {"=": a == f.col, "<": a < f.col, "<=": a <= f.col, ">": a > f.col, ">=": a >= f.col}[op]
        return _nan_safe(plain, f) if op in ("<", "<=") else plain
    if f.literal is not None and abs(f.literal) < EXACT and f.literal == int(f.literal):
        b = F.lit(int(f.literal)).cast("bigint")
        return {"=": i.col == b, "<": i.col < b, "<=": i.col <= b, ">": i.col > b, ">=": i.col >= b}[op]
    high, low = f.col >= F.lit(2.0**63), f.col < F.lit(-(2.0**63))
    whole = F.floor(f.col).try_cast("bigint")
    part = f.col > F.floor(f.col)
    inside = {"=": (i.col == whole) & ~part, "<": (i.col < whole) | ((i.col == whole) & part), "<=": i.col <= whole, ">": i.col > whole, ">=": (i.col > whole) | ((i.col == whole) & ~part)}[op]
    edge = F.when(F.isnan(f.col), F.lit(False)).when(high, F.lit(op in ("<", "<="))).when(low, F.lit(op in (">", ">=")))
    return edge.otherwise(inside)


def minus_zero(col: Column) -> Column:
    """Whether a float is negative zero; false where it is missing."""
    return F.when(col == 0, col.cast("string") == "-0.0").otherwise(F.lit(False))


def with_zero(col: Column, minus: Column) -> Column:
    """A float that was a key, with the sign of zero that keys lose."""
    return F.when(minus, F.lit(-0.0)).otherwise(col)


_FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}


def compare(op: str, a: Typed, b: Typed, label: str = "") -> Column:
    """A filter comparison; null or false where an operand is missing."""
    if op == "!=":
        present = a.col.isNotNull() & b.col.isNotNull()
        return present & ~F.coalesce(compare("=", a, b, label), F.lit(False))
    if a.kind == "null" or b.kind == "null":
        return F.lit(False)
    if isinstance(b, Dynamic) and not isinstance(a, Dynamic):
        return compare(_FLIP[op], b, a, label)
    if isinstance(a, Dynamic):
        if isinstance(b, Dynamic):
            numbers = compare(op, Typed(a.lane("float"), "float"), Typed(b.lane("float"), "float"))
            same = a.numeric & b.numeric
            texts = {"=": a.col == b.col, "<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[op]
            alike = (a.is_text & b.is_text) | (a.boolean & b.boolean) | (a.nested & b.nested)
            return F.when(same, numbers).otherwise(alike & texts)
        if b.kind in ("int", "float"):
            ints, floats = compare(op, Typed(a.lane("int"), "int"), b), compare(op, Typed(a.lane("float"), "float"), b)
            return F.coalesce(ints, floats)
        if b.kind not in ("str", "bool", "json"):
            return F.lit(False)
        return compare(op, Typed(a.lane(b.kind), b.kind), b, label)
    if {a.kind, b.kind} == {"int", "float"}:
        return _int_float(op, a, b) if a.kind == "int" else _int_float(_FLIP[op], b, a)
    if {a.kind, b.kind} == {"datetime", "int"}:
        a, b = (Typed(F.timestamp_micros(x.col), "datetime", x.literal) if x.kind == "int" else x for x in (a, b))
    if {a.kind, b.kind} == {"json", "str"}:
        if op != "=":
            raise LanguageError("an ordered comparison between a document and text is refused")
        from tidewater.functions.documents import canonical

        a, b = (Typed(F.lit(canonical(x.literal)), "json") if x.kind == "str" and x.literal is not None else x for x in (a, b))
    elif a.kind != b.kind:
        if "uuid" in (a.kind, b.kind) or "bytes" in (a.kind, b.kind):
            a, b = (cast(x, (a.kind if x is b else b.kind)) if x.kind == "str" else x for x in (a, b))
        else:
            return F.lit(False)
    x, y = a.col, b.col
    out = {"=": x == y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    if a.kind == "float":
        if op == "=":
            zero = lambda t: t.literal is None or t.literal == 0
            if a.literal is None and b.literal is None:
                out = out & ~F.isnan(x)
            if zero(a) and zero(b):  # negative zero is a float of its own
                out = out & ((x != 0) | (x.cast("string") == y.cast("string")))
        else:  # NaN sorts high in Spark and compares with nothing here
            out = _nan_safe(out, a, b)
    return out


def join_compare(op: str, a: Typed, b: Typed) -> Column:
    """A comparison of a join condition: missing equals missing, and sorts lowest."""
    numbers = {a.kind, b.kind} == {"int", "float"}
    if op in ("=", "!=") and a.kind != b.kind and not numbers and "null" not in (a.kind, b.kind):
        equal = a.col.isNull() & b.col.isNull()
    elif op in ("=", "!=") and numbers:  # by identity an int is no float
        equal = a.col.isNull() & b.col.isNull()
    else:
        equal = a.col.eqNullSafe(b.col)
        if a.kind == b.kind == "float":
            equal = equal & (minus_zero(a.col) == minus_zero(b.col))
    if op == "=":
        return equal
    if op == "!=":
        return ~equal
    if op in (">", ">="):
        return join_compare(_FLIP[op], b, a)
    less = (a.col.isNull() & b.col.isNotNull()) | F.coalesce(a.col < b.col, F.lit(False))
    return less | equal if op == "<=" else less


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    a, b = (Typed(x.lane("float"), "float") if isinstance(x, Dynamic) else x for x in (a, b))
    kinds = {a.kind, b.kind} - {"null"}
    if kinds == {"int"} or kinds == {"datetime", "int"} or kinds == {"datetime"}:
        x, y = (F.unix_micros(t.col) if t.kind == "datetime" else t.col for t in (a, b))
        col = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.call_function("div", x, y)}[op]()
        return Typed(col, "int")
    if not kinds <= {"int", "float"}:
        raise LanguageError(f"'{op}' takes numbers, not {' and '.join(sorted(kinds))}")
    x, y = a.col.cast("double"), b.col.cast("double")
    if op != "/":
        return Typed({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[op](), "float")
    positive = (x > 0) == (y.cast("string") != "-0.0")
    zero = F.when(x.isNull(), F.lit(None)).when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(positive, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return Typed(F.when(y.isNull(), F.lit(None)).when((y != 0) | F.isnan(y), F.try_divide(x, y)).otherwise(zero), "float")


def like(a: Typed, b: Typed) -> Column:
    if isinstance(a, Dynamic):
        a = Typed(a.lane("str"), "str")
    if "str" not in (a.kind, "null") or b.kind not in ("str", "null"):
        raise LanguageError(f"type mismatch: 'like' matches str, not {a.kind if a.kind != 'str' else b.kind}")
    escape = "\u0001"  # an escape that a pattern holds itself stands for itself when doubled
    pattern = F.lit(b.literal.replace(escape, 2 * escape)) if isinstance(b.literal, str) else F.replace(b.col, F.lit(escape), F.lit(2 * escape))
    return F.like(a.col, pattern, F.lit(escape))


def text_of(t: Typed) -> Column:
    """A value as text, floats without a trailing .0."""
    if isinstance(t, Dynamic) or t.kind in ("str", "json"):
        return t.col
    if t.kind == "float":
        whole = (t.col == F.floor(t.col)) & (F.abs(t.col) < 1e15)
        named = F.when(F.isnan(t.col), F.lit("NaN")).when(t.col == float("inf"), F.lit("inf")).when(t.col == float("-inf"), F.lit("-inf"))
        return named.when(whole & (t.col.cast("string") == "-0.0"), F.lit("-0")).when(whole, t.col.cast("bigint").cast("string")).otherwise(t.col.cast("string"))
    if t.kind == "datetime":
        return F.unix_micros(t.col).cast("string")
    if t.kind == "uuid":
        return F.regexp_replace(F.lower(F.hex(t.col)), r"\A(.{8})(.{4})(.{4})(.{4})(.{12})\z", "$1-$2-$3-$4-$5")
    if t.kind == "bytes":
        return F.concat(F.lit("\\x"), F.lower(F.hex(t.col)))
    return t.col.cast("string")


def cast(t: Typed, to: str) -> Typed:
    """A cast; missing where it fails."""
    if t.kind == to:
        return t
    if t.kind == "null":
        return Typed(F.lit(None).cast(SPARK[to]), to)
    if isinstance(t, Dynamic):
        if to == "str":
            return Typed(t.col, "str")
        own = cast(Typed(t.lane("str"), "str"), to).col
        for kind in ("bool", "float", "int"):
            if kind == to or to in ("int", "float"):
                own = F.coalesce(cast(Typed(t.lane(kind), kind), to).col, own)
        return Typed(own, to)
    c = t.col
    if to == "str":
        return Typed(text_of(t), "str")
    if to == "int":
        if t.kind == "float":
            capped = F.when(c >= 2.0**63, F.lit((1 << 63) - 1)).when(c <= -(2.0**63), F.lit(-(1 << 63))).otherwise(c.try_cast("bigint"))
            return Typed(F.when(F.isnan(c), F.lit(0)).otherwise(capped).cast("bigint"), "int")
        if t.kind == "datetime":
            return Typed(F.unix_micros(c), "int")
        if t.kind == "bool":
            return Typed(c.cast("bigint"), "int")
        if t.kind == "str":
            return Typed(F.when(c.rlike(r"\A[+-]?[0-9]+\z"), c.try_cast("bigint")), "int")
    if to == "float":
        if t.kind in ("int", "bool"):
            return Typed(c.cast("double"), "float")
        if t.kind == "str":
            return Typed(F.when(c.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), c.try_cast("double")), "float")
    if to == "bool":
        if t.kind == "int":
            return Typed(c != 0, "bool")
        if t.kind == "str":
            return Typed(F.when(c == "true", F.lit(True)).when(c == "false", F.lit(False)), "bool")
    if to == "datetime" and t.kind == "int":
        return Typed(F.timestamp_micros(c), "datetime")
    if to == "uuid" and t.kind == "str":
        plain = F.regexp_replace(c, "-", "")
        return Typed(F.when(plain.rlike(r"\A[0-9a-fA-F]{32}\z"), F.unhex(plain)), "uuid")
    if to == "bytes" and t.kind == "str":
        return Typed(F.when(c.rlike(r"\A\\x([0-9a-fA-F]{2})*\z"), F.unhex(F.substring(c, F.lit(3), F.length(c)))), "bytes")
    return Typed(F.lit(None).cast(SPARK[to]), to)


_UNITS = {"microsecond": 1, "us": 1, "millisecond": 1000, "ms": 1000, "second": 10**6, "s": 10**6, "minute": 60 * 10**6, "m": 60 * 10**6, "hour": 3600 * 10**6, "h": 3600 * 10**6, "day": 86400 * 10**6, "d": 86400 * 10**6}


def _unit(t: Typed) -> int | None:
    name = str(t.literal)
    return _UNITS.get(name, _UNITS.get(name.removesuffix("s")) if len(name) > 2 else None)


def _micros(t: Typed) -> Column:
    return F.unix_micros(t.col) if t.kind == "datetime" else t.col


def _toward_zero(micros: Column) -> Column:
    """Whole seconds as a timestamp, fractions before 1970 cut toward zero."""
    return F.timestamp_seconds(F.call_function("div", micros, F.lit(10**6)))


def call(name: str, args: list[Typed]) -> Typed:  # noqa: C901
    """A scalar function; a missing argument gives a missing value except in concat."""
    if name == "concat":
        shown = [a for a in args if a.kind not in ("datetime", "uuid", "bytes", "json", "null")]
        return Typed(F.concat(F.lit(""), *(F.coalesce(text_of(a), F.lit("")) for a in shown)), "str")
    if name == "now":
        return Typed(F.current_timestamp(), "datetime")
    if name == "json_type":
        a = args[0]
        raw = a.raw if isinstance(a, Dynamic) else a.col
        kinds = {'"': "string", "t": "bool", "f": "bool", "n": "null", "{": "object", "[": "array"}
        named = reduce(lambda acc, k: acc.when(raw.startswith(k), kinds[k]), kinds, F)
        missing = F.when(a.is_null, "null") if isinstance(a, Dynamic) else F.lit(None).cast("string")
        return Typed(F.when(raw.isNull(), missing).otherwise(named.when(raw.rlike(r"\A-?[0-9]+\z"), "int").otherwise("float")), "str")
    if name == "json_text":
        a = args[0]
        plain = a.col if isinstance(a, Dynamic) else F.coalesce(F.get_json_object(a.col, "$"), a.col)
        return Typed(plain, "str")
    if name in ("upper", "lower", "trim", "substring", "length"):
        args = [Typed(a.lane("str"), "str") if isinstance(a, Dynamic) else a for a in args]
        a = args[0]
        if name == "length" and a.kind == "bytes":
            return Typed(F.octet_length(a.col).cast("bigint"), "int")
        if a.kind not in ("str", "null"):
            raise LanguageError(f"type mismatch: '{name}' measures str{' or bytes' if name == 'length' else ''}, not {a.kind}")
        if name == "length":
            return Typed(F.char_length(a.col).cast("bigint"), "int")
        if name == "trim":
            return Typed(F.regexp_replace(a.col, r"(?U)\A[\s\p{Z}]+|[\s\p{Z}]+\z", ""), "str")
        if name == "substring":
            start, n = args[1].col, args[2].col
            cut = F.substring(a.col, F.greatest(start, F.lit(1)).cast("int"), F.least(n, F.lit((1 << 31) - 1)).cast("int"))
            return Typed(F.when(n < 0, F.lit(None)).when(start < 0, F.lit("")).otherwise(cut), "str")
        return Typed(F.upper(a.col) if name == "upper" else F.lower(a.col), "str")
    if name in ("extract", "date_add", "date_diff"):
        return _date(name, args)
    args = [Typed(a.lane("float"), "float") if isinstance(a, Dynamic) else a for a in args]
    a = args[0]
    if a.kind not in ("int", "float", "null"):
        return Typed(F.lit(None).cast("double"), "float")
    c = a.col
    if name == "abs":
        return Typed(F.when(c == -(1 << 63), F.lit(None)).otherwise(F.abs(F.when(c > -(1 << 63), c))) if a.kind == "int" else F.abs(c), a.kind)
    if name == "round":
        if a.kind == "int":
            return a
        p = F.lit(10.0 ** int(args[1].literal or 0)) if len(args) > 1 else F.lit(1.0)
        return Typed(F.when(F.isnan(c) | (F.abs(c) == float("inf")), c).otherwise(F.round(c * p, 0) / p), "float")
    if name in ("ceil", "floor"):
        if a.kind == "int":
            return a
        big = (F.abs(c) >= 2.0**52) | F.isnan(c)
        return Typed(F.when(big, c).otherwise((F.ceil(c) if name == "ceil" else F.floor(c)).cast("double")), "float")
    if name == "sqrt":
        return Typed(F.when(c >= 0, F.sqrt(c.cast("double"))), "float")
    if name == "pow":
        b = args[1]
        real = F.pow(c.cast("double"), b.col.cast("double"))
        if a.kind == "int" and b.kind == "int" and b.literal is not None and b.literal >= 0:
            product = F.lit(1).cast("decimal(38,0)")
            for _ in range(min(int(b.literal), 64)):
                product = F.try_multiply(product, c.cast("decimal(19,0)")).try_cast("decimal(38,0)")
            return Typed(F.coalesce(product.try_cast("bigint").cast("double"), real), "float") if b.literal > 64 else Typed(product.try_cast("bigint"), "int")
        return Typed(real, "float")
    raise LanguageError(f"unknown function '{name}'")


def _date(name: str, args: list[Typed]) -> Typed:
    if name == "extract":
        part, micros = str(args[0].literal), _micros(args[1])
        at = _toward_zero(micros)
        fields = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}
        if part in fields:
            return Typed(fields[part](at).cast("bigint"), "int")
        if part == "epoch":
            return Typed(F.call_function("div", micros, F.lit(10**6)), "int")
        if part in ("millisecond", "microsecond"):
            rest = F.abs(micros % 10**6)
            return Typed(F.call_function("div", rest, F.lit(1000)) if part == "millisecond" else rest, "int")
        return Typed(F.lit(None).cast("bigint"), "int")
    unit = _unit(args[2])
    if unit is None:
        return Typed(F.lit(None).cast("timestamp" if name == "date_add" else "bigint"), "datetime" if name == "date_add" else "int")
    if name == "date_add":
        return Typed(F.timestamp_micros(_micros(args[0]) + args[1].col * unit), "datetime")
    return Typed(F.call_function("div", _micros(args[0]) - _micros(args[1]), F.lit(unit)), "int")
