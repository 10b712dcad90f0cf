"""JSON expressions to Columns.

A lowered expression is a Column that is null exactly where the expression is missing (null, an empty text or an empty list),
with its kind. A predicate also keeps a plain form, `test`, whose null counts as false: filters use it, so that comparisons reach
the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions.dates import parse_date, parse_duration
from lathe.plans.schema import Scope, is_union, picker

LARGEST = 1.7976931348623157e308
NUMBERS = ("integer", "number", "time", "interval")


@dataclass(frozen=True)
class Lowered:
    col: Column
    kind: str  # boolean integer number time text array object union null
    dtype: T.DataType | None = None
    test: Column | None = None
    raw: Column | None = None  # before empty texts became null
    constant: Any = None
    is_constant: bool = False
    invert: Column | None = None  # what `not` of it is, where that is no plain complement
    parts: tuple[Lowered, ...] = ()  # of a tuple

    @property
    def exists(self) -> Column:
        return F.lit(self.constant is not None) if self.is_constant else self.col.isNotNull()


class ExpressionError(ValueError):
    pass


def null() -> Lowered:
    return Lowered(F.lit(None), "null", is_constant=True)


def constant(value: Any) -> Lowered:
    if value is None or value == "" or value == [] or value == {}:
        return null()
    if isinstance(value, bool):
        return Lowered(F.lit(value), "boolean", constant=value, is_constant=True, test=F.lit(value))
    if isinstance(value, int):
        return Lowered(F.lit(value).cast("long"), "integer", constant=value, is_constant=True)
    if isinstance(value, float):
        return Lowered(F.lit(value), "number", constant=value, is_constant=True)
    if isinstance(value, str):
        return Lowered(F.lit(value), "text", constant=value, is_constant=True, raw=F.lit(value))
    if isinstance(value, (list, tuple)):
        parts = tuple(constant(v) for v in value)
        return Lowered(F.array(*[p.col for p in parts]), "array", constant=list(value), is_constant=True, parts=parts)
    if isinstance(value, dict):
        if set(value) == {"date"}:
            return constant(parse_date(value["date"]))
        return Lowered(F.struct(*[constant(v).col.alias(k) for k, v in value.items()]), "object", constant=value, is_constant=True)
    return constant(parse_date(value))


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(t, T.ArrayType):
        return "array"
    if is_union(t):
        return "union"
    if isinstance(t, T.NullType):
        return "null"
    return "object"


def of_column(col: Column, t: T.DataType) -> Lowered:
    """A column as an expression: times become unix seconds; NaN, infinities, empty texts and empty lists become null."""
    kind = kind_of(t)
    if kind == "time":
        return Lowered(unix_seconds(col, t), "time", raw=col, dtype=t)
    if kind == "text":
        return Lowered(F.nullif(col, F.lit("")), "text", raw=col)
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return Lowered(F.when(F.isnan(col) | (F.abs(col) == float("inf")), F.lit(None)).otherwise(col).cast("double"), "number", raw=col)
    if kind == "number":
        return Lowered(col.cast("double"), "number", raw=col)
    if kind == "array":
        return Lowered(F.when(F.size(col) > 0, col), "array", t)
    if kind == "boolean":
        return Lowered(col, "boolean", test=col)
    return Lowered(col, kind, t, raw=col if kind == "integer" else None)


def unix_seconds(col: Column, t: T.DataType) -> Column:
    if isinstance(t, T.TimestampNTZType):
        return F.expr("0D") + (F.unix_micros(col.cast("timestamp")) / F.lit(1e6))
    if isinstance(t, T.DateType):
        return F.unix_date(col).cast("double") * 86400.0
    return F.unix_micros(col) / F.lit(1e6)


def predicate(test: Column, invert: Column | None = None) -> Lowered:
    return Lowered(F.coalesce(test, F.lit(False)), "boolean", test=test, invert=invert)


def truth(x: Lowered) -> Lowered:
    """To a predicate: booleans as they are with null false, all else by whether it exists."""
    if x.kind == "boolean":
        return x if x.test is not None else predicate(x.col)
    if x.kind == "null":
        return predicate(F.lit(False))
    return predicate(x.exists)


def negated(x: Lowered) -> Lowered:
    if x.invert is not None:
        return predicate(x.invert, x.test)
    return predicate(~F.coalesce(truth(x).test, F.lit(False)), truth(x).test)


def number(x: Lowered) -> Column:
    if x.kind in ("integer", "number", "time", "interval"):
        return x.col
    if x.kind == "boolean":
        return x.col.cast("double")
    if x.kind == "text":
        return F.when(F.lower(x.col) == "true", 1.0).when(F.lower(x.col) == "false", 0.0).otherwise(x.col.try_cast("double"))
    if x.kind == "union":
        fields = {f.name for f in x.dtype.fields}
        parts = [x.col["~n"].cast("double")] * ("~n" in fields) + [x.col["~b"].cast("double")] * ("~b" in fields) + [x.col["~s"].try_cast("double")] * ("~s" in fields)
        return F.coalesce(*parts)
    return F.lit(None).cast("double")


def number_kind(*xs: Lowered) -> str:
    return "integer" if all(x.kind in ("integer", "boolean", "null") for x in xs) and any(x.kind == "integer" for x in xs) else "number"


def text(x: Lowered) -> Column:
    """Numbers without a trailing .0; booleans as true and false; objects and lists as JSON."""
    if x.kind in ("text",):
        return x.col
    if x.kind in ("number", "time", "interval"):
        return number_text(x.col)
    if x.kind in ("integer", "boolean"):
        return x.col.cast("string")
    if x.kind == "union":
        fields = {f.name for f in x.dtype.fields}
        parts = [x.col["~s"]] * ("~s" in fields) + [number_text(x.col["~n"])] * ("~n" in fields) + [x.col["~b"].cast("string")] * ("~b" in fields)
        return F.nullif(F.coalesce(*parts), F.lit(""))
    if x.kind == "null":
        return F.lit(None).cast("string")
    return F.to_json(x.col)


def number_text(c: Column) -> Column:
    whole = (c == F.floor(c)) & (F.abs(c) < 9e15)
    return F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))


def aligned(a: Lowered, b: Lowered) -> tuple[Column, Column]:
    """Both sides in one type for a comparison; sides that cannot be equal get types that compare as text."""
    if "null" in (a.kind, b.kind):
        return a.col, b.col
    if a.kind == b.kind and a.kind not in ("union", "array"):
        return a.col, b.col
    if "union" in (a.kind, b.kind):
        other = b.kind if a.kind == "union" else a.kind
        if other in (*NUMBERS, "boolean"):
            only = lambda x: x.col["~n"].cast("double") if x.kind == "union" and "~n" in x.dtype.fieldNames() else number(x)
            return only(a), only(b)
        return text(a), text(b)
    if a.kind in NUMBERS and b.kind in NUMBERS:
        return a.col, b.col
    if "boolean" in (a.kind, b.kind):
        a, b = (constant(x.constant in ("T", "true", True, 1)) if x.is_constant and x.kind == "text" and x.constant in ("T", "F", "true", "false") else x for x in (a, b))
        if a.kind == b.kind:
            return a.col, b.col
    if a.kind in (*NUMBERS, "boolean") and b.kind in (*NUMBERS, "boolean"):
        return number(a), number(b)
    if "text" in (a.kind, b.kind) and "array" not in (a.kind, b.kind):
        return text(a), text(b)
    return a.col, b.col


def equal(a: Lowered, b: Lowered) -> Lowered:
    """Both missing: true; one missing: false."""
    if a.kind == "array" and b.kind != "array" and a.dtype is not None:
        return member(b, a)
    if b.is_constant and b.kind == "array":
        return member(a, b)
    if a.is_constant and a.kind == "null":
        a, b = b, a
    if b.is_constant and b.kind == "null":
        return predicate(a.col.isNull()) if not a.is_constant else predicate(F.lit(a.kind == "null"))
    x, y = aligned(a, b)
    if b.is_constant or a.is_constant:
        # The constant exists, so plain equality decides; the untouched column lets the scan filter.
        if a.raw is not None and a.kind == b.kind and a.kind == "text":
            x = a.raw
        elif b.raw is not None and a.kind == b.kind and b.kind == "text":
            y = b.raw
        return predicate(x == y)
    return predicate(x.eqNullSafe(y))


def differs(a: Lowered, b: Lowered) -> Lowered:
    """False if either is missing, and so not the complement of equal()."""
    if a.kind == "null" or b.kind == "null":
        return predicate(F.lit(False), F.lit(True))
    x, y = aligned(a, b)
    return predicate(x != y, F.coalesce(x == y, F.lit(True)))


def compared(op: Callable[[Column, Column], Column]) -> Callable[[Lowered, Lowered], Lowered]:
    def out(a: Lowered, b: Lowered) -> Lowered:
        if "null" in (a.kind, b.kind):
            return predicate(F.lit(False))
        if a.kind == "time" and b.is_constant and b.kind == "text":
            b = constant(parse_date(b.constant))
        if b.kind == "time" and a.is_constant and a.kind == "text":
            a = constant(parse_date(a.constant))
        if a.kind == "time" and b.is_constant and a.dtype is not None and b.kind in ("integer", "number"):
            # Compared as a time, so that the scan can filter.
            stamp = F.timestamp_micros(F.lit(round(b.constant * 1e6)))
            t = "timestamp_ntz" if isinstance(a.dtype, T.TimestampNTZType) else "timestamp"
            if not isinstance(a.dtype, T.DateType):
                return predicate(op(a.raw, stamp.cast(t)))
        both_text = a.kind == b.kind == "text"
        if both_text:
            x = a.raw if a.raw is not None and b.is_constant else a.col
            return predicate(op(x, b.col) if not (b.is_constant and x is a.raw) else op(x, b.col) & (x != ""))
        if a.parts or b.parts or "object" in (a.kind, b.kind):
            return predicate(op(a.col, b.col))
        x = a.raw if a.raw is not None and a.kind in ("integer", "number") and b.is_constant else number(a)
        if x is a.raw and a.kind == "number":  # the bounds keep NaN and infinities out, and reach the scan like the comparison
            return predicate(op(x, number(b)) & (x >= -LARGEST) & (x <= LARGEST))
        return predicate(op(x, number(b)))

    return out


def member(x: Lowered, group: Lowered) -> Lowered:
    """x in a literal list, or in an array column."""
    if group.kind == "null" or x.kind == "null":
        return predicate(F.lit(False))
    if group.is_constant and group.kind == "array":
        values = [p for p in group.parts if p.kind != "null"]
        if not values:
            return predicate(F.lit(False))
        if x.kind == "array":
            return predicate(reduce(lambda a, b: a | b, [member(v, x).col for v in values]))
        if x.kind == "text" and all(v.kind == "text" for v in values):
            return predicate((x.raw if x.raw is not None else x.col).isin([v.constant for v in values]))
        if x.kind in ("integer", "number") and all(v.kind in ("integer", "number") for v in values):
            return predicate(x.col.isin([v.constant for v in values]))
        return predicate(reduce(lambda a, b: a | b, [equal(x, v).col for v in values]))
    if group.kind == "array":
        element = group.dtype.elementType if isinstance(group.dtype, T.ArrayType) else None
        return predicate(F.exists(group.col, lambda e: equal(of_column(e, element) if element is not None else Lowered(e, x.kind), x).col))
    return equal(x, group)


def locate(v: Column, find: Column, start: Column) -> Column:
    """0-based place of find in v at or after start; null if there is none."""
    return F.nullif(F.call_function("locate", find, v, (start + 1).cast("int")), F.lit(0)) - 1


class Compiler:
    """Compiles expressions in a scope. functions: Python callables or Columns' functions by name, for `call`."""

    def __init__(self, scope: Scope, scripting: bool = False, functions: dict[str, Callable] | None = None, rows: Callable | None = None, now: float | None = None):
        self.scope, self.scripting, self.functions, self.rows, self.now = scope, scripting, functions or {}, rows, now

    def __call__(self, e: Any) -> Lowered:
        if isinstance(e, Lowered):
            return e
        if e is None or isinstance(e, (bool, int, float)):
            return constant(e)
        if isinstance(e, str):
            return self.variable(e)
        if isinstance(e, (list, tuple)):
            return self.tuple(list(e))
        if not isinstance(e, dict):
            if isinstance(e, Column):
                return Lowered(e, "object")
            return constant(parse_date(e, self.now))
        if not e:
            return null()
        if "when" in e:
            return self.choose([(e["when"], e.get("then"))], e.get("else"))
        if "from" in e and not any(k in OPERATORS for k in e if k not in ("from", "select", "where", "sort", "limit", "filter")):
            return self.nested(e)
        keys = [k for k in e if ALIASES.get(k, k) in OPERATORS]
        keys = [k for k in keys if k not in MODIFIERS] or keys
        if not keys:
            raise ExpressionError(f"no operator in {e!r}; known: {', '.join(sorted(OPERATORS))}")
        op = ALIASES.get(keys[0], keys[0])
        return OPERATORS[op](self, e[keys[0]], {k: v for k, v in e.items() if k != keys[0]})

    def condition(self, e: Any) -> Column:
        """A filter's condition: null counts as false."""
        return truth(self(e)).test

    def variable(self, name: str) -> Lowered:
        found = self.scope.find(name)
        return null() if found is None else of_column(*found)

    def tuple(self, items: list) -> Lowered:
        parts = tuple(self(x) for x in items)
        if len(parts) == 1:
            return parts[0]
        return Lowered(F.struct(*[p.col.alias(f"_{i}") for i, p in enumerate(parts)]), "object", parts=parts)

    def choose(self, cases: list[tuple[Any, Any]], other: Any) -> Lowered:
        results = [self(t) for _, t in cases] + [self(other)]
        kinds = {r.kind for r in results if r.kind != "null"}
        if not kinds:
            return null()
        if len(kinds) == 1:
            kind, form = kinds.pop(), lambda r: r.col
        elif kinds <= set(NUMBERS):
            kind, form = "number", lambda r: r.col.cast("double")
        elif kinds <= {*NUMBERS, "boolean"}:
            kind, form = "number", number
        else:
            kind, form = "text", text
        out = None
        for (c, _), r in zip(cases, results, strict=False):
            test = F.coalesce(truth(self(c)).test, F.lit(False))
            out = F.when(test, form(r)) if out is None else out.when(test, form(r))
        out = out.otherwise(form(results[-1]))
        dtype = next((r.dtype for r in results if r.dtype is not None), None)
        return Lowered(out, kind, dtype, test=out if kind == "boolean" else None)

    def nested(self, q: dict) -> Lowered:
        """A query over a list inside the row: where, select, sort and limit by higher-order functions."""
        source = self(q["from"]) if not isinstance(q["from"], list) else constant(q["from"])
        if source.kind == "null":
            return null()
        col, element = source.col, source.dtype.elementType
        within = lambda x: Compiler(Scope(element if isinstance(element, T.StructType) else T.StructType([T.StructField("value", element)]), aliases={".": (x, element)}, lookup=(lambda steps, x=x: x[steps[0]]) if isinstance(element, T.StructType) else (lambda steps, x=x: x)), self.scripting, self.functions)
        where = q.get("where", q.get("filter"))
        if where is not None:
            col = F.filter(col, lambda x: F.coalesce(within(x).condition(where), F.lit(False)))
        if q.get("sort"):
            keys = []
            for s in q["sort"] if isinstance(q["sort"], list) else [q["sort"]]:
                way: Any = 1
                if isinstance(s, dict) and "value" in s:
                    s, way = s["value"], s.get("sort", 1)
                elif isinstance(s, dict) and len(s) == 1 and next(iter(s.values())) in (1, -1, "asc", "desc"):
                    s, way = next(iter(s.items()))
                keys.append((s, way in (-1, "desc")))
            col = F.transform(col, lambda x: F.struct(*[within(x)(k).col.alias(f"k{i}") for i, (k, _) in enumerate(keys)], x.alias("v")))

            def compare(a: Column, b: Column) -> Column:
                """By each key in turn; missing ones come last."""
                out = F.lit(0)
                for i, (_, down) in reversed(list(enumerate(keys))):
                    x, y = a[f"k{i}"], b[f"k{i}"]
                    less, more = (1, -1) if down else (-1, 1)
                    out = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), 1).when(y.isNull(), -1).when(x < y, less).when(x > y, more).otherwise(out)
                return out

            col = F.transform(F.array_sort(col, compare), lambda x: x["v"])
        if q.get("groupby") is not None:
            by = q["groupby"][0] if isinstance(q["groupby"], list) else q["groupby"]
            name, key = (by.get("name") or by["value"], by["value"]) if isinstance(by, dict) and "value" in by else (str(by), by)
            lowered: list[Lowered] = []

            def key_of(x: Column) -> Column:
                lowered.append(within(x)(key))
                return lowered[-1].col

            kinds = F.array_distinct(F.transform(col, key_of))
            members = col
            out = F.transform(kinds, lambda k: F.struct(k.alias(name), F.filter(members, lambda x: within(x)(key).col.eqNullSafe(k)).alias("group")))
            kind = SPARK_TYPES.get(lowered[0].kind) or lowered[0].dtype or T.StringType()
            element = T.StructType([T.StructField(name, kind), T.StructField("group", T.ArrayType(element))])
            return Lowered(F.when(F.size(col) > 0, out), "array", T.ArrayType(element))
        if q.get("limit") is not None:
            col = F.slice(col, 1, int(q["limit"]))
        select = q.get("select")
        if select not in (None, "*", "."):
            made = [None]

            def pick(x):
                if isinstance(select, list):
                    cols = [(s if isinstance(s, str) else s.get("name") or s["value"], within(x)(s if isinstance(s, str) else s["value"])) for s in select]
                    return F.struct(*[c.col.alias(n) for n, c in cols])
                made[0] = within(x)(select["value"] if isinstance(select, dict) and "value" in select else select)
                return made[0].col

            col = F.transform(col, pick)
            if made[0] is not None:
                element = SPARK_TYPES.get(made[0].kind) or made[0].dtype or element
        return Lowered(F.when(F.size(col) > 0, col), "array", T.ArrayType(element))


SPARK_TYPES = {"text": T.StringType(), "integer": T.LongType(), "boolean": T.BooleanType(), "number": T.DoubleType(), "time": T.DoubleType(), "interval": T.DoubleType()}
OPERATORS: dict[str, Callable[[Compiler, Any, dict], Lowered]] = {}
MODIFIERS = ("default", "nulls", "separator", "start", "comment", "name")
# Other names of operators.
ALIASES = {
    "ge": "gte", "le": "lte", "neq": "ne", "term": "eq", "terms": "in", "equal": "eq", "minus": "sub", "subtract": "sub", "divide": "div",
    "mult": "mul", "multiply": "mul", "instr": "find", "postfix": "suffix", "regexp": "regex", "to_text": "text", "match_all": "true",
    "groupby": "group", "group by": "group", "average": "avg", "mean": "avg", "minimum": "min", "maximum": "max", "where": "filter",
    "meta": "comment", "to_number": "number", "to_boolean": "boolean", "to_integer": "integer", "power": "exp", "pow": "exp",
}


def operator(*names: str):
    def put(f):
        for n in names:
            OPERATORS[n] = f
        return f

    return put


def pairs(c: Compiler, p: Any) -> list[tuple[Lowered, Lowered]]:
    """[a, b], or {variable: constant, ...}."""
    if isinstance(p, dict):
        return [(c(k), literal_side(c, v)) for k, v in p.items()]
    a, b = p
    return [(c(a), c(b))]


def literal_side(c: Compiler, v: Any) -> Lowered:
    if isinstance(v, dict) and v and not (set(v) == {"date"}):
        return c(v)
    return constant(v)


def binary(f: Callable[[Lowered, Lowered], Lowered]):
    def out(c: Compiler, p: Any, mods: dict) -> Lowered:
        found = [f(a, b) for a, b in pairs(c, p)]
        return found[0] if len(found) == 1 else conjunction(found)

    return out


def conjunction(xs: list[Lowered]) -> Lowered:
    xs = [truth(x) for x in xs]
    if not xs:
        return predicate(F.lit(True))
    return predicate(reduce(lambda a, b: a & b, [x.test for x in xs]), reduce(lambda a, b: a | b, [negated(x).col for x in xs]))


def disjunction(xs: list[Lowered]) -> Lowered:
    xs = [truth(x) for x in xs]
    if not xs:
        return predicate(F.lit(False))
    return predicate(reduce(lambda a, b: a | b, [x.test for x in xs]), reduce(lambda a, b: a & b, [negated(x).col for x in xs]))


def terms(c: Compiler, p: Any) -> list[Lowered]:
    if isinstance(p, dict) and not any(ALIASES.get(k, k) in OPERATORS for k in p) and not {"when", "from"} & set(p):
        return [x for k, v in p.items() for x in (c(k), literal_side(c, v))]
    return [c(x) for x in p] if isinstance(p, (list, tuple)) else [c(p)]


for _name, _f in {"eq": equal, "ne": differs, "gt": compared(lambda a, b: a > b), "gte": compared(lambda a, b: a >= b), "lt": compared(lambda a, b: a < b), "lte": compared(lambda a, b: a <= b)}.items():
    OPERATORS[_name] = binary(_f)

operator("and")(lambda c, p, m: conjunction([c(x) for x in (p if isinstance(p, list) else [p])]))
operator("or")(lambda c, p, m: disjunction([c(x) for x in (p if isinstance(p, list) else [p])]))
operator("not")(lambda c, p, m: negated(c(p)))
operator("true")(lambda c, p, m: constant(True))
operator("false")(lambda c, p, m: constant(False))
operator("null")(lambda c, p, m: null())
operator("comment")(lambda c, p, m: null())
operator("literal")(lambda c, p, m: constant(p))
operator("date")(lambda c, p, m: constant(parse_date(p, c.now)))
operator("duration")(lambda c, p, m: constant(parse_duration(p).seconds))
operator("get")(lambda c, p, m: get_path(c, p))
operator("tuple")(lambda c, p, m: c.tuple(p if isinstance(p, list) else [p]))
operator("name")(lambda c, p, m: c(m.get("value", p)))
operator("value")(lambda c, p, m: c(p))


@operator("in")
def _in(c: Compiler, p: Any, m: dict) -> Lowered:
    if isinstance(p, dict):
        return conjunction([member(c(k), c(v) if isinstance(v, str) else literal_side(c, v)) for k, v in p.items()])
    a, b = p
    return member(c(a), constant(b) if isinstance(b, list) else c(b))


@operator("range")
def _range(c: Compiler, p: dict, m: dict) -> Lowered:
    return conjunction([c({op: {k: v}}) for k, limits in p.items() for op, v in limits.items()])


@operator("missing")
def _missing(c: Compiler, p: Any, m: dict) -> Lowered:
    x = c(p)
    return predicate(~x.exists, x.exists)


@operator("exists")
def _exists(c: Compiler, p: Any, m: dict) -> Lowered:
    x = c(p)
    return predicate(x.exists, ~x.exists)


@operator("nested")
def _nested(c: Compiler, p: Any, m: dict) -> Lowered:
    """{path, where/query}: whether any member matches; with select, the members."""
    q = {"from": p["path"], "where": p.get("where", p.get("query", True)), **{k: p[k] for k in ("select", "sort", "limit") if k in p}}
    return c.nested(q)


@operator("coalesce")
def _coalesce(c: Compiler, p: Any, m: dict) -> Lowered:
    xs = [first_of(x) for x in terms(c, p)]
    xs = [x for x in xs if x.kind != "null"]
    if "default" in m:
        xs.append(c(m["default"]))
    if not xs:
        return null()
    kinds = {x.kind for x in xs}
    if len(kinds) == 1:
        return Lowered(F.coalesce(*[x.col for x in xs]), xs[0].kind, xs[0].dtype, test=F.coalesce(*[x.col for x in xs]) if kinds == {"boolean"} else None)
    form, kind = (number, "number") if kinds <= {*NUMBERS, "boolean"} else (text, "text")
    return Lowered(F.coalesce(*[form(x).cast("double") if kind == "number" else form(x) for x in xs]), kind)


@operator("default")
def _default(c: Compiler, p: Any, m: dict) -> Lowered:
    return OPERATORS["coalesce"](c, p, {})


def first_of(x: Lowered) -> Lowered:
    if x.kind == "array" and isinstance(x.dtype, T.ArrayType):
        return of_column(F.try_element_at(x.col, F.lit(1)), x.dtype.elementType)
    return x


@operator("case")
def _case(c: Compiler, p: list, m: dict) -> Lowered:
    last = p[-1] if not (isinstance(p[-1], dict) and "when" in p[-1]) else None
    return c.choose([(x["when"], x.get("then")) for x in p if isinstance(x, dict) and "when" in x], last)


for _kind, _members in {"boolean": ("boolean",), "integer": ("integer",), "number": NUMBERS, "text": ("text",)}.items():

    def _is(c: Compiler, p: Any, m: dict, kind=_kind, members=_members) -> Lowered:
        x = c(p)
        if x.kind == "union":
            field = {"boolean": "~b", "integer": "~n", "number": "~n", "text": "~s"}[kind]
            if field not in x.dtype.fieldNames():
                return null()
            return of_column(x.col[field], x.dtype[field].dataType)
        return x if x.kind in members else null()

    OPERATORS["is_" + _kind] = _is


def arithmetic(plain: Callable[[Column, Column], Column], identity: float):
    """n-ary. By default null if any term is; with nulls: true, null only if all are."""

    def out(c: Compiler, p: Any, m: dict) -> Lowered:
        xs = [x for x in terms(c, p)]
        if not xs or any(x.kind == "null" for x in xs) and not m.get("nulls"):
            return c(m["default"]) if "default" in m else null()
        xs = [x for x in xs if x.kind != "null"]
        if not xs:
            return c(m["default"]) if "default" in m else null()
        cols = [number(x) for x in xs]
        kind = number_kind(*xs)
        if m.get("nulls"):
            value = F.when(reduce(lambda a, b: a & b, [k.isNull() for k in cols]), None).otherwise(reduce(plain, [F.coalesce(k, F.lit(identity)) for k in cols]))
            kind = "number"
        else:
            value = reduce(plain, cols)
        if "default" in m:
            value = F.coalesce(value, number(c(m["default"])))
        return Lowered(value, kind)

    return out


OPERATORS["add"] = arithmetic(F.try_add, 0)
OPERATORS["mul"] = arithmetic(F.try_multiply, 1)


def two_numbers(f: Callable[[Column, Column], Column], kind: str | None = None):
    def out(c: Compiler, p: Any, m: dict) -> Lowered:
        a, b = pairs(c, p)[0]
        if a.kind == "text" and b.kind == "text" and a.is_constant:
            a = constant(parse_date(a.constant, c.now))
        if "null" in (a.kind, b.kind):
            return c(m["default"]) if "default" in m else null()
        value = f(number(a), number(b))
        if "default" in m:
            value = F.coalesce(value, number(c(m["default"])).cast("double"))
        return Lowered(value, kind or number_kind(a, b))

    return out


OPERATORS["sub"] = two_numbers(F.try_subtract)
OPERATORS["div"] = two_numbers(lambda a, b: F.try_divide(a.cast("double"), b.cast("double")), "number")
OPERATORS["exp"] = two_numbers(F.pow, "number")
OPERATORS["mod"] = two_numbers(lambda a, b: F.when(b > 0, F.pmod(a, F.when(b > 0, b))))


@operator("floor")
def _floor(c: Compiler, p: Any, m: dict) -> Lowered:
    if isinstance(p, (list, tuple)) and len(p) == 2 or isinstance(p, dict) and not any(ALIASES.get(k, k) in OPERATORS for k in p):
        a, b = pairs(c, p)[0]
        x, step = number(a), number(b)
        return Lowered(F.when(step > 0, F.floor(F.try_divide(x.cast("double"), step)) * step), number_kind(a, b))
    x = c(p[0] if isinstance(p, list) else p)
    return Lowered(F.floor(number(x)).cast("long"), "integer")


@operator("ceiling")
def _ceiling(c: Compiler, p: Any, m: dict) -> Lowered:
    if isinstance(p, (list, tuple)) and len(p) == 2:
        a, b = pairs(c, p)[0]
        return Lowered(F.when(number(b) > 0, F.ceil(F.try_divide(number(a).cast("double"), number(b))) * number(b)), number_kind(a, b))
    return Lowered(F.ceil(number(c(p))).cast("long"), "integer")


def one_number(f: Callable[[Column], Column], kind: str | None = "number"):
    def out(c: Compiler, p: Any, m: dict) -> Lowered:
        x = c(p)
        return null() if x.kind == "null" else Lowered(f(number(x)), kind or number_kind(x))

    return out


OPERATORS["abs"] = one_number(F.abs, None)
OPERATORS["sqrt"] = one_number(lambda x: F.when(x >= 0, F.sqrt(x)))
OPERATORS["log"] = one_number(lambda x: F.when(x > 0, F.ln(F.when(x > 0, x))))
OPERATORS["log10"] = one_number(lambda x: F.when(x > 0, F.log10(F.when(x > 0, x))))
OPERATORS["sign"] = one_number(F.signum)
OPERATORS["neg"] = one_number(lambda x: -x, None)
OPERATORS["from_unix"] = lambda c, p, m: Lowered(number(c(p)).cast("double"), "time")
OPERATORS["unix"] = lambda c, p, m: to_unix(c(p))


@operator("round")
def _round(c: Compiler, p: Any, m: dict) -> Lowered:
    x, digits = (c(p[0]), int(p[1])) if isinstance(p, list) else (c(p), int(m.get("decimal", 0)))
    return Lowered(F.round(number(x), digits), "number")


def to_unix(x: Lowered) -> Lowered:
    if x.kind == "text":
        forms = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")
        stamps = [F.try_to_timestamp(x.col, F.lit(f)) for f in forms]
        return Lowered(F.unix_micros(F.coalesce(*stamps)) / F.lit(1e6), "number")
    return Lowered(number(x).cast("double"), "number")


def over_terms(many: Callable[[list[Column]], Column], array: Callable[[Column], Column], kind: str | None = None):
    """An aggregate's row-wise form: over terms, or over the members of one list; missing ones do not count."""

    def out(c: Compiler, p: Any, m: dict) -> Lowered:
        xs = terms(c, p)
        if len(xs) == 1 and xs[0].parts:
            xs = list(xs[0].parts)
        if len(xs) == 1 and xs[0].kind == "array" and isinstance(xs[0].dtype, T.ArrayType):
            element = xs[0].dtype.elementType
            value_of = (lambda e: of_column(e, element).col) if kind == "integer" else (lambda e: number(of_column(e, element)).cast("double"))
            nums = F.filter(F.transform(xs[0].col, value_of), lambda e: e.isNotNull())
            value, out_kind = array(nums), kind or "number"
        else:
            live = [x for x in xs if x.kind != "null"]
            if not live:
                value = many([])
                return Lowered(value, kind or "null") if kind == "integer" else null()
            if kind is None and all(x.kind == "text" for x in live):
                value, out_kind = many([x.col for x in live]), "text"
            else:
                value, out_kind = many([number(x) if kind != "integer" else x.exists.cast("long") for x in live]), kind or number_kind(*live)
        if "default" in m:
            value = F.coalesce(value, c(m["default"]).col)
        return Lowered(value, out_kind)

    return out


def _total(cols: list[Column]) -> Column:
    return F.when(reduce(lambda a, b: a & b, [x.isNull() for x in cols]), None).otherwise(reduce(F.try_add, [F.coalesce(x, F.lit(0)) for x in cols]))


def _least(cols: list[Column]) -> Column:
    return F.least(*cols) if len(cols) > 1 else cols[0]


def _greatest(cols: list[Column]) -> Column:
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


_array_sum = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda x, y: x + y))
OPERATORS["sum"] = over_terms(_total, _array_sum)
OPERATORS["max"] = over_terms(_greatest, F.array_max)
OPERATORS["min"] = over_terms(_least, F.array_min)
OPERATORS["avg"] = over_terms(lambda cols: F.try_divide(_total(cols).cast("double"), reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in cols]).cast("double")), lambda a: F.try_divide(_array_sum(a), F.size(a)), "number")
OPERATORS["count"] = over_terms(lambda cols: reduce(lambda a, b: a + b, cols, F.lit(0).cast("long")), lambda a: F.size(a).cast("long"), "integer")
OPERATORS["product"] = over_terms(lambda cols: reduce(F.try_multiply, [F.coalesce(x, F.lit(1)) for x in cols]), lambda a: F.aggregate(a, F.lit(1.0), lambda x, y: x * y))


@operator("cardinality")
def _cardinality(c: Compiler, p: Any, m: dict) -> Lowered:
    x = c(p)
    if x.kind == "array":
        return Lowered(F.size(F.array_distinct(F.filter(x.col, lambda e: e.isNotNull()))).cast("long"), "integer")
    return Lowered(x.exists.cast("long"), "integer")


@operator("union")
def _union(c: Compiler, p: Any, m: dict) -> Lowered:
    xs = [x for x in terms(c, p) if x.kind != "null"]
    if not xs:
        return null()
    if all(x.kind == "array" for x in xs):
        col = F.array_sort(F.array_distinct(F.filter(F.flatten(F.array(*[F.coalesce(x.col, F.array().cast(x.dtype)) for x in xs])), lambda e: e.isNotNull())))
        return Lowered(F.when(F.size(col) > 0, col), "array", xs[0].dtype)
    kind = xs[0].kind
    col = F.array_sort(F.array_distinct(F.filter(F.array(*[x.col for x in xs]), lambda e: e.isNotNull())))
    return Lowered(F.when(F.size(col) > 0, col), "array", T.ArrayType({"text": T.StringType(), "integer": T.LongType(), "boolean": T.BooleanType()}.get(kind, T.DoubleType())))


@operator("percentile")
def _percentile(c: Compiler, p: Any, m: dict) -> Lowered:
    """Of a list's members, interpolated."""
    x, q = c(p), float(m.get("percentile", 0.5))
    a = F.array_sort(F.filter(F.transform(x.col, lambda e: e.cast("double")), lambda e: e.isNotNull()))
    at = (F.size(a) - 1) * q
    low, high = F.try_element_at(a, (F.floor(at) + 1).cast("int")), F.try_element_at(a, (F.ceil(at) + 1).cast("int"))
    return Lowered(low + (high - low) * (at - F.floor(at)), "number")


@operator("number")
def _number(c: Compiler, p: Any, m: dict) -> Lowered:
    x = c(p)
    return x if x.kind in NUMBERS else Lowered(number(x), "number")


@operator("integer")
def _integer(c: Compiler, p: Any, m: dict) -> Lowered:
    x = number(c(p))
    return Lowered(F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("long"), "integer")


@operator("boolean")
def _boolean(c: Compiler, p: Any, m: dict) -> Lowered:
    x = c(p)
    if x.kind == "text":
        return predicate(F.when(F.lower(x.col).isin("f", "false"), False).otherwise(x.exists))
    return truth(x)


@operator("text")
def _text(c: Compiler, p: Any, m: dict) -> Lowered:
    return Lowered(text(c(p)), "text")


@operator("concat")
def _concat(c: Compiler, p: Any, m: dict) -> Lowered:
    separator = m.get("separator", "")
    if isinstance(separator, dict):
        separator = c(separator).constant or ""
    xs = [x for x in terms(c, p) if x.kind != "null"]
    default = c(m["default"]) if "default" in m else null()
    if not xs:
        return default
    value = F.nullif(F.concat_ws(separator, *[text(x) for x in xs]), F.lit(""))
    return Lowered(value if default.kind == "null" else F.coalesce(value, text(default)), "text")


@operator("length")
def _length(c: Compiler, p: Any, m: dict) -> Lowered:
    x = c(p)
    if x.kind == "array":
        return Lowered(F.size(x.col).cast("long"), "integer")
    return null() if x.kind == "null" else Lowered(F.length(text(x)).cast("long"), "integer")


def sided(f: Callable[[Column, Column, Column], Column]):
    """f(text, n, length) with n at least 0; an empty result is missing."""

    def out(c: Compiler, p: Any, m: dict) -> Lowered:
        a, b = pairs(c, p)[0]
        v, n = text(a), F.greatest(F.lit(0), number(b).cast("int"))
        return Lowered(F.nullif(f(v, n, F.length(v)), F.lit("")), "text")

    return out


OPERATORS["left"] = sided(lambda v, n, size: F.substring(v, F.lit(1), n))
OPERATORS["right"] = sided(lambda v, n, size: F.substring(v, F.greatest(size - n, F.lit(0)) + 1, n))
OPERATORS["not_left"] = sided(lambda v, n, size: F.substring(v, n + 1, size))
OPERATORS["not_right"] = sided(lambda v, n, size: F.substring(v, F.lit(1), F.greatest(F.lit(0), size - n)))
for _n, _g in {"lower": F.lower, "upper": F.upper, "trim": F.trim}.items():
    OPERATORS[_n] = lambda c, p, m, g=_g: Lowered(F.nullif(g(text(c(p))), F.lit("")), "text")


@operator("substring")
def _substring(c: Compiler, p: list, m: dict) -> Lowered:
    """[text, start, end): 0-based."""
    v, start, end = text(c(p[0])), number(c(p[1])).cast("int"), number(c(p[2])).cast("int") if len(p) > 2 else None
    size = F.length(v) if end is None else end - start
    return Lowered(F.nullif(F.substring(v, start + 1, F.greatest(F.lit(0), size)), F.lit("")), "text")


@operator("find")
def _find(c: Compiler, p: Any, m: dict) -> Lowered:
    """The 0-based place, or default; as a condition, whether there is one."""
    a, b = pairs(c, p)[0]
    if "null" in (a.kind, b.kind):
        return c(m["default"]) if "default" in m else null()
    v, start = text(a), number(c(m["start"])).cast("int") if "start" in m else F.lit(0)
    place = locate(v, text(b), start).cast("long")
    if "default" in m:
        place = F.coalesce(place, number(c(m["default"])).cast("long"))
    return Lowered(place, "integer")


@operator("between")
def _between(c: Compiler, p: Any, m: dict) -> Lowered:
    """Between two texts, or two places; a null end is the text's own."""
    if isinstance(p, dict):
        ((value, (low, high)),) = p.items()
        v, low, high = c(value), constant(low), constant(high)
    else:
        v, low, high = (c(x) for x in p)
    s = text(v)
    start = number(c(m["start"])).cast("int") if "start" in m else F.lit(0)
    if low.kind in NUMBERS or high.kind in NUMBERS:
        begin = number(low).cast("int") if low.kind in NUMBERS else F.lit(0)
        end = number(high).cast("int") if high.kind in NUMBERS else F.length(s)
    else:
        begin = start if low.kind == "null" else locate(s, text(low), start) + F.length(text(low))
        end = F.length(s) if high.kind == "null" else locate(s, text(high), begin)
    value = F.nullif(F.substring(s, (begin + 1).cast("int"), F.greatest(F.lit(0), (end - begin).cast("int"))), F.lit(""))
    if "default" in m:
        value = F.coalesce(value, text(c(m["default"])))
    return Lowered(value, "text")


def affix(test: Callable[[Column, Column], Column]):
    def one(a: Lowered, b: Lowered) -> Lowered:
        if b.kind == "null":
            return predicate(F.lit(True))
        if a.kind == "null":
            return predicate(F.lit(False))
        v = a.raw if a.kind == "text" and a.raw is not None and b.is_constant else text(a)
        return predicate(test(v, text(b))) if b.is_constant else predicate(F.when(text(b).isNull(), True).otherwise(test(v, text(b))))

    return binary(one)


OPERATORS["prefix"] = affix(lambda v, x: v.startswith(x))
OPERATORS["suffix"] = affix(lambda v, x: v.endswith(x))


@operator("regex")
def _regex(c: Compiler, p: Any, m: dict) -> Lowered:
    """The whole text must match."""
    return conjunction([predicate(text(a).rlike("^(?s:" + b.constant + ")$")) for a, b in pairs(c, p)])


@operator("split")
def _split(c: Compiler, p: Any, m: dict) -> Lowered:
    a, b = pairs(c, p)[0]
    return Lowered(F.split(text(a), re.escape(b.constant)), "array", T.ArrayType(T.StringType()))


@operator("replace")
def _replace(c: Compiler, p: list, m: dict) -> Lowered:
    v, old, new = (c(x) for x in p)
    return Lowered(F.nullif(F.replace(text(v), text(old), F.coalesce(text(new), F.lit(""))), F.lit("")), "text")


def get_path(c: Compiler, p: Any) -> Lowered:
    base, *steps = p if isinstance(p, list) else list(p.items())[0]
    x = c(base)
    for step in steps:
        step = step["literal"] if isinstance(step, dict) and "literal" in step else step
        if x.kind == "array" and isinstance(step, int):
            x = of_column(F.try_element_at(x.col, F.lit(step + 1)), x.dtype.elementType)
        elif isinstance(x.dtype, T.StructType) and str(step) in x.dtype.fieldNames():
            x = of_column(x.col[str(step)], x.dtype[str(step)].dataType)
        elif isinstance(x.dtype, T.ArrayType) and isinstance(x.dtype.elementType, T.StructType) and str(step) in x.dtype.elementType.fieldNames():
            t = x.dtype.elementType[str(step)].dataType
            x = of_column(F.transform(x.col, picker(str(step))), T.ArrayType(t))
        else:
            return null()
    return x


@operator("first")
def _first(c: Compiler, p: Any, m: dict) -> Lowered:
    return first_of(c(p))


@operator("last")
def _last(c: Compiler, p: Any, m: dict) -> Lowered:
    x = c(p)
    return of_column(F.try_element_at(x.col, F.lit(-1)), x.dtype.elementType) if x.kind == "array" else x


@operator("offset")
def _offset(c: Compiler, p: Any, m: dict) -> Lowered:
    a, n = p if isinstance(p, list) else next(iter(p.items()))
    x = c(a)
    if x.parts:
        return x.parts[n] if 0 <= n < len(x.parts) else null()
    return of_column(F.try_element_at(x.col, F.lit(int(n) + 1)), x.dtype.elementType) if x.kind == "array" else (x if n == 0 else null())


@operator("limit")
def _limit(c: Compiler, p: Any, m: dict) -> Lowered:
    a, n = p if isinstance(p, list) else next(iter(p.items()))
    x = c(a)
    return Lowered(F.slice(x.col, 1, int(n)), "array", x.dtype) if x.kind == "array" else x


@operator("array")
def _array(c: Compiler, p: Any, m: dict) -> Lowered:
    x = c(p)
    if x.kind == "array":
        return x
    return Lowered(F.when(x.exists, F.array(x.col)), "array", T.ArrayType({"text": T.StringType(), "integer": T.LongType(), "boolean": T.BooleanType()}.get(x.kind, x.dtype or T.DoubleType())))


@operator("filter")
def _filter(c: Compiler, p: Any, m: dict) -> Lowered:
    """[list, condition]."""
    return c.nested({"from": p[0], "where": p[1]})


@operator("group")
def _group(c: Compiler, p: Any, m: dict) -> Lowered:
    """[list, key]: the list's members by key, each key with its group."""
    return c.nested({"from": p[0], "groupby": p[1]})


def encoding(name: str, form: Callable[[Column], Column], kind: str = "text") -> None:
    """A text's bytes (UTF-8) in another form, or back."""
    OPERATORS[name] = lambda c, p, m: Lowered(form(text(c(p))), kind)


encoding("base64", lambda x: F.base64(x.cast("binary")))
encoding("unbase64", lambda x: F.unbase64(x).cast("string"))
encoding("hex", lambda x: F.lower(F.hex(x.cast("binary"))))
encoding("unhex", lambda x: F.unhex(x).cast("string"))
encoding("md5", lambda x: F.md5(x.cast("binary")))
encoding("sha1", lambda x: F.sha1(x.cast("binary")))
encoding("sha256", lambda x: F.sha2(x.cast("binary"), 256))
encoding("crc32", lambda x: F.crc32(x.cast("binary")), "integer")


@operator("select")
def _select(c: Compiler, p: Any, m: dict) -> Lowered:
    if isinstance(p, list) and p and isinstance(p[0], dict) and "name" in p[0]:
        return Lowered(F.struct(*[c(x["value"]).col.alias(x["name"]) for x in p]), "object")
    if isinstance(p, list):
        return c.nested({"from": p[0], "select": p[1]})
    return Lowered(F.struct(*[c(v).col.alias(k) for k, v in p.items()]), "object")


@operator("leaves")
def _leaves(c: Compiler, p: Any, m: dict) -> Lowered:
    return Lowered(F.struct(*[c.scope._walk(steps)[0].alias(".".join(steps)) for steps, _ in c.scope.leaves(p)]), "object")


@operator("rows")
def _rows(c: Compiler, p: Any, m: dict) -> Lowered:
    """[name, offset]: the value of a neighbouring row, in a window."""
    if c.rows is None:
        raise ExpressionError("rows is for windows")
    name, offset = p if isinstance(p, list) else next(iter(p.items()))
    return c.rows(c(name), int(offset))


@operator("script")
def _script(c: Compiler, p: str, m: dict) -> Lowered:
    if not c.scripting:
        raise ExpressionError("scripting is off")
    return Lowered(F.expr(p), "object")


@operator("call")
def _call(c: Compiler, p: list, m: dict) -> Lowered:
    """[name, arguments...]: a registered function; a udf's type decides the kind."""
    f = c.functions[p[0]]
    t = getattr(f, "returnType", None)
    out = f(*[c(x).col for x in p[1:]])
    return of_column(out, t) if t is not None else Lowered(out, "object")

