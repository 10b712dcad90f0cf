"""Domains: the parts that an edge divides rows into.

A domain turns a value into the number of its part by arithmetic or by a constant map, so no join is needed to find parts; what
is in no part gets null. Parts are known on the driver, and their number is limited.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.functions.dates import Duration, add, parse_date, parse_duration
from lathe.functions.scalar import Compiler, ExpressionError, Lowered, NUMBERS, equal, number, text, truth

MAX_PARTS = 100_000


@dataclass
class Edge:
    """name, parts' keys, the part's number for a row (null: the null part), and whether rows cover many parts."""

    name: str
    parts: list[Any]
    index: Column
    type: str = "set"
    allow_nulls: bool = True
    show_null: bool = True
    many: bool = False  # index is then a list of numbers
    domain: dict = field(default_factory=dict)
    kind: str = "text"


def steps(low: float, high: float, step: Duration | float) -> list[float]:
    out, at = [], low
    while at < high:
        out.append(at)
        at = add(at, step) if isinstance(step, Duration) else at + step
        if len(out) > MAX_PARTS:
            raise ExpressionError(f"a domain of more than {MAX_PARTS} parts")
    return out


def numeric_index(v: Column, low: float, high: float, parts: list[float], step: float | None) -> Column:
    """Number of the part [part, next) that v is in; null outside [low, high). step: the parts' width if all are equal."""
    inside = (v >= low) & (v < high)
    if step:
        return F.when(inside, F.floor((v - low) / step).cast("int"))
    # Calendar months: the number of parts that begin at or before v, less one.
    return F.when(inside, F.size(F.filter(F.array(*[F.lit(float(p)) for p in parts]), lambda p: p <= v)) - 1)


def equal_steps(parts: list[float], high: float) -> float | None:
    widths = {round(b - a, 9) for a, b in zip(parts, [*parts[1:], high], strict=True)}
    return widths.pop() if len(widths) == 1 else (widths and len({round(b - a, 9) for a, b in zip(parts, parts[1:], strict=False)}) == 1 and parts[1] - parts[0]) or None


def top_parts(df: DataFrame, value: Lowered, limit: int) -> tuple[list[Any], bool]:
    """The distinct values, most frequent first, then by value; and whether any row is in none of them."""
    counts = df.select(value.col.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.orderBy(F.col("v").isNull(), F.desc("n"), F.asc("v")).limit(limit + 1).collect()
    parts = [r.v for r in rows if r.v is not None]
    more = len(parts) > limit
    null = any(r.v is None for r in rows) or (more and True)
    if not null and len(rows) == limit + 1:
        null = True
    elif not null:
        null = False
    parts = parts[:limit]
    return sorted(parts, key=lambda v: (str(type(v)), v) if not isinstance(v, dict) else str(v)), null


def make_edge(spec: Any, compile_: Compiler, df: DataFrame, limit: int) -> Edge:
    """An edge from its JSON form: a name, or {name, value, range, domain, allowNulls}."""
    if isinstance(spec, str):
        spec = {"name": spec, "value": spec}
    value = spec.get("value")
    name = spec.get("name") or (value if isinstance(value, str) else "edge")
    domain = spec.get("domain") or {"type": "default"}
    if isinstance(domain, str):
        domain = {"type": domain}
    allow = spec.get("allowNulls", domain.get("allowNulls", True))
    kind = domain.get("type", "set" if "partitions" in domain else "default")
    if kind in ("time", "duration", "range", "numeric"):
        return regular(name, spec, domain, kind, compile_, allow)
    if kind == "set" or "partitions" in domain:
        return listed(name, value, domain, compile_, allow)
    v = compile_(value)
    n = int(domain.get("limit", limit))
    if v.kind == "null":
        return Edge(name, [], F.lit(None).cast("int"), "set", allow, domain=domain)
    if kind in ("value", "uid", "unit"):
        n = MAX_PARTS
    if v.parts:
        v = Lowered(F.when(F.coalesce(*[p.col.cast("string") for p in v.parts]).isNotNull(), v.col), "object", parts=v.parts)
    many = v.kind == "array"
    flat = df.select(F.explode_outer(v.col).alias("v")) if many else df
    parts, null = top_parts(flat, Lowered(F.col("v"), "text") if many else v, n)
    if kind in ("value", "uid", "unit") and len(parts) == MAX_PARTS and null and flat.select((F.col("v") if many else v.col).alias("v")).where("v is not null").distinct().count() > MAX_PARTS:
        raise ExpressionError(f"edge {name!r} has more than {MAX_PARTS} parts")
    if v.parts:
        keys = [tuple(p) for p in parts]
        case = None
        for i, key in enumerate(keys):
            test = None
            for p, k in zip(v.parts, key, strict=True):
                t = p.col.eqNullSafe(F.lit(k))
                test = t if test is None else test & t
            case = F.when(test, i) if case is None else case.when(test, i)
        return Edge(name, [list(k) for k in keys], case if case is not None else F.lit(None).cast("int"), "set", allow, show_null=null, domain=domain, kind="tuple")
    number_of = mapped(parts)
    index = F.transform(v.col, number_of) if many else number_of(v.col)
    return Edge(name, parts, index, "set", allow, show_null=null, many=many, domain=domain, kind=v.kind)


def mapped(parts: list[Any]):
    """A function from a value to its place in parts, by a constant map."""
    if not parts:
        return lambda c: F.lit(None).cast("int")
    table = F.create_map(*[x for i, p in enumerate(parts) for x in (F.lit(p), F.lit(i))])
    return lambda c: F.try_element_at(table, c)


def listed(name: str, value: Any, domain: dict, compile_: Compiler, allow: bool) -> Edge:
    """Explicit parts: values, parts with where, or parts with a key (and name)."""
    parts = domain.get("partitions", domain.get("values", []))
    key = domain.get("key", "value")
    if parts and all(isinstance(p, dict) and ("where" in p or "min" in p) for p in parts):
        case = None
        v = compile_(value) if value is not None else None
        for i, p in enumerate(parts):
            test = F.coalesce(truth(compile_(p["where"])).test, F.lit(False)) if "where" in p else (number(v) >= p["min"]) & (number(v) < p["max"])
            case = F.when(test, i) if case is None else case.when(test, i)
        return Edge(name, [p.get("name", p.get("value", i)) for i, p in enumerate(parts)], case, "set", allow, domain=domain)
    values = [p.get(key, p.get("value", p.get("name"))) if isinstance(p, dict) else p for p in parts]
    shown = [p.get("name", p.get(key, p.get("value"))) if isinstance(p, dict) else p for p in parts]
    v = compile_(value)
    if v.kind == "array":
        return Edge(name, shown, F.transform(v.col, mapped(values)), "set", allow, many=True, domain=domain)
    if v.parts or v.kind in ("object", "null", "union", "boolean"):
        case = None
        for i, x in enumerate(values):
            xs = x if isinstance(x, list) else [x]
            sides = v.parts or (v,)
            test = None
            for a, b in zip(sides, xs, strict=False):
                t = equal(a, compile_({"literal": b})).col
                test = t if test is None else test & t
            case = F.when(test, i) if case is None else case.when(test, i)
        return Edge(name, shown, case if case is not None else F.lit(None).cast("int"), "set", allow, domain=domain)
    col = v.col
    if v.kind in NUMBERS and all(isinstance(x, (int, float)) for x in values):
        col, values = col.cast("double"), [float(x) for x in values]
    elif v.kind != "text":
        col, values = text(v), [str(x) for x in values]
    return Edge(name, shown, mapped(values)(col), "set", allow, domain=domain, kind=v.kind)


def regular(name: str, spec: dict, domain: dict, kind: str, compile_: Compiler, allow: bool) -> Edge:
    """time, duration and range domains: parts [min, max) of one width, or irregular parts."""
    if kind == "time":
        read = lambda x: parse_date(x, compile_.now)
    elif kind == "duration":
        read = lambda x: parse_duration(x).seconds
    else:
        read = float
    span = spec.get("range")
    if domain.get("partitions"):
        ends = [(read(p["min"]), read(p["max"])) for p in domain["partitions"]]
        shown = [p.get("name", p["min"]) for p in domain["partitions"]]
        part_index = None
    else:
        low, high = read(domain["min"]), read(domain["max"])
        step = parse_duration(domain.get("interval", "day" if kind == "time" else "day")) if kind != "range" else float(domain.get("interval", high - low))
        months = isinstance(step, Duration) and kind == "time" and step.months
        parts = steps(low, high, step if months else (step.seconds if isinstance(step, Duration) else step))
        ends = list(zip(parts, [*parts[1:], high], strict=True))
        shown = parts
        part_index = lambda v: numeric_index(v, low, high, parts, None if months else (step.seconds if isinstance(step, Duration) else step))
    if kind == "numeric":
        v = number(compile_(spec["value"]))
        return Edge(name, [ends[0][0]], F.when((v >= ends[0][0]) & (v < ends[-1][1]), 0), kind, allow, domain=domain)
    if span:
        # The row covers every part that its own range meets (or, as a snapshot, whose beginning lies in the range).
        a, b = number(compile_(span["min"])), number(compile_(span["max"]))
        snapshot = span.get("mode") == "snapshot"
        begin, end = F.array(*[F.lit(float(x)) for x, _ in ends]), [float(y) for _, y in ends]
        n = len(ends)
        if part_index and not domain.get("partitions") and isinstance(shown[0] if shown else 0.0, float) and equal_steps([x for x, _ in ends], ends[-1][1]):
            width = ends[0][1] - ends[0][0]
            low = ends[0][0]
            first = F.ceil((a - low) / width) if snapshot else F.floor((a - low) / width)
            last = F.ceil((b - low) / width) - 1
            first, last = F.greatest(F.lit(0), first).cast("int"), F.least(F.lit(n - 1), last).cast("int")
            index = F.when(first <= last, F.sequence(first, last))
        else:
            tests = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("i"), F.element_at(begin, i + 1).alias("x"), F.element_at(F.array(*[F.lit(y) for y in end]), i + 1).alias("y")))
            met = F.filter(tests, lambda p: ((a <= p["x"]) & (p["x"] < b)) if snapshot else ((p["x"] < b) & (a < p["y"])))
            index = F.when(F.size(met) > 0, F.transform(met, lambda p: p["i"]))
        return Edge(name, shown, index, kind, allow, many=True, domain=domain)
    v = number(compile_(spec["value"]))
    if part_index is None:
        case = None
        for i, (x, y) in enumerate(ends):
            case = F.when((v >= x) & (v < y), i) if case is None else case.when((v >= x) & (v < y), i)
        return Edge(name, shown, case, kind, allow, domain=domain, kind="number")
    return Edge(name, shown, part_index(v), kind, allow, domain=domain, kind="number")
