"""Aggregates by name. All ignore missing values; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lathe.functions.scalar import ExpressionError, Lowered, number

# Other names of aggregates.
ALIASES = {
    "value_count": "count", "N": "count", "s0": "count", "X0": "count", "add": "sum", "s1": "sum", "X1": "sum", "sos": "s2", "X2": "s2",
    "sum_of_squares": "s2", "average": "avg", "mean": "avg", "minimum": "min", "maximum": "max", "variance": "var", "stddev": "std",
    "distinct": "cardinality", "bool_and": "and", "bool_or": "or",
}
NAMES = (
    "count", "one", "exists", "sum", "s2", "s3", "s4", "avg", "min", "max", "and", "or", "median", "percentile", "cardinality", "var", "std",
    "skew", "kurtosis", "stats", "union", "count_values", "list", "first", "last", "product", "none", "any",
)


def canonical(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in NAMES:
        raise ExpressionError(f"no aggregate named {name!r}; known: {', '.join(NAMES)}")
    return name


def aggregate(name: str, x: Lowered | None, spec: dict | None = None, order: Column | None = None) -> Column:
    """The aggregate of x (None: of rows). spec may have percentile and default; order is what first, last and list follow."""
    spec = spec or {}
    name = canonical(name)
    out = _plain(name, x, spec, order)
    if spec.get("default") is not None and name != "none":
        out = F.coalesce(out, F.lit(spec["default"]))
    return out


def _plain(name: str, x: Lowered | None, spec: dict, order: Column | None) -> Column:
    if x is None:
        if name not in ("count", "exists"):
            raise ExpressionError(f"{name} needs a value")
        n = F.count(F.lit(1))
        return n if name == "count" else n > 0
    v = x.col
    n = number(x)
    if name == "count":
        if x.parts:
            return F.sum(sum((p.exists.cast("long") for p in x.parts), F.lit(0)))
        return F.count(v) if x.kind != "null" else F.sum(F.lit(0).cast("long"))
    if x.kind == "null":
        return F.max(F.lit(None))
    if name == "exists":
        return F.coalesce(F.max(x.exists), F.lit(False))
    if name == "one":
        # The single distinct value; several are an error.
        return F.when(F.min(v).eqNullSafe(F.max(v)), F.min(v)).otherwise(F.raise_error(F.lit("several values where one is expected")).cast("string"))
    if name == "sum":
        return F.sum(n)
    if name in ("s2", "s3", "s4"):
        return F.sum(F.pow(n.cast("double"), int(name[1])))
    if name == "product":
        return F.product(n)
    if name == "avg":
        return F.avg(n)
    if name in ("min", "max"):
        y = n if x.kind == "boolean" else v
        return F.min(y) if name == "min" else F.max(y)
    if name in ("and", "or"):
        b = v if x.kind == "boolean" else x.exists
        return F.bool_and(b) if name == "and" else F.bool_or(b)
    if name == "median":
        return F.median(n)
    if name == "percentile":
        q = spec.get("percentile", 0.5)
        if isinstance(q, str) or not 0 <= q <= 1:
            raise ExpressionError("percentile must be a number from 0 to 1")
        return F.percentile(n, float(q))
    if name == "cardinality":
        return F.count_distinct(v)
    if name == "var":
        return F.var_pop(n)
    if name == "std":
        return F.stddev_pop(n)
    if name == "skew":
        return F.skewness(n)
    if name == "kurtosis":
        return F.kurtosis(n)
    if name == "stats":
        return F.struct(
            F.count(n).alias("count"), F.stddev_pop(n).alias("std"), F.min(n).alias("min"), F.max(n).alias("max"), F.sum(n).alias("sum"),
            F.median(n).alias("median"), F.sum(n.cast("double") * n).alias("sos"), F.var_pop(n).alias("var"), F.avg(n).alias("avg"),
        )
    if name == "union":
        if x.kind == "array":
            return F.array_sort(F.array_distinct(F.flatten(F.collect_set(v))))
        return F.array_sort(F.collect_set(v))
    if name == "count_values":
        return counted(F.array_sort(F.collect_list(v)))
    if name == "list":
        if order is None:
            return F.collect_list(v)
        rows = F.when(x.exists, F.struct(order.alias("k"), v.alias("v")))
        return F.transform(F.array_sort(F.collect_list(rows)), lambda r: r["v"])
    if name in ("first", "last"):
        if order is None:
            return F.first(v, True) if name == "first" else F.last(v, True)
        key = F.when(x.exists, order)
        return F.min_by(v, key) if name == "first" else F.max_by(v, key)
    if name == "any":
        return F.any_value(v, True)
    raise ExpressionError(f"{name} is no aggregate of values")


def counted(values: Column) -> Column:
    """A map of the distinct members of a sorted list and how often each occurs, from the places where a new one begins."""
    n = F.size(values)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    first = F.filter(places, lambda i: (i == 1) | (F.element_at(values, i) != F.element_at(values, F.greatest(i - 1, F.lit(1)))))
    return F.map_from_arrays(F.transform(first, lambda i: F.element_at(values, i)), F.transform(first, lambda i, k: (F.coalesce(F.get(first, k + 1), n + 1) - i).cast("long")))
