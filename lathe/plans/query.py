"""JSON queries to DataFrames.

from, select, where, groupby or edges, window, sort, limit and format become one lazy plan. Only domains whose parts are asked
from the data run a query of their own, which returns no more rows than the domain's limit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions.scalar import Compiler, ExpressionError, Lowered, of_column, truth
from lathe.operators.aggregates import aggregate, canonical
from lathe.operators.domains import Edge, make_edge
from lathe.plans.schema import Scope, join_path, quoted, split_path

DEFAULT_LIMIT = 10
#: The most cells a dense result may have.
MAX_CELLS = 1_000_000
CLAUSES = ("from", "select", "where", "filter", "groupby", "edges", "window", "sort", "limit", "format", "having", "distinct")


@dataclass
class Select:
    name: str
    value: Any
    aggregate: str = "none"
    spec: dict = field(default_factory=dict)


@dataclass
class Plan:
    """A query's DataFrame, and what formats need: names of selects and edges."""

    df: DataFrame
    selects: list[str]
    edges: list[Edge] = field(default_factory=list)
    groups: list[str] = field(default_factory=list)
    kind: str = "set"  # set, group, edges, value
    format: str = "list"
    whole: bool = False  # each row is one value, named "."


class NestedScope(Scope):
    """Names when rows are members of a list: the member's own first, then all of the document."""

    def __init__(self, schema: T.StructType, path: list[str], item: str, element: T.DataType, outer: Scope):
        super().__init__(schema)
        self.path, self.item, self.element, self.outer = path, item, element, outer

    def _member(self, steps: list[str]):
        if not steps:
            return F.col(quoted(self.item)), self.element
        if not isinstance(self.element, T.StructType):
            return None
        return Scope(self.element, lookup=lambda s: F.col(quoted(self.item))[s[0]])._walk(steps)

    def _walk(self, steps: list[str]):
        if steps[: len(self.path)] == self.path:
            return self._member(steps[len(self.path) :])
        return self.outer._walk(steps)

    def find(self, name: str):
        steps = split_path(name)
        found = self._member(steps)
        return found or self._walk(steps) if steps else found

    def leaves(self, name: str = "."):
        steps = split_path(name)
        found = self._member(steps)
        if found and isinstance(found[1], T.StructType):
            return [(self.path + steps + s, t) for s, t in Scope(found[1]).leaves(".")]
        return [(self.path + steps, found[1])] if found else []


class Engine:
    """Runs queries over named tables. tables: names to DataFrames, or functions that give them; other names are views of the session."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | Callable[[], DataFrame]] | None = None, scripting: bool = False, functions: dict[str, Callable] | None = None, limit: int | None = DEFAULT_LIMIT, now: float | None = None, dimensions: dict[str, Any] | None = None):
        self.dimensions = dimensions or {}
        self.spark, self.tables, self.scripting, self.functions, self.limit, self.now = spark, tables or {}, scripting, functions or {}, limit, now

    # sources

    def table(self, name: str) -> DataFrame | None:
        if name in self.tables:
            t = self.tables[name]
            return t() if callable(t) and not isinstance(t, DataFrame) else t
        if name.startswith("meta."):
            return self.meta(name)
        return self.spark.table(name) if "." not in name and self.spark.catalog.tableExists(name) else None

    def meta(self, name: str) -> DataFrame:
        """meta.tables and meta.columns, from the schemas."""
        rows = []
        for t in self.tables:
            for steps, kind in Scope(self.table(t).schema).leaves():
                rows.append((t, join_path(steps), of_column(F.lit(None), kind).kind, kind.simpleString()))
        if name == "meta.tables":
            return self.spark.createDataFrame([(t,) for t in self.tables], "name string")
        return self.spark.createDataFrame(rows, "table string, name string, kind string, type string")

    def source(self, frum: Any) -> tuple[DataFrame, Scope]:
        from lathe.sources.store import from_rows

        if isinstance(frum, DataFrame):
            return frum, Scope(frum.schema)
        if isinstance(frum, (list, tuple)):
            df = from_rows(self.spark, list(frum))
            return df, Scope(df.schema)
        if isinstance(frum, dict):
            df = self.plan(frum, inner=True).df
            return df, Scope(df.schema)
        steps = split_path(frum)
        for k in range(len(steps), 0, -1):
            df = self.table(".".join(steps[:k]))
            if df is not None:
                return self.members(df, steps[k:])
        raise ExpressionError(f"no table named {frum!r}")

    def members(self, df: DataFrame, path: list[str]) -> tuple[DataFrame, Scope]:
        """One row for each member of the lists along path; the document's columns stay visible."""
        scope = Scope(df.schema)
        done: list[str] = []
        for i, step in enumerate(path):
            done.append(step)
            found = scope._walk(done)
            if found is None:
                raise ExpressionError(f"no path {'.'.join(path)!r}")
            col, t = found
            if isinstance(t, T.ArrayType):
                item = f"__item{i}"
                df = df.select("*", F.posexplode(col).alias(f"__order{i}", item))
                scope = NestedScope(df.schema, list(done), item, t.elementType, scope)
        if isinstance(scope, NestedScope) and scope.path == path:
            return df, scope
        return df, Scope(df.schema, path)

    # clauses

    def compiler(self, scope: Scope, rows=None) -> Compiler:
        return Compiler(scope, self.scripting, self.functions, rows, self.now)

    def selects(self, q: dict, scope: Scope, default: Any) -> tuple[list[Select], bool]:
        """Normal form of the select clause; and whether rows are bare values."""
        s = q.get("select", default)
        if s is None:
            return [], False
        bare = isinstance(s, (str, dict)) and s != "*" and not (isinstance(s, str) and s.endswith(".*"))
        out: list[Select] = []
        for x in s if isinstance(s, list) else [s]:
            if isinstance(x, str):
                if x == "*" or x.endswith(".*"):
                    base = x.removesuffix("*").removesuffix(".") or "."
                    hidden = len(scope.path) if isinstance(scope, NestedScope) else 0
                    out += [Select(join_path(p[hidden:] or p), join_path(p)) for p, _ in scope.leaves(base) if not p[0].startswith("__")]
                else:
                    out.append(Select(x, x))
                continue
            if not isinstance(x, dict):
                out.append(Select(str(x), x))
                continue
            if "value" not in x and "aggregate" not in x and "name" not in x:
                out.append(Select(next(iter(x)), x))
                continue
            value = x.get("value")
            agg = x.get("aggregate", "none")
            name = x.get("name") or (value if isinstance(value, str) and value != "." else None) or (agg if agg != "none" else ".")
            spec = {k: x[k] for k in ("default", "percentile") if k in x}
            if isinstance(value, str) and value.endswith(".*"):
                base = value[:-2]
                out += [Select(join_path([*split_path(name), *p[len(split_path(base)) :]]), join_path(p)) for p, _ in scope.leaves(base)]
                continue
            out.append(Select(name, value, agg, spec))
        names = [o.name for o in out]
        if len(set(names)) < len(names):
            raise ExpressionError(f"two selects of one name in {names}")
        return out, bare

    def plan(self, q: dict, inner: bool = False) -> Plan:
        known = {"from", "meta", "comment", "chunk_size", "destination", *CLAUSES}
        if bad := set(q) - known:
            raise ExpressionError(f"unknown clauses {sorted(bad)}")
        if q.get("edges") and q.get("groupby"):
            raise ExpressionError("a query has edges or groupby, not both")
        df, scope = self.source(q["from"])
        where = q.get("where", q.get("filter"))
        if where is not None and where is not True:
            df = df.where(self.compiler(scope).condition(where))
        limit = q.get("limit", None if inner else self.limit)
        if limit is not None and limit < 0:
            raise ExpressionError("limit must not be negative")
        selects = q.get("select")
        aggregates = any(isinstance(s, dict) and s.get("aggregate", "none") != "none" for s in (selects if isinstance(selects, list) else [selects]))
        if q.get("edges") is not None and q.get("edges") != []:
            plan = self.dense(q, df, scope, limit)
        elif q.get("groupby") is not None and q.get("groupby") != []:
            plan = self.grouped(q, df, scope)
        elif aggregates:
            plan = self.total(q, df, scope)
        else:
            plan = self.rows(q, df, scope)
        if q.get("having") is not None:
            plan.df = plan.df.where(self.compiler(Scope(plan.df.schema)).condition(q["having"]))
        if q.get("window"):
            from lathe.operators.windows import with_windows

            plan = with_windows(self, plan, q["window"])
        if q.get("distinct"):
            plan.df = plan.df.distinct()
        if plan.kind != "set" and q.get("sort"):
            plan.df = plan.df.orderBy(*self.order(q["sort"], Scope(plan.df.schema), plan))
        if plan.kind in ("set", "group") and limit is not None:
            plan.df = plan.df.limit(int(limit))
        plan.format = q.get("format", "list")
        return plan

    def order(self, sort: Any, scope: Scope, plan: Plan | None = None) -> list[Column]:
        """Missing values come last in both directions; mixed types by type, then value."""
        out = []
        for s in sort if isinstance(sort, list) else [sort]:
            way: Any = 1
            value = s
            if isinstance(s, int) and not isinstance(s, bool):
                value = plan.selects[s] if plan else scope.schema.names[s]
            elif isinstance(s, dict) and ("value" in s or "field" in s):
                value, way = s.get("value", s.get("field")), s.get("sort", 1)
            elif isinstance(s, dict) and len(s) == 1 and next(iter(s.values())) in (1, -1, 0, "asc", "desc", "ascending", "descending", "none"):
                value, way = next(iter(s.items()))
            if way in (0, "none"):
                continue
            down = way in (-1, "desc", "descending")
            if plan and isinstance(value, str) and (e := next((e for e in plan.edges if e.name == value), None)):
                cols = [F.col(quoted(f"__{e.name}"))] if f"__{e.name}" in plan.df.columns else [F.col(quoted(value))]
            elif plan and isinstance(value, str) and value in plan.df.columns:
                cols = [F.col(quoted(value))]
            else:
                x = self.compiler(scope)(value)
                if x.kind == "union":
                    names = x.dtype.fieldNames()
                    cols = [F.when(x.exists, F.coalesce(*[F.when(x.col[n].isNotNull(), i) for i, n in enumerate(("~b", "~n", "~s")) if n in names])), *[x.col[n] for n in ("~b", "~n", "~s") if n in names]]
                else:
                    cols = [x.col]
            out += [c.desc_nulls_last() if down else c.asc_nulls_last() for c in cols]
        return out

    def rows(self, q: dict, df: DataFrame, scope: Scope) -> Plan:
        if q.get("sort"):
            df = df.orderBy(*self.order(q["sort"], scope))
        if q.get("select") is None and "select" not in q and not isinstance(scope, NestedScope) and not scope.prefix:
            return Plan(df, df.columns, whole=False)
        items, bare = self.selects(q, scope, "." if isinstance(scope, NestedScope) or scope.prefix else "*")
        c = self.compiler(scope)
        if any(_mentions(s.value, "rownum") for s in items) and scope.find("rownum") is None:
            from lathe.operators.lists import with_rownum

            df = with_rownum(df, "__rownum")
            scope.aliases = scope.aliases | {"rownum": (F.col("__rownum"), T.LongType())}
        if bare and items and items[0].value == "." and isinstance(scope, NestedScope) and isinstance(scope.element, T.StructType):
            item = F.col(quoted(scope.item))
            return Plan(df.select(*[item[n].alias(n) for n in scope.element.names]), scope.element.names)
        exploded, cols = df, []
        for s in items:
            x = c(s.value)
            cols.append(self._shown(x, s).alias(s.name))
        out = exploded.select(*cols)
        return Plan(out, [s.name for s in items], whole=bare and len(items) == 1)

    @staticmethod
    def _shown(x: Lowered, s: Select) -> Column:
        return F.coalesce(x.col, F.lit(s.spec["default"])) if s.spec.get("default") is not None else x.col

    @staticmethod
    def ordered(q: dict, df: DataFrame) -> DataFrame:
        """df with the order of its rows, if an aggregate follows it."""
        s = q.get("select")
        wants = any(isinstance(x, dict) and x.get("aggregate") in ("list", "first", "last") for x in (s if isinstance(s, list) else [s]))
        return df.withColumn("__seq", F.monotonically_increasing_id()) if wants else df

    def measures(self, items: list[Select], c: Compiler) -> list[Column]:
        out = []
        for s in items:
            if s.aggregate == "none" and s.value is not None and s.value != ".":
                raise ExpressionError(f"select {s.name!r} of a grouped query needs an aggregate")
            x = None if s.value in (None, ".") else c(s.value)
            order = F.col("__seq") if s.aggregate in ("list", "first", "last") else None
            out.append(aggregate("count" if s.aggregate == "none" else s.aggregate, x, s.spec, order).alias(s.name))
        return out

    def total(self, q: dict, df: DataFrame, scope: Scope) -> Plan:
        items, bare = self.selects(q, scope, None)
        out = self.ordered(q, df).agg(*self.measures(items, self.compiler(scope)))
        return Plan(out, [s.name for s in items], kind="value", whole=bare and len(items) == 1)

    def grouped(self, q: dict, df: DataFrame, scope: Scope) -> Plan:
        keys: list[tuple[str, Any]] = []
        by = q["groupby"]
        for g in by if isinstance(by, list) else [by]:
            if isinstance(g, str) and (g == "*" or g.endswith(".*")):
                base = g.removesuffix("*").removesuffix(".") or "."
                keys += [(join_path(p), join_path(p)) for p, _ in scope.leaves(base)]
            elif isinstance(g, dict):
                if "domain" in g and (g["domain"] if isinstance(g["domain"], str) else g["domain"].get("type", "default")) != "default":
                    raise ExpressionError("groupby takes only default domains; use edges")
                keys.append((g.get("name") or g["value"], g["value"]))
            else:
                keys.append((g, g))
        c = self.compiler(scope)
        lowered = [(n, c(v)) for n, v in keys]
        items, _ = self.selects(q, scope, {"name": "count", "aggregate": "count"})
        names = {n for n, _ in keys}
        items = [s for s in items if not (s.aggregate == "none" and s.name in names)]
        out = self.ordered(q, df).groupBy(*[x.col.alias(n) for n, x in lowered]).agg(*self.measures(items, c))
        return Plan(out, [s.name for s in items], groups=[n for n, _ in keys], kind="group")

    def dense(self, q: dict, df: DataFrame, scope: Scope, limit: int | None) -> Plan:
        """Groups over domains: every part, and the null part, has a row. Rows are counted by part numbers; the grid of numbers,
        limited to MAX_CELLS, is joined with the counts."""
        c = self.compiler(scope)
        spec = q["edges"] if isinstance(q["edges"], list) else [q["edges"]]
        spec = [d for e in spec for d in self.dimension(e)]
        edges = [make_edge(e, c, df, limit or DEFAULT_LIMIT) for e in spec]
        items, bare = self.selects(q, scope, {"name": "count", "aggregate": "count"})
        cells = reduce(lambda a, e: a * (len(e.parts) + 1), edges, 1)
        if cells > MAX_CELLS:
            raise ExpressionError(f"a dense result of {cells} cells; the most is {MAX_CELLS}")
        marked = self.ordered(q, df)
        for e in edges:
            marked = marked.withColumn(f"__{e.name}", F.explode_outer(e.index) if e.many else e.index)
            if not e.allow_nulls:
                marked = marked.where(F.col(quoted(f"__{e.name}")).isNotNull())
        scope.aliases = scope.aliases | {e.name: (part_value(e, marked), T.DoubleType()) for e in edges if e.type != "set" and scope.find(e.name) is None}
        index = [F.coalesce(F.col(quoted(f"__{e.name}")), F.lit(len(e.parts))).alias(f"__{e.name}") for e in edges]
        counted = marked.groupBy(*index).agg(*self.measures(items, self.compiler(scope)))
        grid = None
        for e in edges:
            n = len(e.parts) + int(e.allow_nulls and e.show_null)
            one = self.spark.range(n).select(F.col("id").cast("int").alias(f"__{e.name}"))
            grid = one if grid is None else grid.crossJoin(one)
        out = grid.join(counted, [f"__{e.name}" for e in edges], "left")
        shown = [part_value(e, out).alias(e.name) for e in edges]
        for s in items:
            col = F.col(quoted(s.name))
            if s.aggregate in ("count", "none") or s.aggregate != "none" and canonical(s.aggregate) in ("count", "cardinality"):
                col = F.coalesce(col, F.lit(0))
            elif s.spec.get("default") is not None:
                col = F.coalesce(col, F.lit(s.spec["default"]))
            shown.append(col.alias(s.name))
        order = [F.col(quoted(f"__{e.name}")) for e in edges]
        out = out.select(*order, *shown).orderBy(*order)
        return Plan(out, [s.name for s in items], edges, kind="edges", whole=bare and len(items) == 1)

    def dimension(self, e: Any) -> list[Any]:
        """An edge, or those that a named dimension stands for: one edge, or several by their fields. A dotted name picks a part of a
        tree of partitions, whose own partitions are then the edge's."""
        if not isinstance(e, str):
            return [e]
        head, *rest = split_path(e)
        if head not in self.dimensions:
            return [e]
        d = self.dimensions[head]
        if "fields" in d:
            return [{"name": f"{head}.{f}", "value": f} if isinstance(f, str) else f for f in d["fields"]]
        parts = d.get("partitions")
        for step in rest:
            part = next((p for p in parts or () if p.get("name") == step), None)
            if part is None:
                raise ExpressionError(f"no part {step!r} in dimension {head!r}")
            parts = part.get("partitions", [part])
        domain = {"type": "set", "partitions": [{k: v for k, v in p.items() if k != "partitions"} for p in parts]} if parts else d.get("domain", "default")
        return [{"name": e, "value": d.get("value"), "domain": domain, **{k: d[k] for k in ("allowNulls",) if k in d}}]

    # results

    def extract(self, q: dict, path: str, form: str = "json", chunk_size: int | None = None, partition_by: list[str] | None = None) -> None:
        """Writes all rows of q to files of at most chunk_size rows, from all tasks."""
        from lathe.sources.store import write

        write(self.frame(q), path, form, partition_by, **({"maxRecordsPerFile": chunk_size} if chunk_size else {}))

    def query(self, q: dict) -> Any:
        """Runs q and packages its result as format says."""
        from lathe.plans.formats import package

        return package(self.plan(q))

    def frame(self, q: dict) -> DataFrame:
        """The rows of q as a DataFrame, without a default limit."""
        plan = self.plan(q, inner=True)
        return plan.df.drop(*[f"__{e.name}" for e in plan.edges])


def part_value(e: Edge, df: DataFrame) -> Column:
    """A part's key by its number."""
    if not e.parts:
        return F.lit(None).cast("string")
    parts = e.parts
    if any(isinstance(p, (list, dict)) for p in parts):
        values = F.array(*[F.to_json(F.array(*[F.lit(None if x is None else str(x)) for x in p])) if isinstance(p, list) else F.lit(str(p)) for p in parts])
    else:
        values = F.array(*[F.lit(p) for p in parts])
    return F.try_element_at(values, (F.col(quoted(f"__{e.name}")) + 1).cast("int"))


def _mentions(e: Any, name: str) -> bool:
    if isinstance(e, str):
        return e == name
    if isinstance(e, dict):
        return any(_mentions(x, name) for x in (*e.keys(), *e.values()))
    return isinstance(e, (list, tuple)) and any(_mentions(x, name) for x in e)
