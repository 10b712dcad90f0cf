"""Fluent streams: lazy chains over a DataFrame with values and annotations as columns.

    stream(rows).filter(it.v > 2).map({"a": it.a, "w": it.v * 2}).sort("w").limit(3).to_list()
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions.scalar import Compiler, Lowered
from lathe.operators.lists import reverse, with_rownum
from lathe.plans.formats import plain
from lathe.plans.schema import Scope


class It:
    """An expression to be: attributes, items and operators give JSON expressions."""

    def __init__(self, e: Any = "."):
        self._e = e

    def __getattr__(self, name: str) -> It:
        if name.startswith("__"):
            raise AttributeError(name)
        return It(name if self._e == "." else f"{self._e}.{name}" if isinstance(self._e, str) else {"get": [self._e, name]})

    def __getitem__(self, key: Any) -> It:
        return It({"get": [self._e, key]}) if isinstance(key, int) else getattr(self, key)

    def _op(self, op: str, other: Any, swap: bool = False) -> It:
        a, b = self._e, other._e if isinstance(other, It) else {"literal": other}
        return It({op: [b, a] if swap else [a, b]})

    __add__ = lambda s, o: s._op("concat", o) if isinstance(o, str) else s._op("add", o)
    __radd__ = lambda s, o: s._op("add", o, True)
    __sub__ = lambda s, o: s._op("sub", o)
    __rsub__ = lambda s, o: s._op("sub", o, True)
    __mul__ = __rmul__ = lambda s, o: s._op("mul", o)
    __truediv__ = lambda s, o: s._op("div", o)
    __mod__ = lambda s, o: s._op("mod", o)
    __eq__ = lambda s, o: s._op("eq", o)
    __ne__ = lambda s, o: s._op("ne", o)
    __lt__ = lambda s, o: s._op("lt", o)
    __le__ = lambda s, o: s._op("lte", o)
    __gt__ = lambda s, o: s._op("gt", o)
    __ge__ = lambda s, o: s._op("gte", o)
    __and__ = lambda s, o: s._op("and", o)
    __or__ = lambda s, o: s._op("or", o)
    __invert__ = lambda s: It({"not": s._e})
    __hash__ = None

    def __rshift__(self, name: str) -> tuple[str, It]:
        """Names a value: it.v >> "w"."""
        return name, self

    def call(self, op: str, *args: Any) -> It:
        return It({op: [self._e, *[a._e if isinstance(a, It) else {"literal": a} for a in args]]}) if args else It({op: self._e})


it = It()


def stream(values: Any, spark: SparkSession | None = None) -> Stream:
    """A DataFrame, rows, a dict's items, a range or a text's lines."""
    if isinstance(values, DataFrame):
        return Stream(values)
    spark = spark or SparkSession.getActiveSession()
    if isinstance(values, range):
        return Stream(spark.range(values.start, values.stop, values.step).withColumnRenamed("id", "value"))
    if isinstance(values, dict):
        values = [{"key": k, "value": v} for k, v in values.items()]
    if isinstance(values, (str, bytes)):
        values = (values if isinstance(values, str) else values.decode()).splitlines()
    from lathe.sources.store import from_rows

    return Stream(from_rows(spark, list(values)))


class Stream:
    """Rows of columns; a single column `value` is a bare value. order: (column, descending) of a sort that the rows still have."""

    def __init__(self, df: DataFrame, order: list[tuple[str, bool]] | None = None):
        self.df, self.order = df, order

    def _low(self, e: Any) -> Lowered:
        if isinstance(e, It):
            e = e._e
        if e == "." and self.df.columns == ["value"]:
            e = "value"
        scope = Scope(self.df.schema)
        if self.df.columns == ["value"]:
            scope.aliases = {".": (F.col("value"), self.df.schema["value"].dataType)}
        return Compiler(scope)(e)

    def _new(self, df: DataFrame, order: list[tuple[str, bool]] | None = None) -> Stream:
        return Stream(df, order)

    def __getattr__(self, name: str) -> Stream:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.map(It(name))

    def map(self, f: Any, returns: T.DataType | str | None = None) -> Stream:
        """A name, an expression, a dict of them, a named expression, a Column, or a Python function with its return type."""
        if isinstance(f, dict):
            return self._new(self.df.select(*[(v if isinstance(v, Column) else self._low(v).col).alias(k) for k, v in f.items()]))
        if isinstance(f, tuple):
            return self.map({f[0]: f[1]})
        if isinstance(f, Column):
            return self._new(self.df.select(f.alias("value")))
        if callable(f) and not isinstance(f, It):
            if returns is None:
                raise TypeError("a Python function needs its return type")
            arg = F.col("value") if self.df.columns == ["value"] else F.struct(*self.df.columns)
            return self._new(self.df.select(F.udf(guarded(f), returns)(arg).alias("value")))
        return self._new(self.df.select(self._low(f).col.alias("value")))

    def filter(self, e: Any) -> Stream:
        x = e if isinstance(e, Column) else Compiler(Scope(self.df.schema, aliases={".": (F.col("value"), self.df.schema["value"].dataType)} if self.df.columns == ["value"] else None)).condition(e._e if isinstance(e, It) else e)
        return self._new(self.df.where(x), self.order)

    def attach(self, **named: Any) -> Stream:
        return self._new(self.df.withColumns({k: self._low(v).col for k, v in named.items()}))

    def enumerate(self, name: str = "index") -> Stream:
        """Each row's place as the rows come."""
        return self._new(with_rownum(self.df, name), self.order)

    def exists(self) -> Stream:
        return self._new(self.df.where(F.greatest(*[F.col(c).isNotNull().cast("int") for c in self.df.columns]) == 1 if len(self.df.columns) > 1 else F.col(self.df.columns[0]).isNotNull()))

    def flatten(self, column: str = "value") -> Stream:
        rest = [c for c in self.df.columns if c != column]
        return self._new(self.df.select(*rest, F.explode(column).alias(column)))

    def distinct(self, *names: str) -> Stream:
        return self._new(self.df.dropDuplicates(list(names)) if names else self.df.distinct())

    def sort(self, *keys: str, reverse: bool = False) -> Stream:
        names = list(keys) or self.df.columns
        return self._new(self.df.orderBy(*[F.col(k).desc_nulls_last() if reverse else F.col(k).asc_nulls_last() for k in names]), [(k, reverse) for k in names])

    def reverse(self) -> Stream:
        """The rows last first: by the sort turned round, or by their places. Of a sorted stream, equal rows may come in any order."""
        if self.order:
            turned = [F.col(k).asc_nulls_first() if down else F.col(k).desc_nulls_first() for k, down in self.order]
            return Stream(self.df.orderBy(*turned))
        return self._new(reverse(self.df))

    def limit(self, n: int) -> Stream:
        return self._new(self.df.limit(n), self.order)

    def append(self, row: Any) -> Stream:
        return self.extend([row])

    def extend(self, rows: Any) -> Stream:
        from lathe.sources.store import from_rows, insert

        more = rows.df if isinstance(rows, Stream) else from_rows(self.df.sparkSession, list(rows))
        return self._new(insert(self.df, more))

    def zip(self, other: Stream) -> Stream:
        from lathe.operators.lists import zipped

        return self._new(zipped(self.df, other.df))

    def group(self, by: Any) -> Stream:
        """(group, rows) for each value of by."""
        return Stream(self.df.groupBy(self._low(by).col.alias("group")).agg(F.collect_list(F.struct(*self.df.columns)).alias("rows")))

    # ends

    def to_list(self) -> list:
        rows = [plain(r) for r in self.df.collect()]
        return [r.get("value") for r in rows] if self.df.columns == ["value"] else rows

    def to_value(self) -> Any:
        rows = self.limit(2).to_list()
        if len(rows) > 1:
            raise ValueError("several values where one is expected")
        return rows[0] if rows else None

    def to_dict(self, key: str) -> dict:
        out = {}
        for r in self.to_list():
            if r[key] in out:
                raise ValueError(f"several rows for {r[key]!r}")
            out[r[key]] = r
        return out

    def to_data(self, path: str, form: str = "json") -> None:
        from lathe.sources.store import write

        write(self.df, path, form)

    def sum(self) -> Any:
        return self.df.agg(F.sum("value")).first()[0]

    def count(self) -> int:
        return self.df.count()

    def first(self) -> Any:
        return next(iter(self.limit(1).to_list()), None)

    def last(self) -> Any:
        return self.reverse().first()

    def materialize(self) -> Stream:
        return self._new(self.df.persist())


def guarded(f: Callable) -> Callable:
    """Errors become missing values."""

    def safe(x):
        try:
            return f(x)
        except Exception:
            return None

    return safe
