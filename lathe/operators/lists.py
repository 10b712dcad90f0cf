"""List operators on DataFrames: indexes, contiguous groups, chunks, multisets, cubes' arithmetic, keyed set algebra."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions.scalar import Compiler, ExpressionError
from lathe.plans.folders import cut
from lathe.plans.schema import Scope


#: The most cells that cubes without a shared edge may be multiplied to.
MAX_CELLS = 1_000_000


def index(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each key as a list."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("rows"))


def unique_index(df: DataFrame, keys: list[str]) -> DataFrame:
    """The one row of each key. A key with several different rows is an error when the result is computed."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    found = df.groupBy(*keys).agg(F.min(row).alias("__low"), F.max(row).alias("__high"))
    checked = F.when(F.col("__low").eqNullSafe(F.col("__high")), F.col("__low")).otherwise(F.raise_error(F.lit("several rows for one key")).cast(found.schema["__low"].dataType))
    return found.withColumn("__row", checked).select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def map_to_set(df: DataFrame, column: str) -> DataFrame:
    """The distinct members of a list column."""
    return df.select(F.explode(column).alias("value")).distinct()


def filter_rows(df: DataFrame, where) -> DataFrame:
    return df.where(Compiler(Scope(df.schema)).condition(where))


def contiguous_groups(df: DataFrame, value: str, order: list[str], keys: list[str] = ()) -> DataFrame:
    """Rows numbered by runs of an equal value in order: column `group`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("__new", changed).withColumn("group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__new")


def chunk(df: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Rows in chunks of size by order: column `chunk`. Rows are numbered from counts of ranges of the order, not in one task."""
    return with_position(df, order, "__n").withColumn("chunk", F.floor(F.col("__n") / size)).drop("__n")


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Each row's 0-based place in order (names, or columns with a direction). The rows are sorted by range over all tasks."""
    return with_rownum(df.orderBy(*order), name)


def with_rownum(df: DataFrame, name: str = "rownum") -> DataFrame:
    """Each row's 0-based place as df's rows come. df is computed once and kept; its tasks' rows are numbered from the counts of those
    before; only a count for each task goes to the driver."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kept = cut(df.withColumns({"__part": F.spark_partition_id(), "__in": inside}))
    counts = {r["__part"]: r.n for r in kept.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    base = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts] or [F.lit(0).cast("long")]), F.col("__part") + 1)
    return kept.withColumn(name, base + F.col("__in")).drop("__part", "__in")


def zipped(a: DataFrame, b: DataFrame, order_a: list[str] = (), order_b: list[str] = ()) -> DataFrame:
    """Rows of both by place, in order or as they come; the shorter side is null beyond its end."""
    placed = lambda df, order: with_position(df, order, "__n") if order else with_rownum(df, "__n")
    return placed(a, order_a).join(placed(b, order_b), "__n", "full").drop("__n")


def reverse(df: DataFrame, order: list[str] = ()) -> DataFrame:
    """The rows of df, by order or as they come, last first."""
    if order:
        return df.orderBy(*[F.col(c).desc_nulls_first() for c in order])
    return with_rownum(df, "__n").orderBy(F.desc("__n")).drop("__n")


# Multisets


def multiset(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))


def multiset_add(a: DataFrame, b: DataFrame, columns: list[str], sign: int = 1) -> DataFrame:
    """Counts of both added, or taken off with sign -1; counts of 0 go."""
    both = a.select(*columns, "count").unionByName(b.select(*columns, (F.col("count") * sign).alias("count")))
    return both.groupBy(*columns).agg(F.sum("count").alias("count")).where("count <> 0")


def group_by_population(df: DataFrame, value: str, least: int, most: int) -> DataFrame:
    """Values in order, put in groups of at least `least` rows and fewer than `most`: value, count, group. A group takes the next value
    while it is below least, or stays below most with it. An error is raised where that cannot be kept. Each group depends on the one
    before, so the values' counts (one row for each distinct value) stream through one task, which holds one group."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("count")).coalesce(1).sortWithinPartitions(value)

    def run(frames):
        group = total = 0
        for f in frames:
            numbers = []
            for c in f["count"].tolist():
                if total and total >= least and total + c >= most:
                    group, total = group + 1, 0
                total += c
                if total >= most:
                    raise ValueError(f"groups of {least} to {most} rows: one would have {total}")
                numbers.append(group)
            yield f.assign(group=numbers)

    return counts.mapInPandas(run, T.StructType([*counts.schema.fields, T.StructField("group", T.LongType())]))


# Keyed set algebra


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys), keys, "left_anti")


def intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), keys, "left_semi")


def union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a, and those of b whose keys a has not."""
    return a.unionByName(difference(b, a, keys), allowMissingColumns=True)


def symmetric_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return difference(a, b, keys).unionByName(difference(b, a, keys), allowMissingColumns=True)


# Cubes: one row for each cell


class Cube:
    """Measures over edges. Arithmetic joins cells by null-safe coordinates."""

    def __init__(self, df: DataFrame, edges: list[str], measure: str):
        self.df, self.edges, self.measure = df, edges, measure

    def _with(self, other, f: Callable[[Column, Column], Column]) -> Cube:
        if not isinstance(other, Cube):
            return Cube(self.df.withColumn(self.measure, f(F.col(self.measure), F.lit(other))), self.edges, self.measure)
        shared = [e for e in self.edges if e in other.edges]
        b = other.df.select(*[F.col(e).alias(f"__{e}") for e in shared], *[e for e in other.edges if e not in shared], F.col(other.measure).alias("__m"))
        test = reduce(lambda x, y: x & y, [F.col(e).eqNullSafe(F.col(f"__{e}")) for e in shared], F.lit(True))
        if not shared and (cells := self.df.count() * b.count()) > MAX_CELLS:
            raise ExpressionError(f"cubes without a shared edge would have {cells} cells; the most is {MAX_CELLS}")
        out = self.df.join(b, test, "left" if shared else "cross")
        edges = [*self.edges, *[e for e in other.edges if e not in shared]]
        return Cube(out.select(*edges, f(F.col(self.measure), F.col("__m")).alias(self.measure)), edges, self.measure)

    def __add__(self, o):
        return self._with(o, F.try_add)

    def __sub__(self, o):
        return self._with(o, F.try_subtract)

    def __mul__(self, o):
        return self._with(o, F.try_multiply)

    def __truediv__(self, o):
        return self._with(o, lambda a, b: F.try_divide(a.cast("double"), b.cast("double")))

    def __lt__(self, o):
        return self._with(o, lambda a, b: a < b)

    def __gt__(self, o):
        return self._with(o, lambda a, b: a > b)

    def equals(self, o):
        return self._with(o, lambda a, b: a.eqNullSafe(b))

    def __getitem__(self, parts: dict) -> Cube:
        """The slice at the given parts; their edges go."""
        df = self.df
        for e, p in parts.items():
            df = df.where(F.col(e).eqNullSafe(F.lit(p)))
        edges = [e for e in self.edges if e not in parts]
        return Cube(df.select(*edges, self.measure), edges, self.measure)

    def forall(self, f: Callable[[dict[str, Column]], Column]) -> Cube:
        """The measure computed anew for each cell, from its coordinates and measure by name."""
        return Cube(self.df.withColumn(self.measure, f({c: F.col(c) for c in [*self.edges, self.measure]})), self.edges, self.measure)

    def filter(self, where) -> Cube:
        return Cube(filter_rows(self.df, where), self.edges, self.measure)

    def total(self, edges: list[str], aggregate: str = "sum") -> Cube:
        from lathe.functions.scalar import of_column
        from lathe.operators.aggregates import aggregate as agg

        x = of_column(F.col(self.measure), self.df.schema[self.measure].dataType)
        return Cube(self.df.groupBy(*edges).agg(agg(aggregate, x).alias(self.measure)), edges, self.measure)
