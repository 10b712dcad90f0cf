"""Window clauses and sequence windows.

A frame for row i is rows i + min to i + max - 1. Sums over empty frames are 0, as in the sliding form; other aggregates are null.
"""

from __future__ import annotations

import heapq
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions.scalar import Lowered, of_column, truth
from lathe.operators.aggregates import aggregate, canonical
from lathe.plans.schema import Scope


def with_windows(engine, plan, specs: Any):
    """Adds each spec's column: {name, value, edges, sort, where, aggregate, range}."""
    for w in specs if isinstance(specs, list) else [specs]:
        df = plan.df
        scope = Scope(df.schema)
        c = engine.compiler(scope)
        keys = [c(e["value"] if isinstance(e, dict) else e).col for e in _listed(w.get("edges", w.get("groupby")))]
        order = engine.order(w["sort"], scope) if w.get("sort") else []
        base = Window.partitionBy(*keys)
        ordered = base.orderBy(*(order or [F.monotonically_increasing_id()]))
        rownum = F.row_number().over(ordered) - 1

        def neighbour(x: Lowered, k: int, ordered=ordered) -> Lowered:
            col = F.lead(x.col, k).over(ordered) if k >= 0 else F.lag(x.col, -k).over(ordered)
            return Lowered(col, x.kind, x.dtype)

        if not keys and not w.get("range") and w.get("aggregate", "none") == "none" and w.get("value") == "rownum":
            # Places in the whole table come from counts of its parts, not from one task.
            from lathe.operators.lists import with_rownum

            plan.df = with_rownum(df.orderBy(*order) if order else df, w["name"])
            if w["name"] not in plan.selects:
                plan.selects = [*plan.selects, w["name"]]
            continue
        scope.aliases = {"rownum": (rownum.cast("long"), T.LongType())}
        c = engine.compiler(scope, rows=neighbour)
        x = c(w["value"]) if "value" in w else None
        where = F.coalesce(truth(c(w["where"])).test, F.lit(False)) if w.get("where") is not None else None
        agg = w.get("aggregate", "none")
        if agg == "none":
            col = x.col
        else:
            if where is not None:
                x = Lowered(F.when(where, x.col if x is not None else F.lit(1)), x.kind if x is not None else "integer")
            span = w.get("range")
            frame = base
            if span:
                low, high = span.get("min"), span.get("max")
                frame = ordered.rowsBetween(Window.unboundedPreceding if low is None else int(low), Window.unboundedFollowing if high is None else int(high) - 1)
            elif order:
                frame = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            col = aggregate(agg, x, w).over(frame)
            if canonical(agg) == "sum" and w.get("default") is None:
                col = F.coalesce(col, F.lit(0))
        if where is not None and agg == "none":
            col = F.when(where, col)
        plan.df = df.withColumn(w["name"], col)
        plan.selects = [*[s for s in plan.selects if s != w["name"]], w["name"]]
        plan.whole = False
    return plan


def _listed(x: Any) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


# Sequence windows over ordered rows. keys divide the rows into sequences; without keys there is one, and one task.


def _over(order: list, keys: list) -> Any:
    return Window.partitionBy(*keys).orderBy(*order)


def pairwise(df: DataFrame, value: str, order: list, keys: list = ()) -> DataFrame:
    """Each value with the next: columns a, b."""
    return df.select(*keys, *order, F.col(value).alias("a"), F.lead(value).over(_over(order, keys)).alias("b"), F.lead(F.lit(1)).over(_over(order, keys)).alias("__n")).where("__n = 1").drop("__n")


def slide(df: DataFrame, value: str, size: int, order: list, keys: list = ()) -> DataFrame:
    """All runs of size values, as lists."""
    w = _over(order, keys)
    return df.select(*keys, *order, F.collect_list(value).over(w.rowsBetween(0, size - 1)).alias("window"), F.count(F.lit(1)).over(w.rowsBetween(0, size - 1)).alias("__n")).where(f"__n = {int(size)}").drop("__n")


def prefixes(df: DataFrame, value: str, order: list, keys: list = ()) -> DataFrame:
    """For each row the list of values up to it."""
    return df.select(*keys, *order, F.collect_list(value).over(_over(order, keys).rowsBetween(Window.unboundedPreceding, 0)).alias("prefix"))


def accumulate(df: DataFrame, value: str, order: list, keys: list = (), name: str = "total") -> DataFrame:
    """The sum of the values before each row."""
    return df.withColumn(name, F.coalesce(F.sum(value).over(_over(order, keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def countdown(df: DataFrame, order: list, keys: list = (), name: str = "left") -> DataFrame:
    """How many rows come after each."""
    return df.withColumn(name, F.count(F.lit(1)).over(_over(order, keys).rowsBetween(1, Window.unboundedFollowing)))


def intervals(df: DataFrame, low: str, high: str, step: float, name: str = "interval") -> DataFrame:
    """A row for each step of [low, high)."""
    n = F.ceil((F.col(high) - F.col(low)) / step).cast("int")
    return df.where(n > 0).withColumn("__i", F.explode(F.sequence(F.lit(0), n - 1))).withColumn(name, F.struct((F.col(low) + F.col("__i") * step).alias("min"), F.least(F.col(high), F.col(low) + (F.col("__i") + 1) * step).alias("max"))).drop("__i")


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Of each key the row with the largest version; an aggregation, so rows are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(version).isNotNull(), F.col(version))).alias("__row"))
    return picked.select(*[F.col(k) if k in keys else F.col("__row")[k].alias(k) for k in df.columns])


def holes(df: DataFrame, value: str, keys: list = ()) -> DataFrame:
    """Ranges [min, max) of whole numbers that are missing between values."""
    w = Window.partitionBy(*keys).orderBy(value)
    return df.select(*keys, value).distinct().withColumn("__next", F.lead(value).over(w)).where(f"__next > `{value}` + 1").select(*keys, (F.col(value) + 1).alias("min"), F.col("__next").alias("max"))


# Change points


def mann_whitney_p(left: np.ndarray, right: np.ndarray) -> float:
    """Two-sided p of the rank sum test, by the normal approximation with ties."""
    n, m = len(left), len(right)
    both = np.concatenate((left, right))
    _, at, counts = np.unique(both, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    ranks = (ends - (counts - 1) / 2)[at]
    u = ranks[:n].sum() - n * (n + 1) / 2
    total = n + m
    spread = n * m / 12 * (total + 1 - (counts**3 - counts).sum() / (total * (total - 1)))
    if spread <= 0:
        return 1.0
    from math import erfc, sqrt

    return erfc(max(0.0, abs(u - n * m / 2) - 0.5) / sqrt(2 * spread))


def mann_whitney_ps(values: np.ndarray, places: np.ndarray, low: int, high: int, reach: int) -> list[float]:
    """mann_whitney_p at each of many places of [low, high), of up to reach values on each side. values have no NaN."""
    from math import erfc

    at = places[:, None] + np.arange(-reach, reach)
    # What lies outside is NaN, which is neither over, under nor equal to anything.
    both = np.where((at >= low) & (at < high), values[np.clip(at, 0, len(values) - 1)], np.nan)
    left, right = both[:, :reach, None], both[:, None, reach:]
    u = (np.count_nonzero(left > right, axis=(1, 2)) + np.count_nonzero(left >= right, axis=(1, 2))) / 2
    both.sort(axis=1)
    starts = np.flatnonzero(np.concatenate((np.ones((len(places), 1), bool), both[:, 1:] != both[:, :-1]), axis=1))
    counts = np.diff(starts, append=both.size)
    ties = np.bincount(starts // both.shape[1], counts**3 - counts, len(places))
    n, m = np.minimum(reach, places - low), np.minimum(reach, high - places)
    total = n + m
    spread = n * m / 12 * (total + 1 - ties / (total * (total - 1)))
    z = np.maximum(0.0, np.abs(u - n * m / 2) - 0.5) / np.sqrt(2 * np.where(spread > 0, spread, 1.0))
    return [erfc(x) if s > 0 else 1.0 for x, s in zip(z.tolist(), spread.tolist(), strict=True)]


def change_points(values: np.ndarray, size: int = 6, reach: int = 24, limit: float = 1e-3) -> list[int]:
    """Places where values before and after differ: the place of least p divides a series while p is below limit, then each side is
    looked at by itself. Segments have at least size values; up to reach values are compared on each side. A cut changes p only within
    reach of it, so p is taken once for all places and anew near each cut. Both sides of a cut are apart, so one heap serves them all."""
    count, span = len(values), max(size, reach)
    values = np.unique(values, return_inverse=True)[1].astype(float)
    p = np.full(count + 1, np.inf)
    cut = np.zeros(count + 1, bool)
    cut[[0, count]] = True

    def look(first: int, end: int, low: int, high: int) -> list[tuple[float, int]]:
        """p of the places from first to before end, in a segment [low, high); those below limit."""
        first, end, found = max(first, low + size), min(end, high - size + 1), []
        for i in range(first, end, 512):
            places = np.arange(i, min(i + 512, end))
            ps = mann_whitney_ps(values, places, low, high, reach)
            p[i : i + len(ps)] = ps
            found += [(x, i + k) for k, x in enumerate(ps) if x < limit]
        return found

    heap = look(0, count, 0, count)
    heapq.heapify(heap)
    while heap:
        least, i = heapq.heappop(heap)
        if p[i] != least:  # taken anew since, or too near a cut
            continue
        before, after = np.flatnonzero(cut[max(0, i - 2 * span) : i]), np.flatnonzero(cut[i + 1 : i + 2 * span])
        low = max(0, i - 2 * span) + (int(before[-1]) if len(before) else 0)
        high = i + 1 + int(after[0]) if len(after) else i + 2 * span
        cut[i] = True
        p[max(0, i - size + 1) : i + size] = np.inf
        for x in look(i - span + 1, i, low, i) + look(i + 1, i + span, i, high):
            heapq.heappush(heap, x)
    return np.flatnonzero(cut)[1:-1].tolist()


def segments(df: DataFrame, keys: list[str], order: str, value: str, size: int = 6, limit: float = 1e-3) -> DataFrame:
    """Each series of keys divided where its level changes: segment number, begin, end, count, mean and population deviation. Rows equal
    in order come by value, so the result does not depend on how rows come. A series is in one task, as each cut depends on those before."""
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(x, T.LongType()) for x in ("segment", "begin", "end", "count")] + [T.StructField(x, T.DoubleType()) for x in ("mean", "std")])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        key = [pdf[k].iloc[0] for k in keys]
        v = pdf.sort_values([order, value], kind="stable")[value].to_numpy(float)
        v = v[~np.isnan(v)]
        cuts = [0, *change_points(v, size, limit=limit), len(v)]
        rows = [[*key, i, a, b, b - a, v[a:b].mean(), v[a:b].std()] for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        return pd.DataFrame(rows, columns=schema.names)

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(one, schema)


def cumulative_variance(df: DataFrame, value: str, order: list, keys: list = ()) -> DataFrame:
    """Population variance of the values up to each row."""
    return df.withColumn("variance", F.var_pop(value).over(_over(order, keys).rowsBetween(Window.unboundedPreceding, 0)))
