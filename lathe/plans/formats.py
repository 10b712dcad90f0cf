"""Results: list, table, cube, value, and text lines. Only here do rows reach the driver."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, Row

from lathe.plans.schema import split_path

UNION = ("~b", "~n", "~s")


def plain(value: Any) -> Any:
    """Rows to dicts without nulls; unions to their value."""
    if isinstance(value, Row):
        d = value.asDict()
        if d and set(d) <= set(UNION):
            return next((plain(d[k]) for k in UNION if d.get(k) is not None), None)
        if d and all(k.startswith("_") and k[1:].isdigit() for k in d):
            return [plain(v) for v in d.values()]
        return {k: p for k, v in d.items() if (p := plain(v)) is not None}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return float(value) if isinstance(value, Decimal) else value


def nested(pairs: Iterator[tuple[str, Any]]) -> dict:
    """Dotted names to objects inside objects; missing values are left out."""
    out: dict = {}
    for name, value in pairs:
        if value is None:
            continue
        steps = split_path(name)
        if not steps:
            if isinstance(value, dict):
                out.update(value)
            continue
        at = out
        for s in steps[:-1]:
            at = at.setdefault(s, {})
        at[steps[-1]] = value
    return out


def _rows(df: DataFrame, names: list[str]) -> list[list[Any]]:
    at = {n: i for i, n in enumerate(df.columns)}
    return [[plain(r[at[n]]) for n in names] for r in df.collect()]


def package(plan) -> Any:
    names = [*[e.name for e in plan.edges], *plan.groups, *plan.selects]
    if plan.format == "container":
        return plan.df
    if plan.format == "table":
        return {"meta": {"format": "table"}, "header": names, "data": _rows(plan.df, names)}
    if plan.format == "cube":
        return cube(plan)
    if plan.format == "value" or plan.kind == "value" and plan.format == "list":
        row = next(iter(_rows(plan.df.limit(1), names)), [None] * len(names))
        data = row[0] if plan.whole else nested(zip(names, row, strict=True))
        return {"meta": {"format": "value"}, "data": data}
    rows = _rows(plan.df, names)
    if plan.format in ("csv", "tab"):
        sign = "," if plan.format == "csv" else "\t"
        return "\n".join([sign.join(names), *[sign.join(cell(x, sign) for x in r) for r in rows]])
    if plan.format == "line":
        return "\n".join(json.dumps(nested(zip(names, r, strict=True)), default=str) for r in rows)
    if plan.whole and plan.kind == "set":
        return {"meta": {"format": "list"}, "data": [r[0] for r in rows]}
    return {"meta": {"format": "list"}, "data": [nested(zip(names, r, strict=True)) for r in rows]}


def cell(x: Any, sign: str) -> str:
    if x is None:
        return ""
    text = x if isinstance(x, str) else json.dumps(x, default=str)
    return '"' + text.replace('"', '""') + '"' if sign in text or '"' in text or "\n" in text else text


def cube(plan) -> dict:
    """Edges with their parts, and a dense array for each select, nested by edge. Plain rows get a rownum edge; groups become edges."""
    if not plan.edges and not plan.groups:
        rows = _rows(plan.df, plan.selects)
        if plan.kind == "value":
            return {"meta": {"format": "cube"}, "edges": [], "data": {n: rows[0][i] for i, n in enumerate(plan.selects)}}
        edge = {"name": "rownum", "domain": {"type": "rownum", "min": 0, "max": len(rows), "interval": 1}}
        return {"meta": {"format": "cube"}, "edges": [edge], "data": {n: [r[i] for r in rows] for i, n in enumerate(plan.selects)}}
    if plan.groups:
        rows = _rows(plan.df, [*plan.groups, *plan.selects])
        k = len(plan.groups)
        parts = [sorted({json.dumps(r[i], default=str): r[i] for r in rows}.values(), key=lambda v: (v is None, str(type(v)), v if v is not None else 0)) for i in range(k)]
        edges = [{"name": n, "allowNulls": True, "domain": {"type": "set", "partitions": [{"value": v} for v in p if v is not None]}} for n, p in zip(plan.groups, parts, strict=True)]
        at = [{json.dumps(v, default=str): i for i, v in enumerate(p)} for p in parts]
        sizes = [len(p) for p in parts]
        cells = {tuple(a[json.dumps(x, default=str)] for a, x in zip(at, r, strict=False)): r[k:] for r in rows}
    else:
        names = [f"__{e.name}" for e in plan.edges]
        rows = _rows(plan.df, [*names, *plan.selects])
        k = len(names)
        sizes = [len(e.parts) + int(e.allow_nulls and e.show_null) for e in plan.edges]
        edges = [
            {"name": e.name, "allowNulls": e.allow_nulls, "domain": {**{x: v for x, v in e.domain.items() if x != "type"}, "type": "set" if e.type == "default" else e.type, "partitions": [{"value": p, "dataIndex": i} for i, p in enumerate(e.parts)]}}
            for e in plan.edges
        ]
        cells = {tuple(r[:k]): r[k:] for r in rows}

    def fill(at: tuple, measure: int) -> Any:
        if len(at) == k:
            return cells.get(at, [None] * len(plan.selects))[measure]
        return [fill((*at, i), measure) for i in range(sizes[len(at)])]

    return {"meta": {"format": "cube"}, "edges": edges, "data": {n: fill((), i) for i, n in enumerate(plan.selects)}}
