"""Query shapes: data, query, and what each format gives."""

from __future__ import annotations

import pytest

from lathe.functions.scalar import ExpressionError
from lathe.plans.query import Engine
from lathe.sources.store import from_rows

TREES = [{"kind": "oak", "h": 21}, {"kind": "elm", "h": 4}, {"h": 9}, {"kind": "elm"}, {"kind": "oak", "h": 6}, {"kind": "oak", "h": 15}, {"kind": "ash", "h": 30}]
RIVERS = ["Aare", "Birs", "Doubs", "Emme", "Inn", "Limmat", "Linth", "Maggia", "Reuss", "Rhine", "Saane", "Thur"]
FLOW = [{"river": r, "flow": 3 * i + 5} for i, r in enumerate(RIVERS)]
HOUSES = [
    {"no": 7, "side": "left", "rooms": [{"use": "bath", "area": 6}, {"use": "hall", "area": 11}, {"area": 20}]}, {"no": 2, "side": "right", "rooms": {"use": "bath", "area": 9}},
    {"no": 9, "side": "left"}, {"no": 4, "side": "right", "rooms": [{"use": "attic", "area": 31}]},
]


@pytest.fixture(scope="module")
def run(spark):
    def go(rows, q):
        return Engine(spark, {"t": from_rows(spark, rows)}).query({"from": "t", **q})

    return go


def unordered(rows):
    return sorted(rows, key=lambda r: str(sorted(r.items())) if isinstance(r, dict) else str(r))


@pytest.mark.parametrize("q, want", [
    ({"edges": ["kind"]}, [{"kind": "ash", "count": 1}, {"kind": "elm", "count": 2}, {"kind": "oak", "count": 3}, {"count": 1}]),
    ({"groupby": "kind", "select": {"value": "h", "aggregate": "sum", "default": -1}}, [{"kind": "ash", "h": 30}, {"kind": "elm", "h": 4}, {"kind": "oak", "h": 42}, {"h": 9}]),
    ({"edges": [{"value": "kind", "allowNulls": False}], "select": {"value": "h", "aggregate": "max"}}, [{"kind": "ash", "h": 30}, {"kind": "elm", "h": 4}, {"kind": "oak", "h": 21}]),
    ({"select": "h", "where": {"eq": {"kind": "elm"}}}, [4, None]),
    ({"select": ["kind"], "where": {"missing": "h"}}, [{"kind": "elm"}]),
    ({"select": ["h"], "where": {"not": {"gt": {"h": 8}}}}, [{"h": 4}, {"h": 6}, {}]),
    ({"select": ["h"], "where": {"or": []}}, []), ({"select": ["h"], "where": {"in": {"h": []}}}, []),
    ({"select": ["h"], "where": {"and": []}, "limit": 1}, [{"h": 21}]),
    ({"select": ["kind", "h"], "where": {"exists": "kind"}, "sort": {"h": "desc"}}, [{"kind": "ash", "h": 30}, {"kind": "oak", "h": 21}, {"kind": "oak", "h": 15}, {"kind": "oak", "h": 6}, {"kind": "elm", "h": 4}, {"kind": "elm"}]),
    ({"select": ["h", {"name": "n", "value": "rownum"}], "where": {"gt": {"h": 8}}, "sort": "h"}, [{"h": 9, "n": 0}, {"h": 15, "n": 1}, {"h": 21, "n": 2}, {"h": 30, "n": 3}]),
    ({"groupby": "kind", "select": {"value": "h", "aggregate": "list"}, "where": {"eq": {"kind": "oak"}}}, [{"kind": "oak", "h": [21, 6, 15]}]),
    ({"groupby": "kind", "select": {"value": "h", "aggregate": "first"}, "where": {"exists": "kind"}}, [{"kind": "ash", "h": 30}, {"kind": "elm", "h": 4}, {"kind": "oak", "h": 21}]),
])
def test_lists(run, q, want):
    got = run(TREES, q)["data"]
    assert (got if "sort" in q else unordered(got)) == (want if "sort" in q else unordered(want))


def test_formats(run):
    assert run(TREES, {"edges": ["kind"], "format": "table"}) == {"meta": {"format": "table"}, "header": ["kind", "count"], "data": [["ash", 1], ["elm", 2], ["oak", 3], [None, 1]]}
    cube = run(TREES, {"edges": ["kind"], "format": "cube"})
    assert cube["data"] == {"count": [1, 2, 3, 1]} and [p["value"] for p in cube["edges"][0]["domain"]["partitions"]] == ["ash", "elm", "oak"]
    assert run(TREES, {"select": {"value": "h", "aggregate": "sum"}})["data"] == 85
    assert run(TREES, {"select": ["kind", "h"], "sort": "h", "limit": 1, "format": "csv"}) == "kind,h\nelm,4"
    assert run(TREES, {"select": ["h"], "sort": "h", "format": "cube"})["data"] == {"h": [4, 6, 9, 15, 21, 30, None]}


def test_default_domain_keeps_ten_and_folds_the_rest(run):
    got = run(FLOW, {"edges": ["river"], "select": {"value": "flow", "aggregate": "max"}})["data"]
    assert got == [{"river": r, "flow": 3 * i + 5} for i, r in enumerate(RIVERS[:10])] + [{"flow": 38}]
    got = run(FLOW, {"edges": ["river"], "limit": 2})["data"]
    assert got == [{"river": "Aare", "count": 1}, {"river": "Birs", "count": 1}, {"count": 10}]


def test_two_dimensions_have_every_cell(run):
    rows = [{"city": "Bern", "size": "s", "n": 4}, {"city": "Bern", "size": "l"}, {"city": "Chur", "size": "s", "n": 17}, {"size": "s", "n": 3}]
    cube = run(rows, {"edges": ["city", {"value": "size", "domain": {"type": "set", "partitions": ["s", "l", "xl"]}}], "select": {"value": "n", "aggregate": "sum"}, "format": "cube"})
    assert cube["data"]["n"] == [[4, None, None, None], [17, None, None, None], [3, None, None, None]]


def test_regular_and_overlap_domains(run):
    rows = [{"s": s, "e": e} for s, e in [(0, 5), (2, 6), (3, 9), (8, 10)]]
    domain = {"type": "range", "min": 0, "max": 10, "interval": 1}
    got = run(rows, {"edges": [{"name": "i", "range": {"min": "s", "max": "e"}, "domain": domain}], "format": "cube"})
    assert got["data"]["count"] == [1, 1, 2, 3, 3, 2, 1, 1, 2, 1, 0]
    got = run(rows, {"edges": [{"name": "i", "range": {"min": "s", "max": "e", "mode": "snapshot"}, "domain": {**domain, "interval": 2}}], "format": "cube"})
    assert got["data"]["count"] == [1, 2, 3, 1, 2, 0]
    got = run(rows, {"edges": [{"name": "p", "value": "s", "domain": {"type": "range", "partitions": [{"name": "low", "min": 0, "max": 3}]}}], "format": "cube"})
    assert got["data"]["count"] == [2, 2]
    days = [{"t": 1704067200 + 3600 * h} for h in (0, 5, 30, 80)]
    got = run(days, {"edges": [{"value": "t", "domain": {"type": "time", "min": "2024-01-01", "max": "2024-01-04", "interval": "day"}}], "format": "cube"})
    assert got["data"]["count"] == [2, 1, 0, 1]


def test_decisive_equality(run):
    rows = [{k: v for k, v in (("p", p), ("q", q)) if v is not None} for p in ("u", "w", None) for q in ("u", "w", None)]
    number = lambda where: len(run(rows, {"where": where})["data"])
    assert [number(x) for x in ({"eq": ["p", "q"]}, {"ne": ["p", "q"]}, {"not": {"ne": ["p", "q"]}}, {"not": {"eq": ["p", "q"]}})] == [3, 2, 7, 6]


def test_nested_rows(run):
    got = run(HOUSES, {"from": "t.rooms", "select": ["no", "use", "area"], "where": {"gte": {"area": 9}}})["data"]
    assert unordered(got) == unordered([{"no": 7, "use": "hall", "area": 11}, {"no": 7, "area": 20}, {"no": 2, "use": "bath", "area": 9}, {"no": 4, "use": "attic", "area": 31}])
    assert unordered(run(HOUSES, {"from": "t.rooms", "groupby": "use"})["data"]) == unordered([{"use": "attic", "count": 1}, {"use": "bath", "count": 2}, {"use": "hall", "count": 1}, {"count": 1}])
    assert run(HOUSES, {"select": "no", "where": {"nested": {"path": "rooms", "query": {"eq": {"use": "bath"}}}}, "sort": "no"})["data"] == [2, 7]
    assert run(HOUSES, {"select": ["no", {"name": "n", "value": {"sum": "rooms.area"}}], "sort": "no"})["data"] == [{"no": 2, "n": 9}, {"no": 4, "n": 31}, {"no": 7, "n": 37}, {"no": 9}]
    by_size = {"from": "rooms", "select": "area", "sort": [{"use": "desc"}, "area"], "limit": 2}
    assert run(HOUSES, {"select": [{"name": "n", "value": by_size}], "where": {"eq": {"no": 7}}})["data"] == [{"n": [11, 6]}]


def test_mixed_types(run):
    rows = [{"a": "x"}, {"a": 1}, {"a": True}, {}]
    assert run(rows, {"select": "a", "sort": "a"})["data"] == [True, 1, "x", None]
    assert run(rows, {"select": "a", "where": {"eq": {"a": 1}}})["data"] == [1]
    assert run(rows, {"select": ["a", {"name": "s", "value": {"is_text": "a"}}], "where": {"eq": {"a": "x"}}})["data"] == [{"a": "x", "s": "x"}]


def test_stats(run):
    rows = [{"x": x} for x in (3, 8, 1, 8, 10, 24)]
    got = run(rows, {"select": [{"name": "s", "value": "x", "aggregate": "stats"}, {"name": "p", "value": "x", "aggregate": "percentile", "percentile": 0.25}, {"name": "c", "value": "x", "aggregate": "count_values"}]})["data"]
    mean = sum(r["x"] for r in rows) / 6
    assert got["s"]["median"] == 8 and got["s"]["sos"] == sum(r["x"] ** 2 for r in rows) and got["p"] == 4.25
    assert abs(got["s"]["var"] - sum((r["x"] - mean) ** 2 for r in rows) / 6) < 1e-9
    assert got["c"] == {1: 1, 3: 1, 8: 2, 10: 1, 24: 1} or {int(k): v for k, v in got["c"].items()} == {1: 1, 3: 1, 8: 2, 10: 1, 24: 1}


def test_windows(run):
    got = run([{"g": g, "x": x} for g, x in (("a", 1), ("a", 2), ("a", 4), ("b", 8))], {"select": ["g", "x"], "window": [
        {"name": "n", "value": "rownum", "edges": ["g"], "sort": "x"}, {"name": "s", "value": "x", "aggregate": "sum", "edges": ["g"], "sort": "x", "range": {"min": -1, "max": 0}},
        {"name": "next", "value": {"rows": ["x", 1]}, "edges": ["g"], "sort": "x"},
    ], "sort": "x"})["data"]
    assert unordered(got) == unordered([{"g": "a", "x": 1, "n": 0, "s": 0, "next": 2}, {"g": "a", "x": 2, "n": 1, "s": 1, "next": 4}, {"g": "a", "x": 4, "n": 2, "s": 2}, {"g": "b", "x": 8, "n": 0, "s": 0}])


@pytest.mark.parametrize("q", [{"edges": ["h"], "groupby": ["kind"]}, {"limit": -3}, {"select": ["h", "h"]}, {"select": {"value": "h", "aggregate": "nope"}}, {"where": {"nope": 1}}, {"select": {"value": "h", "aggregate": "percentile", "percentile": "half"}}, {"where": {"script": "1=1"}}])
def test_errors(run, q):
    with pytest.raises(ExpressionError):
        run(TREES, q)


def test_filters_reach_the_scan(spark, small):
    from lathe.plans.catalog import engine

    df = engine(spark, small).frame({"from": "lineitem", "select": ["l_orderkey"], "where": {"and": [{"eq": {"l_returnflag": "R"}}, {"lt": {"l_quantity": 10}}, {"gte": {"l_shipdate": {"date": "1996-01-01"}}}]}})
    plan = df._jdf.queryExecution().executedPlan().toString()
    for part in ("EqualTo(l_returnflag,R)", "LessThan(l_quantity,10.0)", "GreaterThanOrEqual(l_shipdate"):
        assert part in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in plan


def test_dimensions_and_extraction(spark, tmp_path):
    tree = {"size": {"partitions": [
        {"name": "big", "where": {"gte": {"h": 15}}, "partitions": [{"name": "odd", "where": {"eq": {"h": 21}}}, {"name": "rest", "where": {"gt": {"h": 21}}}]},
        {"name": "small", "where": {"lt": {"h": 15}}},
    ]}, "both": {"fields": ["kind", "h"]}}
    engine = Engine(spark, {"t": from_rows(spark, TREES)}, dimensions=tree)
    assert engine.query({"from": "t", "edges": ["size"], "format": "cube"})["data"]["count"] == [3, 3, 1]
    assert engine.query({"from": "t", "edges": ["size.big"], "format": "cube"})["data"]["count"] == [1, 1, 5]
    assert len(engine.query({"from": "t", "edges": ["both"], "format": "cube"})["edges"]) == 2
    engine.extract({"from": "t"}, f"{tmp_path}/out", chunk_size=2)
    assert spark.read.json(f"{tmp_path}/out").count() == len(TREES)
