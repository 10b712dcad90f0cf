"""Dates, schemas, tables, lists, streams, graphs and SQL text."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pytest

from lathe.functions import dates
from lathe.plans import sqltext
from lathe.plans.schema import join_path, split_path
from lathe.sources import store

NOW = 1704110400.0  # 2024-01-01 12:00, a Monday


@pytest.mark.parametrize("text, want", [
    ("now", NOW), ("today", NOW - 43200), ("tomorrow", NOW + 43200), ("today-day", NOW - 43200 - 86400), ("now|day", NOW - 43200), ("today-week", NOW - 43200 - 604800),
    ("now|week", NOW - 43200 - 86400), ("now-2day+hour", NOW - 2 * 86400 + 3600), ("today+month", NOW - 43200 + 31 * 86400), ("2024-01-01", NOW - 43200), ("2024-01-01T12:00:00Z", NOW),
    (NOW * 1000, NOW), ("1704110400", NOW), ("now|month", NOW - 43200),
])
def test_dates(text, want):
    assert dates.parse_date(text, NOW) == want


def test_durations():
    assert dates.parse_duration("2day+3hour").seconds == 2 * 86400 + 3 * 3600
    assert dates.parse_duration("month").seconds == 28 * 86400 and dates.parse_duration("year").seconds == 52 * 7 * 86400
    assert str(dates.parse_duration("8day")) == "1week+1day" and dates.parse_duration("week") / dates.parse_duration("day") == 7
    assert dates.date_range(0, 3 * 86400, dates.parse_duration("day")) == [0, 86400, 172800]
    with pytest.raises(ValueError):
        dates.parse_date("no date at all")


@pytest.mark.parametrize("name, steps", [("a.b", ["a", "b"]), (".", []), ("a..b.c", ["a.b", "c"])])
def test_paths(name, steps):
    assert split_path(name) == steps and join_path(steps) == name


def test_merged_schemas(spark):
    rows = [{"a": 1, "b": {"c": "x"}}, {"a": 2.5, "b": {"d": True}}, {"a": None, "b": {"c": "y"}, "e": [1]}, {"e": 5}]
    df = store.from_rows(spark, rows)
    assert df.schema["a"].dataType.simpleString() == "double" and df.schema["e"].dataType.simpleString() == "array<bigint>"
    got = store.insert(store.from_rows(spark, [{"x": 1, "y": {"z": 1}}]), store.from_rows(spark, [{"x": "s", "y": [{"z": 2}]}])).collect()
    assert [r.x["~n"] or r.x["~s"] for r in got] == [1, "s"] and [r.y[0].z for r in got] == [1, 2]
    assert store.untyped(store.typed({"a": [1, "x"], "b": {"c": True}})) == {"a": [1, "x"], "b": {"c": True}}


def test_maintenance(spark):
    t = store.from_rows(spark, [{"k": 1, "v": 5}, {"k": 2}, {"k": 3, "v": 7}])
    rows = lambda df: sorted((r.k, r.v) for r in df.collect())
    assert rows(store.update(t, set={"v": {"add": ["v", 1]}}, where={"exists": "v"}).fillna(0)) == [(1, 6), (2, 0), (3, 8)]
    assert [r.v for r in store.update(t, clear=["v"], where={"eq": {"k": 1}}).orderBy("k").collect()] == [None, None, 7]
    assert store.delete(t, {"gt": {"v": 5}}).count() == 2
    assert rows(store.upsert(t, store.from_rows(spark, [{"k": 2, "v": 9}, {"k": 4, "v": 1}]), ["k"])) == [(1, 5), (2, 9), (3, 7), (4, 1)]


def test_files(spark, tmp_path):
    df = store.from_rows(spark, [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}])
    for form in ("parquet", "json", "csv", "tab", "orc"):
        store.write(df, f"{tmp_path}/t.{form}", form)
        back = store.read(spark, f"{tmp_path}/t.{form}", form)
        assert sorted((int(r.a), r.b) for r in back.collect()) == [(1, "x"), (2, "y")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m.txt", "one\ntwo\n")
    got = store.archive_lines(spark, f"{tmp_path}/z.zip").collect()
    assert [(r.member, r.number, r.line) for r in got] == [("m.txt", 0, "one"), ("m.txt", 1, "two")]
    (tmp_path / "d.json").write_text('{"x": {"rows": [{"a": 1, "big": "q"}, {"a": 2}]}}')
    assert [r.a for r in store.read_json_path(spark, f"{tmp_path}/d.json", "x.rows", "a long").collect()] == [1, 2]


def test_streams(spark):
    from lathe.streaming.fluent import it, stream

    assert stream(range(6), spark).filter(it > 2).map(it * 10).to_list() == [30, 40, 50]
    rows = [{"k": "a", "v": 1}, {"k": "b", "v": 2}, {"k": "a", "v": 3}]
    s = stream(rows, spark)
    assert s.sort("v", reverse=True).limit(1).to_list() == [{"k": "a", "v": 3}]
    assert s.map({"w": it.v + 1}).sort("w").to_list() == [{"w": 2}, {"w": 3}, {"w": 4}]
    assert s.v.sum() == 6 and s.distinct("k").count() == 2 and s.sort("v").last() == {"k": "a", "v": 3}
    assert {g["group"]: len(g["rows"]) for g in s.group(it.k).to_list()} == {"a": 2, "b": 1}
    assert sorted(s.v.map(lambda x: 1 // (x - 1), "long").exists().to_list()) == [0, 1]
    assert s.append({"k": "c", "v": 9}).to_dict("v")[9]["k"] == "c"
    assert [r["i"] for r in s.sort("v").enumerate("i").sort("v").to_list()] == [0, 1, 2]


def test_structured_streaming_equals_batch(spark, small, tmp_path):
    from pyspark.sql import functions as F

    from lathe.streaming import events

    table = spark.read.parquet(f"{small}/events.parquet")
    source = tmp_path / "in"
    table.repartition(3).write.parquet(str(source))
    live = events.read_files(spark, str(source), table.schema, files_per_batch=1)
    agg = events.tumbling(live, "ts", "1 day", ["event_type"], F.count(F.lit(1)).alias("n"), late="60 days")
    seen = {}
    events.each_batch(agg, lambda df, n: seen.update({(r.start, r.event_type): r.n for r in df.collect()}), str(tmp_path / "check"), "update")
    batch = events.tumbling(table, "ts", "1 day", ["event_type"], F.count(F.lit(1)).alias("n")).collect()
    assert seen == {(r.start, r.event_type): r.n for r in batch}
    events.once(live, str(tmp_path / "out"), str(tmp_path / "check2"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == table.count()


def test_change_points():
    from lathe.operators.windows import change_points, mann_whitney_p

    rng = np.random.default_rng(2)
    v = np.concatenate((rng.normal(0, 1, 60), rng.normal(6, 1, 50), rng.normal(0, 1, 40)))
    found = change_points(v)
    assert len(found) == 2 and abs(found[0] - 60) <= 2 and abs(found[1] - 110) <= 2
    assert mann_whitney_p(np.ones(8), np.ones(8)) == 1.0


def test_graphs(spark):
    from lathe.operators import graph

    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("x", "r")], "src string, dst string")
    assert {r.node: r.depth for r in graph.bfs(edges, spark.createDataFrame([("r",)], "node string")).collect()} == {"r": 0, "a": 1, "b": 1, "c": 2, "d": 3}
    assert {r.node: r.parent for r in graph.dominator_tree(edges, "r").collect()} == {"a": "r", "b": "r", "c": "r", "d": "c"}
    assert {r.node for r in graph.ancestors(edges, spark.createDataFrame([("c",)], "node string")).collect()} == {"a", "b", "r", "x"}
    assert {r.node: r.depth for r in graph.depths(edges).collect()}["d"] == 4


@pytest.mark.parametrize("sql, part", [
    ("SELECT SAFE_CAST(a AS INT) FROM t", "TRY_CAST("), ("SELECT 'SIMILAR TO' FROM t", "'SIMILAR TO'"), ("SELECT a FROM t WHERE a SIMILAR TO 'x'", "RLIKE"), ("SELECT TOP 3 a FROM t ORDER BY b", "LIMIT 3"),
    ("SELECT a FROM t FOR UPDATE NOWAIT", "FROM t"), ("SELECT a FROM t MINUS SELECT b FROM u", "EXCEPT"), ("SELECT a FROM t CROSS APPLY f(a)", "CROSS JOIN LATERAL"),
])
def test_sql_rewrites(sql, part):
    assert part in sqltext.rewrite(sql) and "UPDATE" not in sqltext.rewrite(sql)


def test_templates(spark):
    from pyspark.sql import functions as F

    from lathe.functions.text import template

    df = spark.createDataFrame([("abc", 0.256, 1234567.0)], "s string, p double, n double")
    got = df.select(template("{{s|upper}} {{p|percent(1)}} {{n|comma}} {{s|right_align(5)}} {{s|limit(2)}}", F.col).alias("t")).first().t
    assert got == "ABC 25.6% 1,234,567   abc ..."


def test_registered_queries_match_sql(spark, small):
    """A few of the catalog's queries against their SQL; the rest are compared outside."""
    import os

    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in ("pricing_summary", "edge_two_dims", "window_sliding_sum", "table_upsert", "from_path", "sql_top_ties"):
        df = queries[name](spark, small)
        cols = sorted(df.columns)
        mine = sorted(tuple(str(r[c]) if not isinstance(r[c], float) else f"{r[c]:.6g}" for c in cols) for r in df.collect())
        cur = con.execute(sql[name])
        at = [[d[0] for d in cur.description].index(c) for c in cols]
        theirs = sorted(tuple(str(r[i]) if not isinstance(r[i], float) else f"{r[i]:.6g}" for i in at) for r in cur.fetchall())
        assert mine == theirs, name
    assert set(sql) <= set(queries)
