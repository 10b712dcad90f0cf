"""Places, reversed rows, graphs and SQL text where the data has many parts."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lathe.operators import custom, graph, lists
from lathe.plans import sqltext
from lathe.streaming.fluent import stream


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_places_over_many_parts(spark, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 50_000
        df = spark.range(n).select((F.col("id") * 7919 % n).alias("k")).repartition(16)
        rows = lists.with_position(df, ["k"]).collect()
        assert all(r.k == r.position for r in rows) and len(rows) == n
        chunks = lists.chunk(df, 1000, ["k"]).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("low")).collect()
        assert sorted((r.chunk, r.n, r.low) for r in chunks) == [(i, 1000, 1000 * i) for i in range(50)]
        both = lists.zipped(df, df.select((F.col("k") * 2).alias("j")), ["k"], ["j"]).collect()
        assert all(r.j == 2 * r.k for r in both)
        s = stream(df).sort("k", reverse=True)
        assert s.first() == {"k": n - 1} and s.last() == {"k": 0} and s.reverse().first() == {"k": 0}
        own = stream(df)
        places = {r["k"]: r["index"] for r in own.enumerate().to_list()}
        assert sorted(places.values()) == list(range(n))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_groups_by_population(spark):
    df = spark.createDataFrame([(v,) for v, n in ((1, 3), (2, 2), (3, 4), (4, 1), (5, 5)) for _ in range(n)], "v int")
    rows = lists.group_by_population(df, "v", 4, 8).orderBy("v").collect()
    assert [(r.v, r["count"], r.group) for r in rows] == [(1, 3, 0), (2, 2, 0), (3, 4, 1), (4, 1, 1), (5, 5, 2)]
    with pytest.raises(Exception, match="groups of 2 to 4 rows"):
        lists.group_by_population(df, "v", 2, 4).collect()


def brute_dominators(edges: list[tuple[int, int]], root: int) -> dict[int, set[int]]:
    def reach(without: int | None) -> set[int]:
        seen, todo = set(), [root] if root != without else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [b for a, b in edges if a == x and b != without]
        return seen

    every = reach(None)
    return {n: {d for d in every if d == n or n not in reach(d)} for n in every}


@pytest.mark.parametrize("seed", range(3))
def test_dominators_against_removal(spark, seed):
    rng = random.Random(seed)
    edges = list({(rng.randrange(12), rng.randrange(12)) for _ in range(22)} | {(0, 1), (0, 2)})
    df = spark.createDataFrame(edges, "src int, dst int")
    got: dict[int, set[int]] = {}
    for r in graph.dominators(df, 0).collect():
        got.setdefault(r.node, set()).add(r.dominator)
    assert got == brute_dominators(edges, 0)


def test_depth_first_walk(spark):
    df = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "e"), ("b", "d"), ("c", "d")], "src string, dst string")
    rows = graph.dfs(df, "a").orderBy("place").collect()
    assert [(r.node, r.parent) for r in rows] == [("a", None), ("b", "a"), ("d", "b"), ("e", "b"), ("c", "a")]


def test_custom_aggregate_merges_states(spark):
    df = spark.createDataFrame([(k, v) for k, v in itertools.product("xyz", range(50))] + [(None, 5), ("x", None)], "k string, v int").repartition(7)
    out = custom.custom_aggregate(df, ["k"], "v", list, lambda s, v: [*s, v], lambda a, b: a + b, lambda s: int(max(s) * 1000 + len(s)), "long", held=1)
    assert {r.k: r.value for r in out.collect()} == {"x": 49050, "y": 49050, "z": 49050, None: 5001}
    total = custom.custom_aggregate(df, [], "v", int, lambda s, v: s + v, lambda a, b: a + b, lambda s: s, "long").collect()
    assert [r.value for r in total] == [3 * 1225 + 5]


def test_statements_change_views(spark):
    tables = {"acc": spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "c", 7)], "id int, name string, n int"), "news": spark.createDataFrame([(2, 20), (9, 90)], "id int, n int")}
    run = lambda q, t=None: sorted(tuple(r) for r in sqltext.run(spark, q, t).collect())
    assert run("INSERT INTO acc VALUES (4, 'it''s', 1)", tables) == [(1, "a", 5), (2, "b", None), (3, "c", 7), (4, "it's", 1)]
    assert run("UPDATE acc SET n = coalesce(n, 0) + 1, name = 'x, (y)' WHERE id >= 2 AND id < 4;")[1:3] == [(2, "x, (y)", 1), (3, "x, (y)", 8)]
    assert run("DELETE FROM acc WHERE n > 6") == [(1, "a", 5), (2, "x, (y)", 1), (4, "it's", 1)]
    assert run("MERGE INTO acc AS a USING (SELECT * FROM news) AS s ON a.id = s.id WHEN MATCHED THEN UPDATE SET n = s.n WHEN NOT MATCHED AND s.n > 50 THEN INSERT (id, n) VALUES (s.id, s.n + 1)") == [(1, "a", 5), (2, "x, (y)", 20), (4, "it's", 1), (9, None, 91)]
    assert run("CREATE OR REPLACE TABLE few AS SELECT TOP 1 id FROM acc ORDER BY id DESC") == [(9,)]
    assert run("TRUNCATE TABLE few") == []
    sqltext.run(spark, "DROP TABLE few")
    assert not spark.catalog.tableExists("few")


def test_similar_to_is_for_whole_texts(spark):
    t = {"w": spark.createDataFrame([("abc",), ("bcd",), ("a.c",), ("b",), ("a\nc",)], "x string")}
    found = lambda p: sorted(r.x for r in sqltext.run(spark, f"SELECT x FROM w WHERE x SIMILAR TO '{p}'", t).collect())
    assert found("b") == ["b"] and found("b%") == ["b", "bcd"] and found("a_c") == ["a\nc", "a.c", "abc"] and found("a.c") == ["a.c"] and found("(a|b)bc|b") == ["abc", "b"]
