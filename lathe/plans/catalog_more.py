"""More named queries: aggregates by order, nested data, dates, kinds of edges, graphs, streams, SQL text. Each with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathe.plans.catalog import _lazy, _sql, _store, _talks, query, scalar
from lathe.plans.query import Engine

# Aggregates

_GROUPED = {"from": "orders", "groupby": "o_custkey"}


def _sorted_orders(e: Engine, select: Any) -> DataFrame:
    return e.frame({"from": e.table("orders").orderBy("o_orderkey"), "groupby": "o_custkey", "select": select})


query("agg_first_by_order", lambda e: _sorted_orders(e, [{"name": "a", "value": "o_totalprice", "aggregate": "first"}, {"name": "b", "value": "o_totalprice", "aggregate": "last"}]),
      "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS a, arg_max(o_totalprice, o_orderkey) AS b FROM orders GROUP BY 1")
query("agg_list_by_order", lambda e: _sorted_orders(e, {"name": "x", "value": "o_orderkey", "aggregate": "list"}).select("o_custkey", F.concat_ws(",", "x").alias("x")),
      "SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS x FROM orders GROUP BY 1")
query("agg_one", {"from": "nation", "groupby": "n_nationkey", "select": {"name": "x", "value": "n_regionkey", "aggregate": "one"}}, "SELECT n_nationkey, any_value(n_regionkey) AS x FROM nation GROUP BY 1")
query("agg_stats", lambda e: e.frame({"from": "part", "groupby": "p_brand", "select": {"name": "s", "value": "p_size", "aggregate": "stats"}}).select("p_brand", *[F.round(f"s.{c}", 6).cast("double").alias(c) for c in ("count", "sum", "min", "max", "avg", "var", "std", "median", "sos")]),
      "SELECT p_brand, " + ", ".join(f"CAST(round({x}, 6) AS DOUBLE) AS \"{n}\"" for n, x in (("count", "count(p_size)"), ("sum", "sum(p_size)"), ("min", "min(p_size)"), ("max", "max(p_size)"), ("avg", "avg(p_size)"), ("var", "var_pop(p_size)"), ("std", "stddev_pop(p_size)"), ("median", "median(p_size)"), ("sos", "sum(p_size * p_size)"))) + " FROM part GROUP BY 1")
query("agg_count_values", lambda e: e.frame({"from": "orders", "groupby": "o_custkey", "select": {"name": "x", "value": "o_orderstatus", "aggregate": "count_values"}}).select("o_custkey", F.explode("x").alias("status", "n")),
      "SELECT o_custkey, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2")
query("agg_union_lists", lambda e: e.frame({"from": e.table("part").select("p_brand", F.split("p_type", " ").alias("w")), "groupby": "p_brand", "select": {"name": "x", "value": "w", "aggregate": "union"}}).select("p_brand", F.concat_ws(",", "x").alias("x")),
      "SELECT p_brand, string_agg(w, ',' ORDER BY w) AS x FROM (SELECT DISTINCT p_brand, unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY 1")
query("agg_empty_input", {"from": "orders", "where": {"lt": {"o_orderkey": 0}}, "select": [{"name": "n", "aggregate": "count"}, {"name": "s", "value": "o_totalprice", "aggregate": "sum"}, {"name": "m", "value": "o_totalprice", "aggregate": "max"}]},
      "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_totalprice) AS m FROM orders WHERE o_orderkey < 0")
query("agg_moment_sums", _lazy("lathe.functions.stats", lambda m, e: m.moments(e.table("part"), "p_size", ["p_brand"]).select("p_brand", "count", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), "s1", "s2", "s3", "s4")),
      "SELECT p_brand, count(*) AS count, round(avg(p_size), 6) AS mean, round(var_pop(p_size), 6) AS variance, CAST(sum(p_size) AS DOUBLE) AS s1, CAST(sum(p_size ** 2) AS DOUBLE) AS s2, CAST(sum(p_size ** 3) AS DOUBLE) AS s3, CAST(sum(p_size ** 4) AS DOUBLE) AS s4 FROM part GROUP BY 1")
for _name, _spec, _sqltext in [
    ("s3", {"value": "p_size", "aggregate": "s3"}, "sum(p_size ** 3)"), ("product", {"value": {"add": [1, {"div": ["p_size", 1e6]}]}, "aggregate": "product"}, "product(1 + p_size / 1e6)"),
    ("skew", {"value": "p_size", "aggregate": "skew"}, "avg(((p_size - m) / d) ** 3)"), ("kurtosis", {"value": "p_size", "aggregate": "kurtosis"}, "avg(((p_size - m) / d) ** 4) - 3"),
]:
    query(f"agg_{_name}", (lambda spec: lambda e: e.frame({"from": "part", "groupby": "p_brand", "select": {"name": "x", **spec}}).select("p_brand", F.round(F.col("x").cast("double"), 5).alias("x")))(_spec),
          f"SELECT p_brand, round(CAST({_sqltext} AS DOUBLE), 5) AS x FROM part JOIN (SELECT p_brand, avg(p_size) AS m, stddev_pop(p_size) AS d FROM part GROUP BY 1) USING (p_brand) GROUP BY 1")


def _median_range(e: Engine) -> DataFrame:
    from lathe.operators.custom import custom_aggregate

    return custom_aggregate(e.table("part"), ["p_brand"], "p_size", lambda: (99, -1), lambda s, v: (min(s[0], v), max(s[1], v)), lambda a, b: (min(a[0], b[0]), max(a[1], b[1])), lambda s: int(s[1] - s[0]), "long", "spread")


query("agg_custom", _median_range, "SELECT p_brand, max(p_size) - min(p_size) AS spread FROM part GROUP BY 1")


def _words(e: Engine) -> DataFrame:
    from lathe.operators.custom import table_function

    return table_function(e.table("part").select("p_partkey", "p_type"), lambda r: ({"p_partkey": r["p_partkey"], "word": w} for w in r["p_type"].split()), "p_partkey long, word string")


query("table_function", _words, "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
query("agg_chi_square", _lazy("lathe.functions.stats", lambda m, e: e.table("part").select("p_partkey", F.round(m.chi_square([F.col("p_size"), F.lit(20)], [F.lit(25.0), F.lit(25.0)]), 6).alias("x"))),
      "SELECT p_partkey, round((p_size - 25) ** 2 / 25.0 + 1.0, 6) AS x FROM part")
query("population_groups", _lazy("lathe.operators.lists", lambda m, e: m.group_by_population(e.table("part"), "p_size", 1, 1_000_000)), "SELECT p_size, count(*) AS count, 0 AS \"group\" FROM part GROUP BY 1")

# Rows by place

query("select_rownum", lambda e: e.frame({"from": e.table("orders").repartition(16, "o_custkey"), "select": ["o_orderkey", {"name": "n", "value": "rownum"}], "sort": "o_orderkey"}), "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders")
query("window_rownum_all", {"from": "orders", "select": ["o_orderkey"], "window": {"name": "n", "value": "rownum", "sort": "o_orderkey"}}, "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders")


def _fluent(f: Callable[[Any, Any, Engine], Any]) -> Callable[[Engine], DataFrame]:
    def run(e: Engine) -> DataFrame:
        from lathe.streaming.fluent import it, stream

        return f(stream, it, e).df

    return run


query("stream_enumerate", _fluent(lambda stream, it, e: stream(e.table("orders").select("o_orderkey").repartition(16)).sort("o_orderkey", reverse=True).enumerate()), "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS \"index\" FROM orders")
query("stream_reverse", _fluent(lambda stream, it, e: stream(e.table("orders").select("o_orderkey")).sort("o_orderkey", reverse=True).reverse().enumerate("i")), "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders")
query("stream_zip", _fluent(lambda stream, it, e: stream(e.table("customer").select("c_custkey")).sort("c_custkey").zip(stream(e.table("part").select("p_partkey")).sort("p_partkey", reverse=True))),
      "SELECT c_custkey, p_partkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) FULL JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey DESC) AS i FROM part) USING (i)")
query("stream_attach_flatten", _fluent(lambda stream, it, e: stream(e.table("part").select("p_partkey", F.split("p_type", " ").alias("w"))).flatten("w").filter({"ne": {"w": "STEEL"}}).attach(n=it.w.call("length"))), "SELECT * , length(w) AS n FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part) WHERE w <> 'STEEL'")
query("stream_distinct_group", _fluent(lambda stream, it, e: stream(e.table("part").select("p_brand", "p_size")).distinct().group(it.p_brand).map({"brand": it.group, "n": F.size("rows")})), "SELECT p_brand AS brand, count(DISTINCT p_size) AS n FROM part GROUP BY 1")
query("stream_append_extend", _fluent(lambda stream, it, e: stream(e.table("region").select("r_regionkey")).extend([{"r_regionkey": 90}, {"r_regionkey": 91}]).append({"r_regionkey": 92})), "SELECT r_regionkey FROM region UNION ALL SELECT unnest([90, 91, 92])")
query("window_sliding", lambda e: __import__("lathe.streaming.events", fromlist=["sliding"]).sliding(e.table("events"), "ts", "2 days", "1 day", ["event_type"], F.count(F.lit(1)).alias("n")).select(F.unix_seconds("start").alias("day"), "event_type", "n"),
      "SELECT CAST(epoch(d) AS BIGINT) AS day, event_type, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS d, event_type FROM events) GROUP BY 1, 2")

# Set operations and lists

for _name, _sqltext in [
    ("union", "SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders"),
    ("symmetric_difference", "(SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))"),
]:
    query(f"set_{_name}", _lazy("lathe.operators.lists", (lambda name: lambda m, e: getattr(m, name)(e.table("customer").select("c_custkey"), e.table("orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), ["c_custkey"]))(_name)), _sqltext)
query("list_multiset_add", _lazy("lathe.operators.lists", lambda m, e: m.multiset_add(m.multiset(e.table("customer"), ["c_nationkey"]), m.multiset(e.table("supplier").withColumnRenamed("s_nationkey", "c_nationkey"), ["c_nationkey"]), ["c_nationkey"])),
      "SELECT c_nationkey, count(*) AS count FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
_CUBE = "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2"
for _name, _f, _sqltext in [
    ("add", lambda a, b: a + b, f"SELECT o_orderstatus, o_orderpriority, n + t AS n FROM ({_CUBE}) JOIN (SELECT o_orderstatus, count(*) AS t FROM orders GROUP BY 1) USING (o_orderstatus)"),
    ("subtract", lambda a, b: a - b, f"SELECT o_orderstatus, o_orderpriority, n - t AS n FROM ({_CUBE}) JOIN (SELECT o_orderstatus, count(*) AS t FROM orders GROUP BY 1) USING (o_orderstatus)"),
    ("multiply", lambda a, b: a * b, f"SELECT o_orderstatus, o_orderpriority, n * t AS n FROM ({_CUBE}) JOIN (SELECT o_orderstatus, count(*) AS t FROM orders GROUP BY 1) USING (o_orderstatus)"),
    ("compare", lambda a, b: a < b, f"SELECT o_orderstatus, o_orderpriority, n < t AS n FROM ({_CUBE}) JOIN (SELECT o_orderstatus, count(*) AS t FROM orders GROUP BY 1) USING (o_orderstatus)"),
    ("slice", lambda a, b: a[{"o_orderstatus": "F"}], "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1"),
    ("filter", lambda a, b: a.filter({"gt": {"n": 100}}), f"SELECT * FROM ({_CUBE}) WHERE n > 100"),
    ("total", lambda a, b: a.total(["o_orderpriority"]), "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1"),
    ("forall", lambda a, b: a.forall(lambda c: c["n"] * F.length("o_orderstatus") + 1), f"SELECT o_orderstatus, o_orderpriority, n + 1 AS n FROM ({_CUBE})"),
]:
    query(f"cube_{_name}", _lazy("lathe.operators.lists", (lambda f: lambda m, e: f(m.Cube(e.table("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")), ["o_orderstatus", "o_orderpriority"], "n"), m.Cube(e.table("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), ["o_orderstatus"], "n")).df)(_f)), _sqltext)

# Edges

_COUNT = {"name": "n", "aggregate": "count"}
query("edge_numeric", {"from": "part", "edges": [{"name": "size", "value": "p_size", "domain": {"type": "numeric", "min": 0, "max": 30}}], "select": _COUNT}, "SELECT CASE WHEN p_size >= 0 AND p_size < 30 THEN 0.0 END AS size, count(*) AS n FROM part GROUP BY 1")
query("edge_value_domain", {"from": "nation", "edges": [{"name": "r", "value": "n_regionkey", "domain": {"type": "value"}}], "select": _COUNT}, "SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1")
query("edge_no_nulls", {"from": "customer", "edges": [{"name": "s", "value": "c_mktsegment", "allowNulls": False, "domain": {"type": "set", "partitions": ["BUILDING", "MACHINERY"]}}], "select": _COUNT}, "SELECT c_mktsegment AS s, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
query("edge_named_ranges", {"from": "part", "edges": [{"name": "size", "value": "p_size", "domain": {"type": "range", "partitions": [{"name": "low", "min": 0, "max": 10}, {"name": "high", "min": 30, "max": 100}]}}], "select": _COUNT},
      "SELECT CASE WHEN p_size < 10 THEN 'low' WHEN p_size >= 30 THEN 'high' END AS size, count(*) AS n FROM part GROUP BY 1")
query("edge_measures", {"from": "orders", "edges": [{"name": "s", "value": "o_orderstatus", "domain": {"type": "set", "partitions": ["F", "O", "X"]}}], "select": [{"name": "m", "value": "o_orderkey", "aggregate": "max"}, {"name": "d", "value": "o_orderkey", "aggregate": "sum", "default": 0}]},
      "SELECT s, max(o_orderkey) AS m, coalesce(sum(o_orderkey), 0) AS d FROM (VALUES ('F'), ('O'), ('X'), (NULL)) v(s) LEFT JOIN (SELECT CASE WHEN o_orderstatus IN ('F', 'O', 'X') THEN o_orderstatus END AS p, o_orderkey FROM orders) ON s IS NOT DISTINCT FROM p GROUP BY 1")
query("edge_multivalue", lambda e: e.frame({"from": e.table("part").select(F.split("p_type", " ").alias("w")), "edges": [{"name": "word", "value": "w", "allowNulls": False, "domain": {"type": "default", "limit": 1000}}], "select": _COUNT}), "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part) GROUP BY 1")
query("edge_tuple_groupby", {"from": "orders", "groupby": ["o_orderstatus", {"name": "p", "value": {"left": {"o_orderpriority": 1}}}], "select": _COUNT}, "SELECT o_orderstatus, left(o_orderpriority, 1) AS p, count(*) AS n FROM orders GROUP BY 1, 2")
query("edge_row_order", lambda e: __import__("lathe.operators.lists", fromlist=["with_rownum"]).with_rownum(e.frame({"from": "orders", "edges": [{"name": "s", "value": "o_orderstatus", "domain": {"type": "set", "partitions": ["P", "F", "O"]}}], "select": _COUNT}), "place"),
      "SELECT s, count(o_orderkey) AS n, place FROM (VALUES ('P', 0), ('F', 1), ('O', 2), (NULL, 3)) v(s, place) LEFT JOIN orders ON o_orderstatus = s GROUP BY s, place")
query("edge_week", {"from": "events", "edges": [{"name": "week", "value": "ts", "allowNulls": False, "domain": {"type": "time", "min": "2024-01-07", "max": "2024-01-28", "interval": "week"}}], "select": _COUNT},
      "SELECT w AS week, count(event_id) AS n FROM (SELECT CAST(unnest([1704585600, 1705190400, 1705795200]) AS DOUBLE) AS w) LEFT JOIN events ON epoch(ts) >= w AND epoch(ts) < w + 604800 GROUP BY 1")
query("edge_duration", {"from": {"from": "events", "select": ["event_id", {"name": "since", "value": {"sub": [{"unix": "ts"}, 1704067200]}}]}, "edges": [{"name": "since", "value": "since", "allowNulls": False, "domain": {"type": "duration", "min": "0day", "max": "3day", "interval": "day"}}], "select": _COUNT},
      "SELECT w AS since, count(event_id) AS n FROM (SELECT CAST(unnest([0, 86400, 172800]) AS DOUBLE) AS w) LEFT JOIN events ON epoch(ts) - 1704067200 >= w AND epoch(ts) - 1704067200 < w + 86400 GROUP BY 1")


def _dimensions(e: Engine) -> DataFrame:
    e.dimensions = {"size": {"partitions": [{"name": "small", "where": {"lt": {"p_size": 20}}, "partitions": [{"name": "tiny", "where": {"lt": {"p_size": 5}}}, {"name": "rest", "where": {"range": {"p_size": {"gte": 5, "lt": 20}}}}]}, {"name": "large", "where": {"gte": {"p_size": 20}}}]}}
    return e.frame({"from": "part", "edges": ["size.small"], "select": _COUNT}).withColumnRenamed("size.small", "size")


query("edge_dimension", _dimensions, "SELECT CASE WHEN p_size < 5 THEN 'tiny' WHEN p_size < 20 THEN 'rest' END AS size, count(*) AS n FROM part GROUP BY 1")

# Nested data

_TURNS = lambda q: lambda e: (_talks(e), e.frame(q))[1]
query("nested_sorted", lambda e: _TURNS({"from": "talks", "select": ["conv_id", {"name": "x", "value": {"from": "turns", "select": "turn", "sort": [{"role": "desc"}, {"turn": "desc"}], "limit": 3}}]})(e).select("conv_id", F.concat_ws(",", "x").alias("x")),
      "SELECT conv_id, string_agg(turn, ',' ORDER BY role DESC, turn DESC) AS x FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY role DESC, turn DESC) AS i FROM conversations) WHERE i <= 3 GROUP BY 1")
query("nested_group", lambda e: _TURNS({"from": "talks", "select": ["conv_id", {"name": "x", "value": {"group": ["turns", "role"]}}]})(e).select("conv_id", F.explode("x").alias("g")).select("conv_id", "g.role", F.size("g.group").alias("n")),
      "SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2")
query("nested_first_last", _TURNS({"from": "talks", "select": ["conv_id", {"name": "a", "value": {"first": "turns.turn"}}, {"name": "b", "value": {"last": "turns.turn"}}, {"name": "c", "value": {"offset": ["turns.turn", 1]}}]}),
      "SELECT conv_id, min(turn) AS a, max(turn) AS b, (list(turn ORDER BY turn))[2] AS c FROM conversations GROUP BY 1")
query("nested_not_exists", _TURNS({"from": "talks", "select": ["conv_id"], "where": {"not": {"nested": {"path": "turns", "query": {"eq": {"role": "system"}}}}}}), "SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'system') = 0")
query("nested_sum", _TURNS({"from": "talks", "select": ["conv_id", {"name": "x", "value": {"sum": "turns.turn"}}, {"name": "n", "value": {"count": "turns.turn"}}]}), "SELECT conv_id, sum(turn) AS x, count(turn) AS n FROM conversations GROUP BY 1")
query("nested_edges", _TURNS({"from": "talks.turns", "edges": [{"name": "role", "value": "role", "allowNulls": False}], "select": [_COUNT, {"name": "m", "value": "turn", "aggregate": "max"}]}), "SELECT role, count(*) AS n, max(turn) AS m FROM conversations GROUP BY 1")
query("select_leaves", lambda e: e.frame({"from": e.table("nation").select(F.struct("n_nationkey", "n_name").alias("a"), F.col("n_regionkey").alias("r")), "select": ["a.*", "r"]}).toDF("k", "name", "r"), "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation")

# Expressions

_P = ("part", "p_partkey")
for _name, _e, _sqltext in [
    ("null", {"coalesce": [{"null": {}}, "p_size"]}, "p_size"), ("true", {"and": [{"true": {}}, {"gt": {"p_size": 10}}]}, "p_size > 10"), ("false", {"or": [{"false": {}}, {"gt": {"p_size": 10}}]}, "p_size > 10"),
    ("sum_row", {"sum": ["p_size", {"literal": 7}]}, "p_size + 7"), ("is_number", {"is_number": "p_size"}, "p_size"), ("is_text", {"is_text": "p_brand"}, "p_brand"), ("get", {"get": [{"split": {"p_type": " "}}, 1]}, "string_split(p_type, ' ')[2]"),
    ("first", {"first": {"split": {"p_type": " "}}}, "string_split(p_type, ' ')[1]"), ("last", {"last": {"split": {"p_type": " "}}}, "string_split(p_type, ' ')[-1]"), ("limit_list", {"length": {"limit": [{"split": {"p_type": " "}}, 2]}}, "least(2, len(string_split(p_type, ' ')))"),
    ("from_unix", {"unix": {"from_unix": {"mul": ["p_size", 86400]}}}, "CAST(p_size * 86400 AS DOUBLE)"), ("hex", {"hex": "p_brand"}, "lower(hex(p_brand))"), ("base64", {"base64": "p_brand"}, "base64(encode(p_brand))"), ("unbase64", {"unbase64": {"base64": "p_brand"}}, "p_brand"),
    ("md5", {"md5": "p_brand"}, "md5(p_brand)"), ("sha1", {"sha1": "p_brand"}, "sha1(p_brand)"), ("sha256", {"sha256": "p_brand"}, "sha256(p_brand)"), ("in_list", {"in": [{"literal": "STEEL"}, {"split": {"p_type": " "}}]}, "list_contains(string_split(p_type, ' '), 'STEEL')"),
    ("eq_text", {"eq": ["p_brand", {"literal": "Brand#11"}]}, "p_brand = 'Brand#11'"), ("sign", {"sign": {"sub": ["p_size", 25]}}, "sign(p_size - 25)"), ("sqrt", {"round": [{"sqrt": "p_size"}, 6]}, "round(sqrt(p_size), 6)"), ("log", {"round": [{"log": "p_size"}, 6]}, "round(ln(p_size), 6)"),
    ("log10", {"round": [{"log10": "p_size"}, 6]}, "round(log10(p_size), 6)"), ("lower", {"lower": "p_name"}, "lower(p_name)"), ("default", {"default": [{"when": {"lt": {"p_size": 10}}, "then": "p_size"}, 0]}, "CASE WHEN p_size < 10 THEN p_size ELSE 0 END"),
]:
    scalar(f"expr_{_name}", *_P, _e, _sqltext)
#: 2024-02-03T04:05:06, which is now in the queries of dates.
_NOW = 1706933106


def _date(text: str) -> Callable[[Engine], DataFrame]:
    def run(e: Engine) -> DataFrame:
        e.now = _NOW
        return e.frame({"from": "region", "select": ["r_regionkey", {"name": "x", "value": {"number": {"date": text}}}]})

    return run


for _name, _text, _seconds in [
    ("iso", "2024-02-03T04:05:06", _NOW), ("day", "2024-02-03", 1706918400), ("month_name", "03 Feb 2024", 1706918400), ("compact", "20240203", 1706918400), ("millis", "1706918400000", 1706918400), ("year_month", "2024-02", 1706745600),
    ("now", "now", _NOW), ("today", "today", 1706918400), ("tomorrow", "tomorrow", 1707004800), ("eod", "eod", 1707004800), ("today_week", "today-week", 1706313600), ("now_days", "now-2day+hour", _NOW - 172800 + 3600),
    ("floor_day", "now|day", 1706918400), ("floor_week", "now|week", 1706400000), ("floor_month", "now|month", 1706745600), ("plus_month", "today+month", 1709424000), ("floor_hour", "now-day|hour", 1706846400 - 0),
]:
    query(f"date_{_name}", _date(_text), f"SELECT r_regionkey, CAST({_seconds} AS DOUBLE) AS x FROM region")

# Tables

query("table_clear", lambda e: _store().update(e.table("customer").select("c_custkey", "c_acctbal"), clear=["c_acctbal"], where={"lt": {"c_acctbal": 0}}), "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer")
query("table_insert_wider", lambda e: _store().insert(e.table("region").select("r_regionkey"), e.table("nation").select(F.col("n_nationkey").alias("r_regionkey"), "n_name")), "SELECT r_regionkey, NULL AS n_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
query("table_merge_shards", lambda e: _store().merge_shards([e.table("events").where(f"event_id % 3 = {k}").select("user_id", "event_id", "event_type") for k in range(3)], ["user_id"], "event_id"), "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
query("table_expire", lambda e: _store().expire(e.table("events").select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t")), "t", 1706745600, 14 * 86400).select("event_id"), "SELECT event_id FROM events WHERE floor(epoch(ts)) >= 1706745600 - 14 * 86400")
_RELATIONS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("lineitem", "l_partkey", "part", "p_partkey")]


def _tree(e: Engine) -> DataFrame:
    names = ("customer", "orders", "lineitem", "nation", "region", "part")
    found = _store().extract_tree({t: e.table(t) for t in names}, _RELATIONS, "customer", e.table("customer").where("c_custkey <= 20").select("c_custkey"))
    out = None
    for t in names:
        n = found[t].agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


query("fk_extract", _tree, """WITH o AS (SELECT * FROM orders WHERE o_custkey <= 20), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)), n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey <= 20))
SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_custkey <= 20 UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l UNION ALL SELECT 'nation', count(*) FROM n
UNION ALL SELECT 'region', count(*) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n) UNION ALL SELECT 'part', count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM l)""")
query("meta_columns", lambda e: e.frame({"from": "meta.columns", "select": ["table", "name"], "where": {"in": {"table": ["region", "nation"]}}}), "SELECT * FROM (VALUES ('region', 'r_regionkey'), ('region', 'r_name'), ('nation', 'n_nationkey'), ('nation', 'n_name'), ('nation', 'n_regionkey')) v(\"table\", name)")

# Graphs

_EDGES = lambda e: e.table("nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst")).unionByName(e.table("region").select(F.lit("top").alias("src"), F.concat(F.lit("r"), "r_regionkey").alias("dst")))
query("graph_dominators", _lazy("lathe.operators.graph", lambda m, e: m.dominators(_EDGES(e), "top")), "SELECT 'top' AS node, 'top' AS dominator UNION ALL SELECT 'r' || r_regionkey, unnest(['top', 'r' || r_regionkey]) FROM region UNION ALL SELECT 'n' || n_nationkey, unnest(['top', 'r' || n_regionkey, 'n' || n_nationkey]) FROM nation")
query("graph_ancestors", _lazy("lathe.operators.graph", lambda m, e: m.ancestors(_EDGES(e), e.spark.createDataFrame([("n3",), ("n7",)], "node string"))), "SELECT 'top' AS node UNION SELECT 'r' || n_regionkey FROM nation WHERE n_nationkey IN (3, 7)")
query("graph_depths", _lazy("lathe.operators.graph", lambda m, e: m.depths(_EDGES(e))), "SELECT 'top' AS node, 0 AS depth UNION ALL SELECT 'r' || r_regionkey, 1 FROM region UNION ALL SELECT 'n' || n_nationkey, 2 FROM nation")
query("graph_dfs", _lazy("lathe.operators.graph", lambda m, e: m.dfs(_EDGES(e), "top").select("node", "parent", "place")),
      "SELECT node, parent, row_number() OVER (ORDER BY k) - 1 AS place FROM (SELECT 'top' AS node, NULL AS parent, '' AS k UNION ALL SELECT 'r' || r_regionkey, 'top', 'r' || r_regionkey FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'r' || n_regionkey || ' n' || n_nationkey FROM nation)")
query("seq_intervals", _lazy("lathe.operators.windows", lambda m, e: m.intervals(e.table("part").select("p_partkey", F.lit(0).alias("a"), F.col("p_size").alias("b")), "a", "b", 10).select("p_partkey", F.col("interval.min").cast("long").alias("low"), F.col("interval.max").cast("long").alias("high"))),
      "SELECT p_partkey, i * 10 AS low, least(p_size, i * 10 + 10) AS high FROM part, range(0, 10) t(i) WHERE i * 10 < p_size")
query("window_where", {"from": "orders", "select": ["o_orderkey", "o_custkey"], "window": {"name": "n", "value": "o_orderkey", "aggregate": "count", "edges": ["o_custkey"], "where": {"gt": {"o_orderkey": 1000}}}}, "SELECT o_orderkey, o_custkey, count(o_orderkey) FILTER (o_orderkey > 1000) OVER (PARTITION BY o_custkey) AS n FROM orders")
query("window_sliding_aggregates", {"from": "orders", "select": ["o_orderkey", "o_custkey"], "window": [{"name": a, "value": "o_orderkey", "aggregate": a, "edges": ["o_custkey"], "sort": "o_orderkey", "range": {"min": -2, "max": 1}} for a in ("min", "max", "avg", "count")]},
      "SELECT o_orderkey, o_custkey, " + ", ".join(f"{a}(o_orderkey) OVER w AS \"{a}\"" for a in ("min", "max", "avg", "count")) + " FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")

# SQL text

for _name, _text, _other in [
    ("qualify_in_cte", "WITH f AS (SELECT o_custkey, o_orderkey, extract(year FROM o_orderdate) AS y FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) SELECT o_custkey, y FROM f", "SELECT o_custkey, year(arg_min(o_orderdate, o_orderkey)) AS y FROM orders GROUP BY 1"),
    ("qualify_in_subquery", "SELECT count(*) AS n FROM (SELECT o_custkey FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) = 1) x", "SELECT count(*) AS n FROM (SELECT 1 FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) = 1)"),
    ("top", "SELECT TOP 7 c_custkey FROM customer ORDER BY c_custkey DESC", "SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 7"),
    ("top_percent", "SELECT TOP 10 PERCENT p_partkey FROM part ORDER BY p_partkey", "SELECT p_partkey FROM part QUALIFY row_number() OVER (ORDER BY p_partkey) <= ceil(0.1 * count(*) OVER ())"),
    ("top_in_subquery", "SELECT max(k) AS k FROM (SELECT TOP 5 c_custkey AS k FROM customer ORDER BY c_custkey) x", "SELECT 5 + min(c_custkey) - 1 AS k FROM customer"),
    ("similar_unanchored", "SELECT p_partkey FROM part WHERE p_brand SIMILAR TO '%1_' OR p_type SIMILAR TO 'STEEL'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, '.*1.') OR p_type = 'STEEL'"),
    ("not_similar", "SELECT p_partkey FROM part WHERE p_brand NOT SIMILAR TO 'Brand#(1|2)_'", "SELECT p_partkey FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#(1|2).')"),
    ("pivot", "SELECT * FROM (SELECT o_orderstatus, o_orderpriority FROM orders) PIVOT (count(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1"),
    ("unpivot", "SELECT * FROM (SELECT n_nationkey, n_regionkey, n_nationkey AS k FROM nation) UNPIVOT (v FOR name IN (n_nationkey, n_regionkey))", "SELECT n_nationkey AS k, 'n_nationkey' AS name, n_nationkey AS v FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', n_regionkey FROM nation"),
    ("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    ("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    ("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
    ("substring_from", "SELECT p_partkey, substring(p_name FROM 2 FOR 4) AS x, trim(BOTH 'a' FROM p_name) AS y FROM part", "SELECT p_partkey, substring(p_name, 2, 4) AS x, trim(p_name, 'a') AS y FROM part"),
    ("minus_all", "SELECT c_nationkey AS k FROM customer MINUS SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier"),
    ("case_between_like", "SELECT p_partkey, CASE WHEN p_size BETWEEN 5 AND 9 THEN 'a' WHEN p_name LIKE '%e' THEN 'b' ELSE 'c' END AS x FROM part WHERE p_size NOT BETWEEN 20 AND 30 AND p_brand NOT IN ('Brand#11')", "SELECT p_partkey, CASE WHEN p_size BETWEEN 5 AND 9 THEN 'a' WHEN p_name LIKE '%e' THEN 'b' ELSE 'c' END AS x FROM part WHERE p_size NOT BETWEEN 20 AND 30 AND p_brand NOT IN ('Brand#11')"),
    ("window_ranks", "SELECT p_partkey, ntile(4) OVER (ORDER BY p_partkey) AS q, dense_rank() OVER (ORDER BY p_size) AS d FROM part", "SELECT p_partkey, ntile(4) OVER (ORDER BY p_partkey) AS q, dense_rank() OVER (ORDER BY p_size) AS d FROM part"),
]:
    query(f"sql_{_name}", _sql(_text), _other)


def _changes(*statements: str) -> Callable[[Engine], DataFrame]:
    """Statements one after the other on copies t (of nation) and s (of region); the last one's table."""

    def run(e: Engine) -> DataFrame:
        from lathe.plans import sqltext

        tables = {"t": e.table("nation").select("n_nationkey", "n_name", "n_regionkey"), "s": e.table("region").select("r_regionkey", "r_name")}
        out = None
        for i, text in enumerate(statements):
            out = sqltext.run(e.spark, text, tables if i == 0 else None)
        return out

    return run


query("sql_insert", _changes("INSERT INTO t (n_nationkey, n_name) SELECT r_regionkey + 100, r_name FROM s"), "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 100, r_name, NULL FROM region")
query("sql_update", _changes("UPDATE t SET n_name = lower(n_name), n_regionkey = n_regionkey + 1 WHERE n_regionkey < 2"), "SELECT n_nationkey, CASE WHEN n_regionkey < 2 THEN lower(n_name) ELSE n_name END AS n_name, CASE WHEN n_regionkey < 2 THEN n_regionkey + 1 ELSE n_regionkey END AS n_regionkey FROM nation")
query("sql_delete", _changes("DELETE FROM t WHERE n_name LIKE 'A%' OR n_regionkey = 3", "DELETE FROM t WHERE n_regionkey = 4"), "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE NOT (n_name LIKE 'A%' OR n_regionkey = 3) AND n_regionkey <> 4")
query("sql_merge", _changes("MERGE INTO t USING s ON t.n_nationkey = s.r_regionkey WHEN MATCHED AND s.r_regionkey = 0 THEN DELETE WHEN MATCHED THEN UPDATE SET n_name = s.r_name WHEN NOT MATCHED THEN INSERT (n_nationkey, n_name) VALUES (s.r_regionkey + 100, s.r_name)"),
      "SELECT n_nationkey, coalesce(r_name, n_name) AS n_name, n_regionkey FROM nation LEFT JOIN region ON n_nationkey = r_regionkey WHERE n_nationkey <> 0")
query("sql_create_as", _changes("CREATE TABLE u AS SELECT r_name, count(*) AS n FROM t JOIN s ON n_regionkey = r_regionkey GROUP BY r_name"), "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")


def _parsed_where(text: str) -> Callable[[Engine], DataFrame]:
    """The where clause of parsed SQL, run by the engine."""

    def run(e: Engine) -> DataFrame:
        from lathe.plans.sqljson import expression, parse

        return e.frame({"from": "part", "select": ["p_partkey"], "where": expression(parse(f"SELECT p_partkey FROM part WHERE {text}")["where"])})

    return run


for _name, _text in [
    ("between", "p_size BETWEEN 10 AND 20"), ("not_between", "p_size NOT BETWEEN 10 AND 20"), ("like", "p_name LIKE '%a_e%'"), ("not_like", "p_brand NOT LIKE 'Brand#1%'"), ("in", "p_size IN (1, 2, 3)"), ("not_in", "p_size NOT IN (1, 2, 3)"),
    ("distinct", "p_size IS NOT DISTINCT FROM 7"), ("null", "p_size IS NOT NULL AND NOT p_size > 30"), ("arithmetic", "p_size * 2 + 1 > 50 OR p_size - 3 < 2"),
]:
    query(f"sqljson_{_name}", _parsed_where(_text), f"SELECT p_partkey FROM part WHERE {_text}")
