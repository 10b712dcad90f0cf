"""Named queries over the test tables, each with equivalent SQL.

Each entry is a JSON query, or a function of an engine, and the SQL that gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.plans.query import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
CATALOG: dict[str, tuple[Any, str | None]] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, {t: (lambda t=t: spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in TABLES}, limit=None)


def query(name: str, q: Any, sql: str | None = None) -> None:
    CATALOG[name] = (q, sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(q: Any) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: q(engine(spark, sf_dir)) if callable(q) else engine(spark, sf_dir).frame(q)

    return {n: runner(q) for n, (q, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in CATALOG.items() if sql}


def scalar(name: str, table: str, key: str, expression: Any, sql: str, where: Any = None) -> None:
    """An expression for each row of a table."""
    q = {"from": table, "select": [key, {"name": "x", "value": expression}]}
    if where is not None:
        q["where"] = where
    query(name, q, sql if sql.lstrip().lower().startswith(("select", "with")) else f"SELECT {key}, {sql} AS x FROM {table}")


# Query clauses

query("pricing_summary", {
    "from": "lineitem", "where": {"lte": {"l_shipdate": {"date": "1998-09-02"}}}, "groupby": ["l_returnflag", "l_linestatus"],
    "select": [
        {"name": "sum_qty", "value": {"round": ["l_quantity", 2]}, "aggregate": "sum"},
        {"name": "avg_qty", "value": "l_quantity", "aggregate": "avg"},
        {"name": "min_disc", "value": "l_discount", "aggregate": "min"},
        {"name": "max_disc", "value": "l_discount", "aggregate": "max"},
        {"name": "n", "aggregate": "count"},
    ],
}, "SELECT l_returnflag, l_linestatus, sum(round(l_quantity,2)) AS sum_qty, avg(l_quantity) AS avg_qty, min(l_discount) AS min_disc, max(l_discount) AS max_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
query("select_columns", {"from": "nation", "select": ["n_nationkey", {"name": "nation", "value": "n_name"}]}, "SELECT n_nationkey, n_name AS nation FROM nation")
query("select_star", {"from": "region", "select": "*"}, "SELECT * FROM region")
query("where_and_or", {"from": "orders", "select": ["o_orderkey"], "where": {"or": [{"and": [{"gt": {"o_totalprice": 200000}}, {"eq": {"o_orderstatus": "F"}}]}, {"prefix": {"o_orderpriority": "1"}}]}}, "SELECT o_orderkey FROM orders WHERE (o_totalprice > 200000 AND o_orderstatus = 'F') OR o_orderpriority LIKE '1%'")
query("where_not_in", {"from": "part", "select": ["p_partkey"], "where": {"not": {"in": {"p_brand": ["Brand#11", "Brand#12", "Brand#13"]}}}}, "SELECT p_partkey FROM part WHERE p_brand NOT IN ('Brand#11','Brand#12','Brand#13')")
query("where_range", {"from": "part", "select": ["p_partkey"], "where": {"range": {"p_size": {"gte": 5, "lt": 15}}}}, "SELECT p_partkey FROM part WHERE p_size >= 5 AND p_size < 15")
query("sort_limit", {"from": "customer", "select": ["c_custkey", "c_acctbal"], "sort": [{"c_acctbal": "desc"}, "c_custkey"], "limit": 25}, "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
query("sub_query", {"from": {"from": "orders", "groupby": "o_custkey", "select": {"name": "n", "aggregate": "count"}}, "groupby": "n", "select": {"name": "customers", "aggregate": "count"}}, "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
query("having", {"from": "orders", "groupby": "o_custkey", "select": {"name": "n", "aggregate": "count"}, "having": {"gt": {"n": 15}}}, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
query("distinct", {"from": "part", "select": ["p_brand"], "distinct": True}, "SELECT DISTINCT p_brand FROM part")
query("groupby_default_count", {"from": "customer", "groupby": "c_mktsegment"}, "SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY 1")
query("groupby_expression", {"from": "part", "groupby": [{"name": "band", "value": {"floor": {"p_size": 10}}}], "select": {"name": "n", "aggregate": "count"}}, "SELECT floor(p_size / 10.0) * 10 AS band, count(*) AS n FROM part GROUP BY 1")

# Aggregates

for _name, _spec, _sql in [
    ("count_value", {"value": {"when": {"gt": {"v": 5}}, "then": "v"}, "aggregate": "count"}, "count(CASE WHEN v > 5 THEN v END)"),
    ("sum_default", {"value": {"when": {"gt": {"v": 1e9}}, "then": "v"}, "aggregate": "sum", "default": -1}, "coalesce(sum(CASE WHEN v > 1e9 THEN v END), -1)"),
    ("s2", {"value": "q", "aggregate": "s2"}, "sum(CAST(q AS DOUBLE) * q)"),
    ("median", {"value": "v", "aggregate": "median"}, "median(v)"),
    ("percentile", {"value": "v", "aggregate": "percentile", "percentile": 0.9}, "quantile_cont(v, 0.9)"),
    ("cardinality", {"value": "q", "aggregate": "cardinality"}, "count(DISTINCT q)"),
    ("min_boolean", {"value": {"gt": {"v": 1000}}, "aggregate": "min"}, "min(CASE WHEN v > 1000 THEN 1.0 ELSE 0.0 END)"),
    ("and", {"value": {"gt": {"v": 0}}, "aggregate": "and"}, "bool_and(v > 0)"),
    ("or", {"value": {"gt": {"v": 2000}}, "aggregate": "or"}, "bool_or(v > 2000)"),
    ("exists", {"value": "v", "aggregate": "exists"}, "count(v) > 0"),
    ("union", {"value": "p_size", "aggregate": "union"}, None),
]:
    _columns = "p_brand AS g, p_retailprice AS v, p_size AS q, p_size"
    query(f"agg_{_name}", {"from": {"from": "part", "select": [{"name": "g", "value": "p_brand"}, {"name": "v", "value": "p_retailprice"}, {"name": "q", "value": "p_size"}, "p_size"]}, "groupby": "g", "select": {"name": "x", **_spec}}, f"SELECT g, {_sql or 'list_sort(list(DISTINCT p_size))'} AS x FROM (SELECT {_columns} FROM part) GROUP BY g")
query("agg_var_std", {"from": "part", "groupby": "p_brand", "select": [{"name": "var", "value": "p_size", "aggregate": "var"}, {"name": "std", "value": "p_size", "aggregate": "std"}]}, "SELECT p_brand, var_pop(p_size) AS var, stddev_pop(p_size) AS std FROM part GROUP BY 1")
query("agg_total", {"from": "lineitem", "select": [{"name": "n", "aggregate": "count"}, {"name": "q", "value": {"integer": "l_quantity"}, "aggregate": "sum"}]}, "SELECT count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem")
query("agg_first_last", lambda e: e.frame({"from": "orders", "groupby": "o_custkey", "select": [{"name": "low", "value": "o_orderkey", "aggregate": "min"}, {"name": "high", "value": "o_orderkey", "aggregate": "max"}]}), "SELECT o_custkey, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY 1")
query("agg_moments", lambda e: e.table("part").groupBy("p_brand").agg(F.round(F.skewness("p_size"), 6).alias("skew"), F.round(F.kurtosis("p_size"), 6).alias("kurtosis")), "SELECT p_brand, round((s3/n - 3*m*s2/n + 2*m*m*m) / power(v, 1.5), 6) AS skew, round((s4/n - 4*m*s3/n + 6*m*m*s2/n - 3*m*m*m*m) / (v*v) - 3, 6) AS kurtosis FROM (SELECT p_brand, count(*) AS n, avg(p_size) AS m, sum(p_size*p_size) AS s2, sum(p_size*p_size*p_size) AS s3, sum(p_size*p_size*p_size*p_size) AS s4, var_pop(p_size) AS v FROM part GROUP BY 1)")

# Edges and domains

query("edge_set", {"from": "orders", "edges": [{"name": "status", "value": "o_orderstatus", "domain": {"type": "set", "partitions": ["F", "O", "X"]}}], "select": {"name": "n", "aggregate": "count"}}, "SELECT p.status, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('X'), (NULL)) p(status) LEFT JOIN orders ON (CASE WHEN o_orderstatus IN ('F','O','X') THEN o_orderstatus END) IS NOT DISTINCT FROM p.status GROUP BY 1")
query("edge_range", {"from": "part", "edges": [{"name": "size", "value": "p_size", "domain": {"type": "range", "min": 0, "max": 40, "interval": 10}}], "select": {"name": "n", "aggregate": "count"}}, "SELECT p.size, count(p_partkey) AS n FROM (VALUES (0.0), (10.0), (20.0), (30.0), (NULL)) p0(size0), LATERAL (SELECT CAST(size0 AS DOUBLE) AS size) p LEFT JOIN part ON (CASE WHEN p_size >= 0 AND p_size < 40 THEN floor(p_size / 10.0) * 10 END) IS NOT DISTINCT FROM p.size GROUP BY 1")
query("edge_default_top", {"from": "nation", "edges": [{"name": "r", "value": "n_regionkey", "domain": {"type": "default", "limit": 3}}], "select": {"name": "n", "aggregate": "count"}}, "WITH top AS (SELECT n_regionkey AS r FROM nation GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3) SELECT top.r, count(*) AS n FROM nation LEFT JOIN top ON n_regionkey = top.r GROUP BY 1")
query("edge_two_dims", {"from": "orders", "edges": [{"name": "status", "value": "o_orderstatus", "domain": {"type": "set", "partitions": ["F", "O", "P"]}}, {"name": "priority", "value": {"left": {"o_orderpriority": 1}}, "domain": {"type": "set", "partitions": ["1", "2", "3"]}}], "select": {"name": "n", "aggregate": "count"}}, "SELECT s.status, p.priority, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), (NULL)) s(status) CROSS JOIN (VALUES ('1'), ('2'), ('3'), (NULL)) p(priority) LEFT JOIN orders ON (CASE WHEN o_orderstatus IN ('F','O','P') THEN o_orderstatus END) IS NOT DISTINCT FROM s.status AND (CASE WHEN left(o_orderpriority,1) IN ('1','2','3') THEN left(o_orderpriority,1) END) IS NOT DISTINCT FROM p.priority GROUP BY 1, 2")
query("edge_time", {"from": "events", "edges": [{"name": "day", "value": "ts", "allowNulls": False, "domain": {"type": "time", "min": "2024-01-01", "max": "2024-01-08", "interval": "day"}}], "select": {"name": "n", "aggregate": "count"}}, "SELECT CAST(epoch(d) AS DOUBLE) AS day, count(event_id) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-07', INTERVAL 1 DAY)) AS d) LEFT JOIN events ON date_trunc('day', ts) = d GROUP BY 1")
query("edge_overlap", {"from": {"from": "lineitem", "select": [{"name": "a", "value": "l_linenumber"}, {"name": "b", "value": {"add": ["l_linenumber", {"mod": ["l_orderkey", 4]}]}}]}, "edges": [{"name": "at", "allowNulls": False, "range": {"min": "a", "max": "b"}, "domain": {"type": "range", "min": 0, "max": 12, "interval": 1}}], "select": {"name": "n", "aggregate": "count"}}, "SELECT CAST(p AS DOUBLE) AS at, count(a) AS n FROM range(12) t(p) LEFT JOIN (SELECT l_linenumber AS a, l_linenumber + l_orderkey % 4 AS b FROM lineitem) ON p < b AND a < p + 1 GROUP BY 1")
query("edge_partitions_where", {"from": "customer", "edges": [{"name": "kind", "domain": {"type": "set", "partitions": [{"name": "rich", "where": {"gte": {"c_acctbal": 5000}}}, {"name": "debt", "where": {"lt": {"c_acctbal": 0}}}]}}], "select": {"name": "n", "aggregate": "count"}}, "SELECT k.kind, count(c_custkey) AS n FROM (VALUES ('rich'), ('debt'), (NULL)) k(kind) LEFT JOIN customer ON (CASE WHEN c_acctbal >= 5000 THEN 'rich' WHEN c_acctbal < 0 THEN 'debt' END) IS NOT DISTINCT FROM k.kind GROUP BY 1")

# Windows

query("window_rownum", {"from": "orders", "select": ["o_orderkey", "o_custkey"], "window": {"name": "n", "value": "rownum", "edges": ["o_custkey"], "sort": "o_orderkey"}}, "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders")
query("window_sliding_sum", {"from": "orders", "select": ["o_orderkey", "o_custkey"], "window": {"name": "s", "value": "o_orderkey", "aggregate": "sum", "edges": ["o_custkey"], "sort": "o_orderkey", "range": {"min": -2, "max": 0}}}, "SELECT o_orderkey, o_custkey, coalesce(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) AS s FROM orders")
query("window_neighbour", {"from": "orders", "select": ["o_orderkey", "o_custkey"], "window": {"name": "next", "value": {"rows": ["o_orderkey", 1]}, "edges": ["o_custkey"], "sort": "o_orderkey"}}, "SELECT o_orderkey, o_custkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next FROM orders")
query("window_max", {"from": "orders", "select": ["o_orderkey", "o_custkey"], "window": {"name": "m", "value": "o_orderkey", "aggregate": "max", "edges": ["o_custkey"]}}, "SELECT o_orderkey, o_custkey, max(o_orderkey) OVER (PARTITION BY o_custkey) AS m FROM orders")

# Expressions

_P = ("part", "p_partkey")
for _name, _e, _sql in [
    ("add", {"add": ["p_size", 1]}, "p_size + 1"), ("sub", {"sub": ["p_size", 3]}, "p_size - 3"), ("mul", {"mul": ["p_size", 2, 3]}, "p_size * 6"),
    ("div", {"div": ["p_retailprice", "p_size"]}, "p_retailprice / p_size"), ("div_zero", {"div": ["p_size", {"mod": ["p_size", 2]}], "default": -1}, "CASE WHEN p_size % 2 = 0 THEN -1.0 ELSE CAST(p_size AS DOUBLE) END"),
    ("mod", {"mod": [{"sub": ["p_size", 25]}, 7]}, "((p_size - 25) % 7 + 7) % 7"), ("exp", {"exp": ["p_size", 2]}, "power(p_size, 2)"), ("abs", {"abs": {"sub": ["p_size", 25]}}, "abs(p_size - 25)"),
    ("floor", {"floor": ["p_retailprice", 100]}, "floor(p_retailprice / 100) * 100"), ("ceiling", {"ceiling": "p_retailprice"}, "CAST(ceil(p_retailprice) AS BIGINT)"), ("round", {"round": ["p_retailprice", 1]}, "round(p_retailprice, 1)"),
    ("max_row", {"max": ["p_size", {"literal": 30}]}, "greatest(p_size, 30)"), ("min_row", {"min": ["p_size", {"literal": 30}]}, "least(p_size, 30)"),
    ("nulls_add", {"add": ["p_size", {"when": {"gt": {"p_size": 25}}, "then": 100}], "nulls": True}, "CAST(p_size + CASE WHEN p_size > 25 THEN 100 ELSE 0 END AS BIGINT)"),
    ("conservative_add", {"add": ["p_size", {"when": {"gt": {"p_size": 25}}, "then": 100}]}, "CASE WHEN p_size > 25 THEN p_size + 100 END"),
    ("count_row", {"count": ["p_size", {"when": {"gt": {"p_size": 25}}, "then": 1}]}, "1 + CASE WHEN p_size > 25 THEN 1 ELSE 0 END"),
    ("avg_row", {"avg": ["p_size", {"literal": 10}]}, "(p_size + 10) / 2.0"),
    ("concat", {"concat": ["p_brand", "p_type"], "separator": "/"}, "p_brand || '/' || p_type"), ("length", {"length": "p_name"}, "length(p_name)"),
    ("left", {"left": {"p_name": 4}}, "left(p_name, 4)"), ("right", {"right": {"p_name": 4}}, "right(p_name, 4)"), ("not_left", {"not_left": {"p_name": 4}}, "nullif(substr(p_name, 5), '')"),
    ("not_right", {"not_right": {"p_name": 4}}, "nullif(left(p_name, greatest(0, length(p_name) - 4)), '')"), ("find", {"find": {"p_type": "A"}}, "nullif(strpos(p_type, 'A'), 0) - 1"),
    ("find_default", {"find": {"p_type": "ZZ"}, "default": -1}, "-1"), ("between", {"between": {"p_brand": ["Brand", None]}}, "nullif(substr(p_brand, 6), '')"),
    ("between_places", {"between": {"p_brand": [1, 4]}}, "substr(p_brand, 2, 3)"), ("upper", {"upper": "p_name"}, "upper(p_name)"), ("text", {"text": "p_size"}, "CAST(p_size AS VARCHAR)"),
    ("text_number", {"text": {"floor": ["p_retailprice", 1]}}, "CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR)"), ("number", {"number": {"not_left": {"p_brand": 6}}}, "TRY_CAST(nullif(substr(p_brand, 7), '') AS DOUBLE)"),
    ("integer", {"integer": "p_retailprice"}, "CAST(trunc(p_retailprice) AS BIGINT)"), ("replace", {"replace": ["p_brand", {"literal": "#"}, {"literal": "-"}]}, "replace(p_brand, '#', '-')"),
    ("when", {"when": {"gte": {"p_size": 25}}, "then": {"literal": "big"}, "else": {"literal": "small"}}, "CASE WHEN p_size >= 25 THEN 'big' ELSE 'small' END"),
    ("case", {"case": [{"when": {"lt": {"p_size": 10}}, "then": 1}, {"when": {"lt": {"p_size": 20}}, "then": 2}, 3]}, "CASE WHEN p_size < 10 THEN 1 WHEN p_size < 20 THEN 2 ELSE 3 END"),
    ("coalesce", {"coalesce": [{"when": {"lt": {"p_size": 10}}, "then": "p_size"}, -1]}, "coalesce(CASE WHEN p_size < 10 THEN p_size END, -1)"),
    ("eq_null", {"eq": [{"when": {"lt": {"p_size": 10}}, "then": "p_size"}, {"when": {"lt": {"p_size": 5}}, "then": "p_size"}]}, "(CASE WHEN p_size < 10 THEN p_size END) IS NOT DISTINCT FROM (CASE WHEN p_size < 5 THEN p_size END)"),
    ("ne_null", {"ne": [{"when": {"lt": {"p_size": 10}}, "then": "p_size"}, 3]}, "coalesce((CASE WHEN p_size < 10 THEN p_size END) <> 3, false)"),
    ("missing", {"missing": {"when": {"lt": {"p_size": 10}}, "then": "p_size"}}, "p_size >= 10"), ("exists_op", {"exists": {"when": {"lt": {"p_size": 10}}, "then": "p_size"}}, "p_size < 10"),
    ("prefix", {"prefix": {"p_brand": "Brand#1"}}, "starts_with(p_brand, 'Brand#1')"), ("suffix", {"suffix": {"p_brand": "1"}}, "suffix(p_brand, '1')"), ("regex", {"regex": {"p_brand": "Brand#[1-3].*"}}, "regexp_full_match(p_brand, 'Brand#[1-3].*')"),
    ("boolean", {"boolean": "p_size"}, "p_size IS NOT NULL"), ("not", {"not": {"gt": {"p_size": 25}}}, "NOT coalesce(p_size > 25, false)"),
]:
    scalar(f"expr_{_name}", *_P, _e, _sql)
scalar("expr_unix", "events", "event_id", {"unix": "ts"}, "epoch(ts)")
scalar("expr_split", "part", "p_partkey", {"length": {"split": {"p_type": " "}}}, "len(string_split(p_type, ' '))")
query("where_date", {"from": "events", "select": ["event_id"], "where": {"and": [{"gte": {"ts": {"date": "2024-01-05"}}}, {"lt": {"ts": {"date": "2024-01-06"}}}]}}, "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'")
query("where_find", {"from": "pages", "select": ["page_id"], "where": {"find": {"url": "blog"}}}, "SELECT page_id FROM pages WHERE strpos(url, 'blog') > 0")


# Nested data


def _talks(e: Engine) -> DataFrame:
    from lathe.sources.store import nest

    talks = e.table("conversations")
    e.tables["talks"] = nest(talks.select("conv_id").distinct(), talks, {"conv_id": "conv_id"}, "turns", ["turn", "role", "text"])
    return e.tables["talks"]


query("nest_children", lambda e: _talks(e).select("conv_id", F.size("turns").alias("n")), "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1")
query("from_path", lambda e: (_talks(e), e.frame({"from": "talks.turns", "select": ["conv_id", "turn", "role"], "where": {"eq": {"role": "user"}}}))[1], "SELECT conv_id, turn, role FROM conversations WHERE role = 'user'")
query("nested_exists", lambda e: (_talks(e), e.frame({"from": "talks", "select": ["conv_id"], "where": {"nested": {"path": "turns", "query": {"gte": {"turn": 3}}}}}))[1], "SELECT DISTINCT conv_id FROM conversations WHERE turn >= 3")
query("nested_count", lambda e: (_talks(e), e.frame({"from": "talks", "select": ["conv_id", {"name": "n", "value": {"count": {"from": "turns", "where": {"eq": {"role": "user"}}, "select": "turn"}}}]}))[1], "SELECT conv_id, nullif(count(*) FILTER (role = 'user'), 0) AS n FROM conversations GROUP BY 1")
query("groupby_path", lambda e: (_talks(e), e.frame({"from": "talks.turns", "groupby": "role", "select": {"name": "n", "aggregate": "count"}}))[1], "SELECT role, count(*) AS n FROM conversations GROUP BY 1")
query("fk_tree", lambda e: __import__("lathe.sources.store", fromlist=["nest"]).nest(e.table("customer").select("c_custkey"), e.table("orders").select("o_custkey", "o_orderkey"), {"c_custkey": "o_custkey"}, "orders", ["o_orderkey"]).select("c_custkey", F.size("orders").alias("n"), F.col("orders")[0]["o_orderkey"].alias("first")), "SELECT c_custkey, CASE WHEN count(o_orderkey) > 0 THEN count(o_orderkey) END AS n, min(o_orderkey) AS first FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")


# Tables


def _store():
    from lathe.sources import store

    return store


query("table_update", lambda e: _store().update(e.table("customer").select("c_custkey", "c_acctbal"), set={"c_acctbal": 0}, where={"lt": {"c_acctbal": 0}}), "SELECT c_custkey, greatest(c_acctbal, 0) AS c_acctbal FROM customer")
query("table_delete", lambda e: _store().delete(e.table("customer").select("c_custkey", "c_mktsegment"), {"eq": {"c_mktsegment": "BUILDING"}}), "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'")
query("table_upsert", lambda e: _store().upsert(e.table("nation").select("n_nationkey", "n_name"), e.table("region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name")), ["n_nationkey"]), "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region) UNION ALL SELECT r_regionkey, r_name FROM region")
query("table_insert_new", lambda e: _store().insert_new(e.table("region"), e.table("nation").select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name")), ["r_regionkey"]), "SELECT * FROM region UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)")
query("table_condense", lambda e: _store().condense(e.table("events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id"), "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
query("table_violations", lambda e: _store().violations(e.table("part").select("p_partkey", "p_size"), {"lte": {"p_size": 40}}), "SELECT p_partkey, p_size FROM part WHERE p_size > 40")
query("meta_tables", {"from": "meta.tables", "select": ["name"]}, "SELECT unnest(['region','nation','customer','supplier','part','orders','lineitem','events','documents','embeddings','pages','benchmark','labels','conversations']) AS name")


# Sequences, lists and sets


def _lazy(module: str, f: Callable[[Any, Engine], DataFrame]) -> Callable[[Engine], DataFrame]:
    """f(module, engine), with the module imported when the query runs."""
    from importlib import import_module

    return lambda e: f(import_module(module), e)


_WINDOWS, _LISTS, _STATS = "lathe.operators.windows", "lathe.operators.lists", "lathe.functions.stats"
_ORDERS = lambda e: e.table("orders").select("o_custkey", "o_orderkey")
query("seq_pairwise", _lazy(_WINDOWS, lambda m, e: m.pairwise(_ORDERS(e), "o_orderkey", ["o_orderkey"], ["o_custkey"]).select("o_custkey", "a", "b")), "SELECT * FROM (SELECT o_custkey, o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE b IS NOT NULL")
query("seq_slide", _lazy(_WINDOWS, lambda m, e: m.slide(_ORDERS(e), "o_orderkey", 3, ["o_orderkey"], ["o_custkey"]).select("o_orderkey", F.element_at("window", 3).alias("third"))), "SELECT * FROM (SELECT o_orderkey, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS third FROM orders) WHERE third IS NOT NULL")
query("seq_accumulate", _lazy(_WINDOWS, lambda m, e: m.accumulate(_ORDERS(e), "o_orderkey", ["o_orderkey"], ["o_custkey"])), "SELECT o_custkey, o_orderkey, coalesce(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS total FROM orders")
query("seq_countdown", _lazy(_WINDOWS, lambda m, e: m.countdown(_ORDERS(e), ["o_orderkey"], ["o_custkey"])), "SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS \"left\" FROM orders")
query("seq_prefixes", _lazy(_WINDOWS, lambda m, e: m.prefixes(_ORDERS(e), "o_orderkey", ["o_orderkey"], ["o_custkey"]).select("o_orderkey", F.size("prefix").alias("n"))), "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders")
query("seq_holes", _lazy(_WINDOWS, lambda m, e: m.holes(e.table("orders").where("o_orderkey % 7 <> 3").withColumn("k", F.floor(F.col("o_orderkey") / 100)), "o_orderkey", ["k"])), "SELECT k, o_orderkey + 1 AS min, n AS max FROM (SELECT o_orderkey, floor(o_orderkey / 100.0) AS k, lead(o_orderkey) OVER (PARTITION BY floor(o_orderkey / 100.0) ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 7 <> 3) WHERE n > o_orderkey + 1")
query("seq_running_variance", _lazy(_WINDOWS, lambda m, e: m.cumulative_variance(_ORDERS(e), "o_orderkey", ["o_orderkey"], ["o_custkey"]).select("o_orderkey", F.round("variance", 4).alias("v"))), "SELECT o_orderkey, round(var_pop(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS v FROM orders")
query("seq_segments", _lazy(_WINDOWS, lambda m, e: m.segments(e.table("events"), ["event_type"], "ts", "value")))
query("list_chunk", _lazy(_LISTS, lambda m, e: m.chunk(e.table("customer").select("c_custkey"), 7, ["c_custkey"])), "SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 7 AS chunk FROM customer")
query("list_runs", _lazy(_LISTS, lambda m, e: m.contiguous_groups(e.table("orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"], ["o_custkey"]).groupBy("o_custkey").agg((F.max("group") + 1).alias("runs"))), "SELECT o_custkey, 1 + sum(CASE WHEN p <> o_orderstatus THEN 1 ELSE 0 END) AS runs FROM (SELECT o_custkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) GROUP BY 1")
query("list_index", _lazy(_LISTS, lambda m, e: m.index(e.table("nation").select("n_regionkey", "n_nationkey"), ["n_regionkey"]).select("n_regionkey", F.size("rows").alias("n"))), "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
query("list_unique_index", _lazy(_LISTS, lambda m, e: m.unique_index(e.table("nation").select("n_nationkey", "n_name"), ["n_nationkey"])), "SELECT n_nationkey, n_name FROM nation")
query("list_multiset", _lazy(_LISTS, lambda m, e: m.multiset_add(m.multiset(e.table("customer"), ["c_nationkey"]), m.multiset(e.table("supplier").withColumnRenamed("s_nationkey", "c_nationkey"), ["c_nationkey"]), ["c_nationkey"], -1)), "SELECT c_nationkey, sum(n) AS count FROM (SELECT c_nationkey, 1 AS n FROM customer UNION ALL SELECT s_nationkey, -1 FROM supplier) GROUP BY 1 HAVING sum(n) <> 0")
query("list_zip", _lazy(_LISTS, lambda m, e: m.zipped(e.table("nation").select("n_name"), e.table("region").select("r_name"), ["n_name"], ["r_name"])), "SELECT n_name, r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS i FROM nation) FULL JOIN (SELECT r_name, row_number() OVER (ORDER BY r_name) AS i FROM region) USING (i)")
query("list_map_to_set", _lazy(_LISTS, lambda m, e: m.map_to_set(e.table("part").select(F.split("p_type", " ").alias("w")), "w")), "SELECT DISTINCT unnest(string_split(p_type, ' ')) AS value FROM part")
query("set_intersection", _lazy(_LISTS, lambda m, e: m.intersection(e.table("customer").select("c_custkey"), e.table("orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
query("set_difference", _lazy(_LISTS, lambda m, e: m.difference(e.table("customer").select("c_custkey"), e.table("orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
query("cube_divide", _lazy(_LISTS, lambda m, e: (m.Cube(e.table("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")), ["o_orderstatus", "o_orderpriority"], "n") / m.Cube(e.table("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), ["o_orderstatus"], "n")).df), "SELECT o_orderstatus, o_orderpriority, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY o_orderstatus) AS n FROM orders GROUP BY 1, 2")
query("stats_trimmed", _lazy(_STATS, lambda m, e: m.trimmed(e.table("part"), "p_size", 0.8, ["p_brand"]).select("p_brand", "count", F.round("mean", 6).alias("mean"))), "SELECT p_brand, count(*) AS count, round(avg(p_size), 6) AS mean FROM part JOIN (SELECT p_brand, quantile_cont(p_size, 0.1) AS a, quantile_cont(p_size, 0.9) AS b FROM part GROUP BY 1) USING (p_brand) WHERE p_size BETWEEN a AND b GROUP BY 1")
query("stats_bayesian", _lazy(_STATS, lambda m, e: e.table("lineitem").select("l_orderkey", "l_linenumber", F.round(m.bayesian_add(F.col("l_tax") + 0.1, F.lit(0.3)), 9).alias("p"))), "SELECT l_orderkey, l_linenumber, round((l_tax + 0.1) * 0.3 / ((l_tax + 0.1) * 0.3 + (1 - (l_tax + 0.1)) * 0.7), 9) AS p FROM lineitem")

# Graphs: nations and regions as a tree

_EDGES = lambda e: e.table("nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst")).unionByName(e.table("region").select(F.lit("top").alias("src"), F.concat(F.lit("r"), "r_regionkey").alias("dst")))
query("graph_bfs", _lazy("lathe.operators.graph", lambda m, e: m.bfs(_EDGES(e), e.spark.createDataFrame([("top",)], "node string"))), "SELECT 'top' AS node, 0 AS depth UNION ALL SELECT 'r' || r_regionkey, 1 FROM region UNION ALL SELECT 'n' || n_nationkey, 2 FROM nation")
query("graph_dominator_tree", _lazy("lathe.operators.graph", lambda m, e: m.dominator_tree(_EDGES(e), "top")), "SELECT 'r' || r_regionkey AS node, 'top' AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation")


# Streams, SQL text, templates


def _fluent(e: Engine) -> DataFrame:
    from lathe.streaming.fluent import it, stream

    return stream(e.table("part")).filter((it.p_size > 10) & (it.p_brand != "Brand#11")).map({"key": it.p_partkey, "double": it.p_size * 2, "brand": it.p_brand}).df


query("stream_chain", _fluent, "SELECT p_partkey AS key, p_size * 2 AS double, p_brand AS brand FROM part WHERE p_size > 10 AND p_brand <> 'Brand#11'")


def _windows(e: Engine) -> DataFrame:
    from lathe.streaming import events

    return events.tumbling(e.table("events"), "ts", "1 day", ["event_type"], F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).select(F.unix_seconds("start").alias("day"), "event_type", "n", F.round("v", 4).alias("v"))


query("window_tumbling", _windows, "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")


def _sessions(e: Engine) -> DataFrame:
    from lathe.streaming import events

    return events.sessions(e.table("events"), "ts", "6 hours", ["user_id"], F.count(F.lit(1)).alias("n")).select("user_id", F.unix_seconds("start").alias("start"), "n")


query("window_session", _sessions, "SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) GROUP BY user_id, s")


def _sql(text: str) -> Callable[[Engine], DataFrame]:
    def run(e: Engine) -> DataFrame:
        from lathe.plans import sqltext

        return sqltext.run(e.spark, text, {t: e.table(t) for t in TABLES if t in text})

    return run


query("sql_join", _sql("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"), "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
query("sql_qualify", _sql("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1"), "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
query("sql_distinct_on", _sql("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_orderkey DESC"), "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
query("sql_top_ties", _sql("SELECT TOP 5 WITH TIES p_partkey, p_size FROM part ORDER BY p_size"), "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size) <= 5")
query("sql_similar", _sql("SELECT p_partkey FROM part WHERE p_brand SIMILAR TO 'Brand#(1|2)_'"), "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#(1|2).')")
query("sql_recursive", _sql("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, count(c_custkey) AS c FROM t LEFT JOIN customer ON c_nationkey = n GROUP BY n"), "SELECT n, count(c_custkey) AS c FROM range(1, 21) t(n) LEFT JOIN customer ON c_nationkey = n GROUP BY n")
query("sql_set_operations", _sql("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"), "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")


def _template(e: Engine) -> DataFrame:
    from lathe.functions.text import template

    return e.table("nation").select("n_nationkey", template("{{n_name|lower|capitalize}} ({{n_regionkey}})", F.col).alias("t"))


query("text_template", _template, "SELECT n_nationkey, upper(left(n_name, 1)) || lower(substr(n_name, 2)) || ' (' || n_regionkey || ')' AS t FROM nation")

from lathe.plans import catalog_more  # noqa: E402, F401  (adds its queries)
