"""Rows in and out: inference with merged types, table maintenance, nested assembly, files."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions.scalar import Compiler
from lathe.plans.schema import Scope, is_union

TAGS = {T.BooleanType(): "~b", T.DoubleType(): "~n", T.LongType(): "~n", T.StringType(): "~s"}


# Inference


def infer(value: Any) -> T.DataType:
    if value is None or value == []:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, (datetime, date)):
        return T.TimestampType() if isinstance(value, datetime) else T.DateType()
    if isinstance(value, timedelta):
        return T.DoubleType()
    if isinstance(value, dict):
        return T.StructType([T.StructField(k, infer(v)) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        out: T.DataType = T.NullType()
        for v in value:
            out = merge(out, infer(v))
        return T.ArrayType(out)
    return T.StringType()


def union_fields(t: T.DataType) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in t.fields} if is_union(t) else {TAGS[t]: t}


def merge(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: numbers widen, objects merge by name, a list and a member become a list, and unlike primitives
    become a union of typed fields."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.ArrayType) or isinstance(b, T.ArrayType):
        x = a.elementType if isinstance(a, T.ArrayType) else a
        y = b.elementType if isinstance(b, T.ArrayType) else b
        return T.ArrayType(merge(x, y))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType) and not is_union(a) and not is_union(b):
        fields = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            fields[f.name] = merge(fields[f.name], f.dataType) if f.name in fields else f.dataType
        return T.StructType([T.StructField(k, v) for k, v in fields.items()])
    if {type(a), type(b)} == {T.LongType, T.DoubleType}:
        return T.DoubleType()
    if (is_union(a) or a in TAGS) and (is_union(b) or b in TAGS):
        x, y = union_fields(a), union_fields(b)
        return T.StructType([T.StructField(k, merge(x[k], y[k]) if k in x and k in y else x.get(k, y.get(k))) for k in ("~b", "~n", "~s") if k in x or k in y])
    return T.StringType()


def fitted(value: Any, t: T.DataType) -> Any:
    """value in the form of t."""
    if value is None:
        return None
    if is_union(t):
        tag = "~b" if isinstance(value, bool) else "~n" if isinstance(value, (int, float)) else "~s"
        return tuple(fitted(value, f.dataType) if f.name == tag else None for f in t.fields)
    if isinstance(t, T.ArrayType):
        return [fitted(v, t.elementType) for v in (value if isinstance(value, (list, tuple)) else [value])]
    if isinstance(t, T.StructType):
        return tuple(fitted(value.get(f.name), f.dataType) for f in t.fields) if isinstance(value, dict) else None
    if isinstance(t, T.DoubleType):
        x = value.total_seconds() if isinstance(value, timedelta) else float(value)
        return None if x != x or x in (float("inf"), float("-inf")) else x
    if isinstance(t, T.StringType) and not isinstance(value, str):
        return json.dumps(value, default=str)
    return value


def solid(t: T.DataType) -> T.DataType:
    """Types that stayed unknown become text, and empty objects a text field."""
    if isinstance(t, T.NullType):
        return T.StringType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(solid(t.elementType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, solid(f.dataType)) for f in t.fields]) if t.fields else T.StringType()
    return t


def from_rows(spark: SparkSession, rows: list[Any], schema: T.StructType | None = None) -> DataFrame:
    """Python rows (objects, or bare values as the column `value`) with an inferred schema."""
    rows = [r if isinstance(r, dict) else {"value": r} for r in rows]
    if schema is None:
        found: T.DataType = T.StructType([])
        for r in rows:
            found = merge(found, infer(r))
        schema = solid(found) if found.fields else T.StructType([T.StructField("value", T.StringType())])
    return spark.createDataFrame([fitted(r, schema) for r in rows], schema)


# Maintenance: tables are values, so each operation gives a new DataFrame


def cast_to(col: Column, have: T.DataType, want: T.DataType) -> Column:
    """col in the wider type want, as merge() made it."""
    if have == want:
        return col
    if is_union(want):
        own = union_fields(have)
        if is_union(have):
            parts = [(f, col[f.name] if f.name in own else F.lit(None)) for f in want.fields]
        else:
            parts = [(f, col if f.name in own else F.lit(None)) for f in want.fields]
        return F.when(col.isNotNull(), F.struct(*[p.cast(f.dataType).alias(f.name) for f, p in parts]))
    if isinstance(want, T.ArrayType):
        if isinstance(have, T.ArrayType):
            return F.transform(col, lambda x: cast_to(x, have.elementType, want.elementType))
        return F.when(col.isNotNull(), F.array(cast_to(col, have, want.elementType)))
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        names = have.fieldNames()
        return F.when(col.isNotNull(), F.struct(*[(cast_to(col[f.name], have[f.name].dataType, f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]))
    return col.cast(want)


def insert(df: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of both, in the merged schema; lists are made of single values where the other has lists."""
    want = merge(T.StructType([T.StructField(f.name, loose(f.dataType)) for f in df.schema]), T.StructType([T.StructField(f.name, loose(f.dataType)) for f in more.schema]))

    def shaped(d: DataFrame) -> DataFrame:
        have = {f.name: f.dataType for f in d.schema}
        return d.select(*[(cast_to(F.col(f"`{f.name}`"), loose(have[f.name]), f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields])

    return shaped(df).unionByName(shaped(more))


def loose(t: T.DataType) -> T.DataType:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return T.LongType()
    return T.DoubleType() if isinstance(t, (T.FloatType, T.DecimalType)) else t


def insert_new(df: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Adds only rows whose keys are not there."""
    return insert(df, more.join(df.select(*keys), keys, "left_anti"))


def update(df: DataFrame, set: dict[str, Any] | None = None, clear: list[str] | None = None, where: Any = True) -> DataFrame:
    """Columns by expressions, or to null, where the condition holds."""
    c = Compiler(Scope(df.schema))
    test = F.coalesce(c.condition(where), F.lit(False))
    have = {f.name: f.dataType for f in df.schema}
    changes = {}
    for name, e in (set or {}).items():
        x = c(e if isinstance(e, dict) else {"literal": e}).col
        changes[name] = F.when(test, x.cast(have[name]) if name in have else x).otherwise(F.col(f"`{name}`") if name in have else F.lit(None))
    for name in clear or ():
        changes[name] = F.when(~test, F.col(f"`{name}`"))
    return df.withColumns(changes)


def delete(df: DataFrame, where: Any) -> DataFrame:
    return df.where(~F.coalesce(Compiler(Scope(df.schema)).condition(where), F.lit(False)))


def upsert(df: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of more replace those of equal keys."""
    return insert(df.join(more.select(*keys).distinct(), keys, "left_anti"), more)


def condense(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    from lathe.operators.windows import latest

    return latest(df, keys, version)


def violations(df: DataFrame, constraint: Any) -> DataFrame:
    """Rows for which a constraint does not hold."""
    return delete(df, constraint)


def nest(parent: DataFrame, child: DataFrame, on: dict[str, str], name: str, order: list[str]) -> DataFrame:
    """Children of each parent as a list of objects, ordered; on: parent's column to child's. The children are grouped before
    the join, so a parent's row is joined once."""
    rest = [c for c in child.columns if c not in on.values()]
    ordered = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    lists = child.groupBy(*[F.col(c).alias(f"__{p}") for p, c in on.items()]).agg(F.array_sort(F.collect_list(ordered)).alias(name))
    test = None
    for p in on:
        t = parent[p] == lists[f"__{p}"]
        test = t if test is None else test & t
    return parent.join(lists, test, "left").drop(*[f"__{p}" for p in on])


def typed(value: Any) -> Any:
    """JSON with each primitive under its type's sign, as {"a": 1} to {"a": {"~n~": 1}}."""
    if value is None or value == "":
        return None
    if isinstance(value, bool):
        return {"~b~": value}
    if isinstance(value, (int, float)):
        return {"~n~": value}
    if isinstance(value, str):
        return {"~s~": value}
    if isinstance(value, dict):
        return {**{k: t for k, v in value.items() if (t := typed(v)) is not None}, "~e~": 1}
    return {"~a~": [typed(v) for v in value], "~e~": len(value)}


def untyped(value: Any) -> Any:
    if isinstance(value, dict):
        for sign in ("~b~", "~n~", "~s~", "~t~", "~d~", "~i~"):
            if sign in value:
                return value[sign]
        if "~a~" in value:
            return [untyped(v) for v in value["~a~"]]
        return {k: untyped(v) for k, v in value.items() if k != "~e~"}
    return value


# Files


def read(spark: SparkSession, path: str, form: str | None = None, schema: T.StructType | str | None = None, **options: Any) -> DataFrame:
    """parquet, orc, json (lines), csv, tab, text, by form or by the path's ending; compressed files by their ending."""
    form = form or next((x for x in ("parquet", "orc", "json", "csv", "tab", "tsv", "txt", "text", "lines") if f".{x}" in path.rsplit("/", 1)[-1]), "parquet")
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if form in ("csv", "tab", "tsv"):
        return reader.option("header", options.get("header", True)).csv(path, sep="," if form == "csv" else "\t")
    if form in ("txt", "text", "lines"):
        return reader.text(path)
    return reader.format(form).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: Any) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_json_path(spark: SparkSession, path: str, query_path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of the list at query_path in JSON documents; only the schema's fields are parsed."""
    member = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    t: T.DataType = T.ArrayType(member)
    steps = [s for s in query_path.split(".") if s]
    for s in reversed(steps):
        t = T.StructType([T.StructField(s, t)])
    whole = spark.read.option("multiLine", True).schema(t).json(path)
    col = F.col(steps[0])
    for s in steps[1:]:
        col = col[s]
    return whole.select(F.explode(col).alias("row")).select("row.*")


def write(df: DataFrame, path: str, form: str = "parquet", partition_by: list[str] | None = None, mode: str = "overwrite", **options: Any) -> None:
    writer = df.write.mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if form in ("csv", "tab"):
        writer.option("header", True).csv(path, sep="," if form == "csv" else "\t")
    elif form in ("line", "json"):
        writer.json(path)
    else:
        writer.format(form).save(path)


def rollover(df: DataFrame, time: str, oldest: datetime, unit: str = "day") -> DataFrame:
    """Rows not older than oldest, with the time bucket that a partitioned write goes by."""
    return df.where(F.col(time) >= F.lit(oldest)).withColumn("bucket", F.date_trunc(unit, F.col(time)))


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text in zip, tar, tar.gz and zst files: path, member, number, line. One file is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
            if name.endswith(".zip"):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
            elif ".tar" in name or name.endswith(".tgz"):
                with tarfile.open(fileobj=io.BytesIO(data)) as t:
                    yield from ((m.name, t.extractfile(m).read()) for m in t if m.isfile())
            elif name.endswith(".zst"):
                import zstandard

                yield name.rsplit("/", 1)[-1], zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read()
            elif name.endswith(".gz"):
                import gzip

                yield name.rsplit("/", 1)[-1], gzip.decompress(data)
            else:
                yield name.rsplit("/", 1)[-1], data

        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for member, content in members(name, data):
                    lines = content.decode("utf-8", "replace").splitlines()
                    yield pa.RecordBatch.from_pydict({"path": [name] * len(lines), "member": [member] * len(lines), "number": pa.array(range(len(lines)), pa.int64()), "line": pa.array(lines, pa.string())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, member string, number long, line string")


def extract_tree(tables: dict[str, DataFrame], relations: list[tuple[str, str, str, str]], root: str, ids: DataFrame) -> dict[str, DataFrame]:
    """The rows of all tables that belong to the rows of root whose keys are in ids, whose columns name the keys.

    relations: (table, column, referred table, its column). Down from root, rows that refer to rows already taken are taken with them;
    of all taken, the rows that they refer to are taken too, to any depth. Each relation is followed once in each way, by semi joins.
    """
    keys = ids.columns
    taken = {root: tables[root].join(ids.distinct(), keys, "left_semi")}
    down = [root]
    while down:
        at = down.pop(0)
        for table, column, target, key in relations:
            if target == at and table not in taken:
                taken[table] = tables[table].join(taken[at].select(F.col(key).alias(column)), column, "left_semi")
                down.append(table)
    up, done = list(taken), set()
    while up:
        at = up.pop(0)
        for i, (table, column, target, key) in enumerate(relations):
            if table == at and i not in done and target not in taken:
                done.add(i)
                wanted = [taken[t].select(F.col(c).alias(key)) for t, c, x, k in relations if x == target and k == key and t in taken]
                both = wanted[0]
                for more in wanted[1:]:
                    both = both.unionByName(more)
                taken[target] = tables[target].join(both, key, "left_semi")
                up.append(target)
    return taken


def merge_shards(shards: list[DataFrame], keys: list[str] | None = None, version: str | None = None) -> DataFrame:
    """Shards of one table, whose schemas may differ, as one; with keys and version only the latest row of each key."""
    out = shards[0]
    for s in shards[1:]:
        out = insert(out, s)
    return condense(out, keys, version) if keys and version else out


def expire(df: DataFrame, time: str, now: float, keep: float) -> DataFrame:
    """Rows whose time (seconds since 1970) is not older than keep seconds before now; rows without a time go."""
    return df.where(F.col(time) >= F.lit(now - keep))
