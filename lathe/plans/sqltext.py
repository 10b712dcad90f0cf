"""SQL text: what Spark's parser lacks is rewritten, at every depth of a statement, then the session runs it.

Statements that change tables (INSERT, UPDATE, DELETE, MERGE, TRUNCATE, CREATE TABLE AS, DROP) work on views: run() computes the new
table and puts it in the view's place.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts of a statement that are not to be searched: strings, quoted names, comments.
OPAQUE = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
SIMPLE = [
    (re.compile(r"\bSAFE_CAST\s*\(", re.I), "TRY_CAST("),
    (re.compile(r"\bCROSS\s+APPLY\b", re.I), "CROSS JOIN LATERAL"), (re.compile(r"\bOUTER\s+APPLY\b", re.I), "LEFT JOIN LATERAL"), (re.compile(r"\bWITH\s*\(\s*NOLOCK\s*\)", re.I), ""),
    (re.compile(r"\bFOR\s+(?:UPDATE|SHARE|NO\s+KEY\s+UPDATE|KEY\s+SHARE)(?:\s+(?:NOWAIT|SKIP\s+LOCKED))?", re.I), ""), (re.compile(r"\bMINUS\b", re.I), "EXCEPT"),
    (re.compile(r"\bFETCH\s+(?:FIRST|NEXT)\s+(\d+)\s+ROWS?\s+ONLY\b", re.I), r"LIMIT \1"),
]
SIMILAR = re.compile(r"\b(NOT\s+)?SIMILAR\s+TO\s+\x01(\d+)\x02", re.I)
TOP = re.compile(r"\s*TOP\s*\(?\s*(\d+)\s*\)?\s*(PERCENT\b)?\s*(WITH\s+TIES\b)?", re.I)
DISTINCT_ON = re.compile(r"\s*DISTINCT\s+ON\s*\(([^)]*)\)", re.I)
SET_WORD = re.compile(r"\b(?:UNION|INTERSECT|EXCEPT)\b(?!\s*\()(?:\s+(?:ALL|DISTINCT)\b)?", re.I)


def masked(sql: str) -> tuple[str, list[str]]:
    held: list[str] = []

    def put(m: re.Match) -> str:
        held.append(m[0])
        return f"\x01{len(held) - 1}\x02"

    return OPAQUE.sub(put, sql), held


def unmasked(text: str, held: list[str]) -> str:
    """With all that is held put back, also what it holds itself."""
    while "\x01" in text:
        text = re.sub("\x01(\\d+)\x02", lambda m: held[int(m[1])], text)
    return text


def outside(pattern: str, text: str, start: int = 0) -> re.Match | None:
    """Where pattern first stands outside parentheses."""
    for m in re.finditer(pattern, text[start:], re.I):
        before = text[start : start + m.start()]
        if before.count("(") == before.count(")"):
            return re.compile(pattern, re.I).match(text, start + m.start())
    return None


def pieces(text: str, sign: str = ",") -> list[str]:
    """text divided at signs outside parentheses."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == sign and not depth:
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]


def similar(pattern: str) -> str:
    """A SIMILAR TO pattern as a regular expression for the whole text: % and _ are wild, and . ^ $ stand for themselves."""
    return "^(?s:" + "".join({"%": ".*", "_": ".", ".": r"\.", "^": r"\^", "$": r"\$"}.get(c, c) for c in pattern) + ")$"


def hidden(text: str, held: list[str]) -> str:
    """text with each sub-query in parentheses rewritten and put aside."""
    out, i = [], 0
    while i < len(text):
        if text[i] != "(":
            out.append(text[i])
            i += 1
            continue
        depth, j = 1, i + 1
        while j < len(text) and depth:
            depth += (text[j] == "(") - (text[j] == ")")
            j += 1
        inner = text[i + 1 : j - 1]
        if re.match(r"\s*(?:SELECT|WITH)\b", inner, re.I):
            held.append(f"({statement(inner, held)})")
            out.append(f"\x01{len(held) - 1}\x02")
        else:
            out.append(f"({hidden(inner, held)})")
        i = j
    return "".join(out)


def statement(text: str, held: list[str]) -> str:
    """A query: its sub-queries first, then each SELECT of its set operations."""
    text = hidden(text, held)

    def put(m: re.Match) -> str:
        literal = held[int(m[2])][1:-1].replace("''", "'")
        held.append("'" + similar(literal).replace("\\", "\\\\").replace("'", "\\'") + "'")
        return f"{m[1] or ''}RLIKE \x01{len(held) - 1}\x02"

    text = SIMILAR.sub(put, text)
    for pattern, new in SIMPLE:
        text = pattern.sub(new, text)
    start = 0
    if re.match(r"\s*WITH\b", text, re.I) and (m := outside(r"\bSELECT\b", text)):
        start = m.start()
    out, at = [text[:start]], start
    while m := outside(SET_WORD.pattern, text, at):
        out += [select(text[at : m.start()]), " ", m[0], " "]
        at = m.end()
    return "".join([*out, select(text[at:])])


def select(text: str) -> str:
    """A SELECT without sub-queries, rewritten if it has DISTINCT ON, TOP or QUALIFY."""
    m = re.match(r"\s*SELECT\b", text, re.I)
    frum = outside(r"\bFROM\b", text)
    if not m or not frum:
        return text
    head, rest = text[m.end() : frum.start()], text[frum.end() :]
    tail = outside(r"\b(?:ORDER\s+BY|LIMIT)\b", rest)
    rest, tail = (rest, "") if tail is None else (rest[: tail.start()], rest[tail.start() :])
    order = outside(r"\bORDER\s+BY\b", tail)
    limit = outside(r"\bLIMIT\b", tail)
    by = [] if order is None else pieces(tail[order.end() : limit.start() if limit else len(tail)])
    limit = "" if limit is None else " " + tail[limit.start() :].strip()
    if on := DISTINCT_ON.match(head):
        cols, number = head[on.end() :], f"row_number() OVER (PARTITION BY {on[1]} ORDER BY {', '.join(by) or on[1]}) AS __n"
        return outer(cols, rest, [number], "__n = 1", by) + limit
    if top := TOP.match(head):
        n, percent, ties = top.groups()
        cols = head[top.end() :]
        if not percent and not ties:
            return f"SELECT {cols.strip()} FROM {rest.strip()}" + (f" ORDER BY {', '.join(by)}" if by else "") + f" LIMIT {n}"
        if not percent:
            return outer(cols, rest, [f"rank() OVER (ORDER BY {', '.join(by) or '1'}) AS __n"], f"__n <= {n}", by)
        rank = "rank()" if ties else "row_number()"
        return outer(cols, rest, [f"{rank} OVER (ORDER BY {', '.join(by) or '1'}) AS __n", "count(*) OVER () AS __all"], f"__n <= ceil({n} / 100.0 * __all)", by)
    if q := outside(r"\bQUALIFY\b", rest):
        return outer(head, rest[: q.start()], [f"({rest[q.end() :].strip()}) AS __q"], "__q", by) + limit
    return text


def outer(cols: str, rest: str, more: list[str], test: str, by: list[str]) -> str:
    """Rows of a SELECT with more columns that pass test, in its order."""
    keys = [re.match(r"(?s)\s*(.*?)\s*((?:\b(?:ASC|DESC)\b)?\s*(?:\bNULLS\s+(?:FIRST|LAST)\b)?)\s*$", x, re.I).groups() for x in by]
    more = [*more, *[f"{k} AS __o{i}" for i, (k, _) in enumerate(keys)]]
    names = ", ".join(re.search(r"\bAS\s+(\w+)$", x)[1] for x in more)
    order = " ORDER BY " + ", ".join(f"__o{i} {way}".strip() for i, (_, way) in enumerate(keys)) if keys else ""
    inner = f"SELECT {cols.strip()}, {', '.join(more)} FROM {rest.strip()}"
    return f"SELECT * EXCEPT({names}) FROM (SELECT * FROM ({inner}) WHERE {test}{order})"


def rewrite(sql: str) -> str:
    """The query in Spark's dialect."""
    text, held = masked(sql.strip().rstrip(";"))
    return unmasked(statement(text, held), held)


def run(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of a query; of a statement that changes a table, the new table."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    text, held = masked(sql.strip().rstrip(";"))
    for pattern, change in CHANGES.items():
        if m := re.match(pattern, text, re.I | re.S):
            parts = [None if x is None else x.strip() for x in m.groups()]
            name, df = change(spark, lambda x: unmasked(statement(x, held), held), *parts)
            if df is None:
                spark.catalog.dropTempView(name)
                return spark.createDataFrame([], "dropped string")
            df.createOrReplaceTempView(name)
            return df
    return spark.sql(unmasked(statement(text, held), held))


# Statements that change tables: the view's name and its new rows


def _insert(spark, sql, name, columns, rows):
    old = spark.table(name)
    given = [x.strip() for x in columns.split(",")] if columns else old.columns
    new = spark.sql(sql(rows)).toDF(*given)
    return name, old.unionByName(new.select(*[F.col(c).cast(old.schema[c].dataType).alias(c) for c in given]), allowMissingColumns=True)


def _assignments(sql, text: str) -> dict[str, str]:
    return {k.strip().split(".")[-1]: sql(v.strip()) for k, _, v in (x.partition("=") for x in pieces(text))}


def _update(spark, sql, name, sets, where):
    df, test = spark.table(name), f"coalesce(({sql(where)}), false)" if where else "true"
    new = _assignments(sql, sets)
    cols = [F.expr(f"CASE WHEN {test} THEN {new[c]} ELSE `{c}` END").cast(df.schema[c].dataType).alias(c) if c in new else F.col(c) for c in df.columns]
    return name, df.select(*cols)


def _delete(spark, sql, name, where):
    df = spark.table(name)
    return name, df.where(f"NOT coalesce(({sql(where)}), false)") if where else df.limit(0)


def _create(spark, sql, name, query):
    return name, spark.sql(sql(query))


def _merge(spark, sql, name, alias, source, other, on, clauses):
    """Rows of the table with their match; the first clause whose condition holds changes a row. Several matches for one row are an
    error when the result is computed."""
    table, key = spark.table(name), alias or name
    spare = other or source
    left = table.withColumn("__row", F.monotonically_increasing_id()).alias(key)
    right = (spark.sql(sql(source[1:-1])) if source.startswith("(") else spark.table(source)).withColumn("__hit", F.lit(True)).alias(spare)
    both = left.join(right, F.expr(sql(on)), "full")
    parts = re.split(r"\bWHEN\s+", clauses, flags=re.I)[1:]
    keep, values, added = F.lit(True), {c: F.col(f"{key}.{c}") for c in table.columns}, None
    for part in reversed(parts):
        m = re.match(r"(NOT\s+)?MATCHED(?:\s+AND\s+(.*?))?\s+THEN\s+(.*)$", part.strip(), re.I | re.S)
        no, test, what = m.groups()
        test = F.coalesce(F.expr(sql(test)), F.lit(False)) if test else F.lit(True)
        if no:
            cols, given = re.match(r"INSERT\s*\(([^)]*)\)\s*VALUES\s*\((.*)\)\s*$", what, re.I | re.S).groups()
            made = dict(zip([c.strip() for c in cols.split(",")], [sql(v) for v in pieces(given)], strict=True))
            added = (test, made)
        else:
            hit = F.col("__hit").isNotNull() & F.col("__row").isNotNull() & test
            if re.match(r"DELETE\b", what, re.I):
                keep = F.when(hit, F.lit(False)).otherwise(keep)
            else:
                new = _assignments(sql, re.sub(r"^UPDATE\s+SET\s+", "", what, flags=re.I))
                keep = F.when(hit, F.lit(True)).otherwise(keep)
                values = {c: F.when(hit, F.expr(new[c]) if c in new else F.col(f"{key}.{c}")).otherwise(v) for c, v in values.items()}
    own = both.where(F.col("__row").isNotNull())
    times = F.count(F.lit(1)).over(Window.partitionBy("__row"))
    out = own.select(*[v.cast(table.schema[c].dataType).alias(c) for c, v in values.items()], F.when(times > 1, F.raise_error(F.lit("several matches for one row")).cast("boolean")).otherwise(keep).alias("__keep")).where("__keep").drop("__keep")
    if added:
        test, made = added
        fresh = both.where(F.col("__row").isNull() & test)
        out = out.unionByName(fresh.select(*[(F.expr(made[c]) if c in made else F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in table.columns]))
    return name, out


CHANGES: dict[str, Callable] = {
    r"INSERT\s+INTO\s+(\w+)\s*(?:\(([^()]*)\))?\s*((?:SELECT|WITH|VALUES)\b.*)$": _insert,
    r"UPDATE\s+(\w+)\s+SET\s+(.*?)(?:\s+WHERE\s+(.*))?$": _update,
    r"DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.*))?$": _delete,
    r"TRUNCATE\s+TABLE\s+(\w+)()$": lambda spark, sql, name, _: (name, spark.table(name).limit(0)),
    r"CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?(?:TABLE|VIEW)\s+(\w+)\s+AS\s+(.*)$": _create,
    r"DROP\s+(?:TABLE|VIEW)\s+(?:IF\s+EXISTS\s+)?(\w+)()$": lambda spark, sql, name, _: (name, None),
    r"MERGE\s+INTO\s+(\w+)(?:\s+(?:AS\s+)?(?!USING\b)(\w+))?\s+USING\s+(\w+|\(.*?\))(?:\s+(?:AS\s+)?(?!ON\b)(\w+))?\s+ON\s+(.*?)\s+(WHEN\s+.*)$": _merge,
}
