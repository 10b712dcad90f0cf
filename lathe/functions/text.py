"""Text functions of message templates, as Columns: {{value|upper|left(5)}}."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2**31 - 1))


def html(c: Column) -> Column:
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(code))
    return c


def limit(c: Column, n: int) -> Column:
    """At most n signs, the last three as dots where text was cut."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, max(0, n - 3)), F.lit("...")))


def indent(c: Column, prefix: str = "\t") -> Column:
    return F.concat(F.lit(prefix), F.regexp_replace(c, "\n", "\n" + prefix))


def outdent(c: Column) -> Column:
    return F.regexp_replace(c, "(?m)^[ \t]+", "")


def between(c: Column, low: str, high: str) -> Column:
    start = F.instr(c, low)
    rest = F.substring(c, start + len(low), F.length(c))
    end = F.instr(rest, high)
    return F.when((start > 0) & (end > 0), F.substring(rest, F.lit(1), end - 1))


def rounded(c: Column, decimal: int | None = None, digits: int | None = None) -> Column:
    """By decimals, or by significant digits."""
    if digits is None:
        return F.round(c, decimal or 0)
    scale = F.pow(F.lit(10.0), F.lit(digits) - F.ceil(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c * scale) / scale)


FUNCTIONS = {
    "upper": F.upper, "lower": F.lower, "capitalize": capitalize, "trim": F.trim, "strip": F.trim, "html": html, "url": F.url_encode,
    "json": F.to_json, "unicode": lambda c: c.cast("string"), "hex": lambda c: F.lower(F.hex(c)), "limit": limit, "indent": indent, "outdent": outdent,
    "newline": lambda c: F.concat(F.lit("\n"), c), "tab": lambda c: F.concat(F.lit("\t"), c), "quote": lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"')),
    "replace": lambda c, old, new: F.replace(c, F.lit(old), F.lit(new)), "split": lambda c, sep="\n": F.split(c, re.escape(sep)), "find": lambda c, x: F.instr(c, x) - 1, "between": between,
    "left": lambda c, n: F.left(c, F.lit(n)), "right": lambda c, n: F.right(c, F.lit(n)), "left_align": lambda c, n: F.rpad(F.left(c, F.lit(n)), n, " "), "right_align": lambda c, n: F.lpad(F.right(c, F.lit(n)), n, " "),
    "round": rounded, "percent": lambda c, decimal=0: F.concat(F.format_number(c * 100, decimal), F.lit("%")), "comma": lambda c: F.format_number(c, 0),
    "datetime": lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss"), "unix": lambda c: F.unix_timestamp(c),
}
PART = re.compile(r"\{\{\s*([^}|]+?)\s*((?:\|[^}]*)?)\}\}")


def template(text: str, compile_) -> Column:
    """A template's text for each row; compile_ turns a name into a Column. Missing values are empty."""
    import ast

    out, at = [], 0
    for m in PART.finditer(text):
        out.append(F.lit(text[at : m.start()]))
        c = compile_(m[1])
        for call in filter(None, (x.strip() for x in m[2].split("|"))):
            name, _, args = call.partition("(")
            given = ast.literal_eval("(" + args.rstrip(")") + ",)") if args.rstrip(")").strip() else ()
            c = FUNCTIONS[name.strip()](c, *given)
        out.append(F.coalesce(c.cast("string"), F.lit("")))
        at = m.end()
    return F.concat(*out, F.lit(text[at:]))
