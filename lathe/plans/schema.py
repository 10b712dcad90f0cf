"""Names in queries against the schema of a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def split_path(name: str) -> list[str]:
    """Steps of a dotted name; two dots stand for one inside a step."""
    if name in (".", ""):
        return []
    return [x.replace("\0", ".") for x in name.replace("\\.", "\0").replace("..", "\0").split(".")]


def picker(name: str):
    return lambda x: x[name]


def join_path(steps: list[str]) -> str:
    return ".".join(s.replace(".", "..") for s in steps) or "."


def quoted(*steps: str) -> str:
    return ".".join("`" + s.replace("`", "``") + "`" for s in steps)


def is_union(t: T.DataType) -> bool:
    """A struct that holds one value in one of several types: see sources.store.typed()."""
    return isinstance(t, T.StructType) and bool(t.fields) and all(f.name in ("~b", "~n", "~s") for f in t.fields)


class Scope:
    """Resolves names. aliases: names that stand for columns, such as edges already matched."""

    def __init__(self, schema: T.StructType, prefix: list[str] | None = None, aliases: dict[str, tuple[Column, T.DataType]] | None = None, lookup=None):
        self.schema, self.prefix, self.aliases = schema, prefix or [], aliases or {}
        self.lookup = lookup or (lambda steps: F.col(quoted(*steps)))

    def _walk(self, steps: list[str]) -> tuple[Column, T.DataType] | None:
        at: T.DataType = self.schema
        out: Column | None = None
        for i, step in enumerate(steps):
            inner = at.elementType if isinstance(at, T.ArrayType) else at
            if isinstance(inner, T.MapType):
                return F.try_element_at(out, F.lit(step)), inner.valueType
            if not isinstance(inner, T.StructType):
                return None
            found = next((f for f in inner.fields if f.name == step), None) or next((f for f in inner.fields if f.name.lower() == step.lower()), None)
            if found is None:
                return None
            if out is None:
                out, at = self.lookup([found.name]), found.dataType
            elif isinstance(at, T.ArrayType):
                out = F.transform(out, picker(found.name))
                at = T.ArrayType(found.dataType)
                if isinstance(found.dataType, T.ArrayType):
                    out, at = F.flatten(out), found.dataType
            else:
                out, at = out[found.name], found.dataType
        return None if out is None else (out, at)

    def find(self, name: str) -> tuple[Column, T.DataType] | None:
        """Relative to the prefix first, then absolute."""
        if name in self.aliases:
            return self.aliases[name]
        steps = split_path(name)
        if not steps:
            if self.prefix:
                return self._walk(self.prefix)
            return F.struct(*[self.lookup([f.name]).alias(f.name) for f in self.schema.fields]), self.schema
        if self.prefix and (found := self._walk(self.prefix + steps)):
            return found
        return self._walk(steps)

    def leaves(self, name: str = ".") -> list[tuple[list[str], T.DataType]]:
        """Paths and types of all leaves under name; arrays and unions are leaves."""

        def walk(t: T.DataType, steps: list[str]):
            if isinstance(t, T.StructType) and not is_union(t):
                for f in t.fields:
                    yield from walk(f.dataType, [*steps, f.name])
            else:
                yield steps, t

        steps = split_path(name)
        if not steps:
            return list(walk(self.schema, []))
        for base in ([*self.prefix, *steps], steps):
            found = self._walk(base)
            if found:
                return list(walk(found[1], base))
        return []
