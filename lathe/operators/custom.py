"""Aggregates and table functions of one's own, in Python.

An aggregate is a start, add(state, value), merge(state, state) and end(state). States are made in each task and merged by key after
one shuffle, so a key's rows are never in one place; states must pickle.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def custom_aggregate(df: DataFrame, keys: list[str], value: str, start: Callable[[], Any], add: Callable[[Any, Any], Any], merge: Callable[[Any, Any], Any], end: Callable[[Any], Any], returns: T.DataType | str, name: str = "value", held: int = 100_000) -> DataFrame:
    """keys and the result of each group. Missing values are not added. At most held states are in a task before they are passed on."""
    kinds = [df.schema[k] for k in keys]
    states = T.StructType([*kinds, T.StructField("__state", T.BinaryType())])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[tuple, Any] = {}

        def out() -> pd.DataFrame:
            rows = [(*k, pickle.dumps(s)) for k, s in own.items()]
            own.clear()
            return pd.DataFrame(rows, columns=states.names)

        for f in frames:
            lists = [[None if pd.isna(x) else x for x in f[k]] for k in keys]
            for *key, v in zip(*lists, f[value].tolist(), strict=True):
                k = tuple(key)
                state = own.get(k)
                if state is None:
                    state = start()
                own[k] = state if v is None or v != v else add(state, v)
            if len(own) > held:
                yield out()
        yield out()

    kind = T._parse_datatype_string(returns) if isinstance(returns, str) else returns
    schema = T.StructType([*kinds, T.StructField(name, kind)])

    def final(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for f in frames:
            lists = [[None if pd.isna(x) else x for x in f[k]] for k in keys]
            rows = []
            for *key, raw in zip(*lists, f["__state"].tolist(), strict=True):
                k, s = tuple(key), pickle.loads(raw)
                if k == now:
                    state = merge(state, s)
                else:
                    if now is not None:
                        rows.append((*now, end(state)))
                    now, state = k, s
            yield pd.DataFrame(rows, columns=schema.names)
        if now is not None:
            yield pd.DataFrame([(*now, end(state))], columns=schema.names)

    parts = df.select(*keys, value).mapInPandas(partial, states)
    if keys:
        parts = parts.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    else:
        parts = parts.coalesce(1)  # one state for each task
    return parts.mapInPandas(final, schema)


def table_function(df: DataFrame, f: Callable[[dict], Iterator[dict]], returns: str) -> DataFrame:
    """The rows that f gives for each row, a dict each."""
    names = T._parse_datatype_string(returns).names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([x for row in frame.to_dict("records") for x in f(row)], columns=names)

    return df.mapInPandas(run, returns)
