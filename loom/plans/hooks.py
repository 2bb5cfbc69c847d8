"""Registries, and a user's function over rows that keeps, drops or multiplies them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Registry:
    """Names for functions or classes; a name is taken once unless ``exist_ok``."""

    def __init__(self, kind: str) -> None:
        self.kind, self.items = kind, {}

    def register(self, name: str, item: Any = None, exist_ok: bool = False) -> Any:
        """Adds item, or as a decorator what follows."""
        if item is None:
            return lambda x: self.register(name, x, exist_ok)
        if name in self.items and not exist_ok:
            raise ValueError(f"two {self.kind}s named {name}")
        self.items[name] = item
        return item

    def __getitem__(self, name: str) -> Any:
        if name not in self.items:
            raise KeyError(f"no {self.kind} named {name}; there are {sorted(self.items)}")
        return self.items[name]


#: Scorers give a Column of a response and a gold Column; metrics are accumulators; losses and loss scales give Columns.
SCORERS, METRICS, LOSSES, LOSS_SCALES = Registry("scorer"), Registry("metric"), Registry("loss"), Registry("loss scale")


def scored(df: DataFrame, names: list[str], response: str, gold: str) -> DataFrame:
    """Adds a column for each registered scorer."""
    return df.select("*", *[SCORERS[n](F.col(response), F.col(gold)).alias(n) for n in names])


def row_map(df: DataFrame, function: Callable[[dict], dict | list[dict] | None], schema: str, strict: bool = False, error: str | None = None) -> DataFrame:
    """function over each row, a dict: None drops it, a dict replaces it, a list of dicts puts several in its place.

    A row on which the function fails is an error where strict; with ``error``, the name of a further
    column, it is one row of nulls and the failure's text there, so that failures can be counted and
    read; else it is dropped.  Rows travel in Arrow batches, for a user's function knows rows only; what
    is built in is written as Columns instead.
    """
    names = df.columns
    if error:
        schema += f", `{error}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for values in pdf.itertuples(index=False, name=None):
                try:
                    made = function(dict(zip(names, values, strict=True)))
                except Exception as e:
                    if strict:
                        raise
                    out += [{error: f"{type(e).__name__}: {e}"}] if error else []
                    continue
                out += made if isinstance(made, list) else [] if made is None else [made]
            yield pd.DataFrame(out, columns=columns, dtype=object)

    columns = [f.name for f in df.sparkSession.createDataFrame([], schema).schema]
    return df.mapInPandas(run, schema)


def repaired(df: DataFrame, messages: str, repair: Callable[[Any], Any] | None) -> DataFrame:
    """The messages column through a user's repair of one conversation, given and returned as lists of (role, content)."""
    if repair is None:
        return df
    kind = "array<struct<role:string,content:string>>"

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else json.dumps([{"role": r, "content": c} for r, c in repair([(m.get("role"), m.get("content")) for m in json.loads(t)])]))

    return df.withColumn(messages, F.from_json(run(F.to_json(messages)), kind))
