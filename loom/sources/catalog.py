"""Named datasets, and the mini-language that asks for them: [hub::]name[:subset/subset][#rows]."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from loom.operators import sampling
from loom.sources import files

#: What is a path and no name.
PATH = re.compile(r".*://|[/.~]|[^:]*\.(?:jsonl?|csv|tsv|txt|parquet)$")


@dataclass(frozen=True)
class Request:
    name: str
    hub: str | None = None
    subsets: tuple[str, ...] = ()
    rows: int | None = None


def parse(text: str) -> Request:
    """The hub before the first "::", rows after the last "#", subsets after the first ":" (not in paths).

    A path has a scheme, begins with a slash, a dot or a tilde, or ends in a file name's extension; no file
    system is asked, for the driver's is not the cluster's.
    """
    hub, sep, rest = text.partition("::")
    if not sep:
        hub, rest = None, text
    head, sep, tail = rest.rpartition("#")
    rows, body = (int(tail), head) if sep and tail.isdigit() else (None, rest)
    if PATH.match(body):
        return Request(body, hub, (), rows)
    name, sep, subsets = body.partition(":")
    return Request(name, hub, tuple(s for s in subsets.split("/") if s), rows)


@dataclass
class Dataset:
    """A way to load a subset, and what to make of its rows. Weak subsets are not part of "all"."""

    name: str
    load: Callable[[SparkSession, str], DataFrame]
    subsets: tuple[str, ...] = ("default",)
    weak: tuple[str, ...] = ()
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df
    aliases: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)


class Catalog:
    def __init__(self) -> None:
        self.datasets: dict[str, Dataset] = {}

    def register(self, dataset: Dataset, exist_ok: bool = False) -> None:
        for key in (dataset.name, *dataset.aliases):
            if key in self.datasets and not exist_ok:
                raise ValueError(f"a dataset named {key} is registered")
            self.datasets[key] = dataset

    def register_info(self, text: str) -> None:
        """From a JSON list of {name, path, columns?}; columns are renames."""
        for d in json.loads(text):
            columns = d.get("columns", {})
            self.register(Dataset(d["name"], lambda spark, _, p=d["path"]: files.by_extension(spark, p), prepare=lambda df, c=columns: df.withColumnsRenamed(c)), exist_ok=True)

    def find(self, name: str) -> Dataset | None:
        """By name or alias, else by the end of one."""
        if name in self.datasets:
            return self.datasets[name]
        ends = [d for k, d in self.datasets.items() if k.endswith("/" + name)]
        return ends[0] if ends else None

    def chosen(self, dataset: Dataset, wanted: tuple[str, ...]) -> tuple[str, ...]:
        """None asked: the only one, or "default"; "all": every one that is not weak."""
        if not wanted:
            if len(dataset.subsets) == 1:
                return dataset.subsets
            if "default" in dataset.subsets:
                return ("default",)
            raise ValueError(f"{dataset.name} has subsets {dataset.subsets}: name one")
        if wanted == ("all",):
            return tuple(s for s in dataset.subsets if s not in dataset.weak)
        unknown = [s for s in wanted if s not in dataset.subsets]
        if unknown:
            raise ValueError(f"{dataset.name} has no subsets {unknown}")
        return wanted

    def load(self, spark: SparkSession, requests: list[str], key: str, seed: int = 42) -> DataFrame:
        """Requests' rows, one after the other: subsets joined, rows sampled, columns prepared."""
        out = None
        for text in requests:
            r = parse(text)
            d = self.find(r.name)
            part = None
            if d is None:
                part = files.by_extension(spark, r.name)
            else:
                for s in self.chosen(d, r.subsets):
                    piece = d.prepare(d.load(spark, s))
                    part = piece if part is None else part.unionByName(piece, allowMissingColumns=True)
            if r.rows is not None:
                part = sampling.sampled(part, key, r.rows, seed)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out
