"""Map-reduce jobs of the user's own Python functions, as Arrow-batched maps around one sort-based shuffle.

Values of a key reach ``reduce`` as an iterator and are never held together,
so that a key may have any number of them. Built-in aggregates are faster
wherever they can say the same.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

JOBS: dict[str, type] = {}


class Job:
    """A job: ``map`` and ``reduce`` are generators; ``map_init``, ``reduce_init`` and ``cleanup`` run once a task."""

    #: Types of key and value, and the columns that ``reduce`` gives tuples of.
    key, value, out = "string", "long", "key string, value long"

    def __init__(self, **params):
        self.params = params

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        JOBS[cls.__name__] = cls

    def map_init(self) -> None: ...

    def map(self, item: dict) -> Iterator[tuple]:
        raise NotImplementedError

    def combine(self, key, values: list) -> Iterable:
        """Fewer values of a key of one batch; as they are by default."""
        return values

    def reduce_init(self) -> None: ...

    def reduce(self, key, values: Iterator) -> Iterator[tuple]:
        raise NotImplementedError

    def cleanup(self) -> None: ...


def by_name(name: str) -> type:
    """A job's class by its name or as ``module.Class``."""
    if name in JOBS:
        return JOBS[name]
    module, _, cls = name.rpartition(".")
    return getattr(importlib.import_module(module), cls)


def number(x: str) -> int | float | str:
    """An int if it reads as one, else a float, else the text."""
    for kind in (int, float):
        try:
            return kind(x)
        except ValueError:
            pass
    return x


def arguments(text: str) -> dict:
    """Keyword arguments from ``a=1,b=2.5,c=x``."""
    return {k: number(v) for k, v in (part.split("=", 1) for part in text.split(",") if part)}


def _rows(items: Iterable[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for item in items:
        held.append(item)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _schema(text: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(text))


def run(df: DataFrame, job: Job | Callable[[], Job]) -> DataFrame:
    """The result of a job over all rows of ``df``."""
    job = job if isinstance(job, Job) else job()
    pairs = f"key {job.key}, value {job.value}"
    pair_schema, out_schema = _schema(pairs), _schema(job.out)

    def mapped(batches):
        job.map_init()
        for b in batches:
            by_key: dict = {}
            for item in b.to_pylist():
                for k, v in job.map(item):
                    by_key.setdefault(k, []).append(v)
            yield from _rows(((k, v) for k, values in by_key.items() for v in job.combine(k, values)), pair_schema)
        job.cleanup()

    def reduced(batches):
        job.reduce_init()
        rows = ((k, v) for b in batches for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        results = (item for k, own in groupby(rows, key=lambda r: r[0]) for item in job.reduce(k, (v for _, v in own)))
        yield from _rows(results, out_schema)
        job.cleanup()

    return df.mapInArrow(mapped, pairs).repartition("key").sortWithinPartitions("key").mapInArrow(reduced, job.out)


class WordCount(Job):
    """Words of the column ``text``, each counted ``factor`` times (default 1)."""

    def map(self, item):
        for word in (item["text"] or "").lower().split():
            yield word, 1

    def combine(self, key, values):
        return [sum(values)]

    def reduce(self, key, values):
        yield key, sum(values) * int(self.params.get("factor", 1))


class Largest(Job):
    """The ``k`` largest of the values (column ``value``) of each key (column ``key``), merged from bounded queues."""

    value, out = "double", "key string, rank int, value double"

    def map(self, item):
        if item["value"] is not None and item["value"] == item["value"]:
            yield item["key"], item["value"]

    def combine(self, key, values):
        return sorted(values, reverse=True)[: self.params["k"]]

    def reduce(self, key, values):
        import heapq

        for rank, v in enumerate(heapq.nlargest(self.params["k"], values), 1):
            yield key, rank, v
