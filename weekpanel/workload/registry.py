"""Registered queries: a Spark callable, its output columns and the SQL that must give the same rows.

Output columns are declared once, as ``name:kind``. Both sides are cast by that list: ``s`` text,
``l`` whole number, ``d`` number rounded to six digits, ``t`` date as ISO text. The SQL runs on the
input views plus the fixture views it names.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from weekpanel.workload.fixtures import FIXTURES, Tables, needed

QUERIES: dict[str, "Query"] = {}


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    columns: tuple[tuple[str, str], ...]
    run: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.run(Tables(spark, sf_dir)).selectExpr(*[_spark_out(n, k) for n, k in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        views = [f"{name} as ({FIXTURES[name].format_map(_Plain())})" for name in needed(self.sql)]
        body = f"select {', '.join(_sql_out(n, k) for n, k in self.columns)} from ({self.sql}) as result"
        return (f"with {', '.join(views)} " if views else "") + body


class _Plain(dict):
    def __missing__(self, key: str) -> str:
        return key


def _spark_out(name: str, kind: str) -> str:
    c = f"`{name}`"
    if kind == "l":
        return f"cast({c} as bigint) as {c}"
    if kind == "d":
        return f"floor(cast({c} as double) * 1e6D + 0.5D) / 1e6D as {c}"
    if kind == "t":
        return f"cast(cast({c} as date) as string) as {c}"
    return f"cast({c} as string) as {c}"


def _sql_out(name: str, kind: str) -> str:
    c = f'"{name}"'
    if kind == "l":
        return f"cast({c} as bigint) as {c}"
    if kind == "d":
        return f"floor(cast({c} as double) * 1e6 + 0.5) / 1e6 as {c}"
    if kind == "t":
        return f"cast(cast({c} as date) as varchar) as {c}"
    return f"cast({c} as varchar) as {c}"


def query(name: str, covers: str, out: str, sql: str | None = None):
    """Register a query. ``covers`` names the operators of the inventory it runs."""
    columns = tuple(tuple(re.split(r":(?=[sldt]$)", part)) for part in out.split())

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = Query(name, tuple(covers.split()), columns, fn, sql)
        return fn

    return add
