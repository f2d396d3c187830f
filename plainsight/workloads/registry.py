"""Registered queries: name, inventory ids, Spark function, and the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plainsight.session import read_table


@dataclass(frozen=True)
class Workload:
    name: str
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Workload] = {}


def workload(name: str, ids: str, sql: str | None = None):
    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Workload(name, ids, fn, sql)
        return fn
    return register


class Tables:
    """``t.documents`` instead of ``read_table(spark, sf_dir, 'documents')``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self._spark, self._dir, name)
