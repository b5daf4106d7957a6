"""Registry of the queries: name -> (Spark plan, DuckDB SQL or None)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.sources import tables

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        PLANS[name] = plan
        if sql:
            ORACLES[name] = sql
        return plan

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SAVED: dict[tuple, str] = {}


def saved(spark: SparkSession, sf_dir: str, name: str, source: str, build: Callable[[str], object]) -> str:
    """The folder of what `build` writes from a table (an index): built once a session and state of the table's files, then opened again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{source}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)))
    key = (spark.sparkContext.applicationId, name, files)
    if key not in _SAVED:
        folder = tables.scratch(spark, name)
        build(folder)
        _SAVED[key] = folder
    return _SAVED[key]


@functools.lru_cache(maxsize=16)
def opened(kind: type, spark: SparkSession, path: str):  # noqa: ANN201
    """A saved index, opened once."""
    return kind(spark, path)


def short_batches(spark: SparkSession, size: int = 4_000_000) -> None:
    """Arrow batches of few enough bytes that a Python worker holds little, however long texts are. For the session: plans run after they are returned."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("bB")) <= size:
        spark.conf.set(name, str(size))
