"""Registered queries over the given tables and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkaudit.session import spread

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


TEXT_TABLES = ("documents", "pages", "conversations")


class Tables:
    """The given Parquet tables as attributes. Text work is heavy per row, so text tables use all cores."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(table) if name in TEXT_TABLES else table


def _plain_types(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT and other numbers as DOUBLE, so results compare across engines."""
    out = []
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            out.append(F.col(field.name).cast("bigint").alias(field.name))
        elif isinstance(kind, (T.FloatType, T.DecimalType)):
            out.append(F.col(field.name).cast("double").alias(field.name))
        else:
            out.append(F.col(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], QueryFn]:
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Tables], DataFrame]) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return _plain_types(fn(Tables(spark, folder)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return run

    return wrap
