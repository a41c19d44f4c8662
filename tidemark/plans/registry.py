"""Registration of queries together with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query; its output is rendered to plain portable types."""

    def wrap(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return render(fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def _portable(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, T.DateType):
        c = F.date_format(c, "yyyy-MM-dd")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        c = c.cast("bigint")
    elif isinstance(kind, T.DecimalType):
        c = c.cast("double")
    elif isinstance(kind, T.ArrayType):
        c = F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return c.alias(field.name)


def render(df: DataFrame) -> DataFrame:
    """Dates and times as text, integers as bigint, decimals as double, lists joined.

    Both engines of the correctness check then hold the same types.
    """
    return df.select(*[_portable(f) for f in df.schema.fields])
