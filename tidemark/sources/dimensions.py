"""Small dimension tables with their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE_SCHEMA = T.StructType(
    [
        T.StructField("rule_id", T.StringType(), False),
        T.StructField("evidence_level", T.StringType(), False),
        T.StructField("implementation_mode", T.StringType(), False),
        T.StructField("human_approval_required", T.BooleanType(), False),
        T.StructField("project_operationalization", T.BooleanType(), False),
        T.StructField("allowed_outputs", T.ArrayType(T.StringType()), False),
        T.StructField("forbidden_uses", T.ArrayType(T.StringType()), False),
        T.StructField("rule_version", T.StringType(), False),
    ]
)

UNIVERSE_SCHEMA = "symbol string, category string"


def rule_registry(spark: SparkSession, path: str) -> DataFrame:
    """Rules from a JSON-lines file; the registry is data, none is built in."""
    return spark.read.schema(RULE_SCHEMA).json(path, mode="FAILFAST")


def universe(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(UNIVERSE_SCHEMA).json(path, mode="FAILFAST")


def dimension_defects(df: DataFrame, key: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Keys that repeat or rows that lack a required value; an empty result means usable."""
    lacking: Column = F.col(key).isNull()
    for c in required:
        lacking = lacking | F.col(c).isNull()
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("rows"), F.bool_or(lacking).alias("lacks_required"))
        .where((F.col("rows") > 1) | F.col("lacks_required"))
    )
