"""Merging and writing of result tables and ledgers.

Merges return DataFrames.  Writers of versions put a new version next to the old
one.  Writers of tables cut into parts (by a hash of the key, or by month) read
and replace only the parts that new rows fall into; the files of all others
stay as they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.asof import newest


def keyed_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ("fetched_at",)) -> DataFrame:
    """Latest row per key over both tables; on equal order the new table wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return newest(both, keys, [*order, "_new"]).drop("_new")


def range_replace(old: DataFrame, new: DataFrame, ranges: DataFrame) -> DataFrame:
    """Replace whole (symbol, from, to) ranges by the new rows of those ranges."""
    spans = ranges.select("symbol", F.col("start").alias("_from"), F.col("end").alias("_to"))
    kept = old.join(
        spans, (old["symbol"] == spans["symbol"]) & old["date"].between(spans["_from"], spans["_to"]), "left_anti"
    )
    fresh = new.join(
        spans, (new["symbol"] == spans["symbol"]) & new["date"].between(spans["_from"], spans["_to"]), "left_semi"
    )
    return kept.unionByName(fresh)


def append_decision(existing: DataFrame, incoming: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Decide for each incoming row: append, already there, or conflict.

    Both carry ``fingerprint`` (of the content) and ``idempotency_key``; one row
    per pair of them comes out.  Equal content is appended once, under its least
    key of the batch; the other keys of that content are unchanged.  A key seen
    before, or twice in the batch, with other content is a conflict.  ``keys``
    says which keys were seen, where a table of its own has them.
    """
    # Only ledger rows that the batch names matter; a small batch is broadcast and the ledger is not shuffled.
    named_content = incoming.select("fingerprint").distinct()
    named_keys = incoming.select("idempotency_key").distinct()
    known = (
        existing.select("fingerprint").join(named_content, "fingerprint", "left_semi").distinct().withColumn("_known", F.lit(True))
    )
    taken = (existing if keys is None else keys).select("idempotency_key", F.col("fingerprint").alias("_old"))
    by_key = taken.join(named_keys, "idempotency_key", "left_semi").groupBy("idempotency_key").agg(F.min("_old").alias("_old"))
    # The batch is dealt twice: by its keys for all that a key says, then by its contents.
    of_key = Window.partitionBy("idempotency_key").orderBy("fingerprint")
    same = Window.partitionBy("idempotency_key", "fingerprint").orderBy("fingerprint")
    dealt = incoming.withColumns({"_first": F.first("fingerprint").over(of_key), "_rn": F.row_number().over(same)})
    # Only a pair that is no conflict of its own may stand for the content.
    keyed = dealt.where("_rn = 1").drop("_rn").join(by_key, "idempotency_key", "left")
    fit = F.col("_first").eqNullSafe(F.col("fingerprint")) & F.coalesce(F.col("_old") == F.col("fingerprint"), F.lit(True))
    lead = F.min(F.when(fit, F.col("idempotency_key"))).over(Window.partitionBy("fingerprint"))
    rows = keyed.withColumn("_lead", lead).join(known, "fingerprint", "left")
    decision = (
        F.when(F.col("_known").isNotNull(), "unchanged")
        .when(F.col("_old").isNotNull() & (F.col("_old") != F.col("fingerprint")), "conflict")
        .when(F.col("_first") != F.col("fingerprint"), "conflict")
        .when(F.col("_lead") != F.col("idempotency_key"), "unchanged")
        .otherwise("append")
    )
    return rows.select(*incoming.columns, decision.alias("decision"))


# -- tables cut into parts ------------------------------------------------------------


def with_part(df: DataFrame, key: str | Sequence[str], parts: int) -> DataFrame:
    """The rows with ``part``, a hash of their key below ``parts``."""
    names = [key] if isinstance(key, str) else list(key)
    return df.withColumn("part", F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int"))


def parts_of(df: DataFrame, column: str = "part") -> list:
    """The parts that rows fall into: as many values as a table has parts at most."""
    return sorted(r[0] for r in df.select(column).distinct().collect() if r[0] is not None)


def read_parts(spark: SparkSession, path: str, like: DataFrame, touched: Sequence, column: str = "part") -> DataFrame:
    """The rows of some parts of a table; the others are not listed in the scan.  A missing table is empty."""
    spark.createDataFrame([], like.schema).write.mode("ignore").partitionBy(column).parquet(path)
    shape = T.StructType([f for f in like.schema if f.name != column] + [like.schema[column]])
    return spark.read.schema(shape).parquet(path).where(F.col(column).isin(list(touched))).select(*like.columns)


def replace_parts(df: DataFrame, path: str, touched: Sequence, column: str = "part") -> None:
    """Write the whole content of the touched parts; a part without rows keeps an empty file.

    Spark's dynamic overwrite stages the new files and swaps the folders of
    the parts when all tasks are done, so the rows may come from the same table.
    """
    spark = df.sparkSession
    # An empty part would not be swapped: a row of nulls stands in and is not read back.
    mark = spark.createDataFrame([(t,) for t in touched], T.StructType([df.schema[column]])).withColumn("_mark", F.lit(True))
    rows = df.withColumn("_mark", F.lit(None).cast("boolean")).unionByName(mark, allowMissingColumns=True)
    rows.repartition(column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def held_rows(spark: SparkSession, path: str, like: DataFrame, touched: Sequence, column: str = "part") -> DataFrame:
    """The rows of some parts of a table that ``replace_parts`` writes."""
    return read_parts(spark, path, like.withColumn("_mark", F.lit(None).cast("boolean")), touched, column).where("_mark is null").drop("_mark")


def stored_rows(spark: SparkSession, path: str, column: str = "part") -> DataFrame:
    """All rows of a table that ``replace_parts`` wrote."""
    return spark.read.parquet(path).where("_mark is null").drop("_mark", column)


def upsert_into(path: str, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ("fetched_at",), parts: int = 64) -> list:
    """Upsert rows into a table cut by hash of its keys; the parts that were written come back."""
    spark = new.sparkSession
    fresh = with_part(new, keys, parts).persist()
    touched = parts_of(fresh)
    old = held_rows(spark, path, fresh, touched)
    replace_parts(keyed_upsert(old, fresh, keys, order), path, touched)
    fresh.unpersist()
    return touched


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def replace_ranges_in(path: str, new: DataFrame, ranges: DataFrame) -> list:
    """Replace (symbol, start, end) ranges in a table cut by month; the months that were written come back."""
    spark = new.sparkSession
    steps = F.explode(F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month")))
    touched = parts_of(ranges.where("start <= end").select(steps.alias("month")).select(month_of(F.col("month")).alias("part")))
    fresh = new.withColumn("part", month_of(F.col("date")))
    old = held_rows(spark, path, fresh, touched)
    replace_parts(range_replace(old, fresh, ranges), path, touched)
    return touched


def write_version(df: DataFrame, path: str, version: str, partition_by: Sequence[str] = ()) -> str:
    """Write a table version; an existing version is never overwritten."""
    target = f"{path.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(target)
    return target


def write_results(tables: Mapping[str, DataFrame], path: str, run_id: str, fmt: str = "parquet") -> None:
    """Result tables of one run, each in the run's partition; writing a run again replaces it."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).option("header", "true").save(f"{path.rstrip('/')}/{name}/run_id={run_id}")


def write_snapshot(panel: DataFrame, ledgers: Mapping[str, DataFrame], path: str) -> None:
    """Reconciled panel by year, and its ledgers of adjustments and open days."""
    base = path.rstrip("/")
    # Ranges of (year, symbol) split a large year over many tasks and files.
    panel.withColumn("year", F.year("date")).repartitionByRange("year", "symbol").sortWithinPartitions("year", "symbol", "date").write.mode(
        "errorifexists"
    ).partitionBy("year").parquet(f"{base}/panel")
    for name, df in ledgers.items():
        df.write.mode("errorifexists").parquet(f"{base}/{name}")
