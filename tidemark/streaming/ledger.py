"""Incremental ingestion with file streams.

What a stream must remember lies in its keyed state or in tables cut by a hash
of their key, of which a batch reads only the parts it touches.  A batch may
run again after a failure: what it writes replaces its own earlier attempt or
is found in the target first, so a repeat adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.validate import split_valid, validate
from tidemark.session import settle
from tidemark.sources.sinks import append_decision, held_rows, parts_of, read_parts, replace_parts, with_part

PARTS = 64  # folders of a ledger; a batch reads and writes those its keys fall into


def _run(
    source: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def without_repeats(stream: DataFrame, key: list[str], delay: str) -> DataFrame:
    """Drop rows whose key arrived within ``delay`` before; the state forgets a key after that time.

    The clock is that of arrival, so no row is ever too late to be let in.
    """
    return stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", delay).dropDuplicatesWithinWatermark(key).drop("_arrived")


def ledger_append(
    stream: DataFrame, rules: Mapping[str, Column], ledger: str, rejects: str, checkpoint: str, delay: str | None = "1 day", parts: int = PARTS
) -> StreamingQuery:
    """Validate, drop repeats, append new content; rejected and conflicting rows go aside.

    The stream carries ``fingerprint`` and ``idempotency_key``.  Copies that
    arrive within ``delay`` are dropped by the stream's own state; later ones
    are found in the ledger.  Ledger and rejects lie in ``parts`` folders by
    hash of the fingerprint, and ``<ledger>_keys`` has the keys by their own
    hash: a batch reads the folders of its fingerprints and keys, and no other.
    ``<ledger>_batch`` holds the rows of the last batch.
    """
    key = ["fingerprint", "idempotency_key"]
    unique = without_repeats(stream, key, delay) if delay else stream
    keys = f"{ledger}_keys"

    spark, landed = stream.sparkSession, f"{ledger}_batch"

    def batch(df: DataFrame, _: int) -> None:
        # Written down once, so that the state is asked once; the session of a stream does not adapt its shuffles, that of the caller does.
        checked = validate(df, rules)
        checked.write.mode("overwrite").parquet(landed)
        good, bad = split_valid(spark.read.schema(checked.schema).parquet(landed))
        good = with_part(good, "fingerprint", parts)
        content = read_parts(spark, ledger, good, parts_of(good))
        own_keys = with_part(good.select(*key), "idempotency_key", parts)
        taken = read_parts(spark, keys, own_keys, parts_of(own_keys))
        # Written down, not cached: Spark computes a cache anew when a table behind it is written to.
        decided = settle(append_decision(content, good.drop("part"), taken))
        conflicts = decided.where("decision = 'conflict'").drop("decision").withColumn("reasons", F.array(F.lit("idempotency_conflict")))
        refused = with_part(bad.unionByName(conflicts).dropDuplicates(key), "fingerprint", parts).persist()
        known = read_parts(spark, rejects, refused, parts_of(refused)).select(*key)
        _append(refused.join(known, key, "left_anti"), rejects)
        fresh = with_part(decided.where("decision = 'append'").drop("decision"), "fingerprint", parts)
        # Keys first: a batch that ends between the two finds its keys with the same content and appends again.
        _append(with_part(fresh.select(*key), "idempotency_key", parts), keys)
        _append(fresh, ledger)
        refused.unpersist()

    return _run(unique, batch, checkpoint)


def _append(df: DataFrame, path: str) -> None:
    # A part with many rows is written by several tasks.
    df.hint("rebalance", "part").write.mode("append").partitionBy("part").parquet(path)


# -- pairing of two markets -------------------------------------------------------

PAIRED = "trade_date date, market_a double, market_b double, total double, status string, revision int"


def _pair_day(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Both sides of a day and its number of changes; a change is the next revision."""
    a, b, revision = state.get if state.exists else (None, None, 0)
    found: dict[str, tuple] = {}
    for frame in frames:
        for market, value, at in zip(frame["market"], frame["value"], frame["arrival"], strict=True):
            if market in ("A", "B") and value == value and value is not None:
                found[market] = max(found.get(market, (at, value)), (at, value))
    new = tuple(found[m][1] if m in found else old for m, old in (("A", a), ("B", b)))
    if new != (a, b):
        state.update((*new, revision + 1))
        both = new[0] is not None and new[1] is not None
        row = (key[0], *new, new[0] + new[1] if both else None, "available" if both else "partial", revision + 1)
        out = pd.DataFrame([row], columns=["trade_date", "market_a", "market_b", "total", "status", "revision"])
        yield out.astype({c: "float64" for c in ("market_a", "market_b", "total")} | {"revision": "int32"})


def turnover_pairing(stream: DataFrame, ledger: str, checkpoint: str) -> StreamingQuery:
    """Pair two markets per day as they arrive; every change of a day is its next revision.

    ``stream(trade_date, market, value[, ingested_at])``.  A day's state is one
    row: the value of either market and the number of revisions.  No table is
    read.  A later batch replaces a market's value; within a batch the newest
    ``ingested_at`` and then the largest value counts.  Repeats change nothing.
    """
    arrival = F.col("ingested_at").cast("timestamp").cast("double") if "ingested_at" in stream.columns else F.lit(0.0)
    rows = stream.select("trade_date", "market", F.col("value").cast("double").alias("value"), F.coalesce(arrival, F.lit(float("-inf"))).alias("arrival"))
    paired = rows.groupBy("trade_date").applyInPandasWithState(_pair_day, PAIRED, "a double, b double, revision int", "append", GroupStateTimeout.NoTimeout)
    return paired.writeStream.format("parquet").outputMode("append").option("path", ledger).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# -- publication evidence ------------------------------------------------------------

EVENT = "period string, revision int, event string, payload string"


def _gate(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A row waits in the state until accepted evidence for it arrives; what is released is released once."""
    payload, accepted, released = state.get if state.exists else (None, False, False)
    waited = payload is not None
    rows = []
    for frame in frames:
        accepted = accepted or bool((frame["proof"] == "accepted").any())
        rows += [p for p in frame["payload"] if p is not None]
    rows.sort()
    events = []
    if payload is None and rows:
        payload = rows.pop(0)
    events += [("clash", p) for p in dict.fromkeys(rows) if p != payload]
    if payload is not None and not released:
        if accepted:
            released = True
            events.append(("released" if waited else "direct", payload))
        elif not waited:
            events.append(("waiting", payload))
    state.update((payload, accepted, released))
    if events:
        yield pd.DataFrame([(*key, e, p) for e, p in events], columns=["period", "revision", "event", "payload"]).astype({"revision": "int32"})


def evidence_gate(stream: DataFrame, evidence: DataFrame, ledger: str, candidates: str, clashes: str, checkpoint: str, parts: int = PARTS) -> StreamingQuery:
    """Rows enter the ledger once accepted publication evidence exists; until then they are candidates.

    ``stream(period, revision, ...)`` and ``evidence(period, revision, status)``
    are both streams.  They meet in one keyed state per (period, revision)
    that holds the waiting row and whether evidence was accepted, whichever
    comes first; neither has to come within a time.  A released row leaves the
    candidates: the folders that hold it are written anew without it.

    The first row of a (period, revision) counts; of several in one batch that
    with the least text of its other columns as JSON.  Rows that differ from
    it go to ``clashes``.  Evidence once accepted stays accepted.
    """
    others = [c for c in stream.columns if c not in ("period", "revision")]
    shape = T.StructType([stream.schema[c] for c in others])
    key = [F.col("period"), F.col("revision").cast("int").alias("revision")]
    none = F.lit(None).cast("string")
    text = F.to_json(F.struct(*others), {"ignoreNullFields": "false"})
    both = stream.select(*key, text.alias("payload"), none.alias("proof")).unionByName(evidence.select(*key, none.alias("payload"), F.col("status").alias("proof")))
    events = both.groupBy("period", "revision").applyInPandasWithState(_gate, EVENT, "payload string, accepted boolean, released boolean", "append", GroupStateTimeout.NoTimeout)

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        rows = df.withColumn("row", F.from_json("payload", shape)).select("period", "revision", "event", "row.*").persist()
        own = ["period", "revision", *others]
        # One folder per batch: a repeat of the batch writes the same folder again.
        rows.where("event in ('released', 'direct')").select(*own).write.mode("overwrite").parquet(f"{ledger}/batch={number}")
        rows.where("event = 'clash'").select(*own).write.mode("overwrite").parquet(f"{clashes}/batch={number}")
        moved = with_part(rows.where("event in ('waiting', 'released')"), "period", parts).persist()
        touched = parts_of(moved)
        held = held_rows(spark, candidates, moved.select(*own, "part"), touched)
        kept = held.unionByName(moved.where("event = 'waiting'").select(*own, "part")).dropDuplicates(["period", "revision"])
        left = kept.join(moved.where("event = 'released'").select("period", "revision"), ["period", "revision"], "left_anti")
        replace_parts(left, candidates, touched)
        moved.unpersist()
        rows.unpersist()

    return _run(events, batch, checkpoint)
