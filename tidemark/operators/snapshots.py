"""Snapshot documents: assembly, provenance, paging, latest per symbol."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.canonical import fingerprint
from tidemark.operators.asof import newest


def section_document(symbols: DataFrame, sections: Mapping[str, DataFrame], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One JSON document per key (symbol, or symbol and cutoff); each section contributes its columns as an object.

    All sections are one tagged table of (keys, section, object) that is folded
    by a single grouping, however many there are; a missing section is a JSON
    null, and of several rows of a section the one with the greatest text counts.
    Only keys of ``symbols`` get a document.
    """
    tagged = symbols.select(*keys).distinct().select(*keys, F.lit(None).cast("string").alias("_section"), F.lit(None).cast("string").alias("_body"))
    for name, df in sections.items():
        cols = sorted(c for c in df.columns if c not in keys)
        body = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
        tagged = tagged.unionByName(df.select(*keys, F.lit(name).alias("_section"), body.alias("_body")))
    parts = [F.max(F.when(F.col("_section") == name, F.col("_body"))).alias(f"_{i}") for i, name in enumerate(sorted(sections))]
    folded = tagged.groupBy(*keys).agg(F.bool_or(F.isnull("_section")).alias("_asked"), *parts).where("_asked")
    head = F.regexp_replace(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), r"\}$", "")
    bodies = [F.concat(F.lit(f',"{name}":'), F.coalesce(f"_{i}", F.lit("null"))) for i, name in enumerate(sorted(sections))]
    out = folded.select(*keys, F.concat(head, *bodies, F.lit("}")).alias("document"))
    return out.withColumn("document_id", fingerprint(F.col("document"), "analysis_", 24))


def provenance_union(sections: Mapping[str, DataFrame]) -> DataFrame:
    """Dependencies of all sections in section order, one per section, type and resource.

    Each input: ``(snapshot_id, resource_type, resource_id, position)``; the
    result is ordered by section_number and position.
    """
    out = None
    for i, (name, df) in enumerate(sections.items()):
        part = df.withColumns({"section": F.lit(name), "section_number": F.lit(i)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return dependency_dedupe(out)


def dependency_dedupe(dependencies: DataFrame, keys: tuple[str, ...] = ("snapshot_id",)) -> DataFrame:
    """One dependency per section, type and resource; the last in section order wins."""
    return newest(dependencies, [*keys, "section", "resource_type", "resource_id"], ["position"])


def keyset_page(df: DataFrame, limit: int, before: tuple[str, int] | None = None, created: str = "created_at", key: str = "id") -> DataFrame:
    """Next page in (created, id) descending order, one row more than asked to tell if more follow."""
    page = df
    if before:
        at, last_id = F.lit(before[0]).cast("timestamp"), F.lit(before[1])
        page = df.where((F.col(created) < at) | ((F.col(created) == at) & (F.col(key) < last_id)))
    return page.orderBy(F.col(created).desc(), F.col(key).desc()).limit(limit + 1)


def latest_per_symbol(snapshots: DataFrame, cutoff: str) -> DataFrame:
    """Newest snapshot per symbol at the cutoff, and whether its text still matches its hash."""
    c = F.lit(cutoff).cast("timestamp")
    last = newest(snapshots.where(F.col("created_at") <= c), ["symbol"], ["created_at", "snapshot_id"])
    return last.withColumn("integrity_ok", F.sha2("document", 256) == F.col("document_sha256"))


def latest_event_per_item(events: DataFrame) -> DataFrame:
    return newest(events, ["item_id"], ["event_at", "event_id"])


def queue_page(watchlist: DataFrame, order: str = "symbol", include_archived: bool = False, limit: int = 50) -> DataFrame:
    """One page of ``limit`` rows of the queue by symbol, or by last update with ties by symbol and item."""
    if limit < 1:
        raise ValueError("limit must be positive")
    rows = watchlist if include_archived else watchlist.where(~F.col("archived"))
    keys = [F.col("symbol"), F.col("item_id")]
    return rows.orderBy(*(keys if order == "symbol" else [F.col("updated_at").desc(), *keys])).limit(limit)
