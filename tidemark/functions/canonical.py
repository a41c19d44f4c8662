"""Canonical text and fingerprints."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """Compact JSON object with sorted keys; null fields are written as null."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def canonical_map(c: Column | str) -> Column:
    """Map rebuilt in key order, so that equal maps have equal text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.map_from_entries(F.array_sort(F.map_entries(c)))


def fingerprint(text: Column, prefix: str = "", length: int = 64) -> Column:
    """Prefixed, shortened SHA-256 of a text."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, length))


def dataset_hash(rows: Column) -> Column:
    """SHA-256 over the sorted lines of a group; for groups of bounded size only."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(rows)), "\n"), 256)


def path_get(document: Column | str, path: str) -> Column:
    """Value at a dotted path, with a flag that tells a stored null from an absent field."""
    doc = F.col(document) if isinstance(document, str) else document
    *parents, leaf = path.split(".")
    holder = F.get_json_object(doc, "$." + ".".join(parents)) if parents else doc
    present = F.coalesce(F.array_contains(F.json_object_keys(holder), leaf), F.lit(False))
    return F.struct(present.alias("present"), F.get_json_object(doc, "$." + path).alias("value"))
