"""Stored analysis documents as VARIANT values: their sections, registered fields and subjects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.operators.diff import changed_fields

ITEMS = "array<variant>"


def parsed(documents: DataFrame, column: str = "document") -> DataFrame:
    """The documents with ``doc``, the text as a variant; null where it is no JSON."""
    return documents.withColumn("doc", F.try_parse_json(column))


def unreadable_documents(documents: DataFrame, column: str = "document") -> DataFrame:
    """Documents that are no JSON objects, with the reason."""
    doc = F.try_parse_json(F.col(column))
    reason = (
        F.when(F.col(column).isNull(), "document_missing")
        .when(doc.isNull(), "document_unreadable")
        .when(~F.schema_of_variant(doc).startswith("OBJECT"), "document_is_no_object")
    )
    return documents.withColumn("reason", reason).where("reason is not null")


def _field(item: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", kind)


def scenario_subjects(snapshots: DataFrame, column: str = "document") -> DataFrame:
    """Candidates and clusters that stored snapshots name, as rows to be evaluated.

    All other columns of ``snapshots`` are kept.  Methods count if their
    family is known and its role fits: the support family, and it alone, is a
    support.  A method without a range has its price as both ends.
    """
    keep = [c for c in snapshots.columns if c != column]
    confluence = "$.output.target_confluence"
    none = F.array().cast(ITEMS)

    def tagged(name: str, cluster: bool) -> Column:
        items = F.coalesce(F.try_variant_get("doc", f"{confluence}.{name}", ITEMS), none)
        return F.transform(items, lambda item: F.struct(F.lit(cluster).alias("cluster"), item.alias("item")))

    # Both lists leave the document in one pass.  The outer form keeps Spark from asking for their
    # length in a filter below the parsing, which would build and parse each text once more.
    found = F.posexplode_outer(F.concat(tagged("supporting_methods", False), tagged("overlap_ranges", True))).alias("place", "e")
    items = parsed(snapshots, column).select(*keep, found).where("place is not null").select(*keep, "e.cluster", "e.item")
    item, cluster = F.col("item"), F.col("cluster")
    role, family = _field(item, "semantic_role", "string"), _field(item, "method_family", "string")
    fields = items.withColumns({"_role": role, "_family": F.when(cluster, F.lit(K.CLUSTER_FAMILY)).otherwise(family)})
    role, family = F.col("_role"), F.col("_family")
    fits = family.isin(*K.TARGET_FAMILIES, K.SUPPORT_FAMILY) & ((family == K.SUPPORT_FAMILY) == F.coalesce(role == "support", F.lit(False)))

    def end(name: str) -> Column:
        """The end of the range; a key that is not there falls back to the price of a method, a stored null does not."""
        there = cluster | F.try_variant_get("item", f"$.{name}", "variant").isNotNull()
        return F.when(there, _field(item, name, "decimal(18,4)")).otherwise(_field(item, "price", "decimal(18,4)"))

    return fields.where(cluster | fits).select(
        *keep,
        F.when(cluster, "target_cluster").when(role == "support", "support_candidate").otherwise("target_candidate").alias("subject_type"),
        F.when(cluster, _field(item, "cluster_id", "string")).otherwise(_field(item, "candidate_id", "string")).alias("subject_id"),
        family.alias("method_family"),
        F.when(cluster, "target").otherwise(role).alias("semantic_role"),
        end("price_low").alias("price_low"),
        end("price_high").alias("price_high"),
        F.when(cluster, _field(item, "evidence_strength", "string")).alias("evidence_strength"),
    )


def registered_paths() -> dict[str, str]:
    """Path -> kind of change, for the fields and section states that are compared."""
    paths = {f"liquidity.{name}": "liquidity_context_changed" for name in K.LIQUIDITY_PATHS}
    paths |= {f"screening.{name}": "screening_result_changed" for name in K.SCREENING_PATHS}
    paths |= {f"{name}.status": "section_status_changed" for name in K.DOCUMENT_SECTIONS}
    return paths | {"data_quality.status": "data_quality_status_changed"}


def document_fields(documents: DataFrame, paths: Mapping[str, str] | None = None, column: str = "document") -> DataFrame:
    """(pair_id, field_path, present, value) of the registered paths below ``output``.

    Scalars are plain text, objects and lists canonical JSON; a stored null is
    present without a value.
    """
    doc = parsed(documents, column)
    names = list(paths or registered_paths())
    return doc.select("pair_id", F.explode(_field_list(F.col("doc"), names)).alias("f")).select("pair_id", "f.*")


def _field_list(doc: Column, names: Sequence[str]) -> Column:
    """One entry per path, in order; each value is looked up once."""

    def entry(f: Column) -> Column:
        value = f["v"]
        text = F.when(~F.is_variant_null(value), F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)))
        return F.struct(f["p"].alias("field_path"), value.isNotNull().alias("present"), text.alias("value"))

    found = [F.struct(F.lit(n).alias("p"), F.try_variant_get(doc, f"$.output.{n}", "variant").alias("v")) for n in names]
    return F.transform(F.array(*found), entry)


def document_diff(base: DataFrame, comparison: DataFrame) -> DataFrame:
    """Deltas of all registered paths of two documents per pair, numbers with their exact difference.

    The two documents of a pair meet as a whole, and only fields that differ
    become rows; a document that is missing has none of the fields.
    """
    paths = registered_paths()
    names = list(paths)
    numeric = [f"liquidity.{name}" for name in K.LIQUIDITY_NUMBERS]
    a = base.select("pair_id", F.col("document").alias("_b"))
    c = comparison.select("pair_id", F.col("document").alias("_c"))
    both = a.join(c, "pair_id", "full_outer")
    read = both.select("pair_id", F.try_parse_json("_b").alias("_b"), F.try_parse_json("_c").alias("_c"))
    lists = read.select("pair_id", _field_list(F.col("_b"), names).alias("_b"), _field_list(F.col("_c"), names).alias("_c"))

    def pair(x: Column, y: Column) -> Column:
        return F.struct(x["field_path"].alias("field_path"), x["present"].alias("_pb"), y["present"].alias("_pc"), x["value"].alias("before"), y["value"].alias("after"))

    differs = F.filter(F.zip_with("_b", "_c", pair), lambda f: (f["_pb"] != f["_pc"]) | ~f["before"].eqNullSafe(f["after"]))
    # The outer form keeps Spark from asking for the length of the list in a filter below the parsing.
    found = lists.select("pair_id", F.posexplode_outer(differs).alias("place", "f")).where("place is not null")
    deltas = changed_fields(found.select("pair_id", "f.*"), paths, numeric)
    kind = F.col("change_type")
    named = F.when(kind == "liquidity_context_changed", "market_liquidity").when(kind == "screening_result_changed", "screening_result")
    return deltas.withColumn("identity", F.coalesce(named, "identity"))
