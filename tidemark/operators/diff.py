"""Differences between two stored snapshots of the same subject.

Every diff returns deltas ``(pair_id, change_type, section, resource_type,
identity, field_path, before, after, absolute_delta)``.  Values are canonical
texts; a missing side is null with its presence decided by the change type.
All of them are keyed full outer joins or grouped counts on (pair, key).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.canonical import canonical_json
from tidemark.functions.numbers import canonical_decimal, first_reason

DELTA = (
    "pair_id",
    "change_type",
    "section",
    "resource_type",
    "identity",
    "field_path",
    "before",
    "after",
    "absolute_delta",
)


def _delta(df: DataFrame, **values: Column) -> DataFrame:
    blank = F.lit(None).cast("string")
    return df.select("pair_id", *[values.get(c, blank).alias(c) for c in DELTA[1:]])


def comparable_gate(pairs: DataFrame) -> DataFrame:
    """First reason why two snapshots must not be compared, else null.

    ``pairs`` hold base and comparison columns with prefixes b_ and c_, and the
    comparison cutoff.
    """
    reason = first_reason(
        (~(F.col("b_contract_ok") & F.col("c_contract_ok")), "unsupported_comparison_snapshot_contract"),
        (F.col("b_symbol") != F.col("c_symbol"), "different_symbol"),
        (F.col("b_model_version") != F.col("c_model_version"), "different_model_version"),
        (F.col("b_capture_mode") != F.col("c_capture_mode"), "different_capture_mode"),
        (
            F.col("comparison_cutoff") < F.greatest("b_cutoff", "c_cutoff"),
            "comparison_cutoff_precedes_snapshot_cutoff",
        ),
    )
    return pairs.withColumn("reason", reason).withColumn("comparable", F.col("reason").isNull())


def dependency_diff(base: DataFrame, comparison: DataFrame) -> DataFrame:
    """Added, removed, re-revised and re-approved dependencies.

    Inputs: ``(pair_id, section, resource_type, resource_id, logical_resource_id,
    revision_number, approval_ids array<string>)``.
    """

    def side(df: DataFrame, tag: str) -> DataFrame:
        stable = F.coalesce(F.nullif("logical_resource_id", F.lit("")), F.col("resource_id"))
        approvals = F.array_join(F.array_sort("approval_ids"), ",")
        revision = canonical_json(
            {"resource_id": F.col("resource_id"), "revision_number": F.col("revision_number").cast("string")}
        )
        return df.select(
            "pair_id",
            F.concat_ws("|", "section", "resource_type", stable).alias("identity"),
            F.col("section").alias(f"{tag}_section"),
            F.col("resource_type").alias(f"{tag}_type"),
            revision.alias(f"{tag}_revision"),
            approvals.alias(f"{tag}_approvals"),
        )

    both = side(base, "b").join(side(comparison, "c"), ["pair_id", "identity"], "full_outer")
    old, new = F.col("b_revision").isNotNull(), F.col("c_revision").isNotNull()
    kept = old & new

    def change(cond: Column, kind: str, path: str, before: str, after: str) -> Column:
        return F.when(
            cond,
            F.struct(
                F.lit(kind).alias("change_type"),
                F.lit(path).alias("field_path"),
                F.col(before).alias("before"),
                F.col(after).alias("after"),
            ),
        )

    changes = F.array_compact(
        F.array(
            change(~old, "dependency_added", "source_resource_versions", "b_revision", "c_revision"),
            change(~new, "dependency_removed", "source_resource_versions", "b_revision", "c_revision"),
            change(
                kept & (F.col("b_revision") != F.col("c_revision")),
                "resource_revision_changed",
                "source_resource_versions.revision",
                "b_revision",
                "c_revision",
            ),
            change(
                kept & (F.col("b_approvals") != F.col("c_approvals")),
                "approval_reference_changed",
                "source_resource_versions.approval_ids",
                "b_approvals",
                "c_approvals",
            ),
        )
    )
    out = both.select(
        "pair_id",
        "identity",
        F.coalesce("c_section", "b_section").alias("section"),
        F.coalesce("c_type", "b_type").alias("resource_type"),
        F.explode(changes).alias("x"),
    )
    return _delta(
        out,
        change_type=F.col("x.change_type"),
        section=F.col("section"),
        resource_type=F.col("resource_type"),
        identity=F.col("identity"),
        field_path=F.col("x.field_path"),
        before=F.col("x.before"),
        after=F.col("x.after"),
    )


def map_diff(base: DataFrame, comparison: DataFrame, field: str, change_type: str, section: str) -> DataFrame:
    """Key-wise difference of a map column, by joining its entries."""

    def entries(df: DataFrame, name: str) -> DataFrame:
        e = df.select("pair_id", F.explode(F.map_entries(field)).alias("e"))
        return e.select("pair_id", F.col("e.key").alias("k"), F.col("e.value").alias(name), F.lit(True).alias(f"_{name}"))

    both = entries(base, "before").join(entries(comparison, "after"), ["pair_id", "k"], "full_outer")
    changed = both.where(~F.col("before").eqNullSafe(F.col("after")) | F.col("_before").isNull() | F.col("_after").isNull())
    return _delta(
        changed,
        change_type=F.lit(change_type),
        section=F.lit(section),
        identity=F.col("k"),
        field_path=F.concat(F.lit(f"{field}."), F.col("k")),
        before=F.col("before"),
        after=F.col("after"),
    )


def _counted(base: DataFrame, comparison: DataFrame) -> DataFrame:
    """Copies of each record text per (pair, key) on both sides, with the group sizes."""
    u = base.select("pair_id", "k", "text", F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        comparison.select("pair_id", "k", "text", F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    g = u.groupBy("pair_id", "k", "text").agg(F.sum("_l").alias("nl"), F.sum("_r").alias("nr"))
    group = Window.partitionBy("pair_id", "k")
    return g.withColumn("_single", (F.sum("nl").over(group) == 1) & (F.sum("nr").over(group) == 1))


def _single_pairs(counted: DataFrame) -> DataFrame:
    """One-to-one groups whose texts differ."""
    return (
        counted.where("_single")
        .groupBy("pair_id", "k")
        .agg(F.max(F.when(F.col("nl") > 0, F.col("text"))).alias("before"), F.max(F.when(F.col("nr") > 0, F.col("text"))).alias("after"))
        .where(~F.col("before").eqNullSafe(F.col("after")))
        .select("pair_id", F.col("k").alias("identity"), "before", "after")
    )


def record_list_diff(base: DataFrame, comparison: DataFrame, change_type: str, section: str, field_path: str) -> DataFrame:
    """Keyed difference of record lists; repeated keys are paired by exact text.

    Inputs: ``(pair_id, k, text)``.
    """
    counted = _counted(base, comparison)
    w = Window.partitionBy("pair_id", "k").orderBy("text")
    many = (
        counted.where("not _single")
        .withColumn("_at", F.row_number().over(w) - 1)
        .where((F.col("nl") == 0) | (F.col("nr") == 0))
        .select(
            "pair_id",
            F.concat("k", F.lit("|exact:"), F.col("_at").cast("string")).alias("identity"),
            F.when(F.col("nl") > 0, F.col("text")).alias("before"),
            F.when(F.col("nr") > 0, F.col("text")).alias("after"),
        )
    )
    out = _single_pairs(counted).unionByName(many)
    return _delta(
        out,
        change_type=F.lit(change_type),
        section=F.lit(section),
        identity=F.col("identity"),
        field_path=F.lit(field_path),
        before=F.col("before"),
        after=F.col("after"),
    )


def multiset_diff(base: DataFrame, comparison: DataFrame, change_type: str, section: str, field_path: str) -> DataFrame:
    """Like ``record_list_diff``, but copies count: common copies cancel, the rest is added or removed."""
    counted = _counted(base, comparison)
    extra = F.col("nl") - F.col("nr")
    rest = (
        counted.where(~F.col("_single") & (extra != 0))
        .withColumn("_kind", F.when(extra > 0, "removed").otherwise("added"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.abs(extra).cast("int"))))
    )
    w = Window.partitionBy("pair_id", "k", "_kind").orderBy("text", "_copy")
    many = rest.select(
        "pair_id",
        F.concat("k", F.lit("|"), "_kind", F.lit(":"), (F.row_number().over(w) - 1).cast("string")).alias("identity"),
        F.when(F.col("_kind") == "removed", F.col("text")).alias("before"),
        F.when(F.col("_kind") == "added", F.col("text")).alias("after"),
    )
    out = _single_pairs(counted).unionByName(many)
    return _delta(
        out,
        change_type=F.lit(change_type),
        section=F.lit(section),
        identity=F.col("identity"),
        field_path=F.lit(field_path),
        before=F.col("before"),
        after=F.col("after"),
    )


def cluster_diff(base: DataFrame, comparison: DataFrame) -> DataFrame:
    """Clusters added, removed or changed, by cluster id.  Inputs: ``(pair_id, cluster_id, text)``."""
    both = base.withColumnRenamed("text", "before").join(
        comparison.withColumnRenamed("text", "after"), ["pair_id", "cluster_id"], "full_outer"
    )
    kind = (
        F.when(F.col("before").isNull(), "confluence_cluster_added")
        .when(F.col("after").isNull(), "confluence_cluster_removed")
        .when(F.col("before") != F.col("after"), "confluence_cluster_changed")
    )
    out = both.withColumn("kind", kind).where(F.col("kind").isNotNull())
    return _delta(
        out,
        change_type=F.col("kind"),
        section=F.lit("target_confluence"),
        identity=F.col("cluster_id"),
        field_path=F.lit("target_confluence.overlap_ranges"),
        before=F.col("before"),
        after=F.col("after"),
    )


def unpivot_fields(df: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """Wide snapshot to (pair_id, field_path, present, value); values are (present, value) structs."""
    items = [F.struct(F.lit(p).alias("field_path"), c["present"].alias("present"), c["value"].alias("value")) for p, c in fields.items()]
    return df.select("pair_id", F.explode(F.array(*items)).alias("f")).select("pair_id", "f.*")


def field_diff(
    base: DataFrame, comparison: DataFrame, change_types: Mapping[str, str], numeric: Sequence[str] = ()
) -> DataFrame:
    """Changed scalar fields in long form; a field's section is the head of its path.

    A stored null and an absent field are different.  Registered numeric fields
    also get the exact difference.
    """
    a = base.select("pair_id", "field_path", F.col("present").alias("_pb"), F.col("value").alias("before"))
    b = comparison.select("pair_id", "field_path", F.col("present").alias("_pc"), F.col("value").alias("after"))
    both = a.join(b, ["pair_id", "field_path"], "full_outer").fillna(False, ["_pb", "_pc"])
    changed = both.where((F.col("_pb") != F.col("_pc")) | ~F.col("before").eqNullSafe(F.col("after")))
    return changed_fields(changed, change_types, numeric)


def changed_fields(changed: DataFrame, change_types: Mapping[str, str], numeric: Sequence[str] = ()) -> DataFrame:
    """Deltas of fields that are known to differ: ``(pair_id, field_path, before, after)``."""
    kinds = F.create_map(*[F.lit(x) for pair in change_types.items() for x in pair])
    section = F.element_at(F.split("field_path", "\\."), 1)
    diff = F.col("after").try_cast("decimal(28,10)") - F.col("before").try_cast("decimal(28,10)")
    is_number = F.col("field_path").isin(*numeric) if numeric else F.lit(False)
    return _delta(
        changed,
        change_type=F.try_element_at(kinds, F.col("field_path")),
        section=section,
        identity=section,
        field_path=F.col("field_path"),
        before=F.col("before"),
        after=F.col("after"),
        absolute_delta=F.when(is_number, canonical_decimal(diff)),
    )


CONTEXT_PUBLICATION = (
    "bound_publication_evidence_id",
    "latest_visible_publication_evidence_id",
    "bound_evidence_status",
    "publication_binding_status",
)


def context_diff(base: DataFrame, comparison: DataFrame) -> DataFrame:
    """Changes of the current context of dependencies: status, approval, review, publication.

    Inputs: ``(pair_id, identity, section, resource_type, status,
    effective_approval_status, candidate_awaiting_review boolean, publication string)``.
    """
    cols = ("section", "resource_type", "status", "effective_approval_status", "candidate_awaiting_review", "publication")

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select("pair_id", "identity", *[F.col(c).alias(f"{tag}_{c}") for c in cols])

    both = side(base, "b").join(side(comparison, "c"), ["pair_id", "identity"], "full_outer")

    def differs(c: str) -> Column:
        return ~F.col(f"b_{c}").eqNullSafe(F.col(f"c_{c}"))

    def change(c: str, kind: Column) -> Column:
        return F.when(
            differs(c),
            F.struct(
                kind.alias("change_type"),
                F.lit(f"checked_dependencies.{c}").alias("field_path"),
                F.col(f"b_{c}").cast("string").alias("before"),
                F.col(f"c_{c}").cast("string").alias("after"),
            ),
        )

    status_kind = (
        F.when(F.col("c_status") == "blocked", "dependency_blocked")
        .when(F.col("c_status") == "unknown", "dependency_unknown")
        .otherwise("freshness_status_changed")
    )
    approval_kind = F.when(F.col("c_effective_approval_status") == "revoked", "approval_revoked").otherwise(
        "approval_eligibility_changed"
    )
    changes = F.array_compact(
        F.array(
            change("status", status_kind),
            change("effective_approval_status", approval_kind),
            change("candidate_awaiting_review", F.lit("approval_eligibility_changed")),
            change("publication", F.lit("publication_evidence_changed")),
        )
    )
    out = both.select(
        "pair_id",
        "identity",
        F.coalesce("c_section", "b_section").alias("section"),
        F.coalesce("c_resource_type", "b_resource_type").alias("resource_type"),
        F.explode(changes).alias("x"),
    )
    return _delta(
        out,
        change_type=F.col("x.change_type"),
        section=F.col("section"),
        resource_type=F.col("resource_type"),
        identity=F.col("identity"),
        field_path=F.col("x.field_path"),
        before=F.col("x.before"),
        after=F.col("x.after"),
    )


def delta_order(deltas: DataFrame) -> DataFrame:
    """Canonical order of deltas."""
    return deltas.orderBy("pair_id", "section", "change_type", "resource_type", "identity", "field_path")
