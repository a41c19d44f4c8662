"""Overlap of target ranges, independence of methods, and support alignment.

Ranges of one analysis (``symbol``) are cut into price buckets.  Maximal
overlapping sets come from one ordered pass over range ends: a set is maximal
exactly where a range end directly follows a range start.  Nothing compares
ranges or sets pairwise, and a symbol with very many ranges is spread over its
buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.numbers import first_reason, point_to_range
from tidemark.operators.asof import bucketed_lag, explode_buckets

CLUSTER_PREFIX = "target_cluster_"
MIN_COMPONENTS = 2
EXCLUDED_MODES = ("unsupported", "legacy_experimental")


def _ends(candidates: DataFrame) -> tuple[Column, Column]:
    price = F.col("price").cast("decimal(18,4)")
    low = F.coalesce(F.col("price_low"), price) if "price_low" in candidates.columns else price
    high = F.coalesce(F.col("price_high"), price) if "price_high" in candidates.columns else price
    return low, high


def exclusion_reason(candidates: DataFrame, families: Sequence[str]) -> Column:
    """Why a candidate is no evidence, or null if it is admissible."""
    low, high = _ends(candidates)
    mode = F.col("implementation_mode").isin(*EXCLUDED_MODES) if "implementation_mode" in candidates.columns else F.lit(False)
    return first_reason(
        (~F.coalesce(F.col("method_family").isin(*families), F.lit(False)), "method_family_not_allowed_by_profile"),
        (F.col("evidence_level").eqNullSafe("U"), "evidence_level_unverified"),
        (mode, "implementation_mode_excluded"),
        (low.isNull() | (low <= 0), "price_not_positive"),
        (low > high, "range_reversed"),
    )


def normalize_candidates(
    candidates: DataFrame, tolerance: str, families: Sequence[str] = (*K.TARGET_FAMILIES, K.SUPPORT_FAMILY)
) -> DataFrame:
    """Ranges of admissible candidates; points are widened by the tolerance.

    ``rejected_candidates`` lists the others; both together are all rows.
    """
    lo, hi = point_to_range(*_ends(candidates), tolerance)
    return (
        candidates.where(exclusion_reason(candidates, families).isNull())
        .withColumns({"lo": lo.cast("decimal(20,4)"), "hi": hi.cast("decimal(20,4)")})
        .drop("price_low", "price_high")
    )


def rejected_candidates(candidates: DataFrame, families: Sequence[str] = (*K.TARGET_FAMILIES, K.SUPPORT_FAMILY)) -> DataFrame:
    """Candidates that ``normalize_candidates`` leaves out, with the reason."""
    return candidates.withColumn("exclusion_reason", exclusion_reason(candidates, families)).where(F.col("exclusion_reason").isNotNull())


def candidate_extract(matrix: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Candidates from usable matrix cells and from approved technical scenarios.

    ``matrix(symbol, id, eps_scenario, pe_id, status, target_price)``;
    ``scenarios(symbol, anchor_set_id, rule_id, calculated_level)``.
    """
    eps, pe = F.col("id").cast("string"), F.col("pe_id")
    cells = matrix.where((F.col("status") == "available") & F.col("target_price").isNotNull()).select(
        "symbol",
        F.concat_ws(":", F.lit("valuation"), eps, "eps_scenario", pe).alias("candidate_id"),
        F.lit("VAL-01").alias("method_family"),
        F.lit("target").alias("semantic_role"),
        F.col("target_price").cast("decimal(18,4)").alias("price"),
        F.array(eps, pe).alias("source_resource_ids"),
        F.array(
            F.concat(F.lit("forward_eps_revision:"), eps), F.concat(F.lit("pe_scenario_revision:"), pe)
        ).alias("dependency_keys"),
    )
    anchor, rule = F.col("anchor_set_id").cast("string"), F.col("rule_id")
    levels = scenarios.where(rule.isin("FB-03", K.SUPPORT_FAMILY) & F.col("calculated_level").isNotNull()).select(
        "symbol",
        F.concat_ws(":", F.lit("technical"), anchor, rule).alias("candidate_id"),
        rule.alias("method_family"),
        F.when(rule == K.SUPPORT_FAMILY, "support").otherwise("target").alias("semantic_role"),
        F.col("calculated_level").cast("decimal(18,4)").alias("price"),
        F.array(anchor).alias("source_resource_ids"),
        F.array(F.concat(F.lit("anchor_revision:"), anchor)).alias("dependency_keys"),
    )
    return cells.unionByName(levels)


def _bucket(c: Column, width: float) -> Column:
    return F.floor(c / F.lit(width)).cast("bigint")


def overlap_points(targets: DataFrame, width: float) -> DataFrame:
    """Prices at which a maximal set of overlapping ranges is complete."""
    ends = targets.select(
        "symbol",
        F.explode(
            F.array(
                F.struct(F.col("lo").alias("at"), F.lit(0).alias("kind")),
                F.struct(F.col("hi").alias("at"), F.lit(1).alias("kind")),
            )
        ).alias("e"),
    ).select("symbol", "e.*")
    ends = ends.withColumn("_bucket", _bucket(F.col("at"), width))
    # Starts sort before ends at the same price, so touching ranges overlap; equal ends are alike.
    marked = bucketed_lag(ends, ["symbol"], "_bucket", ["at", "kind"], ["kind", "at"])
    return marked.where("kind = 1 and prev_kind = 0").select("symbol", F.col("prev_at").alias("point"))


def overlap_members(targets: DataFrame, points: DataFrame, width: float) -> DataFrame:
    """Ranges covering each point, through the buckets both lie in."""
    spread = explode_buckets(targets, _bucket(F.col("lo"), width), _bucket(F.col("hi"), width))
    asked = points.withColumn("_bucket", _bucket(F.col("point"), width))
    # The bucket stays: grouped by it too, the members of a point lie where the join left them.
    return asked.join(spread, ["symbol", "_bucket"]).where(F.col("point").between(F.col("lo"), F.col("hi")))


def maximal_sets(targets: DataFrame, width: float) -> DataFrame:
    """Every maximal set of mutually overlapping ranges, as sorted ids."""
    members = overlap_members(targets, overlap_points(targets, width), width)
    sets = members.groupBy("symbol", "_bucket", "point").agg(F.array_sort(F.collect_set("candidate_id")).alias("candidate_ids"))
    return sets.drop("_bucket")


def _family_dependencies(families: Sequence[str]) -> dict[str, Column]:
    """Aggregates: distinct dependency keys per method family (families are a short fixed list)."""
    return {
        f: F.array_distinct(F.flatten(F.collect_set(F.when(F.col("method_family") == f, F.array_sort("dependency_keys")))))
        for f in families
    }


def _with_components(grouped: DataFrame, families: Sequence[str]) -> DataFrame:
    """Merge families that share a dependency; each pair of families is looked at once.

    ``grouped`` holds one dependency list per family in a column named after it.
    """
    shared = F.array().cast("array<string>")
    label = {f: F.lit(i) for i, f in enumerate(families)}
    present = {f: F.array_contains("families", f) for f in families}
    links = []
    for i, a in enumerate(families):
        for b in families[i + 1 :]:
            common = F.array_intersect(F.col(f"`{a}`"), F.col(f"`{b}`"))
            shared = F.array_union(shared, common)
            links.append((a, b, present[a] & present[b] & (F.size(common) > 0)))
    # Passing the smallest label along all links as often as there are families reaches everyone.
    out = grouped.withColumns({f"_l{i}": label[f] for i, f in enumerate(families)})
    out = out.withColumns({f"_e{j}": cond for j, (_, _, cond) in enumerate(links)})
    at = {f: f"_l{i}" for i, f in enumerate(families)}
    for _ in range(max(len(families) - 1, 1)):
        for j, (a, b, _) in enumerate(links):
            low = F.least(at[a], at[b])
            out = out.withColumns({at[a]: F.when(F.col(f"_e{j}"), low).otherwise(F.col(at[a])), at[b]: F.when(F.col(f"_e{j}"), low).otherwise(F.col(at[b]))})
    labels = F.array_compact(F.array(*[F.when(present[f], F.col(at[f])) for f in families]))
    return out.withColumns(
        {"independent_method_count": F.size(F.array_distinct(labels)), "shared_dependencies": F.array_sort(shared)}
    ).drop(*at.values(), *[f"_e{j}" for j in range(len(links))], *families)


def independent_components(
    members: DataFrame,
    keys: Sequence[str] = ("symbol", "point"),
    families: Sequence[str] = (*K.TARGET_FAMILIES, K.SUPPORT_FAMILY),
) -> DataFrame:
    """Number of method families not linked by shared dependencies, per set; one grouping."""
    deps = _family_dependencies(families)
    grouped = members.groupBy(*keys).agg(
        F.array_sort(F.collect_set("method_family")).alias("families"), *[c.alias(f) for f, c in deps.items()]
    )
    return _with_components(grouped, families)


def strength(count: Column, policy: Sequence[tuple[int, str]]) -> Column:
    """Label of the highest threshold reached."""
    out = F.lit(None).cast("string")
    for minimum, label in sorted(policy):
        out = F.when(count >= minimum, F.lit(label)).otherwise(out)
    return out


def overlap_clusters(targets: DataFrame, width: float, policy: Sequence[tuple[int, str]], families: Sequence[str] = K.TARGET_FAMILIES) -> DataFrame:
    """Clusters of at least two families; dependent ones are marked, not dropped.

    ``families`` are those the profile allows, as in ``normalize_candidates``.
    """
    targets = targets.where(F.col("method_family").isin(*families))
    members = overlap_members(targets, overlap_points(targets, width), width)
    deps = _family_dependencies(families)
    grouped = members.groupBy("symbol", "_bucket", "point").agg(
        F.max("lo").alias("price_low"),
        F.min("hi").alias("price_high"),
        F.array_sort(F.collect_set("candidate_id")).alias("candidate_ids"),
        F.array_sort(F.collect_set("method_family")).alias("families"),
        *[c.alias(f) for f, c in deps.items()],
    )
    out = _with_components(grouped.where(F.size("families") >= 2), families)
    ok = F.col("independent_method_count") >= MIN_COMPONENTS
    digest = F.substring(F.sha2(F.array_join("candidate_ids", "|"), 256), 1, 20)
    return out.select(
        "symbol",
        F.concat(F.lit(CLUSTER_PREFIX), digest).alias("cluster_id"),
        "price_low",
        "price_high",
        F.size("candidate_ids").alias("candidate_count"),
        F.size("families").alias("support_count"),
        "independent_method_count",
        F.when(ok, strength(F.col("independent_method_count"), policy)).alias("evidence_strength"),
        "families",
        "candidate_ids",
        "shared_dependencies",
        F.when(ok, "available").otherwise("independent_target_methods_below_two").alias("status"),
    )


def support_overlap(clusters: DataFrame, supports: DataFrame, width: float) -> DataFrame:
    """Common part of each cluster and support range of the same analysis."""
    a = explode_buckets(
        clusters.select("symbol", "cluster_id", "price_low", "price_high"),
        _bucket(F.col("price_low"), width),
        _bucket(F.col("price_high"), width),
    )
    b = explode_buckets(
        supports.select("symbol", F.col("candidate_id").alias("support_candidate_id"), "lo", "hi"),
        _bucket(F.col("lo"), width),
        _bucket(F.col("hi"), width),
    )
    low, high = F.greatest("price_low", "lo"), F.least("price_high", "hi")
    # Several buckets may be common; the pair is reported in the one of its lower end.
    hit = a.join(b, ["symbol", "_bucket"]).where((low <= high) & (F.col("_bucket") == _bucket(low, width)))
    return hit.select(
        "symbol", "cluster_id", "support_candidate_id", low.alias("overlap_low"), high.alias("overlap_high")
    )


def unclustered(targets: DataFrame, clusters: DataFrame) -> DataFrame:
    """Targets that belong to no accepted cluster."""
    used = clusters.where("status = 'available'").select("symbol", F.explode("candidate_ids").alias("candidate_id"))
    return targets.join(used, ["symbol", "candidate_id"], "left_anti")


def confluence_summary(symbols: DataFrame, clusters: DataFrame, policy: Sequence[tuple[int, str]]) -> DataFrame:
    """Largest counts and strength per analysis; analyses without clusters are kept."""
    g = clusters.where("status = 'available'").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("clusters"),
        F.max("candidate_count").alias("max_candidate_count"),
        F.max("support_count").alias("max_support_count"),
        F.max("independent_method_count").alias("max_independent_method_count"),
    )
    out = symbols.select("symbol").distinct().join(g, "symbol", "left")
    counts = ["clusters", "max_candidate_count", "max_support_count", "max_independent_method_count"]
    out = out.fillna(0, counts)
    have = F.col("clusters") > 0
    return out.select(
        "symbol",
        *counts,
        strength(F.col("max_independent_method_count"), policy).alias("max_evidence_strength"),
        F.when(have, "available").otherwise("insufficient_data").alias("status"),
        F.when(~have, "independent_target_methods_below_two").alias("reason"),
    )
