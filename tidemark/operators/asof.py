"""Point-in-time resolution of ledgers, and as-of joins.

Ledgers are append-only with two clocks: ``available_at`` (when the fact was
public) and ``ingested_at`` (when we held it).  The rule for a cutoff is always
the same: keep rows visible on both clocks, choose the newest revision, and
only then look at its status, so a revoked newest revision never falls back to
an older one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REVISION_ORDER = ("revision_number", "available_at", "ingested_at", "id")
APPROVAL_ORDER = ("available_at", "ingested_at", "approval_event_id")


def visible(ledger: DataFrame, cutoff: Column | str) -> DataFrame:
    """Rows known on both clocks at the cutoff."""
    c = F.lit(cutoff).cast("timestamp") if isinstance(cutoff, str) else cutoff
    return ledger.where((F.col("available_at") <= c) & (F.col("ingested_at") <= c))


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the greatest order per key.

    The rank filter sits directly on ``row_number`` so that Spark drops all but
    one row per key in each map task before the shuffle; a key that holds a
    third of the ledger still sends one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_revision_asof(
    ledger: DataFrame, cutoff: str, keys: Sequence[str] = ("logical_id",), order: Sequence[str] = REVISION_ORDER
) -> DataFrame:
    return newest(visible(ledger, cutoff), keys, order)


def latest_approval_asof(
    approvals: DataFrame, cutoff: str, keys: Sequence[str] = ("resource_id",), order: Sequence[str] = APPROVAL_ORDER
) -> DataFrame:
    return newest(visible(approvals, cutoff), keys, order)


def latest_revision_at_cutoffs(
    ledger: DataFrame,
    cutoffs: Sequence[str],
    keys: Sequence[str] = ("logical_id",),
    order: Sequence[str] = REVISION_ORDER,
) -> DataFrame:
    """Latest revision per key at every cutoff, without ledger x cutoffs rows.

    A revision enters at the first cutoff that sees it.  Per key and entry slot
    only the greatest revision can matter, so at most one row per key, slot and
    map task is shuffled; a running maximum over the few slots of a key then
    carries winners forward.
    """
    stamps = sorted({datetime.fromisoformat(c) for c in cutoffs})
    grid = F.array(*[F.lit(s).cast("timestamp") for s in stamps])
    seen_at = F.greatest("available_at", "ingested_at")
    payload = [c for c in ledger.columns if c not in (*keys, *order)]
    slot = F.size(F.filter(grid, lambda c: c < seen_at))
    entered = ledger.withColumn("_slot", slot).where(F.col("_slot") < len(stamps))
    heads = newest(entered, [*keys, "_slot"], order)
    ranked = heads.select(*keys, "_slot", F.struct(*order, *payload).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_slot")
    best = F.max("_row").over(w.rowsBetween(Window.unboundedPreceding, 0))
    until = F.coalesce(F.lead("_slot").over(w), F.lit(len(stamps)))
    spans = ranked.select(*keys, "_slot", best.alias("_best"), until.alias("_until"))
    held = spans.select(*keys, "_best", F.explode(F.sequence(F.col("_slot"), F.col("_until") - 1)).alias("_at"))
    return held.select(*keys, F.get(grid, F.col("_at")).alias("cutoff"), "_best.*")


def approval_eligible(rule_id: Column | str) -> Column:
    """Approved under the right rule, not of level U, and level C only if operationalised."""
    rule = F.lit(rule_id) if isinstance(rule_id, str) else rule_id
    level = F.col("evidence_level")
    return (
        F.col("decision").eqNullSafe("approved")
        & F.col("rule_id").eqNullSafe(rule)
        & ~level.eqNullSafe("U")
        & (~level.eqNullSafe("C") | F.col("project_operationalization").eqNullSafe(1))
    )


def revision_with_approval(
    ledger: DataFrame, approvals: DataFrame, cutoff: str, keys: Sequence[str] = ("logical_id",)
) -> DataFrame:
    """Latest revision per key, left-joined to the latest approval of that revision."""
    rev = latest_revision_asof(ledger, cutoff, keys)
    app = latest_approval_asof(approvals, cutoff).select(
        F.col("resource_id").alias("id"),
        "approval_event_id",
        "decision",
        "rule_id",
        "evidence_level",
        "project_operationalization",
    )
    return rev.join(app, "id", "left")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    payload: Sequence[str],
    bucket: Callable[[Column], Column],
    keys: Sequence[str] = (),
    forward: bool = False,
) -> DataFrame:
    """Nearest right row at or before each left row (or strictly after, if forward).

    Both sides are cut into time buckets, so the sort within a window is over
    one key and one bucket rather than over a whole key.  What a bucket inherits
    from its neighbours is computed on one summary row per key and bucket.
    ``bucket`` must be monotone in time (for example a truncated timestamp).
    """
    keys = list(keys)
    lcols = left.columns
    hit = F.struct(F.col(right_time).alias("_rt"), *payload)
    r = right.where(F.col(right_time).isNotNull()).select(
        *keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), hit.alias("_hit")
    )
    lrow = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*lcols).alias("_row"))
    both = lrow.unionByName(r, allowMissingColumns=True).withColumn("_b", bucket(F.col("_t")))
    # Right rows sort before left rows of the same instant: inclusive backwards, strict forwards.
    order = [F.col("_t").desc(), F.col("_side").desc()] if forward else [F.col("_t"), F.col("_side")]
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = both.withColumn("_near", F.last("_hit", ignorenulls=True).over(w))
    right_only = F.when(F.col("_side") == 0, F.col("_t"))
    edge = F.min_by("_hit", right_only) if forward else F.max_by("_hit", right_only)
    summary = both.groupBy(*keys, "_b").agg(edge.alias("_edge"))
    side = F.col("_b").desc() if forward else F.col("_b")
    carry = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(side).rowsBetween(Window.unboundedPreceding, -1)
    inherited = summary.select(*keys, "_b", F.last("_edge", ignorenulls=True).over(carry).alias("_carry"))
    found = (
        local.where("_side = 1")
        .join(inherited, [*keys, "_b"], "left")
        .withColumn("_m", F.coalesce("_near", "_carry"))
    )
    return found.select("_row.*", F.col("_m._rt").alias(right_time), *[F.col(f"_m.{c}").alias(c) for c in payload])


def asof_lookup(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    payload: Sequence[str],
    bucket: Callable[[Column], Column],
    keys: Sequence[str] = (),
    forward: bool = False,
) -> DataFrame:
    """As-of join for a large left and a sparse right side; the left is never sorted.

    Right rows are packed into one short ordered list per key and bucket,
    together with the neighbour inherited from other buckets; each left row then
    picks from its bucket's list.  Choose ``bucket`` so that a list stays short.
    The equi-join key is (keys, bucket), which AQE may broadcast or split.
    """
    keys = list(keys)
    hit = F.struct(F.col(right_time).alias("_rt"), *payload)
    r = right.where(F.col(right_time).isNotNull()).select(*keys, bucket(F.col(right_time)).alias("_b"), hit.alias("_hit"))
    packed = r.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list("_hit")).alias("_list"))
    asked = left.select(*keys, bucket(F.col(left_time)).alias("_b")).distinct()
    spine = packed.join(asked, [*keys, "_b"], "full_outer")
    side = F.col("_b").desc() if forward else F.col("_b")
    carry = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(side).rowsBetween(Window.unboundedPreceding, -1)
    edge = F.get("_list", F.lit(0)) if forward else F.element_at("_list", -1)
    ready = spine.withColumn("_edge", F.when(F.col("_list").isNotNull(), edge)).select(
        *keys, "_b", "_list", F.last("_edge", ignorenulls=True).over(carry).alias("_carry")
    )
    t = F.col(left_time)
    out = left.withColumn("_b", bucket(t)).join(ready, [*keys, "_b"], "left")
    if forward:
        near = F.get(F.filter("_list", lambda x: x["_rt"] > t), F.lit(0))
    else:
        near = F.try_element_at(F.filter("_list", lambda x: x["_rt"] <= t), F.lit(-1))
    out = out.withColumn("_m", F.coalesce(near, "_carry"))
    return out.select(*left.columns, F.col("_m._rt").alias(right_time), *[F.col(f"_m.{c}").alias(c) for c in payload])


def bucketed_lag(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Previous row's values per key, for keys of any size.

    ``bucket`` must be monotone in ``order``.  Rows are ordered within (key,
    bucket) only; ahead of them stands the last row of the nearest earlier
    bucket, found on one summary row per bucket.  Nothing is joined, so rows
    that are dealt by key already are not moved.
    """
    order = [c for c in order if c not in (*keys, bucket)]
    held = {v: "_bucket_before" if v == bucket else v for v in values}
    rows = df.withColumn("_bucket_before", F.col(bucket)) if bucket in values else df
    payload = list(dict.fromkeys([*order, *[c for c in held.values() if c not in keys]]))
    last = F.max(F.struct(*order)) if payload == order else F.max_by(F.struct(*payload), F.struct(*order))
    tails = rows.groupBy(*keys, bucket).agg(last.alias("_tail"))
    later = F.lead(bucket).over(Window.partitionBy(*keys).orderBy(bucket))
    # A key that is null is no key: its buckets inherit nothing.
    sent = tails.select(*keys, later.alias("_later"), "_tail").dropna(subset=[*keys, "_later"])
    sent = sent.select(*keys, F.col("_later").alias(bucket), F.lit(0).alias("_own"), "_tail.*")
    both = rows.withColumn("_own", F.lit(1)).unionByName(sent, allowMissingColumns=True)
    w = Window.partitionBy(*keys, bucket).orderBy("_own", *order)
    out = both.select("*", *[F.lag(c).over(w).alias(f"prev_{v}") for v, c in held.items()])
    return out.where("_own = 1").select(*df.columns, *[f"prev_{v}" for v in held])


def bucketed_rank(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], name: str) -> DataFrame:
    """Row number per key, for keys of any size: rank in the bucket plus the rows of earlier buckets."""
    w = Window.partitionBy(*keys, bucket).orderBy(*order)
    local = df.withColumns({"_at": F.row_number().over(w), "_end": F.lead(F.lit(1)).over(w).isNull()})
    counts = local.where("_end").select(*keys, bucket, F.col("_at").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = local.join(offsets, [*keys, bucket])
    return out.withColumn(name, F.col("_at") + F.col("_off")).drop("_at", "_off", "_end")


def explode_buckets(df: DataFrame, low: Column, high: Column, name: str = "_bucket") -> DataFrame:
    """One row per whole-number bucket an interval touches, for bucketed range joins."""
    return df.withColumn(name, F.explode(F.sequence(low, high)))
