"""Reconstruction of provider gaps from official rows and a factor consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.numbers import first_reason
from tidemark.operators.quality import PRICES, clean_ohlcv


def action_segments(rows: DataFrame, actions: DataFrame) -> DataFrame:
    """Label rows with the symbol's latest action date at or before them.

    A symbol has a few actions a year; they travel as one short list per symbol.
    """
    days = actions.groupBy("symbol").agg(F.collect_set("event_date").alias("_days"))
    last = F.array_max(F.filter("_days", lambda x: x <= F.col("date")))
    label = F.coalesce(F.date_format(last, "yyyy-MM-dd"), F.lit(K.NO_PRIOR_ACTION))
    return rows.join(days, "symbol", "left").withColumn("segment", label).drop("_days")


def factor_anchors(official: DataFrame, provider: DataFrame) -> DataFrame:
    """Days on which both sources have a close, with adjusted / raw."""
    raw = official.where(F.col("close") > 0).select("symbol", "date", F.col("close").alias("raw_close"))
    adj = provider.where(F.col("close").isNotNull()).select("symbol", "date", F.col("close").alias("adjusted_close"))
    both = raw.join(adj, ["symbol", "date"])
    return both.withColumn("factor", F.col("adjusted_close") / F.col("raw_close"))


def _relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b))


def _median(values: Column) -> Column:
    n = F.size(values)
    s = F.array_sort(values)
    mid = (n / 2).cast("int")
    return F.when(n % 2 == 1, F.get(s, mid)).otherwise((F.get(s, mid - 1) + F.get(s, mid)) / 2.0)


def factor_consensus(
    anchors: DataFrame, keys: tuple[str, ...] = ("symbol", "month", "segment"), tolerance: float = K.FACTOR_TOLERANCE
) -> DataFrame:
    """Largest set of near-equal factors per symbol, month and segment.

    A group holds at most one anchor per day of a month, so the comparison of
    members against every center happens in a bounded array of one row, without
    a self-join.
    """
    g = anchors.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "factor"))).alias("a"))
    near = F.array_distinct(
        F.transform(
            "a",
            lambda center: F.filter("a", lambda m: _relative_difference(m["factor"], center["factor"]) <= tolerance),
        )
    )
    g = g.withColumn("sets", near).withColumn("largest", F.array_max(F.transform("sets", lambda s: F.size(s))))
    g = g.withColumn("winners", F.filter("sets", lambda s: F.size(s) == F.col("largest")))
    chosen = F.get("winners", F.lit(0))
    unique = (F.size("winners") == 1) & (F.col("largest") >= K.MIN_FACTOR_ANCHORS)
    return g.select(
        *keys,
        F.size("a").alias("candidate_anchor_count"),
        F.col("largest").alias("largest_consensus_size"),
        F.size("winners").alias("largest_consensus_group_count"),
        F.when(unique, _median(F.transform(chosen, lambda m: m["factor"]))).alias("adjustment_factor"),
        F.when(unique, F.transform(chosen, lambda m: F.date_format(m["date"], "yyyy-MM-dd"))).alias("selected_anchors"),
    )


def _month(c: str = "date") -> Column:
    return F.date_format(c, "yyyy-MM")


def adjusted_gap_rows(targets: DataFrame, provider: DataFrame, official: DataFrame, actions: DataFrame) -> DataFrame:
    """One derived row per target day, or the first reason why there is none."""
    anchors = action_segments(factor_anchors(official, provider), actions).withColumn("month", _month())
    consensus = factor_consensus(anchors)
    held = provider.select("symbol", "date", F.lit(True).alias("_held")).distinct()
    raw = official.select(
        "symbol", "date", *[F.col(c).alias(f"raw_{c}") for c in (*PRICES, "volume")], F.lit(True).alias("_raw")
    )
    rows = (
        action_segments(targets.select("symbol", "date").distinct(), actions)
        .withColumn("month", _month())
        .join(held, ["symbol", "date"], "left")
        .join(raw, ["symbol", "date"], "left")
        .join(consensus, ["symbol", "month", "segment"], "left")
    )
    bad_price = F.lit(False)
    for c in PRICES:
        bad_price = bad_price | F.col(f"raw_{c}").isNull() | (F.col(f"raw_{c}") <= 0)
    reason = first_reason(
        (F.col("_held").isNotNull(), "target_date_already_exists"),
        (F.col("_raw").isNull(), "official_raw_row_unavailable"),
        (F.coalesce(F.col("raw_volume"), F.lit(0.0)) <= 0, "official_raw_volume_not_positive"),
        (bad_price, "official_raw_price_invalid"),
        (
            F.coalesce(F.col("candidate_anchor_count"), F.lit(0)) < K.MIN_FACTOR_ANCHORS,
            "fewer_than_two_same_segment_anchors",
        ),
        (F.col("largest_consensus_size") < K.MIN_FACTOR_ANCHORS, "no_factor_consensus"),
        (F.col("largest_consensus_group_count") != 1, "ambiguous_factor_consensus"),
    )
    rows = rows.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return rows.select(
        "symbol",
        "date",
        F.when(ok, "available").otherwise("insufficient_data").alias("status"),
        "reason",
        "segment",
        F.when(ok, F.col("adjustment_factor")).alias("adjustment_factor"),
        *[F.when(ok, F.col(f"raw_{c}") * F.col("adjustment_factor")).alias(c) for c in PRICES],
        F.when(ok, F.col("raw_volume")).alias("volume"),
    )


def reconciled_panel(provider: DataFrame, derived: DataFrame) -> DataFrame:
    """Provider rows plus derived rows, cleaned; provider rows win on the same day."""
    cols = ["symbol", "date", *PRICES, "volume"]
    added = derived.where("status = 'available'").select(*cols, F.lit(0).alias("ingest_order"), F.lit(True).alias("derived"))
    base = provider.select(*cols, F.lit(1).alias("ingest_order"), F.lit(False).alias("derived"))
    return clean_ohlcv(base.unionByName(added))


def reconcile_status(panel: DataFrame, derived: DataFrame) -> DataFrame:
    """Row counts and integrity per symbol after reconstruction."""
    a = panel.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("derived").alias("derived_rows")
    )
    b = derived.groupBy("symbol").agg(F.count_if(F.col("status") != "available").alias("unresolved_rows"))
    out = a.join(b, "symbol", "full_outer").fillna(0, ["rows", "derived_rows", "unresolved_rows"])
    return out.withColumn(
        "integrity_status", F.when(F.col("unresolved_rows") > 0, "quality_warning").otherwise("available")
    )


def zero_volume_reconcile(
    removed: DataFrame, calendar: DataFrame, official: DataFrame, panel: DataFrame
) -> DataFrame:
    """Why each removed zero-volume row was without volume, and whether that settles it."""
    rows = (
        removed.select("symbol", "date")
        .distinct()
        .join(calendar.select("date", F.lit(True).alias("_cal")).distinct(), "date", "left")
        .join(
            official.select("symbol", "date", F.col("volume").alias("official_volume"), F.lit(True).alias("_off")),
            ["symbol", "date"],
            "left",
        )
        .join(panel.select("symbol", "date", F.lit(True).alias("_obs")).distinct(), ["symbol", "date"], "left")
    )
    kind = (
        F.when(F.col("_cal").isNull(), "provider_non_market_zero_volume_artifact")
        .when(F.col("_off").isNull(), "security_no_trade_or_suspended")
        .when(F.coalesce(F.col("official_volume"), F.lit(0.0)) <= 0, "official_zero_volume")
        .when(F.col("_obs").isNotNull(), "replaced_with_official_positive_volume_row")
        .otherwise("unresolved_official_positive_volume_row")
    )
    return rows.select(
        "symbol",
        "date",
        kind.alias("classification"),
        (kind != "unresolved_official_positive_volume_row").alias("resolved"),
        "official_volume",
    )


def override_insert(panel: DataFrame, overrides: DataFrame, anchors: DataFrame) -> DataFrame:
    """Overrides whose day is absent and whose anchors all confirm the stated factor.

    ``overrides(symbol, date, open..volume, adjustment_factor)``;
    ``anchors(symbol, date, anchor_date, raw_close)``.
    """
    close = panel.select("symbol", F.col("date").alias("anchor_date"), "close")
    checked = (
        anchors.join(overrides.select("symbol", "date", "adjustment_factor"), ["symbol", "date"])
        .join(close, ["symbol", "anchor_date"], "left")
        .groupBy("symbol", "date")
        .agg(
            F.bool_and(
                F.coalesce(
                    F.abs(F.try_divide(F.col("close"), F.col("raw_close")) - F.col("adjustment_factor"))
                    <= K.FACTOR_TOLERANCE,
                    F.lit(False),
                )
            ).alias("_ok")
        )
    )
    absent = overrides.join(panel.select("symbol", "date"), ["symbol", "date"], "left_anti")
    good = absent.join(checked.where("_ok").select("symbol", "date"), ["symbol", "date"])
    f = F.col("adjustment_factor")
    return good.select("symbol", "date", *[(F.col(c) * f).alias(c) for c in PRICES], "volume")


def reference_exemption(missing: DataFrame, exempt: DataFrame, evidence: DataFrame) -> DataFrame:
    """Missing days left after exemptions, which count only if all are evidenced.

    Inputs are ``(symbol, date)``; a symbol's day lists are bounded by the calendar.
    """

    def days(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("symbol").agg(F.array_sort(F.collect_set("date")).alias(name))

    none = F.array().cast("array<date>")
    out = days(missing, "m").join(days(exempt, "x"), "symbol", "left").join(days(evidence, "e"), "symbol", "left")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("x", "e")})
    valid = F.size(F.array_except("x", "e")) == 0
    left = F.when(valid, F.array_except("m", "x")).otherwise(F.col("m"))
    return out.select(
        "symbol",
        valid.alias("exemption_valid"),
        F.size("m").alias("missing_days"),
        F.size(left).alias("unexplained_days"),
        F.when(~valid, "exemption_not_evidenced").when(F.size(left) > 0, "missing_reference_dates").alias("reason"),
    )


def explained_days(explained: DataFrame, benchmark_only: DataFrame, start: str, end: str) -> DataFrame:
    """Explained days joined with benchmark-only days of the range, without repeats."""
    inside = benchmark_only.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return explained.select("date").unionByName(inside.select("date")).distinct()


def symbol_code(c: Column) -> Column:
    """Exchange code without its market suffix."""
    return F.substring_index(c, ".", 1)
