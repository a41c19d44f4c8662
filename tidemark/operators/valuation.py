"""Forward EPS and PE scenarios: effective rows, matrix, growth, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.numbers import exact, half_up, out_of_range
from tidemark.operators.asof import approval_eligible, revision_with_approval


def effective_at(cutoff: str) -> Column:
    """Half-open validity; an open side never excludes."""
    c = F.lit(cutoff).cast("timestamp")
    start, end = F.col("effective_from"), F.col("effective_to")
    return (start.isNull() | (start <= c)) & (end.isNull() | (end > c))


def pe_effective(ledger: DataFrame, approvals: DataFrame, cutoff: str, rule_id: str = "VAL-04") -> DataFrame:
    """PE scenarios in force at a cutoff, as ``pe_id``, label, scope, scope_value, pe_value and validity.

    The newest visible revision of a scenario counts, if its newest visible
    approval event approves it under the rule and it is valid at the cutoff; a
    revoked or unapproved newest revision never falls back to an older one.
    """
    newest_rows = revision_with_approval(ledger, approvals, cutoff)
    good = newest_rows.where(approval_eligible(rule_id) & effective_at(cutoff))
    return good.select(F.col("id").alias("pe_id"), "label", "scope", "scope_value", "pe_value", "effective_from", "effective_to")


def scope_dispatch(symbols: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Scenarios per symbol by symbol, industry or market, with the scope's rank.

    Three equi-joins instead of one join on a disjunction.
    """
    parts = []
    for rank, (scope, column) in enumerate((("symbol", "symbol"), ("industry", "industry"), ("market", "market")), 1):
        side = scenarios.where(F.col("scope") == scope).withColumnRenamed("scope_value", column)
        wanted = symbols.select("symbol", *([column] if column != "symbol" else []))
        parts.append(
            wanted.join(side, column)
            .select("symbol", *[c for c in scenarios.columns if c != "scope_value"])
            .withColumn("scope_rank", F.lit(rank))
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def eps_pe_matrix(eps: DataFrame, pe: DataFrame) -> DataFrame:
    """Approved EPS (low, base, high) times every symbol PE; non-positive EPS is not applicable.

    A cell is ``available`` only with a price: a missing multiple is
    ``insufficient_data``, a product beyond exact decimals ``value_out_of_range``.
    """
    long = eps.select(
        "symbol",
        "id",
        "fiscal_year",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(k).alias("eps_scenario"), F.col(f"eps_{k}").alias("eps_value"))
                    for k in ("low", "base", "high")
                ]
            )
        ).alias("e"),
    ).select("symbol", "id", "fiscal_year", "e.*").where(F.col("eps_value").isNotNull())
    cells = long.join(pe.select("symbol", "pe_id", "label", "pe_value"), "symbol")
    ok = F.col("eps_value") > 0
    price = half_up(F.try_multiply(exact("eps_value"), exact("pe_value", 4)), 4)
    status = (
        F.when(~F.coalesce(ok, F.lit(False)), "not_applicable")
        .when(F.col("pe_value").isNull(), "insufficient_data")
        .when(out_of_range(price, "eps_value", "pe_value"), "value_out_of_range")
        .otherwise("available")
    )
    return cells.select(*cells.columns, status.alias("status"), F.when(ok, price).alias("target_price"))


def eps_pe_status(states: DataFrame, pe: DataFrame, rule_id: str = "VAL-02") -> DataFrame:
    """One status per symbol, first failing reason first."""
    ok = approval_eligible(rule_id) & (F.col("status") == "active")
    revoked = (F.col("status") == "revoked") | F.col("decision").eqNullSafe("revoked")
    g = states.groupBy("symbol").agg(
        F.count_if(ok).alias("approved"),
        F.bool_and(revoked).alias("all_revoked"),
        F.max(F.when(ok, F.greatest("eps_low", "eps_base", "eps_high"))).alias("best_eps"),
    )
    have_pe = pe.groupBy("symbol").agg(F.count(F.lit(1)).alias("pe_rows"))
    out = g.join(have_pe, "symbol", "left")
    reason = (
        F.when((F.col("approved") == 0) & F.col("all_revoked"), "forward_eps_approval_revoked")
        .when(F.col("approved") == 0, "approved_forward_eps_required")
        .when(F.col("pe_rows").isNull(), "approved_symbol_pe_missing_at_knowledge_cutoff")
        .when(F.col("best_eps") <= 0, "forward_eps_is_zero_or_negative")
    )
    status = (
        F.when(reason == "forward_eps_approval_revoked", "insufficient_data")
        .when(reason == "forward_eps_is_zero_or_negative", "not_applicable")
        .when(reason.isNotNull(), "needs_human_input")
        .otherwise("available")
    )
    return out.select("symbol", "approved", status.alias("status"), reason.alias("reason"))


def eps_growth(observations: DataFrame, keys: tuple[str, ...] = ("symbol", "source_name")) -> DataFrame:
    """Growth over the last two fiscal years of a source.

    Rows are first reduced to one per key and year, so the window below only
    sees years, whatever the number of observations.
    """
    years = observations.groupBy(*keys, "fiscal_year").agg(
        F.count(F.lit(1)).alias("n"), F.max("eps_base").alias("eps_base")
    )
    w = Window.partitionBy(*keys).orderBy(F.col("fiscal_year").desc())
    last = years.select(
        *keys,
        F.row_number().over(w).alias("rn"),
        F.col("fiscal_year").alias("later_fiscal_year"),
        F.col("n").alias("later_n"),
        F.col("eps_base").alias("later_eps_base"),
        F.lead("fiscal_year").over(w).alias("earlier_fiscal_year"),
        F.lead("n").over(w).alias("earlier_n"),
        F.lead("eps_base").over(w).alias("earlier_eps_base"),
    ).where("rn = 1")
    reason = (
        F.when(F.col("earlier_fiscal_year").isNull(), "forward_eps_growth_requires_two_years")
        .when((F.col("later_n") != 1) | (F.col("earlier_n") != 1), "forward_eps_source_selection_ambiguous")
        .when(
            F.col("later_fiscal_year") != F.col("earlier_fiscal_year") + 1,
            "forward_eps_growth_requires_consecutive_years",
        )
        .when(
            F.coalesce(F.col("earlier_eps_base") <= 0, F.lit(True)) | F.col("later_eps_base").isNull(),
            "non_comparable_forward_eps",
        )
    )
    growth = F.when(
        reason.isNull(),
        (F.col("later_eps_base") - F.col("earlier_eps_base")) / F.col("earlier_eps_base"),
    )
    shown = ~F.coalesce(reason.isin("forward_eps_growth_requires_two_years"), F.lit(False))
    return last.select(
        *keys,
        F.when(reason.isNull(), "available").otherwise("insufficient_data").alias("status"),
        reason.alias("reason"),
        F.when(shown, F.col("earlier_fiscal_year")).alias("earlier_fiscal_year"),
        F.when(shown, F.col("later_fiscal_year")).alias("later_fiscal_year"),
        growth.alias("growth_ratio"),
        F.coalesce(growth >= 0, F.lit(False)).alias("passed"),
    )


def eps_dual_track(institutional: Column, ttm: Column, growth: float = K.DEFAULT_EPS_GROWTH) -> Column:
    """Institutional estimate if positive, else grown trailing EPS, else zero."""
    return F.coalesce(F.when(institutional > 0, institutional), F.when(ttm > 0, ttm * (1.0 + growth)), F.lit(0.0))


def pe_bands(df: DataFrame, pe: tuple[float, float, float] = (K.PE_MIN, K.PE_MID, K.PE_MAX)) -> DataFrame:
    """Cheap, fair and expensive price from EPS; the multiples must be positive and ordered.

    EPS beyond exact decimals has status ``value_out_of_range`` and no prices.
    """
    low, mid, high = pe
    if not 0 < low <= mid <= high:
        raise ValueError("multiples must be positive and ordered")
    ok = F.col("eps") > 0
    prices = zip(("cheap_price", "fair_price", "expensive_price"), pe)
    status = F.when(ok & out_of_range(exact("eps"), "eps"), "value_out_of_range").when(ok, "available").otherwise("not_applicable")
    return df.select(
        *df.columns,
        status.alias("status"),
        *[F.when(ok, half_up(exact("eps") * exact(F.lit(m), 4, 11), 2)).alias(name) for name, m in prices],
    )


def eva_floor(df: DataFrame, wacc: float = K.DEFAULT_WACC) -> DataFrame:
    """Floor price from economic value added; needs positive cost of capital and shares.

    Exact in whole units of the last digit: amounts and shares with four
    decimals (operating profit with eight), rates with six.  Missing amounts
    are ``insufficient_data``, results beyond that range ``value_out_of_range``.
    """
    rate = F.coalesce(F.col("wacc"), F.lit(wacc)) if "wacc" in df.columns else F.lit(wacc)
    ok = F.coalesce((rate > 0) & (F.col("shares") > 0), F.lit(False))
    charge = F.try_multiply(exact("invested_capital", 4, 16), exact(rate, 6, 5))
    eva = F.round(F.try_subtract(exact("nopat", 8, 16), charge), 2)

    def units(c: Column, digits: int) -> Column:
        """A decimal as a whole number of its last digit."""
        return F.try_multiply(c, F.lit(10**digits).cast("decimal(9,0)")).try_cast("decimal(38,0)")

    # (capital + eva / rate) / shares in hundredths, as one fraction of whole numbers.
    capital, gain, cost, count = units(exact("invested_capital", 4, 16), 4), units(eva, 2), units(exact(rate, 6, 5), 6), units(exact("shares", 4, 14), 4)
    hundred, even = F.lit(100).cast("decimal(3,0)"), F.lit(10**8).cast("decimal(9,0)")
    above = F.try_multiply(hundred, F.try_add(F.try_multiply(capital, cost), F.try_multiply(gain, even)).try_cast("decimal(36,0)")).try_cast("decimal(38,0)")
    below = F.try_multiply(cost, count).try_cast("decimal(37,0)")
    double = F.lit(2).cast("decimal(1,0)")
    twice = F.try_add(F.try_multiply(F.abs(above), double).try_cast("decimal(38,0)"), below).try_cast("decimal(38,0)")
    half = F.try_divide(twice, F.try_multiply(below, double).try_cast("decimal(38,0)"))
    price = (F.floor(half) * F.signum(above.cast("double")).cast("int")).cast("double") / 100.0
    status = (
        F.when(~ok, "not_applicable")
        .when(F.col("nopat").isNull() | F.col("invested_capital").isNull(), "insufficient_data")
        .when(price.isNull(), "value_out_of_range")
        .otherwise("available")
    )
    return df.select(*df.columns, status.alias("status"), F.when(ok, eva.cast("double")).alias("eva"), F.when(ok, price).alias("eva_floor_price"))


def fixed_threshold_screen(df: DataFrame, pe_average: Column | float = 15.0) -> DataFrame:
    """Low PE, low PB and high yield against fixed bounds, with the single flags."""
    avg = F.lit(pe_average) if isinstance(pe_average, float) else pe_average
    flags = {
        "pe_below_avg": F.col("pe") < avg,
        "pb_below_max": F.col("pb") < K.PB_MAX,
        "yield_above_min": F.col("dividend_yield_ratio") >= K.YIELD_MIN,
    }
    out = df.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    return out.withColumn("passed", F.col("pe_below_avg") & F.col("pb_below_max") & F.col("yield_above_min"))


def revision_chain_check(ledger: DataFrame, identity: tuple[str, ...], approvals: DataFrame | None = None) -> DataFrame:
    """Defects of revision chains, one row per defective revision.

    Each revision is joined to the parent it names; keys are single revisions,
    so a long chain spreads over the cluster instead of being sorted in one task.
    """
    parent = ledger.select(
        F.col("id").alias("revision_of"),
        F.col("logical_id").alias("_p_logical"),
        F.col("revision_number").alias("_p_number"),
        F.struct(*identity).alias("_p_identity"),
    )
    out = ledger.join(parent, "revision_of", "left")
    first = F.col("revision_number") == 1
    checks = [
        F.when(first & F.col("revision_of").isNotNull(), "first_revision_has_parent"),
        F.when(~first & F.col("revision_of").isNull(), "parent_missing"),
        F.when(F.col("revision_of").isNotNull() & F.col("_p_logical").isNull(), "parent_unknown"),
        F.when(F.col("_p_logical") != F.col("logical_id"), "parent_of_other_series"),
        F.when(F.col("_p_number") + 1 != F.col("revision_number"), "revision_number_not_consecutive"),
        F.when(
            F.col("_p_logical").isNotNull() & (F.struct(*identity) != F.col("_p_identity")), "identity_changed"
        ),
    ]
    if approvals is not None:
        earliest = approvals.groupBy(F.col("resource_id").alias("id")).agg(F.min("available_at").alias("_first_approval"))
        out = out.join(earliest, "id", "left")
        checks.append(F.when(F.col("_first_approval") < F.col("ingested_at"), "approval_back_dated"))
    return (
        out.withColumn("reasons", F.array_compact(F.array(*checks)))
        .where(F.size("reasons") > 0)
        .select("id", "logical_id", "revision_number", "reasons")
    )
