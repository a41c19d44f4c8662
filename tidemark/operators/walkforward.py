"""Walk-forward study: windows, signals, closed-form models, aggregates and gates.

A symbol's bars are bounded by the number of trading days, and every pass below
is keyed by symbol (and window, and candidate), so symbols, windows and
candidates run side by side.  Positions and equity come from running windows
over bars; nothing is replayed order by order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions.normalize import cost_model
from tidemark.functions.numbers import half_up
from tidemark.operators.indicators import by_symbol, falsy, rolling_means, with_resonance


def indexed(bars: DataFrame) -> DataFrame:
    """Bars with their zero-based position within the symbol."""
    return bars.withColumn("idx", F.row_number().over(by_symbol()) - 1)


def windowed_bars(
    bars: DataFrame,
    months: int = K.WALK_MONTHS,
    warmup: int = K.WALK_WARMUP,
    min_bars: int = K.WALK_MIN_BARS,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Bars of validation windows, with window number and context start.

    Windows step from the first bar that has a full warm-up; each start is the
    previous one plus the step, month ends clamped.  Windows with too few bars
    are dropped and the rest numbered without gaps.
    """
    w = by_symbol()
    whole = Window.partitionBy("symbol")
    rows = bars.withColumns({"idx": F.row_number().over(w) - 1, "_context": F.lag("date", warmup).over(w)})
    ready = F.col("idx") >= warmup
    if start:
        ready = ready & (F.col("date") >= F.lit(start).cast("date"))
    rows = rows.withColumns(
        {
            "_first": F.min(F.when(ready, F.col("date"))).over(whole),
            "_last": F.lit(end).cast("date") if end else F.max("date").over(whole),
        }
    ).where((F.col("date") >= F.col("_first")) & (F.col("date") <= F.col("_last")))
    # Only the steps up to the bar's own date matter: fold the step that often.
    upper = (F.months_between("date", "_first") / months).cast("int") + 1
    starts = F.aggregate(
        F.sequence(F.lit(1), upper),
        F.array("_first"),
        lambda acc, _: F.concat(acc, F.array(F.add_months(F.element_at(acc, -1), months))),
    )
    step = F.size(F.filter(starts, lambda s: s <= F.col("date"))) - 1
    rows = rows.withColumn("_step", step)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol", "_step")))
    rows = rows.where(F.col("_n") >= min_bars)
    number = F.dense_rank().over(Window.partitionBy("symbol").orderBy("_step"))
    return rows.withColumn("window_no", number).withColumnRenamed("_context", "context_start").drop(
        "_first", "_last", "_step", "_n"
    )


def walk_forward_windows(rows: DataFrame, warmup: int = K.WALK_WARMUP) -> DataFrame:
    """One row per validation window from ``windowed_bars``."""
    g = rows.groupBy("symbol", "window_no").agg(
        F.min("idx").alias("first_idx"),
        F.max("idx").alias("last_idx"),
        F.min_by("context_start", "idx").alias("context_start"),
        F.min("date").alias("validation_start"),
        F.max("date").alias("validation_end"),
        F.count(F.lit(1)).alias("validation_bars"),
        F.min("close").alias("minimum_close"),
    )
    return g.withColumns({"context_start_idx": F.col("first_idx") - warmup, "warmup_bars": F.lit(warmup)})


def training_slices(
    windows: DataFrame,
    lookback: int = K.TRAIN_BARS,
    warmup: int = K.TRAIN_WARMUP,
    minimum: int = K.TRAIN_MIN_BARS,
) -> DataFrame:
    """Bars before each validation window that may be used for training."""
    end = F.col("first_idx") - 1
    begin = F.greatest(F.lit(0), end - lookback + 1)
    out = windows.select(
        "symbol",
        "window_no",
        begin.alias("train_start_idx"),
        end.alias("train_end_idx"),
        F.greatest(F.lit(0), begin - warmup).alias("context_start_idx"),
        (end - begin + 1).alias("training_bars"),
    )
    return out.where((F.col("train_end_idx") >= 0) & (F.col("training_bars") >= minimum))


def slice_bars(bars_idx: DataFrame, slices: DataFrame) -> DataFrame:
    """Bars of each slice; as many rows come out as the slices hold.

    A symbol's slices are one array sorted by their starts, and both starts and
    ends rise with the window.  The slices of a bar are then one stretch of the
    array: from the first whose end is not before the bar to the last whose
    start is not behind it, both found by binary search.
    """
    s = F.struct("train_start_idx", "train_end_idx", "window_no")
    lists = slices.groupBy("symbol").agg(F.array_sort(F.collect_list(s)).alias("_s"))
    held = bars_idx.join(lists, "symbol")

    def position(field: str, inclusive: bool) -> Column:
        """Number of slices whose start (or end) is below the bar's index, or equal with ``inclusive``."""
        size = F.size("_s")

        def step(at: Column, k: Column) -> Column:
            # Adds 2**k to the count where the slice at that place is still below.
            width = F.pow(F.lit(2), k).cast("int")
            probe = F.get("_s", at + width - 1)[field]
            below = (probe <= F.col("idx")) if inclusive else (probe < F.col("idx"))
            return F.when((at + width <= size) & F.coalesce(below, F.lit(False)), at + width).otherwise(at)

        # The largest step is the largest power of two within the list.
        return F.aggregate(F.sequence(F.floor(F.log2(size)).cast("int"), F.lit(0), F.lit(-1)), F.lit(0), step)

    found = held.withColumns({"_to": position("train_start_idx", True), "_from": position("train_end_idx", False)}).where("_from < _to")
    out = found.withColumn("_hit", F.explode(F.slice("_s", F.col("_from") + 1, F.col("_to") - F.col("_from"))))
    return out.select(*bars_idx.columns, F.col("_hit.window_no").alias("window_no"), F.col("_hit.train_start_idx").alias("train_start_idx"), F.col("_hit.train_end_idx").alias("train_end_idx"))


def capital_feasibility(windows: DataFrame, cash: float) -> DataFrame:
    """Cash needed for the first stage of a board lot at the window's lowest close."""
    cost = cost_model(F.col("symbol"))
    commission = F.lit(f"{1.0 + K.COMMISSION_RATE:.6f}").cast("decimal(9,6)")
    lots = F.col("minimum_close").cast("decimal(14,2)") * cost["lot_size"].cast("decimal(6,0)") * commission
    need = lots / F.lit(f"{K.STAGE_ONE_SHARE:.2f}").cast("decimal(3,2)")
    return windows.select(
        "symbol",
        "window_no",
        "minimum_close",
        F.round(need, 2).cast("double").alias("stage1_minimum_cash"),
        (need <= cash).alias("stage1_feasible"),
    )


def crossover_signals(bars: DataFrame, candidates: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Add one short list per bar: each candidate's position, set by the previous bar's means.

    Kept as a list until the bars that matter are chosen; see ``each_candidate``.
    """
    w = by_symbol()
    lengths = sorted({n for _, a, b in candidates for n in (a, b)})
    means = rolling_means(bars, "close", {f"_m{n}": n for n in lengths}, w)
    signals = means.withColumns(
        {f"_s{i}": falsy(F.lag(F.col(f"_m{a}") > F.col(f"_m{b}")).over(w)).cast("int") for i, (_, a, b) in enumerate(candidates)}
    )
    options = F.array(
        *[F.struct(F.lit(name).alias("candidate_id"), F.col(f"_s{i}").alias("pos")) for i, (name, _, _) in enumerate(candidates)]
    )
    return signals.select(*bars.columns, options.alias("candidates"))


def each_candidate(rows: DataFrame) -> DataFrame:
    """One row per bar and candidate."""
    rest = [c for c in rows.columns if c != "candidates"]
    return rows.select(*rest, F.explode("candidates").alias("_o")).select(*rest, "_o.*")


def position_equity(rows: DataFrame, keys: Sequence[str], tags: Sequence[str] = ("",)) -> DataFrame:
    """Equity of a fully invested position, after costs, starting at one.

    Runs of held bars are numbered by their entries; a run is bought at the open
    of its first bar and sold at the open after its last, or at the final close.
    Several positions on the same bars lie side by side: for each of ``tags``
    the columns pos, segment, equity and trade_factor end with it.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    cost = cost_model(F.col("symbol"))
    buy = F.col("open") * (1.0 + K.SLIPPAGE_RATE) * (1.0 + K.COMMISSION_RATE)
    keep = (1.0 - K.SLIPPAGE_RATE) * (1.0 - K.COMMISSION_RATE - cost["sales_tax_rate"])
    first, second, third, equity = {"_final": F.lead("date").over(w).isNull()}, {}, {}, {}
    for t in tags:
        pos, paid, closed = F.col(f"pos{t}"), F.col(f"_paid{t}"), F.col(f"_closed{t}")
        before = F.coalesce(F.lag(pos).over(w), F.lit(0))
        first |= {f"_enter{t}": (pos == 1) & (before == 0), f"_exit{t}": (pos == 0) & (before == 1)}
        entered = F.col(f"_enter{t}")
        second |= {f"segment{t}": F.sum(entered.cast("int")).over(run), f"_paid{t}": F.last(F.when(entered, buy), ignorenulls=True).over(run)}
        third[f"_closed{t}"] = F.when(F.col(f"_exit{t}"), F.col("open") * keep / paid)
        banked = F.coalesce(F.product(closed).over(run), F.lit(1.0))
        mark = F.when(F.col("_final"), F.col("close") * keep).otherwise(F.col("close")) / paid
        equity[f"equity{t}"] = banked * F.when(pos == 1, mark).otherwise(1.0)
        equity[f"trade_factor{t}"] = F.coalesce(closed, F.when(F.col("_final") & (pos == 1), mark))
    out = rows.withColumns(first).withColumns(second).withColumns(third).withColumns(equity)
    return out.drop("_final", *[f"{c}{t}" for c in ("_enter", "_exit", "_paid", "_closed") for t in tags])


def side_by_side(rows: DataFrame, count: int) -> tuple[DataFrame, list[str]]:
    """The positions of ``count`` candidates as columns of the bar, and the ends of their names."""
    tags = [f"_{i}" for i in range(count)]
    return rows.withColumns({f"pos{t}": F.col("candidates")[i]["pos"] for i, t in enumerate(tags)}).drop("candidates"), tags


def by_candidate(rows: DataFrame, keys: Sequence[str], names: Sequence[str], tags: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per row and candidate: ``keys``, candidate_id and ``columns`` without the ends of their names."""
    options = [F.struct(F.lit(n).alias("candidate_id"), *[F.col(f"{c}{t}").alias(c) for c in columns]) for n, t in zip(names, tags, strict=True)]
    return rows.select(*keys, F.explode(F.array(*options)).alias("_o")).select(*keys, "_o.*")


def crossover_trades(equity: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per held run: entry, exit and return."""
    held = equity.where("segment > 0").groupBy(*keys, "segment").agg(
        F.min("date").alias("entry_date"),
        F.max(F.when(F.col("trade_factor").isNotNull(), F.col("date"))).alias("exit_date"),
        F.count_if(F.col("pos") == 1).alias("bars_held"),
        F.max("trade_factor").alias("factor"),
    )
    return held.select(*keys, "segment", "entry_date", "exit_date", "bars_held", (F.col("factor") - 1.0).alias("trade_return"))


def buy_and_hold_equity(rows: DataFrame, cash: float, keys: Sequence[str] = ("symbol", "window_no")) -> DataFrame:
    """Whole lots bought at the first open, marked to close, sold at the last close."""
    w = Window.partitionBy(*keys).orderBy("date")
    cost = cost_model(F.col("symbol"))
    price = F.first("open").over(w) * (1.0 + K.SLIPPAGE_RATE)
    rows = rows.withColumns({"_price": price, "_final": F.lead("date").over(w).isNull()})
    lots = F.floor(F.lit(cash) / (F.col("_price") * (1.0 + K.COMMISSION_RATE) * cost["lot_size"]))
    rows = rows.withColumn("shares", lots * cost["lot_size"])
    spent = F.col("shares") * F.col("_price") * (1.0 + K.COMMISSION_RATE)
    keep = (1.0 - K.SLIPPAGE_RATE) * (1.0 - K.COMMISSION_RATE - cost["sales_tax_rate"])
    value = F.col("shares") * F.when(F.col("_final"), F.col("close") * keep).otherwise(F.col("close"))
    final = (F.lit(cash) - spent + value) / cash
    return rows.where("shares > 0").withColumns(
        {
            "equity": final,
            "pos": F.lit(1),
            "trade_factor": F.when(F.col("_final"), final),
        }
    ).drop("_price", "_final")


def buy_and_hold_status(asked: DataFrame, windows: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metrics of every window of the asked symbols, with a status.

    Windows whose first price passes the cash for one lot have no figures;
    symbols without a window have one row without a number.
    """
    metrics = metrics.withColumn("_traded", F.lit(True))
    rows = windows.select("symbol", "window_no").join(metrics, ["symbol", "window_no"], "left")
    rows = asked.select("symbol").distinct().join(rows, "symbol", "left")
    status = F.when(F.col("window_no").isNull(), "insufficient_data").when(F.col("_traded"), "available").otherwise("cash_below_one_lot")
    return rows.withColumn("status", status).drop("_traded")


_CURVE = ("final", "dd", "mean", "sd", "n_ret", "total_trades", "won", "held", "observation_days")


def _curve_facts(equity: DataFrame, keys: Sequence[str], tags: Sequence[str]) -> DataFrame:
    """What a curve's figures follow from, per key and tag; all curves of a key in one pass."""
    w = Window.partitionBy(*keys).orderBy("date")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    steps, facts = {}, []
    for t in tags:
        value = F.col(f"equity{t}")
        steps |= {f"_dd{t}": value / F.max(value).over(run) - 1.0, f"_ret{t}": F.try_divide(value, F.lag(value).over(w)) - 1.0}
        facts += [
            F.max_by(value, "date").alias(f"final{t}"),
            F.min(f"_dd{t}").alias(f"dd{t}"),
            F.avg(f"_ret{t}").alias(f"mean{t}"),
            F.stddev_samp(f"_ret{t}").alias(f"sd{t}"),
            F.count(f"_ret{t}").alias(f"n_ret{t}"),
            F.count(f"trade_factor{t}").alias(f"total_trades{t}"),
            F.count_if(F.col(f"trade_factor{t}") > 1.0).alias(f"won{t}"),
            F.sum(f"pos{t}").alias(f"held{t}"),
            F.count(F.lit(1)).alias(f"observation_days{t}"),
        ]
    return equity.withColumns(steps).groupBy(*keys).agg(*facts)


def _curve_figures(facts: DataFrame, keys: Sequence[str], flat_below: float) -> DataFrame:
    sharpe = F.when((F.col("n_ret") >= 2) & (F.col("sd") > flat_below), F.col("mean") / F.col("sd") * (K.TRADING_DAYS_PER_YEAR**0.5))
    return facts.select(
        *keys,
        half_up((F.col("final") - 1.0) * 100.0, 4).alias("total_return_pct"),
        half_up(F.abs("dd") * 100.0, 4).alias("max_drawdown_pct"),
        half_up(sharpe, 4).alias("sharpe_ratio"),
        "total_trades",
        half_up(F.coalesce(F.try_divide(F.col("won") * 100.0, F.col("total_trades")), F.lit(0.0)), 2).alias("win_rate_pct"),
        half_up(F.col("held") * 100.0 / F.col("observation_days"), 2).alias("exposure_pct"),
        "observation_days",
    )


def risk_metrics(equity: DataFrame, keys: Sequence[str], flat_below: float = 1e-12) -> DataFrame:
    """Return, drawdown, Sharpe, trades, win rate and exposure per key.

    A curve whose daily returns deviate by ``flat_below`` at most is flat and
    has no Sharpe ratio; the default covers rounding noise, 0 tests exactly.
    """
    return _curve_figures(_curve_facts(equity, keys, ("",)), keys, flat_below)


def candidate_metrics(rows: DataFrame, keys: Sequence[str], names: Sequence[str], flat_below: float = 1e-12) -> DataFrame:
    """``risk_metrics`` per key and candidate of bars with a list of ``candidates``.

    A bar is shuffled, sorted and buffered once, whatever the number of
    candidates; there is a row per candidate only when the curves are summed up.
    """
    wide, tags = side_by_side(rows.select(*keys, "date", "open", "close", "candidates"), len(names))
    facts = _curve_facts(position_equity(wide, keys, tags), keys, tags)
    return _curve_figures(by_candidate(facts, keys, names, tags, _CURVE), [*keys, "candidate_id"], flat_below)


def benchmark_spine(benchmark: DataFrame, *days: DataFrame) -> DataFrame:
    """For every needed day: nearest benchmark close on either side and its position.

    One row per calendar day, so the ordered windows over it stay small.
    """
    b = benchmark.select("date", F.col("close").alias("_c"))
    spine = b
    for x in days:
        spine = spine.unionByName(x.select("date").distinct().withColumn("_c", F.lit(None).cast("double")))
    spine = spine.groupBy("date").agg(F.max("_c").alias("_c"))
    up = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(F.lit(0)).orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.count("_c").over(up)
    return spine.select(
        "date",
        F.last("_c", ignorenulls=True).over(up).alias("close_at_or_before"),
        F.last("_c", ignorenulls=True).over(down).alias("close_at_or_after"),
        rank.alias("rank_upto"),
        (rank - F.col("_c").isNotNull().cast("int")).alias("rank_before"),
    )


def market_regime(windows: DataFrame, benchmark: DataFrame, threshold: float = K.REGIME_THRESHOLD) -> DataFrame:
    """Bull, bear or sideways by the benchmark's return over each window."""
    starts = windows.select(F.col("validation_start").alias("date"))
    ends = windows.select(F.col("validation_end").alias("date"))
    spine = benchmark_spine(benchmark, starts, ends)
    a = spine.select(
        F.col("date").alias("validation_start"), F.col("close_at_or_after").alias("_open"), F.col("rank_before").alias("_ra")
    )
    z = spine.select(
        F.col("date").alias("validation_end"), F.col("close_at_or_before").alias("_close"), F.col("rank_upto").alias("_rz")
    )
    out = windows.join(a, "validation_start").join(z, "validation_end")
    rows = F.col("_rz") - F.col("_ra")
    ret = F.when(rows >= 2, F.try_divide(F.col("_close"), F.col("_open")) - 1.0)
    label = (
        F.when(ret.isNull(), "unknown").when(ret >= threshold, "bull").when(ret <= -threshold, "bear").otherwise("sideways")
    )
    return out.select(
        "symbol",
        "window_no",
        rows.alias("benchmark_rows"),
        half_up(ret * 100.0, 4).alias("benchmark_return_pct"),
        label.alias("regime"),
    )


def _aggregate_columns() -> list[Column]:
    weighted = F.sum(F.col("exposure_pct") * F.col("observation_days"))
    won = F.sum(F.round(F.col("total_trades") * F.col("win_rate_pct") / 100.0).cast("bigint"))
    trades = F.sum("total_trades")
    return [
        F.count("total_return_pct").alias("window_count"),
        F.count(F.lit(1)).alias("requested_window_count"),
        half_up((F.product(1.0 + F.col("total_return_pct") / 100.0) - 1.0) * 100.0, 4).alias("compounded_return_pct"),
        F.max("max_drawdown_pct").alias("worst_window_drawdown_pct"),
        half_up(F.avg("sharpe_ratio"), 4).alias("average_window_sharpe"),
        trades.alias("total_trades"),
        half_up(F.coalesce(F.try_divide(won * 100.0, trades), F.lit(0.0)), 2).alias("win_rate_pct"),
        half_up(F.try_divide(weighted, F.sum("observation_days")), 2).alias("exposure_pct"),
        F.sum("observation_days").alias("observation_days"),
    ]


def _aggregate_status(g: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("window_count") == 0, "insufficient_data")
        .when(F.col("window_count") == F.col("requested_window_count"), "available")
        .otherwise("partial")
    )
    return g.withColumn("status", status)


def window_aggregate(results: DataFrame, keys: Sequence[str] = ("symbol", "model")) -> DataFrame:
    """Compounded figures over a symbol's windows; windows without a result make it partial."""
    return _aggregate_status(results.groupBy(*keys).agg(*_aggregate_columns()))


def regime_aggregate(results: DataFrame, regimes: DataFrame) -> DataFrame:
    """Overall and per-regime figures in one pass over grouping sets (overall = 'all')."""
    rows = results.join(regimes.select("symbol", "window_no", "regime"), ["symbol", "window_no"])
    both = rows.groupingSets(
        [[F.col("symbol"), F.col("model")], [F.col("symbol"), F.col("model"), F.col("regime")]],
        F.col("symbol"),
        F.col("model"),
        F.col("regime"),
    ).agg(*_aggregate_columns())
    return _aggregate_status(both.withColumn("regime", F.coalesce("regime", F.lit("all"))))


def excess_returns(aggregates: DataFrame, model: str, others: Sequence[str]) -> DataFrame:
    """Difference of compounded returns, only where every model is available."""
    names = [model, *others]
    pick = {
        m: F.max(F.when((F.col("model") == m) & (F.col("status") == "available"), F.col("compounded_return_pct")))
        for m in names
    }
    g = aggregates.groupBy("symbol").agg(*[c.alias(m) for m, c in pick.items()])
    complete = F.lit(True)
    for m in names:
        complete = complete & F.col(m).isNotNull()
    return g.select(
        "symbol",
        *[F.when(complete, half_up(F.col(model) - F.col(o), 4)).alias(f"excess_vs_{o}_pct") for o in others],
    )


def sensitivity_summary(results: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Per candidate: mean, median, share of positive windows, worst drawdown, trades.

    With ``asked`` (symbol, candidate_id), pairs without a training window are
    kept with a count of 0 and no figures.
    """
    out = results.groupBy("symbol", "candidate_id").agg(
        F.count(F.lit(1)).alias("training_window_count"),
        half_up(F.avg("total_return_pct"), 4).alias("average_return_pct"),
        half_up(F.median("total_return_pct"), 4).alias("median_return_pct"),
        half_up(F.avg((F.col("total_return_pct") > 0).cast("double")), 4).alias("positive_window_fraction"),
        F.max("max_drawdown_pct").alias("worst_drawdown_pct"),
        F.sum("total_trades").alias("total_trades"),
    )
    if asked is None:
        return out
    pairs = asked.select("symbol", "candidate_id").distinct()
    return pairs.join(out, ["symbol", "candidate_id"], "left").fillna(0, ["training_window_count"])


def sensitivity_spread(summary: DataFrame) -> DataFrame:
    """Range of candidate means per symbol."""
    return summary.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("candidate_count"),
        half_up(F.max("average_return_pct") - F.min("average_return_pct"), 4).alias("average_return_range_pct"),
        half_up(F.avg((F.col("average_return_pct") > 0).cast("double")), 4).alias("positive_candidate_fraction"),
    )


def profile_selection(
    windows: DataFrame,
    results: DataFrame,
    fallback: str,
    max_drawdown: float = K.MAX_TRAIN_DRAWDOWN_PCT,
    min_trades: int = K.MIN_TRAIN_TRADES,
) -> DataFrame:
    """Best eligible candidate per window from its training slice, else the fallback."""
    ok = (
        (F.col("total_return_pct") > 0)
        & (F.col("max_drawdown_pct") <= max_drawdown)
        & (F.col("total_trades") >= min_trades)
    )
    # Of equal ones the least candidate id is taken.
    merit = F.struct((-F.col("total_return_pct")).alias("r"), "max_drawdown_pct", "candidate_id")
    g = results.groupBy("symbol", "window_no").agg(
        F.min(F.when(ok, merit))["candidate_id"].alias("best"), F.count(F.lit(1)).alias("candidates")
    )
    out = windows.select("symbol", "window_no").join(g, ["symbol", "window_no"], "left")
    reason = (
        F.when(F.col("candidates").isNull(), "insufficient_pre_validation_training_data")
        .when(F.col("best").isNull(), "no_profile_passed_training_risk_guardrails")
        .otherwise("highest_positive_training_return_within_risk_guardrails")
    )
    return out.select(
        "symbol",
        "window_no",
        F.when(F.col("best").isNull(), "fallback").otherwise("selected").alias("status"),
        reason.alias("reason"),
        F.coalesce("best", F.lit(fallback)).alias("candidate_id"),
    )


GATE_CHECKS = (
    "data_quality_available",
    "return_improves_legacy",
    "worst_window_mdd_ok",
    "bear_window_present",
    "bear_return_ok",
    "bear_mdd_ok",
)


def research_gate(
    by_regime: DataFrame,
    quality: DataFrame,
    adaptive: str,
    legacy: str,
    max_mdd: float = 12.0,
    min_bear_return: float = -5.0,
    max_bear_mdd: float = 5.0,
) -> DataFrame:
    """Six checks per symbol on the regime aggregates; all must hold."""

    def pick(model: str, regime: str, value: str) -> Column:
        hit = (F.col("model") == model) & (F.col("regime") == regime) & (F.col("status") == "available")
        return F.max(F.when(hit, F.col(value)))

    ret, mdd = "compounded_return_pct", "worst_window_drawdown_pct"
    g = by_regime.groupBy("symbol").agg(
        pick(adaptive, "all", ret).alias("a_ret"),
        pick(adaptive, "all", mdd).alias("a_mdd"),
        pick(legacy, "all", ret).alias("l_ret"),
        pick(adaptive, "bear", ret).alias("b_ret"),
        pick(adaptive, "bear", mdd).alias("b_mdd"),
    )
    out = g.join(quality.select("symbol", F.col("status").alias("_q")), "symbol", "left")
    checks = {
        "data_quality_available": falsy(F.col("_q") == "available"),
        "return_improves_legacy": falsy(F.col("a_ret") > F.col("l_ret")),
        "worst_window_mdd_ok": falsy(F.col("a_mdd") <= max_mdd),
        "bear_window_present": F.col("b_ret").isNotNull(),
        "bear_return_ok": falsy(F.col("b_ret") > min_bear_return),
        "bear_mdd_ok": falsy(F.col("b_mdd") <= max_bear_mdd),
    }
    out = out.withColumns(checks)
    passed = F.forall(F.array(*GATE_CHECKS), lambda x: x)
    return out.select("symbol", *GATE_CHECKS, passed.alias("passed"), F.col("a_mdd").alias("adaptive_mdd_pct"))


def universe_gate(universe: DataFrame, gate: DataFrame) -> DataFrame:
    """Usable and passed symbols per category and over all configured symbols.

    Symbols without an evaluation stay in the denominators (category 'all').
    """
    rows = universe.join(gate, "symbol", "left").withColumns(
        {
            "_usable": falsy(F.col("data_quality_available")),
            "_passed": falsy(F.col("data_quality_available") & F.col("passed")),
        }
    )
    both = rows.groupingSets([[], [F.col("category")]], F.col("category")).agg(
        F.count(F.lit(1)).alias("total_symbols"),
        F.count_if("_usable").alias("usable_symbols"),
        F.count_if("_passed").alias("passed_symbols"),
        F.max(F.when(F.col("_usable"), F.col("adaptive_mdd_pct"))).alias("maximum_mdd_pct"),
    )
    return both.withColumn("category", F.coalesce("category", F.lit("all"))).withColumn(
        "gate_pass_rate", half_up(F.col("passed_symbols") / F.col("total_symbols"), 6)
    )


def universe_decision(
    summary: DataFrame, minimum_usable: int, minimum_rate: float, maximum_mdd: float
) -> DataFrame:
    """Aggregate gate over the configured universe."""
    return summary.where("category = 'all'").select(
        "total_symbols",
        (F.col("usable_symbols") >= minimum_usable).alias("minimum_usable_symbols_met"),
        (F.col("gate_pass_rate") >= minimum_rate).alias("minimum_gate_pass_rate_met"),
        falsy(F.col("maximum_mdd_pct") <= maximum_mdd).alias("maximum_symbol_mdd_met"),
    ).withColumn(
        "status",
        F.when(
            F.col("minimum_usable_symbols_met") & F.col("minimum_gate_pass_rate_met") & F.col("maximum_symbol_mdd_met"),
            "candidate_for_next_phase",
        ).otherwise("hold_for_revision"),
    )


def latch_positions(bars: DataFrame) -> DataFrame:
    """Enter on resonance when flat, leave below SMA55 or on SMA8 < SMA21 when long.

    A bar that satisfies both rules flips the state, since only the rule of the
    current state is tested.  The state is therefore the last one-sided event,
    flipped once per two-sided bar since then.  Fills happen on the next bar.
    """
    w = by_symbol()
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = with_resonance(bars)
    leave = falsy((F.col("close") < F.col("sma_55")) | (F.col("sma_8") < F.col("sma_21")))
    rows = rows.withColumns({"exit_signal": leave, "_flip": F.col("resonance") & leave})
    one_sided = F.when(F.col("resonance") & ~leave, 1).when(leave & ~F.col("resonance"), 0)
    rows = rows.withColumns({"_set": one_sided, "_flips": F.sum(F.col("_flip").cast("int")).over(run)})
    base = F.coalesce(F.last("_set", ignorenulls=True).over(run), F.lit(0))
    since = F.col("_flips") - F.coalesce(
        F.last(F.when(F.col("_set").isNotNull(), F.col("_flips")), ignorenulls=True).over(run), F.lit(0)
    )
    rows = rows.withColumn("_state", (base + since) % 2)
    rows = rows.withColumn("pos", F.coalesce(F.lag("_state").over(w), F.lit(0)))
    return rows.drop("_flip", "_set", "_flips", "_state")


def pullback_tranches(bars: DataFrame, low: float = K.PULLBACK_LOW, high: float = K.PULLBACK_HIGH) -> DataFrame:
    """Second and third stage signals of every held run.

    Stage 2: pulled back into the band from the running high, still above SMA55,
    never beyond the band so far.  Stage 3: a later close above the high frozen
    at stage 2 with rising volume.
    """
    w = by_symbol()
    rows = rolling_means(latch_positions(bars), "volume", {"_v5": 5, "_v20": 20}, w)
    started = (F.col("pos") == 1) & (F.coalesce(F.lag("pos").over(w), F.lit(0)) == 0)
    rows = rows.withColumns(
        {
            "segment": F.sum(started.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).where("pos = 1")
    inside = Window.partitionBy("symbol", "segment")
    run = inside.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_peak", F.max("high").over(run))
    rows = rows.withColumn("_back", (F.col("_peak") - F.col("close")) / F.col("_peak"))
    # The bar that signals the exit ends the run before any stage is tested.
    rows = rows.withColumn("_broken", F.max((~F.col("exit_signal") & (F.col("_back") > high)).cast("int")).over(run))
    second = (
        ~F.col("exit_signal")
        & (F.col("_broken") == 0)
        & F.col("_back").between(low, high)
        & falsy(F.col("close") > F.col("sma_55"))
    )
    rows = rows.withColumn("_s2", F.min(F.when(second, F.col("date"))).over(inside))
    rows = rows.withColumn("_frozen", F.max(F.when(F.col("date") == F.col("_s2"), F.col("_peak"))).over(inside))
    third = (
        ~F.col("exit_signal")
        & (F.col("date") > F.col("_s2"))
        & (F.col("close") > F.col("_frozen"))
        & falsy(F.col("_v5") > F.col("_v20"))
    )
    return rows.groupBy("symbol", "segment").agg(
        F.min("date").alias("stage1_date"),
        F.max("date").alias("last_date"),
        F.max("_s2").alias("stage2_signal"),
        F.max("_frozen").alias("frozen_high"),
        F.min(F.when(third, F.col("date"))).alias("stage3_signal"),
    )
