"""Domain views over the given tables (DataFrame side).

The given tables are TPC-H-like; each view maps them to one of the engine's
inputs by a rule that both engines can compute exactly (integer cents, whole
days), so that every query runs over whole tables and its work grows with them.

Panels are keyed (symbol, date) with symbol = supplier: the number of symbols
grows with the data while the bars of one symbol are bounded by the number of
trading days, because the daily aggregation combines on the map side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "1995-01-01"
CUTOFF = "1999-06-30 00:00:00"
LATER_CUTOFF = "2000-12-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 100).cast("bigint")


def day_number(c: str = "date") -> Column:
    return F.datediff(F.col(c), F.lit(EPOCH).cast("date"))


def whole_ratio(num: str, den: str) -> Column:
    """Nearest whole number of num/den in integer arithmetic, as double.

    Prices are whole cents, so sums of them are exact in any order.
    """
    return F.expr(f"(2 * {num} + {den}) div (2 * {den})").cast("double")


def day_price() -> Column:
    """Line price in cents, folded into a band so that daily returns stay plausible."""
    return cents("l_extendedprice") % 6000 + 45000


def symbol_number(c: str = "symbol") -> Column:
    return F.substring(F.col(c), 2, 20).cast("bigint")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV per supplier; close is the day's volume-weighted price in whole cents."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_linenumber") % 2 == 1).alias("early"),
        day_price().alias("c"),
        F.col("l_quantity").cast("bigint").alias("q"),
    )
    worth = F.col("c") * F.col("q")
    daily = line.groupBy("l_suppkey", "date").agg(
        F.sum(worth).alias("w"),
        F.sum("q").alias("v"),
        F.sum(F.when(F.col("early"), worth)).alias("we"),
        F.sum(F.when(F.col("early"), F.col("q"))).alias("ve"),
        F.max("c").alias("hi"),
        F.min("c").alias("lo"),
    )
    close = whole_ratio("w", "v")
    early = whole_ratio("we", "ve")
    return daily.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        "date",
        F.coalesce(early, close).alias("open"),
        F.col("hi").cast("double").alias("high"),
        F.col("lo").cast("double").alias("low"),
        close.alias("close"),
        F.col("v").cast("double").alias("volume"),
    )


def asked_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol of the dimension, with rows or without."""
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"))


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as a provider would land them: nulls, bad ranges, zero volume, repeats."""
    n, k = day_number(), symbol_number()
    base = bars(spark, sf_dir).withColumn(
        "ingest_order", F.explode(F.when(n % 113 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    )
    return base.select(
        "symbol",
        "date",
        "ingest_order",
        "open",
        F.when((n + k) % 101 == 0, F.col("low") * 0.5).otherwise(F.col("high")).alias("high"),
        "low",
        F.when((n + k) % 89 == 0, F.lit(None).cast("double"))
        .when((n + k) % 103 == 0, F.col("close") * 2.0)
        .when(F.col("ingest_order") == 2, F.col("close") + 1.0)
        .otherwise(F.col("close"))
        .alias("close"),
        F.when(n % 97 == 0, F.lit(0.0)).otherwise(F.col("volume")).alias("volume"),
    )


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One market-wide bar per ship date (bounded by the number of days)."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_linenumber") % 2 == 1).alias("early"),
        day_price().alias("c"),
        F.col("l_quantity").cast("bigint").alias("q"),
    )
    worth = F.col("c") * F.col("q")
    daily = line.groupBy("date").agg(
        F.sum(worth).alias("w"),
        F.sum("q").alias("v"),
        F.sum(F.when(F.col("early"), worth)).alias("we"),
        F.sum(F.when(F.col("early"), F.col("q"))).alias("ve"),
    )
    close = whole_ratio("w", "v")
    early = whole_ratio("we", "ve")
    return daily.select("date", F.coalesce(early, close).alias("open"), close.alias("close"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()


def official(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official raw rows; some days have no volume, some no opening price."""
    n = day_number()
    return bars(spark, sf_dir).select(
        "symbol",
        "date",
        F.when(n % 29 == 0, F.lit(None).cast("double")).otherwise(F.col("open")).alias("open"),
        "high",
        "low",
        "close",
        F.when(n % 23 == 0, F.lit(0.0)).otherwise(F.col("volume")).alias("volume"),
    )


def provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted provider rows with holes on fixed days."""
    n = day_number()
    factor = F.when(F.col("date") < F.lit("1998-01-05").cast("date"), F.lit(0.9)).otherwise(F.lit(1.0)) * F.when(
        (F.month("date") % 5 == 0) & (F.dayofmonth("date") % 2 == 1), F.lit(1.001)
    ).otherwise(F.lit(1.0))
    kept = bars(spark, sf_dir).where((n % 17 != 0) & (n % 23 != 0) & (n % 29 != 0))
    return kept.select(
        "symbol",
        "date",
        *[(F.col(c) * factor).alias(c) for c in ("open", "high", "low", "close")],
        "volume",
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corporate actions: all suppliers go ex-dividend on one day, every third twice."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    label = F.explode(
        F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("ex_dividend"), F.lit("ex_right"))).otherwise(
            F.array(F.lit("ex_dividend"))
        )
    )
    return s.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"),
        F.lit("1998-01-05").cast("date").alias("event_date"),
        label.alias("event_type"),
    )


def turnover_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turnover per day and market: open orders are market A, all others market B."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(
        F.col("o_orderdate").cast("date").alias("trade_date"),
        F.when(F.col("o_orderstatus") == "O", "A").otherwise("B").alias("market"),
    ).agg((F.sum(cents("o_totalprice")).cast("double") / 100.0).alias("value"))


def m1b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly money supply with up to five revisions per month."""
    o = table(spark, sf_dir, "orders").select(
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("revision"),
        cents("o_totalprice").alias("c"),
    )
    g = o.groupBy("month", "revision").agg((F.sum("c").cast("double") * 3.0 / 100.0).alias("value_twd"))
    number = F.year("month") * 12 + F.month("month")
    available = F.date_add(F.last_day("month"), F.col("revision") * 5)
    return g.select(
        F.date_format("month", "yyyy-MM").alias("period"),
        "revision",
        "value_twd",
        available.cast("timestamp").alias("available_at"),
        F.date_add(available, 1).cast("timestamp").alias("ingested_at"),
        F.when((number * 7 + F.col("revision")) % 11 == 0, "revoked").otherwise("available").alias("status"),
    )


def eps_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward-EPS revisions: one order is one revision of customer x year x series."""
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    base = cents("o_totalprice").cast("double") / 1000000.0
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat_ws("-", F.col("o_custkey").cast("string"), F.year(day).cast("string"), (F.col("o_orderkey") % 2).cast("string")).alias(
            "logical_id"
        ),
        F.month(day).alias("revision_number"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"),
        F.year(day).alias("fiscal_year"),
        (base * 0.9).alias("eps_low"),
        base.alias("eps_base"),
        (base * 1.1).alias("eps_high"),
        F.concat(F.lit("SRC"), (F.col("o_custkey") % 3).cast("string")).alias("source_name"),
        day.cast("timestamp").alias("available_at"),
        F.date_add(day, (F.col("o_orderkey") % 5).cast("int")).cast("timestamp").alias("ingested_at"),
        F.when(F.col("o_orderstatus") == "P", "revoked").otherwise("active").alias("status"),
    )


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approval events: one order line is one event on the order's revision."""
    li = table(spark, sf_dir, "lineitem")
    day = F.col("l_shipdate").cast("date")
    event_id = F.concat_ws(
        "-",
        *[
            F.col(c).cast("bigint").cast("string")
            for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
        ],
        cents("l_extendedprice").cast("string"),
    )
    return li.select(
        event_id.alias("approval_event_id"),
        F.col("l_orderkey").alias("resource_id"),
        F.when(F.col("l_returnflag") == "R", "revoked").otherwise("approved").alias("decision"),
        F.when(cents("l_tax") == 0, "VAL-09").otherwise("VAL-02").alias("rule_id"),
        F.when(F.col("l_linestatus") == "O", "A").otherwise("C").alias("evidence_level"),
        (F.col("l_linenumber") % 2).alias("project_operationalization"),
        day.cast("timestamp").alias("available_at"),
        F.date_add(day, (F.col("l_partkey") % 3).cast("int")).cast("timestamp").alias("ingested_at"),
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with industry and market, from customers and their region."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (
        c.join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"),
            F.col("c_mktsegment").alias("industry"),
            F.col("r_name").alias("market"),
        )
    )


def pe_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PE scenarios: two labels per symbol, one per industry and market."""
    c = table(spark, sf_dir, "customer")
    start = F.date_add(F.lit(EPOCH).cast("date"), (F.col("c_custkey") % 1500).cast("int"))
    own = c.select(
        F.explode(F.array(F.lit(0), F.lit(1))).alias("k"),
        "c_custkey",
        start.cast("timestamp").alias("effective_from"),
        F.when(F.col("c_custkey") % 5 != 0, F.date_add(start, 1200).cast("timestamp")).alias("effective_to"),
    ).select(
        F.concat_ws("-", F.lit("PE"), F.col("c_custkey").cast("string"), F.col("k").cast("string")).alias("pe_id"),
        F.when(F.col("k") == 0, "base").otherwise("bull").alias("label"),
        F.lit("symbol").alias("scope"),
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("scope_value"),
        (F.col("c_custkey") % 16 + 10 + F.col("k") * 4).cast("double").alias("pe_value"),
        "effective_from",
        "effective_to",
    )
    industry = (
        c.groupBy("c_mktsegment")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.concat(F.lit("PE-I-"), F.col("c_mktsegment")).alias("pe_id"),
            F.lit("base").alias("label"),
            F.lit("industry").alias("scope"),
            F.col("c_mktsegment").alias("scope_value"),
            (F.col("n") % 10 + 12).cast("double").alias("pe_value"),
            F.lit("1995-01-01 00:00:00").cast("timestamp").alias("effective_from"),
            F.lit(None).cast("timestamp").alias("effective_to"),
        )
    )
    market = table(spark, sf_dir, "region").select(
        F.concat(F.lit("PE-M-"), F.col("r_name")).alias("pe_id"),
        F.lit("base").alias("label"),
        F.lit("market").alias("scope"),
        F.col("r_name").alias("scope_value"),
        (F.col("r_regionkey") + 15).cast("double").alias("pe_value"),
        F.lit("1995-01-01 00:00:00").cast("timestamp").alias("effective_from"),
        F.lit(None).cast("timestamp").alias("effective_to"),
    )
    return own.unionByName(industry).unionByName(market)


def pe_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The PE ledger: one to three revisions of every scenario, the later ones of some symbols only."""
    pe = pe_ledger(spark, sf_dir)
    n = F.when(F.col("scope") == "symbol", F.expr("try_cast(substring(scope_value, 2) AS bigint)")).otherwise(F.length("scope_value").cast("bigint"))
    kept = F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda r: (r == 1) | (F.col("n") % F.pow(F.lit(3), r - 1).cast("bigint") == 0))
    rows = pe.withColumn("n", n).select("*", F.explode(kept).alias("revision_number"))
    known = F.date_add(F.col("effective_from").cast("date"), F.col("revision_number") * 40 - 60)
    return rows.select(
        F.concat_ws("@", "pe_id", F.col("revision_number").cast("string")).alias("id"),
        F.col("pe_id").alias("logical_id"),
        "revision_number",
        "label",
        "scope",
        "scope_value",
        (F.col("pe_value") + F.col("revision_number") - 1).alias("pe_value"),
        "effective_from",
        "effective_to",
        known.cast("timestamp").alias("available_at"),
        F.date_add(known, 1).cast("timestamp").alias("ingested_at"),
        "n",
    )


def pe_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approval events of PE revisions: most approved at once, some revoked later, some under another rule or never."""
    r = pe_revisions(spark, sf_dir).withColumn("k", F.col("n") + F.col("revision_number"))
    event = F.explode(F.expr("CASE WHEN k % 13 = 0 THEN array() WHEN k % 7 = 0 THEN array(0, 200) ELSE array(0) END")).alias("later")
    rows = r.select("*", event)
    at = F.date_add(F.col("available_at").cast("date"), (F.col("k") % 5).cast("int") + F.col("later"))
    return rows.select(
        F.concat_ws("#", "id", F.col("later").cast("string")).alias("approval_event_id"),
        F.col("id").alias("resource_id"),
        F.when(F.col("later") > 0, "revoked").otherwise("approved").alias("decision"),
        F.when(F.col("k") % 11 == 0, "VAL-02").otherwise("VAL-04").alias("rule_id"),
        F.when(F.col("k") % 4 == 0, "C").otherwise("A").alias("evidence_level"),
        (F.col("k") % 8 == 0).cast("int").alias("project_operationalization"),
        at.cast("timestamp").alias("available_at"),
        F.date_add(at, 1).cast("timestamp").alias("ingested_at"),
    )


def valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily PE, PB and yield per supplier."""
    g = (
        table(spark, sf_dir, "lineitem")
        .select(
            "l_suppkey",
            F.col("l_shipdate").cast("date").alias("metric_date"),
            cents("l_extendedprice").alias("c"),
            F.col("l_quantity").cast("bigint").alias("q"),
            cents("l_tax").alias("t"),
            cents("l_discount").alias("d"),
        )
        .groupBy("l_suppkey", "metric_date")
        .agg(
            F.sum("c").alias("c"),
            F.sum("q").alias("q"),
            F.sum("t").alias("t"),
            F.sum("d").alias("d"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    n = day_number("metric_date")
    return g.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        "metric_date",
        F.when(n % 61 != 0, F.col("c").cast("double") / F.col("q").cast("double") / 10000.0).alias("pe"),
        (F.col("t").cast("double") / F.col("n").cast("double") / 2.0).alias("pb"),
        (F.col("d").cast("double") / F.col("n").cast("double") / 100.0).alias("dividend_yield_ratio"),
    )


def candidates(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Target and support candidates: the lines of an order are one analysis.

    A candidate follows from five numbers, so repeats are dropped on these
    before its texts and keys are made.  With ``dealt`` the lines are dealt by
    analysis, for queries that gather each analysis in one row anyway: no later
    grouping by it moves them again.
    """
    order, *rest = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    symbol = F.concat(F.lit("O"), F.col(order).cast("bigint").cast("string")).alias("symbol")
    li = table(spark, sf_dir, "lineitem").select(F.col(order).cast("bigint").alias(order), *[F.col(c).cast("bigint").alias(c) for c in rest])
    # The symbol holds the order's number, which therefore stays behind.
    li = li.select(symbol, *rest).repartition("symbol").distinct() if dealt else li.distinct().select(symbol, *rest)
    number = F.substring("symbol", 2, 20)
    k = F.col("l_linenumber") % 3
    return li.select(
        "symbol",
        F.concat_ws("-", number, *[F.col(c).cast("string") for c in rest]).alias("candidate_id"),
        F.when(k == 0, "VAL-01").when(k == 1, "FB-03").otherwise("FB-04").alias("method_family"),
        F.when(k == 2, "support").otherwise("target").alias("semantic_role"),
        ((F.col("l_partkey") % 1000 + 9000).cast("double") / 10.0).cast("decimal(18,4)").alias("price"),
        F.when(F.col("l_partkey") % 11 == 0, "U").otherwise("A").alias("evidence_level"),
        F.array(
            F.concat(F.lit("D"), (F.col("l_suppkey") % 7).cast("string")),
            F.concat(F.lit("E"), (F.col("l_partkey") % 5).cast("string")),
        ).alias("dependency_keys"),
    )


def dense_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of six market segments that trade on almost every day."""
    line = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_linenumber") % 2 == 1).alias("early"),
        day_price().alias("c"),
        F.col("l_quantity").cast("bigint").alias("q"),
    )
    worth = F.col("c") * F.col("q")
    daily = line.groupBy("symbol", "date").agg(
        F.sum(worth).alias("w"),
        F.sum("q").alias("v"),
        F.sum(F.when(F.col("early"), worth)).alias("we"),
        F.sum(F.when(F.col("early"), F.col("q"))).alias("ve"),
        F.max("c").alias("hi"),
        F.min("c").alias("lo"),
    )
    close = whole_ratio("w", "v")
    return daily.select(
        "symbol",
        "date",
        F.coalesce(whole_ratio("we", "ve"), close).alias("open"),
        F.col("hi").cast("double").alias("high"),
        F.col("lo").cast("double").alias("low"),
        close.alias("close"),
    )


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored price ranges to be evaluated later: one order is one snapshot subject."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    names = F.array(*[F.lit(s) for s in ("AF", "AO", "NF", "NO", "RF", "RO")])
    low = (cents("o_totalprice") % 9000 + 43500).cast("double")
    family = F.when(key % 4 == 0, "VAL-01").when(key % 4 == 1, "FB-03").when(key % 4 == 2, "FB-04").otherwise("TGT-01")
    role = F.when(key % 4 == 2, "support").otherwise("target")
    return o.select(
        F.concat(F.lit("SNAP"), (key - key % 4).cast("string")).alias("snapshot_id"),
        F.concat(F.lit("SUB"), key.cast("string")).alias("subject_id"),
        F.get(names, F.expr("cast((o_orderkey div 4) % 6 as int)")).alias("symbol"),
        F.when(key % 3 == 0, "live_refresh").otherwise("historical_reconstruction").alias("capture_mode"),
        F.when(key % 4 == 2, "support_candidate").when(key % 4 == 3, "target_cluster").otherwise("target_candidate").alias("subject_type"),
        family.alias("method_family"),
        role.alias("semantic_role"),
        F.when(key % 4 == 3, F.when(key % 8 == 3, "low").otherwise("moderate")).alias("evidence_strength"),
        F.col("o_orderdate").cast("date").alias("cutoff_date"),
        low.alias("price_low"),
        (low + 600.0).alias("price_high"),
    )


def campaign_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal events: campaign = user; three entry stages, entries of no stage, and an invalidation."""
    e = table(spark, sf_dir, "events")
    stage = (
        F.when(F.col("event_type") == "view", 1)
        .when(F.col("event_type") == "click", 2)
        .when(F.col("event_type") == "purchase", 3)
    )
    return e.select(
        "event_id",
        F.col("user_id").alias("campaign_id"),
        F.date_trunc("minute", "ts").alias("signal_at"),
        F.when(F.col("event_type") == "error", "invalidation").otherwise("entry").alias("event_kind"),
        stage.alias("stage"),
    )


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly OHLC of event values (bounded by the number of hours)."""
    e = table(spark, sf_dir, "events").select("ts", "value")
    return e.groupBy(F.date_trunc("hour", "ts").alias("bar_at")).agg(
        F.min_by("value", "ts").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"),
    )


def run_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingestion attempts: one event is one attempt on a provider resource."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("item_id"),
        F.col("event_type").alias("provider_id"),
        F.concat_ws(".", "event_type", F.col("user_id").cast("string")).alias("resource_id"),
        F.col("ts").alias("started_at"),
        (F.col("ts") + F.make_dt_interval(mins=k)).alias("completed_at"),
        k.alias("k"),
        F.when(k < 5, "provider_error")
        .when(k < 12, "partial")
        .when(k < 16, "awaiting_review")
        .otherwise("accepted")
        .alias("status"),
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule registry: one part is one rule."""
    k = F.col("p_partkey")
    uses = F.array(F.lit("automatic_order"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("R"), k.cast("string")).alias("rule_id"),
        F.element_at(F.array(*[F.lit(x) for x in "ABCU"]), (F.col("p_size") % 4 + 1).cast("int")).alias("evidence_level"),
        F.when(k % 11 == 0, "unsupported").when(k % 13 == 0, "legacy_experimental").when(k % 2 == 0, "verified_core").otherwise("parameterized_support").alias("implementation_mode"),
        (k % 3 == 0).alias("human_approval_required"),
        (k % 5 == 0).alias("project_operationalization"),
        F.when(k % 7 == 0, F.array(F.lit("price_scenario"))).otherwise(F.array(F.lit("trend_confirmation"), F.lit("price_scenario"))).alias("allowed_outputs"),
        F.when(k % 17 == 0, F.array_append(uses, F.lit("trend_confirmation"))).otherwise(uses).alias("forbidden_uses"),
        F.concat(F.lit("1."), (F.col("p_size") % 3).cast("string")).alias("rule_version"),
    )
