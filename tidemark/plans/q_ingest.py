"""Queries on normalisation, validation, landed files, merges and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import normalize as nz
from tidemark.functions.canonical import canonical_json, fingerprint
from tidemark.functions.numbers import normalize_twd, parse_number, yield_to_ratio
from tidemark.operators import validate as va
from tidemark.plans import domain as d
from tidemark.plans.domain_sql import cents, with_views
from tidemark.plans.registry import query
from tidemark.session import work_dir
from tidemark.sources import landed as ld, panel as pn, sinks as sk
from tidemark.streaming import ledger as st

TS = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


# ---------------------------------------------------------------- text cells

RAW_SYMBOL = """CASE p_partkey % 7 WHEN 0 THEN 'taiex' WHEN 1 THEN '0000' WHEN 2 THEN '^gspc' WHEN 3 THEN ' 00' || p_partkey || ' '
    WHEN 4 THEN p_partkey || '.tw' WHEN 5 THEN p_partkey || '.TWO' ELSE (1000 + p_partkey)::VARCHAR END"""


@query(
    "normalize_symbol",
    f"""WITH r AS (SELECT p_partkey AS id, {RAW_SYMBOL} AS raw FROM part), u AS (SELECT id, raw, upper(trim(raw)) AS s FROM r),
        n AS (SELECT *, CASE WHEN s IN ('0000', 'TAIEX') THEN '^TWII' WHEN s LIKE '^%' OR s LIKE '%.TW' OR s LIKE '%.TWO' THEN s ELSE s || '.TW' END AS symbol FROM u)
        SELECT id, symbol, CASE WHEN symbol LIKE '^%' OR symbol LIKE '00%' THEN 1e-3 ELSE 3e-3 END AS sales_tax_rate,
            (CASE WHEN symbol LIKE '^%' THEN 1 ELSE 1000 END)::BIGINT AS lot_size,
            CASE WHEN symbol LIKE '^%' THEN 'index_etf_proxy' WHEN symbol LIKE '00%' THEN 'equity_etf' ELSE 'stock' END AS instrument_type FROM n""",
)
def q_symbol(spark, sf_dir):
    k = F.col("p_partkey")
    t = k.cast("string")
    raw = (
        F.when(k % 7 == 0, "taiex").when(k % 7 == 1, "0000").when(k % 7 == 2, "^gspc")
        .when(k % 7 == 3, F.concat(F.lit(" 00"), t, F.lit(" "))).when(k % 7 == 4, F.concat(t, F.lit(".tw")))
        .when(k % 7 == 5, F.concat(t, F.lit(".TWO"))).otherwise((k + 1000).cast("string"))
    )
    out = d.table(spark, sf_dir, "part").select(k.alias("id"), raw.alias("raw"))
    cost = nz.cost_model(F.col("raw"))
    return out.select(
        "id",
        nz.normalize_symbol(F.col("raw")).alias("symbol"),
        cost["sales_tax_rate"].alias("sales_tax_rate"),
        cost["lot_size"].alias("lot_size"),
        cost["instrument_type"].alias("instrument_type"),
    )


def _number_text(k, c):
    """Amount as landed text: thousands separators, or a placeholder for nothing."""
    blanks = F.array(*[F.lit(x) for x in K.MISSING_NUMBERS])
    return F.when(k % 11 == 0, F.get(blanks, (k % len(K.MISSING_NUMBERS)).cast("int"))).otherwise(F.format_number(c / F.lit(100), 2))


@query(
    "parse_number",
    f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN {cents('o_totalprice')}::DOUBLE / 1e2 END AS value,
        CASE WHEN o_orderkey % 11 <> 0 THEN {cents('o_totalprice')} END AS whole FROM orders""",
)
def q_number(spark, sf_dir):
    k, c = F.col("o_orderkey"), d.cents("o_totalprice")
    o = d.table(spark, sf_dir, "orders").select(
        k.alias("id"),
        _number_text(k, c).alias("t"),
        F.when(k % 11 == 0, "--").otherwise(F.format_number(c, 0)).alias("w"),
    )
    return o.select("id", parse_number(F.col("t")).alias("value"), parse_number(F.col("w"), "bigint").alias("whole"))


def _minguo_text(k, day):
    y, m, dd = F.year(day) - 1911, F.month(day), F.dayofmonth(day)
    y3, m2, d2 = F.lpad(y.cast("string"), 3, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(dd.cast("string"), 2, "0")
    return (
        F.when(k % 6 == 0, F.concat_ws("/", y.cast("string"), m2, d2))
        .when(k % 6 == 1, F.concat(y.cast("string"), F.lit("年"), m2, F.lit("月"), d2, F.lit("日")))
        .when(k % 6 == 2, F.concat(y3, m2, d2))
        .when(k % 6 == 3, F.date_format(day, "yyyy-MM-dd"))
        .when(k % 6 == 4, F.concat_ws(".", y.cast("string"), m.cast("string"), dd.cast("string")))
        .otherwise(F.lit("n/a"))
    )


@query(
    "parse_minguo_date",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 <> 5 THEN o_orderdate::DATE::VARCHAR END AS day,
        last_day(o_orderdate::DATE)::VARCHAR AS month_end FROM orders""",
)
def q_minguo(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    o = d.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        _minguo_text(F.col("o_orderkey"), day).alias("t"),
        F.concat(F.year(day).cast("string"), F.lit("M"), F.lpad(F.month(day).cast("string"), 2, "0")).alias("p"),
    )
    return o.select("id", nz.parse_minguo_date(F.col("t")).alias("day"), nz.parse_month_period(F.col("p")).alias("month_end"))


@query(
    "resolve_cutoff",
    f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN {TS.format(c="o_orderdate + INTERVAL 1 HOUR - INTERVAL 8 HOUR")}
            WHEN o_orderkey % 3 = 1 THEN {TS.format(c="o_orderdate + INTERVAL 1 HOUR")} END AS instant,
        CASE WHEN o_orderkey % 3 = 1 THEN {TS.format(c="o_orderdate + INTERVAL 1 HOUR")}
             WHEN o_orderkey % 3 = 0 THEN {TS.format(c="o_orderdate + INTERVAL 1 HOUR - INTERVAL 8 HOUR")}
             ELSE {TS.format(c="o_orderdate::DATE::TIMESTAMP - INTERVAL 8 HOUR")} END AS cutoff FROM orders""",
)
def q_cutoff(spark, sf_dir):
    k = F.col("o_orderkey")
    base = F.date_format("o_orderdate", "yyyy-MM-dd'T'01:00:00")
    text = F.when(k % 3 == 0, F.concat(base, F.lit("+08:00"))).when(k % 3 == 1, F.concat(base, F.lit("Z"))).otherwise(base)
    o = d.table(spark, sf_dir, "orders").select(k.alias("id"), nz.normalize_utc(text).alias("instant"), F.col("o_orderdate").cast("date").alias("day"))
    return o.select("id", "instant", nz.resolve_cutoff(F.col("instant"), F.col("day")).alias("cutoff"))


@query(
    "normalize_units",
    f"""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN {cents('o_totalprice')}::DOUBLE WHEN 1 THEN {cents('o_totalprice')}::DOUBLE * 1e6
            WHEN 2 THEN {cents('o_totalprice')}::DOUBLE * 1e8 END AS twd,
        CASE o_orderkey % 3 WHEN 0 THEN (o_custkey % 100)::DOUBLE / 1e2 WHEN 1 THEN (o_custkey % 100)::DOUBLE END AS ratio FROM orders""",
)
def q_units(spark, sf_dir):
    k = F.col("o_orderkey")
    unit = F.when(k % 4 == 0, "TWD").when(k % 4 == 1, "TWD_million").when(k % 4 == 2, "TWD_100_million").otherwise("USD")
    yunit = F.when(k % 3 == 0, "percent").when(k % 3 == 1, "ratio").otherwise("bps")
    return d.table(spark, sf_dir, "orders").select(
        k.alias("id"),
        normalize_twd(d.cents("o_totalprice").cast("double"), unit).alias("twd"),
        yield_to_ratio((F.col("o_custkey") % 100).cast("double"), yunit).alias("ratio"),
    )


@query(
    "parse_list_cell",
    """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_brand || ',' || p_type WHEN 1 THEN p_brand ELSE '' END AS items,
        (CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END)::BIGINT AS n FROM part""",
)
def q_list(spark, sf_dir):
    k = F.col("p_partkey")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("['"), "p_brand", F.lit("', '"), "p_type", F.lit("']")))
        .when(k % 4 == 1, F.concat(F.lit('["'), "p_brand", F.lit('"]')))
        .when(k % 4 == 2, "not a list")
    )
    out = d.table(spark, sf_dir, "part").select(k.alias("id"), nz.parse_list_cell(text).alias("items"))
    return out.withColumn("n", F.size("items"))


# ---------------------------------------------------------------- validation


@query(
    "revision_validation",
    with_views(
        "eps",
        extra={
            "e": """SELECT id, symbol, revision_number - 1 AS rn, CASE WHEN id % 7 = 0 THEN eps_high + 1 ELSE eps_low END AS lo, eps_base, eps_high,
                CASE WHEN id % 5 = 0 THEN id - 1 END AS parent, available_at + INTERVAL (id % 3 - 1) DAY AS pub, available_at,
                CASE WHEN id % 13 = 0 THEN available_at - INTERVAL 1 DAY ELSE ingested_at END AS ing FROM eps""",
        },
        body="""SELECT id, concat_ws(',', CASE WHEN lo > eps_base OR eps_base > eps_high OR lo > eps_high THEN 'scenario_order' END,
            CASE WHEN rn < 1 THEN 'revision_number_invalid' END, CASE WHEN rn = 1 AND parent IS NOT NULL THEN 'first_revision_has_parent' END,
            CASE WHEN rn > 1 AND parent IS NULL THEN 'parent_missing' END, CASE WHEN pub > available_at THEN 'published_after_available' END,
            CASE WHEN available_at > ing THEN 'available_after_received' END) AS reasons FROM e""",
    ),
)
def q_validation(spark, sf_dir):
    i = F.col("id")
    e = d.eps_ledger(spark, sf_dir).select(
        "id",
        "symbol",
        (F.col("revision_number") - 1).alias("revision_number"),
        F.when(i % 7 == 0, F.col("eps_high") + 1).otherwise(F.col("eps_low")).alias("eps_low"),
        "eps_base",
        "eps_high",
        F.when(i % 5 == 0, i - 1).alias("revision_of"),
        (F.col("available_at") + F.make_dt_interval(days=(i % 3 - 1).cast("int"))).alias("published_at"),
        "available_at",
        F.when(i % 13 == 0, F.col("available_at") - F.make_dt_interval(days=F.lit(1))).otherwise(F.col("ingested_at")).alias("ingested_at"),
    )
    return va.validate(e, va.eps_rules()).select("id", "reasons")


@query(
    "anchor_validation",
    """WITH x AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'FB-03' WHEN 1 THEN 'FB-04' ELSE 'FB-99' END AS rule_id,
            o_orderkey % 5 AS c, o_orderkey % 7 AS p, o_orderkey % 4 AS ch FROM orders)
        SELECT id, concat_ws(',', CASE WHEN rule_id = 'FB-99' THEN 'rule_unknown' END,
            CASE WHEN (rule_id = 'FB-03' AND c = 0) OR (rule_id = 'FB-04' AND c <> 0) THEN 'anchor_roles' END,
            CASE WHEN p = 0 THEN 'anchor_price' END,
            CASE WHEN ((rule_id = 'FB-03' AND c <> 0) OR (rule_id = 'FB-04' AND c = 0)) AND ch = 0 THEN 'anchor_chronology' END) AS reasons FROM x""",
)
def q_anchor_validation(spark, sf_dir):
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")

    def anchor(role, offset, price=None):
        shift = F.when(k % 4 == 0, F.lit(0)).otherwise(F.lit(offset))
        p = F.lit(100.0) if price is None else price
        return F.struct(F.lit(role).alias("role"), F.date_add(day, shift).alias("market_date"), p.alias("price"))

    two = [anchor("origin", 0, F.when(k % 7 == 0, 0.0).otherwise(90.0)), anchor("swing_end", 5)]
    three = [*two, anchor("projection_origin", 9)]
    rows = d.table(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.when(k % 3 == 0, "FB-03").when(k % 3 == 1, "FB-04").otherwise("FB-99").alias("rule_id"),
        F.when(k % 5 == 0, F.array(*two)).otherwise(F.array(*three)).alias("anchors"),
    )
    return va.validate(rows, va.anchor_rules()).select("id", "reasons")


@query(
    "profile_validation",
    """SELECT c_custkey AS id, concat_ws(',', CASE WHEN c_custkey % 120 > 100 THEN 'pe_percentile_max_range' END,
        CASE WHEN c_custkey % 9 = 0 THEN 'pb_percentile_max_range' END, CASE WHEN c_custkey % 40 < 20 THEN 'minimum_observations' END,
        CASE WHEN c_custkey % 6 = 0 THEN 'history_years' END) AS reasons FROM customer""",
)
def q_profile_validation(spark, sf_dir):
    k = F.col("c_custkey")
    rows = d.table(spark, sf_dir, "customer").select(
        k.alias("id"),
        (k % 120).cast("double").alias("pe_percentile_max"),
        F.when(k % 9 != 0, F.lit(50.0)).alias("pb_percentile_max"),
        F.lit(30.0).alias("dividend_yield_percentile_min"),
        (k % 40).alias("minimum_observations"),
        (k % 6).alias("history_years"),
    )
    return va.validate(rows, va.profile_rules()).select("id", "reasons")


@query(
    "plan_and_scope_validation",
    """WITH p AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN [1, 2, 3, 4] WHEN 1 THEN [2, 1] WHEN 2 THEN [1, 2] ELSE [1, 2, 3] END AS st,
            CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 100 END AS cap, o_orderkey % 3 AS sc, o_orderkey % 5 AS sv FROM orders)
        SELECT id, concat_ws(',', CASE WHEN cap <= 0 THEN 'capital_not_positive' END, CASE WHEN len(st) > 3 THEN 'fourth_entry_forbidden' END,
            CASE WHEN st = [2, 1] OR len(st) > 3 THEN 'triggers_not_ordered' END) AS plan_reasons,
        concat_ws(',', CASE WHEN sv = 0 THEN 'pe_not_positive' END, CASE WHEN sv = 1 THEN 'scope_not_exclusive' END,
            CASE WHEN sv = 2 THEN 'scope_value_missing' END, CASE WHEN sv = 3 THEN 'validity_reversed' END) AS scope_reasons FROM p""",
)
def q_plan_validation(spark, sf_dir):
    k = F.col("o_orderkey")

    def ints(*v):
        return F.array(*[F.lit(x) for x in v])

    rows = d.table(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.when(k % 4 == 0, ints(1, 2, 3, 4)).when(k % 4 == 1, ints(2, 1)).when(k % 4 == 2, ints(1, 2)).otherwise(ints(1, 2, 3)).alias("trigger_stages"),
        F.when(k % 10 == 0, 0).otherwise(100).alias("planned_total_capital"),
        F.when(k % 5 == 0, 0.0).otherwise(15.0).alias("pe_value"),
        F.when(k % 3 == 0, "symbol").when(k % 3 == 1, "industry").otherwise("market").alias("scope"),
        # Code 2 fills another scope than the stated one; code 1 fills two.
        F.when(((k % 3 == 0) & (k % 5 != 2)) | ((k % 3 == 1) & (k % 5).isin(1, 2)), "x").alias("symbol"),
        F.when(((k % 3 == 1) & (k % 5 != 2)) | ((k % 3 == 2) & (k % 5).isin(1, 2)), "x").alias("industry"),
        F.when(((k % 3 == 2) & (k % 5 != 2)) | ((k % 3 == 0) & (k % 5).isin(1, 2)), "x").alias("market"),
        F.lit(1).alias("effective_from"),
        F.when(k % 5 == 3, 0).otherwise(2).alias("effective_to"),
    )
    plan = va.validate(rows, va.plan_rules()).withColumnRenamed("reasons", "plan_reasons")
    return va.validate(plan, va.pe_rules()).select("id", "plan_reasons", F.col("reasons").alias("scope_reasons"))


SESS = """SELECT user_id, ts::DATE AS trade_date, event_id, ts, CASE WHEN event_type IN ('view', 'click') THEN 'trading' WHEN event_type = 'error' THEN 'holiday' ELSE 'special' END AS status FROM events"""


@query(
    "noop_suppression",
    f"""WITH s AS ({SESS}), l AS (SELECT *, lag(status) OVER w AS p, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY user_id, trade_date ORDER BY ts, event_id))
        SELECT user_id, trade_date::VARCHAR AS trade_date, event_id, status, row_number() OVER (PARTITION BY user_id, trade_date ORDER BY ts, event_id) AS revision_number
        FROM l WHERE rn = 1 OR status IS DISTINCT FROM p""",
)
def q_noop(spark, sf_dir):
    e = d.table(spark, sf_dir, "events")
    t = F.col("event_type")
    s = e.select(
        "user_id",
        F.col("ts").cast("date").alias("trade_date"),
        "event_id",
        "ts",
        F.when(t.isin("view", "click"), "trading").when(t == "error", "holiday").otherwise("special").alias("status"),
    )
    s = s.withColumn("hour", F.date_trunc("hour", "ts"))
    return va.changed_only(s, ["user_id", "trade_date"], ["ts", "event_id"], ["status"], "hour").drop("ts", "hour")


@query(
    "supersession",
    with_views(
        "run_items",
        extra={
            "l": """SELECT *, lag(item_id) OVER w AS pi, lag(status) OVER w AS ps FROM run_items
                WINDOW w AS (PARTITION BY resource_id, started_at::DATE ORDER BY started_at, item_id)""",
        },
        body="""SELECT item_id, resource_id, status, CASE WHEN pi IS NOT NULL AND ps IS DISTINCT FROM status THEN pi END AS supersedes_id FROM l""",
    ),
)
def q_supersession(spark, sf_dir):
    r = d.run_items(spark, sf_dir).withColumn("day", F.col("started_at").cast("date"))
    r = r.withColumn("hour", F.date_trunc("hour", "started_at"))
    out = va.supersession(r, ["resource_id", "day"], ["started_at", "item_id"], ["status"], "hour", "item_id")
    return out.select("item_id", "resource_id", "status", "supersedes_id")


@query(
    "ingest_metrics",
    with_views(
        "run_items",
        extra={
            "i": "SELECT started_at::DATE AS run, provider_id, resource_id, status FROM run_items",
            "p": """SELECT run, resource_id, count(*) AS record_count, count(*) FILTER (status = 'accepted') AS accepted_count,
                count(*) FILTER (status <> 'accepted') AS rejected_count FROM i GROUP BY ALL""",
            "h": "SELECT *, CASE WHEN accepted_count = 0 THEN 'rejected' WHEN rejected_count > 0 THEN 'partial' ELSE 'fresh' END AS health FROM p",
            "r": "SELECT run, bool_and(health = 'fresh') AS a, bool_or(health <> 'rejected') AS b FROM h GROUP BY run",
        },
        body="""SELECT run::VARCHAR AS run_id, resource_id, record_count, accepted_count, rejected_count, health,
            CASE WHEN a THEN 'succeeded' WHEN b THEN 'partial' ELSE 'failed' END AS run_status FROM h JOIN r USING (run)""",
    ),
)
def q_ingest_metrics(spark, sf_dir):
    items = d.run_items(spark, sf_dir).select(
        F.date_format("started_at", "yyyy-MM-dd").alias("run_id"),
        "resource_id",
        F.when(F.col("status") == "accepted", "accepted").otherwise("rejected").alias("outcome"),
    )
    return va.ingest_metrics(items)


# ---------------------------------------------------------------- landed files


def _envelopes(rows, by, cells):
    """Landed JSON texts, one document per group (a month of one symbol at most), read back under the schema."""
    packed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.array(*cells))).alias("data"))
    text = F.to_json(F.struct(F.lit("OK").alias("stat"), "data"))
    return packed.select(*by, F.from_json(text, ld.ENVELOPE).alias("e")).select(*by, "e.*")


def _slash(day):
    return F.concat_ws("/", (F.year(day) - 1911).cast("string"), F.date_format(day, "MM"), F.date_format(day, "dd"))


@query(
    "landed_market_month",
    f"""SELECT o_orderdate::DATE::VARCHAR AS trade_date, sum({cents('o_totalprice')})::BIGINT AS traded_shares, sum({cents('o_totalprice')})::BIGINT * 10 AS traded_value_twd,
        count(*) AS transaction_count, max({cents('o_totalprice')})::DOUBLE / 1e2 AS taiex,
        CASE WHEN count(*) % 2 = 0 THEN -min({cents('o_totalprice')})::DOUBLE / 1e2 END AS taiex_change FROM orders GROUP BY 1""",
)
def q_landed_month(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    c = d.cents("o_totalprice")
    g = d.table(spark, sf_dir, "orders").groupBy(day.alias("day")).agg(
        F.sum(c).alias("s"), F.count(F.lit(1)).alias("n"), F.max(c).alias("hi"), F.min(c).alias("lo")
    )
    cells = [
        _slash(F.col("day")),
        F.format_number("s", 0),
        F.format_number(F.col("s") * 10, 0),
        F.format_number("n", 0),
        F.format_number(F.col("hi") / F.lit(100), 2),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit("-"), F.format_number(F.col("lo") / F.lit(100), 2))).otherwise("--"),
    ]
    month = g.withColumn("month", F.date_format("day", "yyyy-MM"))
    return ld.market_month(_envelopes(month, ["month"], cells))


@query(
    "landed_stock_day",
    with_views(
        "numbered",
        body="""SELECT symbol, date::VARCHAR AS trade_date, volume::BIGINT AS volume, (volume * 1000)::BIGINT AS traded_value_twd, open,
            CASE WHEN n % 19 = 0 THEN NULL ELSE high END AS high, low, close, '-1.95' AS change_text, n::BIGINT AS transaction_count,
            CASE WHEN n % 2 = 0 THEN 'x' ELSE '' END AS note FROM numbered""",
    ),
)
def q_landed_stock(spark, sf_dir):
    b = d.bars(spark, sf_dir).withColumns({"n": d.day_number(), "month": F.date_format("date", "yyyy-MM")})
    num = {c: F.format_number(c, 2) for c in ("open", "high", "low", "close")}
    cells = [
        _slash(F.col("date")),
        F.format_number("volume", 0),
        F.format_number(F.col("volume") * 1000, 0),
        num["open"],
        F.when(F.col("n") % 19 == 0, "--").otherwise(num["high"]),
        num["low"],
        num["close"],
        F.lit("-1.95"),
        F.format_number("n", 0),
        F.when(F.col("n") % 2 == 0, "x").otherwise(""),
    ]
    return ld.stock_day(_envelopes(b, ["symbol", "month"], cells))


@query(
    "landed_actions",
    f"""SELECT 'S' || s_suppkey AS symbol, (DATE '1998-01-05' + (s_suppkey % 200)::INT)::VARCHAR AS event_date,
            CASE s_suppkey % 4 WHEN 0 THEN 'ex_right' WHEN 1 THEN 'ex_dividend' WHEN 2 THEN 'ex_right_dividend' ELSE 'other_exright' END AS event_type,
            {cents('s_acctbal')}::DOUBLE / 1e2 AS previous_close, 8e1 AS reference_price, 825e-1 AS opening_reference, 2e0 AS action_value,
            CASE s_suppkey % 4 WHEN 0 THEN '權' WHEN 1 THEN '息' WHEN 2 THEN '權息' ELSE '他' END AS action_reason FROM supplier
        UNION ALL SELECT 'S' || s_suppkey, (DATE '1998-01-05' + (s_suppkey % 200)::INT)::VARCHAR, 'capital_reduction', {cents('s_acctbal')}::DOUBLE / 1e2, 8e1,
            NULL, NULL, '退還股款' FROM supplier""",
)
def q_landed_actions(spark, sf_dir):
    k = F.col("s_suppkey")
    s = d.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), k.cast("string")).alias("symbol"),
        F.date_add(F.lit("1998-01-05").cast("date"), (k % 200).cast("int")).alias("day"),
        F.when(k % 4 == 0, "權").when(k % 4 == 1, "息").when(k % 4 == 2, "權息").otherwise("他").alias("label"),
        F.when(d.cents("s_acctbal") < 0, F.concat(F.lit("-"), F.format_number(F.abs(d.cents("s_acctbal")) / F.lit(100), 2)))
        .otherwise(F.format_number(d.cents("s_acctbal") / F.lit(100), 2))
        .alias("close"),
        F.expr("s_suppkey div 100").alias("file"),
    )
    cjk = F.concat((F.year("day") - 1911).cast("string"), F.lit("年"), F.date_format("day", "MM"), F.lit("月"), F.date_format("day", "dd"), F.lit("日"))
    x = F.lit("")
    ex = _envelopes(s, ["file"], [cjk, F.col("symbol"), x, F.col("close"), F.lit("80.00"), F.lit("2.000000"), F.col("label"), x, x, F.lit("82.50"), x])
    red = _envelopes(s, ["file"], [_slash(F.col("day")), F.col("symbol"), x, F.col("close"), F.lit("80.00"), x, x, F.lit("--"), x, F.lit("退還股款"), x])
    return ld.exright(ex).unionByName(ld.reduction(red)).drop("raw_row")


LANDED_TURNOVER = """SELECT trade_date::VARCHAR AS trade_date, market, value FROM turnover_markets"""


def _turnover_objects(spark, sf_dir, market, field):
    rows = d.turnover_markets(spark, sf_dir).where(F.col("market") == market)
    text = F.to_json(F.struct(_slash(F.col("trade_date")).alias("Date"), F.format_number("value", 2).alias(field)))
    schema = ld.TURNOVER_A if market == "A" else ld.TURNOVER_B
    return rows.select(F.from_json(text, schema).alias("o")).select("o.*")


@query("landed_turnover", with_views("turnover_markets", body=LANDED_TURNOVER))
def q_landed_turnover(spark, sf_dir):
    return ld.turnover(_turnover_objects(spark, sf_dir, "A", "TradeValue"), _turnover_objects(spark, sf_dir, "B", "TradeAmount"))


@query("landed_turnover_positional", with_views("turnover_markets", body=LANDED_TURNOVER))
def q_landed_positional(spark, sf_dir):
    rows = d.turnover_markets(spark, sf_dir).withColumn("month", F.date_format("trade_date", "yyyy-MM"))
    day, value = _slash(F.col("trade_date")), F.format_number("value", 2)
    a = _envelopes(rows.where("market = 'A'"), ["month"], [day, F.lit("0"), value])
    packed = rows.where("market = 'B'").groupBy("month").agg(F.collect_list(F.array(day, value)).alias("aaData"))
    b = packed.select(F.from_json(F.to_json(F.struct("aaData")), ld.TABLE_ENVELOPE).alias("e")).select("e.*")
    return ld.turnover_positional(a, b)


@query(
    "landed_money_supply",
    with_views(
        extra={
            "m": f"""SELECT date_trunc('month', o_orderdate)::DATE AS m, sum({cents('o_totalprice')})::BIGINT AS s FROM orders GROUP BY 1""",
        },
        body="""SELECT strftime(m, '%Y-%m') AS period, last_day(m)::VARCHAR AS data_date, s::DOUBLE AS value_raw, 'TWD_million' AS raw_unit FROM m""",
    ),
)
def q_landed_money(spark, sf_dir):
    m = d.table(spark, sf_dir, "orders").groupBy(
        F.concat(F.year("o_orderdate").cast("string"), F.lit("M"), F.lpad(F.month("o_orderdate").cast("string"), 2, "0")).alias("p")
    ).agg(F.sum(d.cents("o_totalprice")).alias("s"), F.count(F.lit(1)).alias("n"))
    # Three categories of two columns; the wanted one is written in full width.
    row = F.array(F.col("p"), F.col("n").cast("string"), F.lit("0"), F.format_number("s", 0), F.lit("1.0"), F.lit("7"), F.lit("0"))
    packed = m.groupBy(F.substring("p", 1, 4).alias("year")).agg(F.collect_list(row).alias("dataSets"))
    names = F.array(*[F.struct(F.lit(x).alias("data")) for x in ("貨幣總計數 -Ｍ１Ａ", "貨幣總計數 -Ｍ １ Ｂ", "貨幣總計數 -Ｍ２")])
    doc = F.to_json(F.struct(F.struct("dataSets", F.struct(names.alias("Table1")).alias("structure")).alias("data")))
    return ld.money_supply(packed.select(F.from_json(doc, ld.MONEY).alias("e")).select("e.*"))


RELEASES = {
    "m": f"""SELECT date_trunc('month', o_orderdate)::DATE AS m, sum({cents('o_totalprice')})::BIGINT AS s FROM orders GROUP BY 1""",
    "rel": """SELECT strftime(m, '%Y-%m') AS period, year(m) AS year, last_day(m)::VARCHAR AS data_date, s::DOUBLE AS value_raw,
        CASE WHEN year(m) % 5 = 2 OR (month(m) % 6 <> 0 AND year(m) % 4 <> 3) THEN (last_day(m) + 25)::TIMESTAMP END AS available_at FROM m""",
}


def _released(spark, sf_dir):
    """A document per year, even years in the full layout and odd ones in the compact one; some months were never released."""
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    m = d.table(spark, sf_dir, "orders").groupBy(month.alias("m")).agg(F.sum(d.cents("o_totalprice")).alias("s"))
    row = F.array(F.date_format("m", "yyyy'M'MM"), F.lit("0"), F.lit("0"), F.format_number("s", 0), F.lit("1.0"))
    packed = m.groupBy(F.year("m").alias("year")).agg(F.collect_list(row).alias("rows"))
    names = [F.lit("M1A"), F.lit("m 1 b (average)")]
    full = F.struct("rows", F.struct(F.array(*[F.struct(x.alias("data")) for x in names]).alias("Table1")).alias("structure"))
    full = F.to_json(F.struct(full.withField("dataSets", F.col("rows")).dropFields("rows").alias("data")))
    tables = F.array(F.struct(F.lit("Table0").alias("name"), F.array(F.lit("M1B")).alias("items")), F.struct(F.lit("Table1").alias("name"), F.array(*names).alias("items")))
    compact = F.to_json(F.struct(F.struct(F.struct(tables.alias("tables")).alias("structure"), F.col("rows").alias("data")).alias("result")))
    doc = F.when(F.col("year") % 2 == 0, full).otherwise(compact)
    rows = ld.money_supply(ld.one_money_layout(packed.select(F.from_json(doc, ld.MONEY_ANY).alias("e")).select("e.*")))
    out = (F.year("m") % 5 == 2) | ((F.month("m") % 6 != 0) & (F.year("m") % 4 != 3))
    releases = m.select(F.date_format("m", "yyyy-MM").alias("period"), F.when(out, F.date_add(F.last_day("m"), 25).cast("timestamp")).alias("available_at"))
    return ld.released_money_supply(rows, releases)


@query(
    "released_money_supply",
    with_views(
        extra=RELEASES,
        body="""SELECT period, data_date, value_raw, 'TWD_million' AS raw_unit, strftime(available_at, '%Y-%m-%d %H:%M:%S.%f') AS available_at,
            CASE WHEN available_at IS NULL THEN 'official_release_timestamp_required' END AS reason FROM rel""",
    ),
)
def q_released_money(spark, sf_dir):
    return _released(spark, sf_dir)


@query(
    "money_release_status",
    with_views(
        extra=RELEASES,
        body="""SELECT year::BIGINT AS year, CASE WHEN count(available_at) = 0 THEN 'needs_human_input' WHEN count(available_at) < count(*) THEN 'partial' ELSE 'available' END AS status,
            count(available_at) AS usable, coalesce(string_agg(period, ',' ORDER BY period) FILTER (available_at IS NULL), '') AS waiting_periods FROM rel GROUP BY year""",
    ),
)
def q_release_status(spark, sf_dir):
    rows = _released(spark, sf_dir).withColumn("year", F.substring("period", 1, 4).cast("bigint"))
    return ld.release_status(rows, ["year"])


@query(
    "landed_sessions",
    """WITH x AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), k AS (SELECT day, dayofyear(day) % 6 AS k FROM x)
        SELECT day::VARCHAR AS trade_date, CASE k WHEN 0 THEN 'no_trading' WHEN 1 THEN 'holiday' WHEN 2 THEN 'special' WHEN 3 THEN 'trading' WHEN 4 THEN 'holiday' END AS session_status,
            CASE k WHEN 0 THEN '市場無交易' WHEN 1 THEN '依規定放假一日' WHEN 2 THEN '最後交易日' WHEN 3 THEN '開始交易日' WHEN 4 THEN '例假日' ELSE '其他' END AS note,
            CASE WHEN k = 5 THEN 'session_meaning_missing' END AS reason FROM k""",
)
def q_landed_sessions(spark, sf_dir):
    cal = d.calendar(spark, sf_dir)
    k = F.dayofyear("date") % 6
    note = (
        F.when(k == 0, "市場無交易").when(k == 1, "依規定放假一日").when(k == 2, "最後交易日")
        .when(k == 3, "開始交易日").when(k == 4, "例假日").otherwise("其他")
    )
    compact = F.concat(F.lpad((F.year("date") - 1911).cast("string"), 3, "0"), F.date_format("date", "MMdd"))
    text = F.to_json(F.struct(F.when(k % 2 == 0, note).otherwise("").alias("Name"), compact.alias("Date"), F.lit("一").alias("Weekday"), F.when(k % 2 == 1, note).otherwise("").alias("Description")))
    return ld.sessions(cal.select(F.from_json(text, ld.SESSIONS).alias("o")).select("o.*"))


@query(
    "landed_fundamentals",
    f"""SELECT 'S' || l_suppkey AS stock_id, l_shipdate::DATE::VARCHAR AS period_end,
        CASE WHEN l_linenumber % 3 = 0 THEN l_shipdate::DATE::VARCHAR ELSE (l_shipdate::DATE + 40)::VARCHAR END AS origin_date,
        {cents('l_extendedprice')}::DOUBLE / 1e2 AS value FROM lineitem WHERE l_linenumber % 2 = 1""",
)
def q_landed_fundamentals(spark, sf_dir):
    li = d.table(spark, sf_dir, "lineitem")
    day = F.col("l_shipdate").cast("date")
    origin = F.when(F.col("l_linenumber") % 3 != 0, F.date_format(F.date_add(day, 40), "yyyy-MM-dd"))
    rows = li.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("stock_id"),
        F.date_format(day, "yyyy-MM-dd").alias("date"),
        origin.alias("origin_date"),
        F.when(F.col("l_linenumber") % 2 == 1, F.when(F.col("l_linenumber") == 1, "EPS").otherwise("BasicEarningsPerShare")).otherwise("Revenue").alias("type"),
        (d.cents("l_extendedprice").cast("double") / 100.0).alias("value"),
    )
    return ld.statements(rows)


@query(
    "landed_per_rows",
    with_views(
        "valuations",
        body="""SELECT symbol, metric_date::VARCHAR AS metric_date, round(pe, 2) AS pe, round(pb, 2) AS pb,
            round(dividend_yield_ratio * 1e2, 2) / 1e2 AS dividend_yield_ratio, NULL::VARCHAR AS reason FROM valuations""",
    ),
)
def q_landed_per(spark, sf_dir):
    v = d.valuations(spark, sf_dir)

    def text(c):
        return F.coalesce(F.round(c, 2).cast("string"), F.lit("-"))

    rows = v.select(
        F.col("symbol").alias("stock_id"),
        F.date_format("metric_date", "yyyy-MM-dd").alias("date"),
        text(F.col("pe")).alias("PER"),
        text(F.col("pb")).alias("PBR"),
        text(F.col("dividend_yield_ratio") * 100.0).alias("dividend_yield"),
    )
    return ld.per_rows(rows, "percent")


# ---------------------------------------------------------------- scans and merges


@query(
    "panel_scan",
    with_views("bars", body="""SELECT symbol, date::VARCHAR AS date, close FROM bars WHERE symbol IN ('S1', 'S5', 'S7') AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"""),
)
def q_scan(spark, sf_dir):
    out = pn.panel_scan(d.bars(spark, sf_dir), ("S1", "S5", "S7"), "1997-01-01", "1998-12-31")
    return out.select("symbol", "date", "close")


@query(
    "coerce_panel",
    with_views(
        "numbered",
        body="""SELECT symbol || '.TW' AS symbol, date::VARCHAR AS date, open, high, low, CASE WHEN n % 10 <> 0 THEN close END AS close, volume FROM numbered""",
    ),
)
def q_coerce(spark, sf_dir):
    b = d.bars(spark, sf_dir)
    landed = b.select(
        F.lower("symbol").alias("symbol"),
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low")],
        F.when(d.day_number() % 10 == 0, "halted").otherwise(F.col("close").cast("string")).alias("close"),
        F.col("volume").cast("string").alias("volume"),
    )
    return pn.coerce_panel(landed)


@query(
    "snapshot_violations",
    with_views(
        "raw_bars",
        extra={
            "v": """SELECT symbol, date, ingest_order, concat_ws(',', CASE WHEN close IS NULL THEN 'price_not_positive' END,
                CASE WHEN close IS NOT NULL AND (high + greatest(open, high, low, close) * 1e-10 < greatest(open, close, low)
                    OR low - greatest(open, high, low, close) * 1e-10 > least(open, close, high)) THEN 'high_low_inconsistent' END,
                CASE WHEN lag(date) OVER (PARTITION BY symbol ORDER BY date, ingest_order) >= date THEN 'date_not_increasing' END) AS reasons FROM raw_bars""",
        },
        body="SELECT symbol, date::VARCHAR AS date, reasons FROM v WHERE reasons <> ''",
    ),
)
def q_violations(spark, sf_dir):
    line = F.struct("date", "ingest_order")
    return pn.snapshot_violations(d.raw_bars(spark, sf_dir).withColumn("_line", line)).select("symbol", "date", "reasons")


@query(
    "reference_calendar",
    with_views("bars", body="SELECT date::VARCHAR AS date FROM bars WHERE symbol = 'S0' AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"),
)
def q_ref_calendar(spark, sf_dir):
    return pn.reference_calendar(d.bars(spark, sf_dir), "S0", "1996-01-01", "1999-12-31")


UPSERT_SQL = """WITH o AS (SELECT o_custkey AS k, year(o_orderdate) AS y, o_orderdate AS f, o_orderkey AS v, (o_orderstatus = 'F')::INT AS nw FROM orders),
        r AS (SELECT *, row_number() OVER (PARTITION BY k, y ORDER BY f DESC, v DESC, nw DESC) AS rn FROM o)
        SELECT k, y::BIGINT AS y, v FROM r WHERE rn = 1"""


@query("keyed_upsert", UPSERT_SQL)
def q_upsert(spark, sf_dir):
    old, new = _upsert_sides(spark, sf_dir)
    return sk.keyed_upsert(old, new, ["k", "y"], ["fetched_at", "v"]).select("k", "y", "v")


def _upsert_sides(spark, sf_dir):
    o = d.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"), F.col("o_orderdate").alias("fetched_at"), F.col("o_orderkey").alias("v"), "o_orderstatus"
    )
    return o.where("o_orderstatus <> 'F'").drop("o_orderstatus"), o.where("o_orderstatus = 'F'").drop("o_orderstatus")


@query("keyed_upsert_sink", UPSERT_SQL)
def q_upsert_sink(spark, sf_dir):
    """The same merge into a stored table cut by hash of its keys."""
    path = work_dir(spark, "upsert")
    old, new = _upsert_sides(spark, sf_dir)
    for rows in (old, new):
        sk.upsert_into(path, rows, ["k", "y"], ["fetched_at", "v"], parts=8)
    return sk.stored_rows(spark, path).select("k", "y", "v")


RANGE_SQL = with_views(
    "bars",
    body="""SELECT symbol, date::VARCHAR AS date, close FROM bars WHERE NOT (substr(symbol, 2)::INT % 2 = 0 AND date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31')
            UNION ALL SELECT symbol, date::VARCHAR, close + 1 FROM bars WHERE substr(symbol, 2)::INT % 2 = 0 AND date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND day(date) <> 1""",
)


@query("range_replace", RANGE_SQL)
def q_replace(spark, sf_dir):
    return sk.range_replace(*_range_sides(spark, sf_dir))


@query("range_replace_sink", RANGE_SQL)
def q_replace_sink(spark, sf_dir):
    """The same replacement in a stored table cut by month."""
    path = work_dir(spark, "ranges")
    old, new, ranges = _range_sides(spark, sf_dir)
    sk.replace_parts(old.withColumn("part", sk.month_of(F.col("date"))), path, [])
    sk.replace_ranges_in(path, new, ranges)
    return sk.stored_rows(spark, path)


def _range_sides(spark, sf_dir):
    b = d.bars(spark, sf_dir).select("symbol", "date", "close")
    new = b.where(F.dayofmonth("date") != 1).withColumn("close", F.col("close") + 1)
    k = F.col("s_suppkey")
    ranges = d.table(spark, sf_dir, "supplier").where(k % 2 == 0).select(
        F.concat(F.lit("S"), k.cast("string")).alias("symbol"),
        F.lit("1997-01-01").cast("date").alias("start"),
        F.lit("1997-12-31").cast("date").alias("end"),
    )
    return b, new, ranges


APPEND = """SELECT l_orderkey || '-' || l_linenumber AS idempotency_key, sha256(l_partkey || '-' || l_suppkey) AS fingerprint,
    l_returnflag FROM lineitem"""


@query(
    "append_decision",
    with_views(
        extra={
            "x": APPEND,
            "old": "SELECT DISTINCT idempotency_key, fingerprint FROM x WHERE l_returnflag = 'R'",
            "inc": "SELECT DISTINCT idempotency_key, fingerprint FROM x WHERE l_returnflag <> 'R'",
            "ok": "SELECT idempotency_key, min(fingerprint) AS o FROM old GROUP BY 1",
            "fi": "SELECT idempotency_key, min(fingerprint) AS f FROM inc GROUP BY 1",
            "ld": """SELECT fingerprint, min(idempotency_key) AS lead FROM inc LEFT JOIN ok USING (idempotency_key) JOIN fi USING (idempotency_key)
                WHERE f = fingerprint AND coalesce(o = fingerprint, true) GROUP BY 1""",
        },
        body="""SELECT i.idempotency_key, i.fingerprint, CASE WHEN i.fingerprint IN (SELECT fingerprint FROM old) THEN 'unchanged'
            WHEN o <> i.fingerprint THEN 'conflict' WHEN f <> i.fingerprint THEN 'conflict' WHEN lead <> i.idempotency_key THEN 'unchanged' ELSE 'append' END AS decision
            FROM inc i LEFT JOIN ok USING (idempotency_key) LEFT JOIN fi USING (idempotency_key) LEFT JOIN ld ON ld.fingerprint = i.fingerprint""",
    ),
)
def q_append(spark, sf_dir):
    li = d.table(spark, sf_dir, "lineitem")
    parts = [F.col(c).cast("bigint").cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    x = li.select(
        F.concat_ws("-", *parts[:2]).alias("idempotency_key"),
        fingerprint(F.concat_ws("-", *parts[2:])).alias("fingerprint"),
        "l_returnflag",
    )
    old = x.where("l_returnflag = 'R'").drop("l_returnflag")
    return sk.append_decision(old, x.where("l_returnflag <> 'R'").drop("l_returnflag"))


# ---------------------------------------------------------------- streams

STREAM_RULES = {
    "value_not_positive": lambda: F.col("value") <= 1.0,
    "kind_unknown": lambda: F.col("event_type") == "signup",
}


@query(
    "stream_ledger_append",
    """SELECT event_id, event_type, value, 'append' AS outcome, '' AS reasons FROM events WHERE value > 1 AND event_type <> 'signup'
        UNION ALL SELECT event_id, event_type, value, 'reject', concat_ws(',', CASE WHEN value <= 1 THEN 'value_not_positive' END,
            CASE WHEN event_type = 'signup' THEN 'kind_unknown' END) FROM events WHERE value <= 1 OR event_type = 'signup'""",
)
def q_stream_append(spark, sf_dir):
    """Lands the whole events table in two deliveries, the second with late copies of the first, and reads both targets."""
    base = work_dir(spark, "ledger-append")
    text = canonical_json({"id": F.col("event_id").cast("string"), "type": F.col("event_type")})
    events = d.table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        "value",
        F.col("ts").cast("timestamp").alias("ingested_at"),
        fingerprint(text).alias("fingerprint"),
        F.col("event_id").cast("string").alias("idempotency_key"),
    )
    first = F.col("event_id") % 2 == 0
    copies = events.where(first & (F.col("event_id") % 3 == 0))
    rules = {name: rule() for name, rule in STREAM_RULES.items()}
    # Copies within a delivery meet in the stream's state, those of the third delivery, past its time, in the ledger.
    for part, delay in ((events.where(first), "1 day"), (events.where(~first).unionByName(copies), "1 day"), (copies, None)):
        part.write.mode("append").parquet(f"{base}/landed")
        rows = st.file_stream(spark, f"{base}/landed", events.schema)
        checkpoint = f"{base}/checkpoint" if delay else f"{base}/checkpoint-again"
        st.ledger_append(rows, rules, f"{base}/ledger", f"{base}/rejects", checkpoint, delay, parts=8).awaitTermination()
    cols = ["event_id", "event_type", "value"]
    none = F.array().cast("array<string>")
    good = spark.read.parquet(f"{base}/ledger").select(*cols, F.lit("append").alias("outcome"), none.alias("reasons"))
    bad = spark.read.parquet(f"{base}/rejects").select(*cols, F.lit("reject").alias("outcome"), "reasons")
    return good.unionByName(bad)


@query(
    "stream_turnover_pairing",
    with_views(
        "turnover_markets",
        extra={
            "p": """SELECT trade_date, max(value) FILTER (market = 'A') AS a, max(value) FILTER (market = 'B') AS b FROM turnover_markets GROUP BY 1""",
            "q": "SELECT *, a IS NOT NULL AND day(trade_date) % 5 = 0 AS mended FROM p",
        },
        body="""SELECT trade_date::VARCHAR AS trade_date, a AS market_a, NULL::DOUBLE AS market_b, NULL::DOUBLE AS total, 'partial' AS status, 1::BIGINT AS revision FROM q WHERE a IS NOT NULL
            UNION ALL SELECT trade_date::VARCHAR, a, b, a + b, CASE WHEN a IS NULL THEN 'partial' ELSE 'available' END, (CASE WHEN a IS NULL THEN 1 ELSE 2 END)::BIGINT FROM q WHERE b IS NOT NULL
            UNION ALL SELECT trade_date::VARCHAR, a - 1, b, a - 1 + b, CASE WHEN b IS NULL THEN 'partial' ELSE 'available' END, (CASE WHEN b IS NULL THEN 2 ELSE 3 END)::BIGINT FROM q WHERE mended""",
    ),
)
def q_stream_turnover(spark, sf_dir):
    """Market A lands first, market B second, then repeats of both and corrections of A; each change is a revision of the day."""
    base = work_dir(spark, "turnover")
    rows = d.turnover_markets(spark, sf_dir)
    mended = rows.where((F.col("market") == "A") & (F.dayofmonth("trade_date") % 5 == 0)).withColumn("value", F.col("value") - 1.0)
    for part in (rows.where("market = 'A'"), rows.where("market = 'B'"), rows.join(mended.select("trade_date"), "trade_date", "left_anti").unionByName(mended)):
        part.write.mode("append").parquet(f"{base}/landed")
        st.turnover_pairing(st.file_stream(spark, f"{base}/landed", rows.schema), f"{base}/ledger", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/ledger")


@query(
    "stream_evidence_gate",
    with_views(
        "m1b",
        body="""SELECT period, revision::BIGINT AS revision, value_twd, status, CASE WHEN revision % 3 <> 0 THEN 'ledger' ELSE 'candidate' END AS target FROM m1b
            UNION ALL SELECT period, revision::BIGINT, value_twd + 1, status, 'clash' FROM m1b WHERE revision = 2""",
    ),
)
def q_stream_evidence(spark, sf_dir):
    """Evidence comes after some rows and before others; released rows leave the candidates, clashing ones go aside."""
    base = work_dir(spark, "evidence")
    rows = d.m1b(spark, sf_dir).select("period", "revision", "value_twd", "status")
    proof = rows.select("period", "revision", F.when(F.col("revision") % 3 == 0, "pending").otherwise("accepted").alias("status"))
    clash = rows.where("revision = 2").withColumn("value_twd", F.col("value_twd") + 1)
    landings = (
        (rows.where("revision <= 3"), proof.limit(0)),
        (clash, proof),
        (rows.where("revision > 3").unionByName(rows.where("revision = 1")), proof.where("revision = 3")),
    )
    for arrived, proven in landings:
        arrived.write.mode("append").parquet(f"{base}/rows")
        proven.write.mode("append").parquet(f"{base}/proof")
        stream, evidence = (st.file_stream(spark, f"{base}/{name}", df.schema) for name, df in (("rows", rows), ("proof", proof)))
        st.evidence_gate(stream, evidence, f"{base}/ledger", f"{base}/candidates", f"{base}/clashes", f"{base}/checkpoint", parts=8).awaitTermination()
    names = rows.columns
    done = spark.read.parquet(f"{base}/ledger").select(*names, F.lit("ledger").alias("target"))
    waiting = sk.stored_rows(spark, f"{base}/candidates").select(*names, F.lit("candidate").alias("target"))
    odd = spark.read.parquet(f"{base}/clashes").select(*names, F.lit("clash").alias("target"))
    return done.unionByName(waiting).unionByName(odd)
