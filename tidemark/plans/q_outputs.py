"""Queries on written results, reject lists, order of deltas and input rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import diff as df_, gaps as gp, validate as va
from tidemark.plans import domain as d
from tidemark.plans.domain_sql import cents, with_views
from tidemark.plans.q_market import TURN, _turnover
from tidemark.plans.q_snapshots import MAPS, _two_maps
from tidemark.plans.registry import query
from tidemark.session import work_dir
from tidemark.sources import landed as ld, sinks as sk


@query(
    "results_sink",
    """SELECT 'status' AS name, run_id, o_orderstatus AS k, count(*) AS n FROM (SELECT *, unnest(['r1', 'r2']) AS run_id FROM orders) GROUP BY ALL
        UNION ALL SELECT 'priority', run_id, o_orderpriority, count(*) FROM (SELECT *, unnest(['r1', 'r2']) AS run_id FROM orders) GROUP BY ALL""",
)
def q_results_sink(spark, sf_dir):
    """Two runs of two result tables, the first written twice; each run is there once."""
    path = work_dir(spark, "results")
    o = d.table(spark, sf_dir, "orders")
    tables = {name: o.groupBy(F.col(c).alias("k")).agg(F.count(F.lit(1)).alias("n")) for name, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"))}
    for run in ("r1", "r1", "r2"):
        sk.write_results(tables, path, run)
    status, priority = (spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("name"), "run_id", "k", "n") for name in tables)
    return status.unionByName(priority)


@query(
    "snapshot_sink",
    with_views(
        "bars",
        "actions",
        body="""SELECT 'panel' AS part, year(date)::BIGINT AS year, symbol, count(*) AS rows, sum(close) AS total FROM bars GROUP BY ALL
            UNION ALL SELECT 'adjustments', NULL, symbol, count(*), NULL FROM actions GROUP BY ALL""",
    ),
)
def q_snapshot_sink(spark, sf_dir):
    """A panel and a ledger written as one snapshot; its year folders prune and hold every row."""
    path = work_dir(spark, "snapshot")
    bars, actions = d.bars(spark, sf_dir), d.actions(spark, sf_dir)
    sk.write_snapshot(bars, {"adjustments": actions}, path)
    panel = spark.read.parquet(f"{path}/panel").groupBy(F.lit("panel").alias("part"), F.col("year").cast("bigint").alias("year"), "symbol")
    ledger = spark.read.parquet(f"{path}/adjustments").groupBy(F.lit("adjustments").alias("part"), F.lit(None).cast("bigint").alias("year"), "symbol")
    n = F.count(F.lit(1)).alias("rows")
    return panel.agg(n, F.sum("close").alias("total")).unionByName(ledger.agg(n, F.lit(None).cast("double").alias("total")))


@query(
    "first_deltas",
    with_views(
        "eps",
        extra={
            **MAPS,
            "dl": """SELECT coalesce(mx.pair_id, my.pair_id) AS pair_id, 'rules' AS section, 'rule_version_reference_changed' AS change_type, coalesce(mx.k, my.k) AS identity,
                mx.v AS before, my.v AS after FROM mx FULL JOIN my ON mx.pair_id = my.pair_id AND mx.k = my.k WHERE mx.v IS DISTINCT FROM my.v""",
        },
        body="SELECT * FROM dl ORDER BY pair_id, section, change_type, identity LIMIT 200",
    ),
)
def q_first_deltas(spark, sf_dir):
    """The first page of all deltas in canonical order."""
    a, b = _two_maps(spark, sf_dir)
    deltas = df_.map_diff(a, b, "used_rule_versions", "rule_version_reference_changed", "rules")
    return df_.delta_order(deltas).select("pair_id", "section", "change_type", "identity", "before", "after").limit(200)


@query(
    "symbol_code",
    """SELECT p_partkey AS id, split_part(p_partkey || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.TW' ELSE '.TWO' END, '.', 1) AS code FROM part""",
)
def q_symbol_code(spark, sf_dir):
    k = F.col("p_partkey")
    suffix = F.when(k % 3 == 0, "").when(k % 3 == 1, ".TW").otherwise(".TWO")
    return d.table(spark, sf_dir, "part").select(k.alias("id"), gp.symbol_code(F.concat(k.cast("string"), suffix)).alias("code"))


@query(
    "envelope_rejects",
    """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate) * 12 + month(o_orderdate) AS k, count(*) AS n FROM orders GROUP BY ALL)
        SELECT month, CASE k % 5 WHEN 0 THEN 'document_unreadable' WHEN 1 THEN 'response_not_ok:no data for ' || n WHEN 2 THEN 'accepted_without_data' ELSE 'response_not_ok:missing' END AS reason
        FROM m WHERE k % 5 <> 4""",
)
def q_envelope_rejects(spark, sf_dir):
    """A landed document per month: broken, refused, without data, without a state, and whole ones, which are no rejects."""
    day = F.col("o_orderdate").cast("date")
    m = d.table(spark, sf_dir, "orders").groupBy(F.date_format(day, "yyyy-MM").alias("month"), (F.year(day) * 12 + F.month(day)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    k = F.col("k") % 5
    text = (
        F.when(k == 0, '{"stat": "OK", "data": [[')
        .when(k == 1, F.concat(F.lit('{"stat": "no data for '), F.col("n").cast("string"), F.lit('"}')))
        .when(k == 2, '{"stat": "OK"}')
        .when(k == 3, '{"data": [["1"]]}')
        .otherwise('{"stat": "OK", "data": [["1"]]}')
    )
    read = F.from_json(text, f"{ld.ENVELOPE}, {ld.CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": ld.CORRUPT})
    return ld.envelope_rejects(m.select("month", read.alias("e")).select("month", "e.*")).select("month", "reason")


@query(
    "money_supply_rejects",
    f"""WITH m AS (SELECT year(o_orderdate) AS y, sum({cents('o_totalprice')})::BIGINT AS s FROM orders GROUP BY 1)
        SELECT y::BIGINT AS year, CASE y % 3 WHEN 0 THEN 'category_missing' ELSE 'no_data' END AS reason FROM m WHERE y % 3 <> 1""",
)
def q_money_supply_rejects(spark, sf_dir):
    """A landed document per year: one in three names no such category, one in three holds no rows."""
    y = F.year("o_orderdate").alias("year")
    m = d.table(spark, sf_dir, "orders").groupBy(y).agg(F.sum(d.cents("o_totalprice")).alias("s"))
    case = F.col("year") % 3
    names = F.array(*[F.struct(F.lit(x).alias("data")) for x in ("M1A", "M1B")])
    named = F.when(case == 0, F.array(F.struct(F.lit("M2").alias("data")))).otherwise(names)
    rows = F.when(case != 2, F.array(F.array(F.concat(F.col("year").cast("string"), F.lit("M01")), F.col("s").cast("string"), F.lit("0"), F.col("s").cast("string"))))
    doc = F.to_json(F.struct(F.struct(rows.alias("dataSets"), F.struct(named.alias("Table1")).alias("structure")).alias("data")))
    documents = m.select("year", F.from_json(doc, ld.MONEY).alias("e")).select("year", "e.*")
    return ld.money_supply_rejects(documents).select("year", "reason")


@query(
    "turnover_validation",
    with_views(
        "turnover_markets",
        extra={
            **TURN,
            "x": """SELECT trade_date, market_a, market_b, status, CASE WHEN day(trade_date) % 7 = 0 THEN coalesce(total, 0) + 1 ELSE total END AS total,
                CASE WHEN day(trade_date) % 11 = 0 THEN 'odd' WHEN day(trade_date) = 13 THEN 'available' ELSE status END AS st FROM turnover""",
        },
        body="""SELECT trade_date::VARCHAR AS trade_date, concat_ws(',', CASE WHEN st = 'available' AND (market_a IS NULL OR market_b IS NULL) THEN 'available_needs_both' END,
            CASE WHEN st = 'partial' AND total IS NOT NULL THEN 'partial_has_total' END, CASE WHEN st = 'available' AND total <> market_a + market_b THEN 'total_mismatch' END,
            CASE WHEN st NOT IN ('available', 'partial', 'revoked') THEN 'status_unknown' END) AS reasons FROM x""",
    ),
)
def q_turnover_validation(spark, sf_dir):
    day = F.dayofmonth("trade_date")
    rows = _turnover(spark, sf_dir).withColumns(
        {
            "total": F.when(day % 7 == 0, F.coalesce("total", F.lit(0.0)) + 1.0).otherwise(F.col("total")),
            "status": F.when(day % 11 == 0, "odd").when(day == 13, "available").otherwise(F.col("status")),
        }
    )
    return va.validate(rows, va.turnover_rules()).select("trade_date", "reasons")


@query(
    "valuation_validation",
    with_views(
        "valuations",
        extra={
            "x": """SELECT symbol, metric_date, CASE WHEN day(metric_date) <> 5 THEN pe END AS pe, CASE WHEN day(metric_date) <> 5 THEN pb END AS pb,
                CASE WHEN day(metric_date) = 5 THEN NULL WHEN day(metric_date) = 6 THEN -dividend_yield_ratio - 1 WHEN day(metric_date) = 7 THEN dividend_yield_ratio + 2
                ELSE dividend_yield_ratio END AS dy FROM valuations""",
        },
        body="""SELECT symbol, metric_date::VARCHAR AS metric_date, CASE WHEN pe IS NULL AND pb IS NULL AND dy IS NULL THEN 'no_metric' WHEN dy < 0 THEN 'yield_negative'
            ELSE 'yield_unit' END AS reasons FROM x WHERE (pe IS NULL AND pb IS NULL AND dy IS NULL) OR dy < 0 OR dy > 1""",
    ),
)
def q_valuation_validation(spark, sf_dir):
    day, dy = F.dayofmonth("metric_date"), F.col("dividend_yield_ratio")
    rows = d.valuations(spark, sf_dir).withColumns(
        {
            "pe": F.when(day != 5, F.col("pe")),
            "pb": F.when(day != 5, F.col("pb")),
            "dividend_yield_ratio": F.when(day == 5, None).when(day == 6, -dy - 1).when(day == 7, dy + 2).otherwise(dy),
        }
    )
    _, refused = va.split_valid(va.validate(rows, va.valuation_rules()))
    return refused.select("symbol", "metric_date", "reasons")
