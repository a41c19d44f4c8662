"""The same domain views as SQL common table expressions for the check engine."""

from __future__ import annotations

_CENTS = "round({c} * 100)::BIGINT"


def cents(c: str) -> str:
    return _CENTS.format(c=c)


def half_up(expr: str, digits: int) -> str:
    return f"round(({expr})::DECIMAL(38,10), {digits})::DOUBLE"


def exact(expr: str, scale: int = 8, whole: int = 14) -> str:
    return f"({expr})::DECIMAL({whole + scale},{scale})"


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "bars": (
        (),
        f"""
        SELECT 'S' || l_suppkey AS symbol, date,
               coalesce((2 * sum(CASE WHEN early THEN c * q END) + sum(CASE WHEN early THEN q END))
                            // (2 * sum(CASE WHEN early THEN q END)),
                        (2 * sum(c * q) + sum(q)) // (2 * sum(q)))::DOUBLE AS open,
               max(c)::DOUBLE AS high, min(c)::DOUBLE AS low,
               ((2 * sum(c * q) + sum(q)) // (2 * sum(q)))::DOUBLE AS close, sum(q)::DOUBLE AS volume
        FROM (SELECT l_suppkey, l_shipdate::DATE AS date, l_linenumber % 2 = 1 AS early,
                     {cents('l_extendedprice')} % 6000 + 45000 AS c, l_quantity::BIGINT AS q FROM lineitem)
        GROUP BY l_suppkey, date""",
    ),
    "numbered": (
        ("bars",),
        """SELECT *, date_diff('day', DATE '1995-01-01', date) AS n, substr(symbol, 2)::BIGINT AS k FROM bars""",
    ),
    "raw_bars": (
        ("numbered",),
        """
        SELECT symbol, date, io AS ingest_order, open,
               CASE WHEN (n + k) % 101 = 0 THEN low * 5e-1 ELSE high END AS high, low,
               CASE WHEN (n + k) % 89 = 0 THEN NULL WHEN (n + k) % 103 = 0 THEN close * 2e0 WHEN io = 2 THEN close + 1e0 ELSE close END AS close,
               CASE WHEN n % 97 = 0 THEN 0e0 ELSE volume END AS volume
        FROM (SELECT *, unnest(CASE WHEN n % 113 = 0 THEN [1, 2] ELSE [1] END) AS io FROM numbered)""",
    ),
    "clean": (
        ("raw_bars",),
        """
        SELECT symbol, date, open, high, low, close, volume FROM (
            SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY ingest_order DESC) AS rn
            FROM raw_bars
            WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL
              AND volume IS NOT NULL AND least(open, high, low, close) > 0 AND high >= low AND volume > 0)
        WHERE rn = 1""",
    ),
    "bench": (
        (),
        f"""
        SELECT date,
               coalesce((2 * sum(CASE WHEN early THEN c * q END) + sum(CASE WHEN early THEN q END))
                            // (2 * sum(CASE WHEN early THEN q END)),
                        (2 * sum(c * q) + sum(q)) // (2 * sum(q)))::DOUBLE AS open,
               ((2 * sum(c * q) + sum(q)) // (2 * sum(q)))::DOUBLE AS close
        FROM (SELECT l_shipdate::DATE AS date, l_linenumber % 2 = 1 AS early,
                     {cents('l_extendedprice')} % 6000 + 45000 AS c, l_quantity::BIGINT AS q FROM lineitem)
        GROUP BY date""",
    ),
    "calendar": ((), "SELECT DISTINCT o_orderdate::DATE AS date FROM orders"),
    "official": (
        ("numbered",),
        """
        SELECT symbol, date, CASE WHEN n % 29 = 0 THEN NULL ELSE open END AS open, high, low, close,
               CASE WHEN n % 23 = 0 THEN 0e0 ELSE volume END AS volume FROM numbered""",
    ),
    "provider": (
        ("numbered",),
        """
        SELECT symbol, date, open * f AS open, high * f AS high, low * f AS low, close * f AS close, volume
        FROM (SELECT *, (CASE WHEN date < DATE '1998-01-05' THEN 9e-1 ELSE 1e0 END)
                      * (CASE WHEN month(date) % 5 = 0 AND day(date) % 2 = 1 THEN 1.001e0 ELSE 1e0 END) AS f
              FROM numbered WHERE n % 17 <> 0 AND n % 23 <> 0 AND n % 29 <> 0)""",
    ),
    "actions": (
        (),
        """
        SELECT 'S' || s_suppkey AS symbol, DATE '1998-01-05' AS event_date,
               unnest(CASE WHEN s_suppkey % 3 = 0 THEN ['ex_dividend', 'ex_right'] ELSE ['ex_dividend'] END) AS event_type
        FROM supplier""",
    ),
    "turnover_markets": (
        (),
        f"""
        SELECT o_orderdate::DATE AS trade_date, CASE WHEN o_orderstatus = 'O' THEN 'A' ELSE 'B' END AS market,
               sum({cents('o_totalprice')})::DOUBLE / 1e2 AS value
        FROM orders GROUP BY 1, 2""",
    ),
    "m1b": (
        (),
        f"""
        SELECT strftime(month, '%Y-%m') AS period, revision, value_twd,
               (last_day(month) + revision * 5)::TIMESTAMP AS available_at,
               (last_day(month) + revision * 5 + 1)::TIMESTAMP AS ingested_at,
               CASE WHEN ((year(month) * 12 + month(month)) * 7 + revision) % 11 = 0
                    THEN 'revoked' ELSE 'available' END AS status
        FROM (SELECT date_trunc('month', o_orderdate)::DATE AS month, substr(o_orderpriority, 1, 1)::INT AS revision,
                     sum({cents('o_totalprice')})::DOUBLE * 3e0 / 1e2 AS value_twd FROM orders GROUP BY 1, 2)""",
    ),
    "eps": (
        (),
        f"""
        SELECT o_orderkey AS id, o_custkey || '-' || year(o_orderdate) || '-' || (o_orderkey % 2) AS logical_id,
               month(o_orderdate) AS revision_number, 'C' || o_custkey AS symbol, year(o_orderdate) AS fiscal_year,
               {cents('o_totalprice')}::DOUBLE / 1e6 * 9e-1 AS eps_low, {cents('o_totalprice')}::DOUBLE / 1e6 AS eps_base,
               {cents('o_totalprice')}::DOUBLE / 1e6 * 1.1e0 AS eps_high, 'SRC' || (o_custkey % 3) AS source_name,
               o_orderdate::DATE::TIMESTAMP AS available_at,
               (o_orderdate::DATE + (o_orderkey % 5)::INT)::TIMESTAMP AS ingested_at,
               CASE WHEN o_orderstatus = 'P' THEN 'revoked' ELSE 'active' END AS status FROM orders""",
    ),
    "approvals": (
        (),
        f"""
        SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::BIGINT
                   || '-' || {cents('l_extendedprice')} AS approval_event_id,
               l_orderkey AS resource_id,
               CASE WHEN l_returnflag = 'R' THEN 'revoked' ELSE 'approved' END AS decision,
               CASE WHEN {cents('l_tax')} = 0 THEN 'VAL-09' ELSE 'VAL-02' END AS rule_id,
               CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'C' END AS evidence_level,
               l_linenumber % 2 AS project_operationalization,
               l_shipdate::DATE::TIMESTAMP AS available_at,
               (l_shipdate::DATE + (l_partkey % 3)::INT)::TIMESTAMP AS ingested_at FROM lineitem""",
    ),
    "symbols": (
        (),
        """
        SELECT 'C' || c_custkey AS symbol, c_mktsegment AS industry, r_name AS market
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "pe": (
        (),
        """
        SELECT 'PE-' || c_custkey || '-' || k AS pe_id, CASE WHEN k = 0 THEN 'base' ELSE 'bull' END AS label,
               'symbol' AS scope, 'C' || c_custkey AS scope_value, (c_custkey % 16 + 10 + k * 4)::DOUBLE AS pe_value,
               s::TIMESTAMP AS effective_from,
               CASE WHEN c_custkey % 5 <> 0 THEN (s + 1200)::TIMESTAMP END AS effective_to
        FROM (SELECT c_custkey, unnest([0, 1]) AS k, DATE '1995-01-01' + (c_custkey % 1500)::INT AS s FROM customer)
        UNION ALL
        SELECT 'PE-I-' || c_mktsegment, 'base', 'industry', c_mktsegment, (count(*) % 10 + 12)::DOUBLE,
               TIMESTAMP '1995-01-01', NULL FROM customer GROUP BY c_mktsegment
        UNION ALL
        SELECT 'PE-M-' || r_name, 'base', 'market', r_name, (r_regionkey + 15)::DOUBLE,
               TIMESTAMP '1995-01-01', NULL FROM region""",
    ),
    "valuations": (
        (),
        f"""
        SELECT 'S' || l_suppkey AS symbol, d AS metric_date,
               CASE WHEN date_diff('day', DATE '1995-01-01', d) % 61 <> 0
                    THEN sum(c)::DOUBLE / sum(q)::DOUBLE / 1e4 END AS pe,
               sum(t)::DOUBLE / count(*)::DOUBLE / 2e0 AS pb,
               sum(ds)::DOUBLE / count(*)::DOUBLE / 1e2 AS dividend_yield_ratio
        FROM (SELECT l_suppkey, l_shipdate::DATE AS d, {cents('l_extendedprice')} AS c, l_quantity::BIGINT AS q,
                     {cents('l_tax')} AS t, {cents('l_discount')} AS ds FROM lineitem)
        GROUP BY l_suppkey, d""",
    ),
    "candidates": (
        (),
        """
        SELECT DISTINCT 'O' || l_orderkey AS symbol,
               l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::BIGINT AS candidate_id,
               CASE l_linenumber % 3 WHEN 0 THEN 'VAL-01' WHEN 1 THEN 'FB-03' ELSE 'FB-04' END AS method_family,
               CASE WHEN l_linenumber % 3 = 2 THEN 'support' ELSE 'target' END AS semantic_role,
               ((l_partkey % 1000 + 9000)::DOUBLE / 1e1)::DECIMAL(18,4) AS price,
               CASE WHEN l_partkey % 11 = 0 THEN 'U' ELSE 'A' END AS evidence_level,
               ['D' || (l_suppkey % 7), 'E' || (l_partkey % 5)] AS dependency_keys
        FROM lineitem""",
    ),
    "dense": (
        (),
        f"""
        SELECT symbol, date,
               coalesce((2 * sum(CASE WHEN early THEN c * q END) + sum(CASE WHEN early THEN q END))
                            // (2 * sum(CASE WHEN early THEN q END)),
                        (2 * sum(c * q) + sum(q)) // (2 * sum(q)))::DOUBLE AS open,
               max(c)::DOUBLE AS high, min(c)::DOUBLE AS low,
               ((2 * sum(c * q) + sum(q)) // (2 * sum(q)))::DOUBLE AS close
        FROM (SELECT l_returnflag || l_linestatus AS symbol, l_shipdate::DATE AS date, l_linenumber % 2 = 1 AS early,
                     {cents('l_extendedprice')} % 6000 + 45000 AS c, l_quantity::BIGINT AS q FROM lineitem)
        GROUP BY symbol, date""",
    ),
    "subjects": (
        (),
        f"""
        SELECT 'SNAP' || (o_orderkey - o_orderkey % 4) AS snapshot_id, 'SUB' || o_orderkey AS subject_id,
               ['AF', 'AO', 'NF', 'NO', 'RF', 'RO'][(o_orderkey // 4) % 6 + 1] AS symbol,
               CASE WHEN o_orderkey % 3 = 0 THEN 'live_refresh' ELSE 'historical_reconstruction' END AS capture_mode,
               CASE o_orderkey % 4 WHEN 2 THEN 'support_candidate' WHEN 3 THEN 'target_cluster' ELSE 'target_candidate' END AS subject_type,
               ['VAL-01', 'FB-03', 'FB-04', 'TGT-01'][o_orderkey % 4 + 1] AS method_family,
               CASE WHEN o_orderkey % 4 = 2 THEN 'support' ELSE 'target' END AS semantic_role,
               CASE WHEN o_orderkey % 8 = 3 THEN 'low' WHEN o_orderkey % 4 = 3 THEN 'moderate' END AS evidence_strength,
               o_orderdate::DATE AS cutoff_date,
               ({cents('o_totalprice')} % 9000 + 43500)::DOUBLE AS price_low,
               ({cents('o_totalprice')} % 9000 + 44100)::DOUBLE AS price_high FROM orders""",
    ),
    "campaign_events": (
        (),
        """
        SELECT event_id, user_id AS campaign_id, date_trunc('minute', ts) AS signal_at,
               CASE WHEN event_type = 'error' THEN 'invalidation' ELSE 'entry' END AS event_kind,
               CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS stage
        FROM events""",
    ),
    "rules": (
        (),
        """
        SELECT 'R' || p_partkey AS rule_id, (['A', 'B', 'C', 'U'])[p_size % 4 + 1] AS evidence_level,
               CASE WHEN p_partkey % 11 = 0 THEN 'unsupported' WHEN p_partkey % 13 = 0 THEN 'legacy_experimental'
                    WHEN p_partkey % 2 = 0 THEN 'verified_core' ELSE 'parameterized_support' END AS implementation_mode,
               p_partkey % 3 = 0 AS human_approval_required, p_partkey % 5 = 0 AS project_operationalization,
               CASE WHEN p_partkey % 7 = 0 THEN ['price_scenario'] ELSE ['trend_confirmation', 'price_scenario'] END AS allowed_outputs,
               CASE WHEN p_partkey % 17 = 0 THEN ['automatic_order', 'trend_confirmation'] ELSE ['automatic_order'] END AS forbidden_uses,
               '1.' || p_size % 3 AS rule_version FROM part""",
    ),
    "hourly": (
        (),
        """
        SELECT date_trunc('hour', ts) AS bar_at, arg_min(value, ts) AS open, max(value) AS high,
               min(value) AS low, arg_max(value, ts) AS close FROM events GROUP BY 1""",
    ),
    "run_items": (
        (),
        """
        SELECT event_id AS item_id, event_type AS provider_id, event_type || '.' || user_id AS resource_id,
               ts AS started_at, ts + to_minutes(k) AS completed_at, k,
               CASE WHEN k < 5 THEN 'provider_error' WHEN k < 12 THEN 'partial'
                    WHEN k < 16 THEN 'awaiting_review' ELSE 'accepted' END AS status
        FROM (SELECT *, regexp_extract(props, '"k": (\\d+)', 1)::INT AS k FROM events)""",
    ),
}


def with_views(*names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """SQL text: the named views in dependency order, extra CTEs, then the body."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        needs, text = CTES[name]
        for need in needs:
            add(need)
        done[name] = text

    for name in names:
        add(name)
    done.update(extra or {})
    parts = ",\n".join(f"{name} AS ({text})" for name, text in done.items())
    return f"WITH {parts}\n{body}" if parts else body


ASKED = "SELECT DISTINCT 'S' || s_suppkey AS symbol FROM supplier"

CUTOFF = "TIMESTAMP '1999-06-30'"
LATER_CUTOFF = "TIMESTAMP '2000-12-31'"
