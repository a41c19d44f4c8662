"""Queries on stored analysis documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import documents as dc, snapshots as sn
from tidemark.plans import domain as d
from tidemark.plans.domain_sql import CUTOFF, LATER_CUTOFF, with_views
from tidemark.plans.q_ledger import PE_LEDGER
from tidemark.plans.q_research import CLUST, _clusters, _norm
from tidemark.plans.registry import query

WHOLE = "(CAST(right(candidate_id, 1) AS INT) % 2 = 0)"


def _stored(spark, sf_dir):
    """A document per analysis; every second method has a price in place of a range, misfits have the wrong role."""
    norm, clusters = _norm(spark, sf_dir, dealt=True), _clusters(spark, sf_dir, dealt=True).where("status = 'available'")
    whole = F.expr(WHOLE)
    method = F.struct(
        "candidate_id", "method_family", "semantic_role",
        F.when(whole, F.col("lo")).alias("price_low"), F.when(whole, F.col("hi")).alias("price_high"), F.when(~whole, F.col("lo")).alias("price"),
    )
    misfit = F.struct(
        F.concat("candidate_id", F.lit("?")).alias("candidate_id"), "method_family", F.when(F.col("semantic_role") == "target", "support").otherwise("target").alias("semantic_role"),
        F.col("lo").alias("price_low"), F.col("hi").alias("price_high"), F.lit(None).cast(norm.schema["lo"].dataType).alias("price"),
    )
    methods = norm.groupBy("symbol").agg(F.concat(F.collect_list(method), F.collect_list(misfit)).alias("supporting_methods"))
    ranges = clusters.groupBy("symbol").agg(F.collect_list(F.struct("cluster_id", "price_low", "price_high", "evidence_strength")).alias("overlap_ranges"))
    body = F.struct(F.struct(F.struct("supporting_methods", "overlap_ranges").alias("target_confluence")).alias("output"))
    return methods.join(ranges, "symbol", "left").select("symbol", F.to_json(body).alias("document"))


@query(
    "snapshot_subjects",
    with_views(
        "candidates",
        extra=CLUST,
        body=f"""SELECT symbol, CASE semantic_role WHEN 'support' THEN 'support_candidate' ELSE 'target_candidate' END AS subject_type, candidate_id AS subject_id, method_family, semantic_role,
            lo::DOUBLE AS price_low, CASE WHEN {WHOLE} THEN hi ELSE lo END::DOUBLE AS price_high, NULL::VARCHAR AS evidence_strength FROM norm
            UNION ALL SELECT symbol, 'target_cluster', cluster_id, 'TGT-01', 'target', lo::DOUBLE, hi::DOUBLE, 'low' FROM cl WHERE ni >= 2""",
    ),
)
def q_subjects(spark, sf_dir):
    return dc.scenario_subjects(_stored(spark, sf_dir))


PATHS = list(dc.registered_paths().items())
NUMBERED = ", ".join(f"({i}, '{path}', '{kind}')" for i, (path, kind) in enumerate(PATHS))


def _documents(spark, sf_dir, after: bool):
    """Documents with every registered path: numbers in the liquidity section, texts elsewhere, some null, some absent."""
    k = F.col("o_orderkey")
    sections: dict[str, list] = {}
    for i, (path, _) in enumerate(PATHS):
        section, *parts = path.split(".")
        number = (k * (i + 3)) % 1000 + (F.when(k % (i + 2) == 0, 1).otherwise(0) if after else 0)
        text = number.cast("string") if section == "liquidity" else F.concat(F.lit('"v'), number.cast("string"), F.lit('"'))
        if not after:
            text = F.when((k + i) % 13 == 0, "null").otherwise(text)
        for part in reversed(parts):
            text = F.concat(F.lit(f'"{part}":'), text) if part == parts[0] else F.concat(F.lit(f'{{"{part}":'), text, F.lit("}"))
        sections.setdefault(section, []).append(F.when((k + i) % 17 != 0, text) if after else text)
    bodies = [F.concat(F.lit(f'"{name}":{{'), F.concat_ws(",", *fields), F.lit("}")) for name, fields in sections.items()]
    text = F.concat(F.lit('{"output":{'), F.concat_ws(",", *bodies), F.lit("}}"))
    return d.table(spark, sf_dir, "orders").select(k.alias("pair_id"), text.alias("document"))


@query(
    "document_diff",
    f"""WITH p AS (SELECT * FROM (VALUES {NUMBERED}) AS t(i, field_path, change_type)),
        x AS (SELECT o_orderkey AS pair_id, p.*, split_part(field_path, '.', 1) AS section, (o_orderkey * (i + 3)) % 1000 AS a, (o_orderkey * (i + 3)) % 1000 + (o_orderkey % (i + 2) = 0)::INT AS b,
            (o_orderkey + i) % 13 = 0 AS void, (o_orderkey + i) % 17 = 0 AS gone FROM orders, p),
        y AS (SELECT *, CASE WHEN NOT void THEN CASE section WHEN 'liquidity' THEN '' ELSE 'v' END || a END AS before, CASE WHEN NOT gone THEN CASE section WHEN 'liquidity' THEN '' ELSE 'v' END || b END AS after FROM x)
        SELECT pair_id, change_type, section, NULL::VARCHAR AS resource_type, CASE change_type WHEN 'liquidity_context_changed' THEN 'market_liquidity' WHEN 'screening_result_changed' THEN 'screening_result' ELSE section END AS identity,
            field_path, before, after, CASE WHEN section = 'liquidity' AND field_path NOT IN ('liquidity.trade_date', 'liquidity.alert_level', 'liquidity.status') AND NOT void AND NOT gone THEN (b - a)::VARCHAR END AS absolute_delta
        FROM y WHERE gone OR before IS DISTINCT FROM after""",
)
def q_document_diff(spark, sf_dir):
    return dc.document_diff(_documents(spark, sf_dir, False), _documents(spark, sf_dir, True))


def _section_sql(name: str, source: str, columns: dict[str, str]) -> dict[str, str]:
    fields = ", ".join(f"'{c}': {columns[c]}" for c in sorted(columns))
    return {f"s_{name}": f"SELECT symbol, cutoff, {{{fields}}} AS s FROM {source} GROUP BY symbol, cutoff"}


EPS_COLUMNS = {
    "forward_eps": {"revisions": "count(*)", "newest": "max(revision_number)::BIGINT"},
    "forward_eps_states": {"active": "count(*) FILTER (status = 'active')", "revoked": "count(*) FILTER (status = 'revoked')"},
    "forward_eps_years": {"first": "min(fiscal_year)::BIGINT", "last": "max(fiscal_year)::BIGINT", "years": "count(DISTINCT fiscal_year)"},
    "forward_eps_sources": {"sources": "count(DISTINCT source_name)"},
}
PE_COLUMNS = {
    "pe_scenarios": {"revisions": "count(*)", "newest": "max(revision_number)::BIGINT"},
    "pe_labels": {"base": "count(*) FILTER (label = 'base')", "bull": "count(*) FILTER (label = 'bull')"},
}
EVENT_COLUMNS = {"approved": "count(*) FILTER (decision = 'approved')", "revoked": "count(*) FILTER (decision = 'revoked')"}
SECTIONS = {
    **PE_LEDGER,
    "cuts": f"SELECT unnest([{CUTOFF}, {LATER_CUTOFF}]) AS cut",
    "e_seen": "SELECT eps.*, strftime(cut, '%Y-%m-%d') AS cutoff FROM eps JOIN cuts ON available_at <= cut AND ingested_at <= cut",
    "a_seen": """SELECT eps.symbol, a.decision, strftime(cut, '%Y-%m-%d') AS cutoff FROM approvals a JOIN eps ON eps.id = a.resource_id
        JOIN cuts ON a.available_at <= cut AND a.ingested_at <= cut""",
    "p_seen": """SELECT p.* RENAME (scope_value AS symbol), strftime(cut, '%Y-%m-%d') AS cutoff FROM pe_revisions p JOIN cuts ON available_at <= cut AND ingested_at <= cut WHERE scope = 'symbol'""",
    "q_seen": """SELECT p.scope_value AS symbol, a.decision, strftime(cut, '%Y-%m-%d') AS cutoff FROM pe_approvals a JOIN pe_revisions p ON p.id = a.resource_id
        JOIN cuts ON a.available_at <= cut AND a.ingested_at <= cut WHERE p.scope = 'symbol'""",
}
for _name, _columns in EPS_COLUMNS.items():
    SECTIONS |= _section_sql(_name, "e_seen", _columns)
for _name, _columns in PE_COLUMNS.items():
    SECTIONS |= _section_sql(_name, "p_seen", _columns)
SECTIONS |= _section_sql("forward_eps_approvals", "a_seen", EVENT_COLUMNS) | _section_sql("pe_approvals", "q_seen", EVENT_COLUMNS)
NAMES = sorted([*EPS_COLUMNS, *PE_COLUMNS, "forward_eps_approvals", "pe_approvals"])
SECTIONS["docs"] = (
    "SELECT k.symbol, k.cutoff, to_json({'symbol': k.symbol, 'cutoff': k.cutoff, "
    + ", ".join(f"'{n}': s_{n}.s" for n in NAMES)
    + "})::VARCHAR AS document FROM (SELECT 'C' || c_custkey AS symbol, strftime(cut, '%Y-%m-%d') AS cutoff FROM customer, cuts) k"
    + "".join(f" LEFT JOIN s_{n} ON s_{n}.symbol = k.symbol AND s_{n}.cutoff = k.cutoff" for n in NAMES)
)


@query(
    "analysis_documents",
    with_views("eps", "approvals", "pe", extra=SECTIONS, body="SELECT symbol, cutoff, document, 'analysis_' || substr(sha256(document), 1, 24) AS document_id FROM docs"),
)
def q_analysis_documents(spark, sf_dir):
    """The document of every symbol at two cutoffs, of eight sections over four ledgers."""
    cuts = F.array(*[F.lit(c).cast("timestamp") for c in (d.CUTOFF, d.LATER_CUTOFF)])

    def seen(df):
        """A row once per cutoff that sees it."""
        at = F.explode(F.filter(cuts, lambda c: (c >= F.col("available_at")) & (c >= F.col("ingested_at"))))
        return df.select("*", at.alias("_cut")).withColumn("cutoff", F.date_format("_cut", "yyyy-MM-dd")).drop("_cut")

    eps, pe = d.eps_ledger(spark, sf_dir), d.pe_revisions(spark, sf_dir).where("scope = 'symbol'").withColumnRenamed("scope_value", "symbol")
    key = ["symbol", "cutoff"]
    events = {
        "forward_eps_approvals": seen(d.approvals(spark, sf_dir)).join(eps.select(F.col("id").alias("resource_id"), "symbol"), "resource_id"),
        "pe_approvals": seen(d.pe_approvals(spark, sf_dir)).join(pe.select(F.col("id").alias("resource_id"), "symbol"), "resource_id"),
    }
    n, newest = F.count(F.lit(1)).alias("revisions"), F.max("revision_number").cast("bigint").alias("newest")
    e, p = seen(eps).groupBy(*key), seen(pe).groupBy(*key)
    sections = {
        "forward_eps": e.agg(n, newest),
        "forward_eps_states": e.agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "revoked").alias("revoked")),
        "forward_eps_years": e.agg(F.min("fiscal_year").cast("bigint").alias("first"), F.max("fiscal_year").cast("bigint").alias("last"), F.count_distinct("fiscal_year").alias("years")),
        "forward_eps_sources": e.agg(F.count_distinct("source_name").alias("sources")),
        "pe_scenarios": p.agg(n, newest),
        "pe_labels": p.agg(F.count_if(F.col("label") == "base").alias("base"), F.count_if(F.col("label") == "bull").alias("bull")),
    }
    for name, rows in events.items():
        sections[name] = rows.groupBy(*key).agg(*[F.count_if(F.col("decision") == x).alias(x) for x in ("approved", "revoked")])
    dates = F.explode(F.transform(cuts, lambda c: F.date_format(c, "yyyy-MM-dd"))).alias("cutoff")
    symbols = d.table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"), dates)
    return sn.section_document(symbols, sections, ("symbol", "cutoff"))
