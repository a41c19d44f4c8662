"""Times the headline queries, one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select
the data and the cores.  Each query is run once to a no-op sink after a short
warm-up; the value is the sum of seconds.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.plans import catalog  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = (
    "sma_deduction",
    "resonance_latest",
    "confirmed_pivots",
    "realtime_wave_targets",
    "clean_panel",
    "data_quality_profile",
    "gap_classification",
    "factor_consensus",
    "reconciled_panel",
    "walk_forward_windows",
    "risk_metrics",
    "regime_aggregate",
    "profile_selection",
    "pullback_tranches",
    "latest_revision_asof",
    "latest_revision_many_cutoffs",
    "eps_pe_matrix",
    "liquidity_alert",
    "liquidity_latest",
    "universe_gate",
    "reconcile_status",
    "sma_adjusted_prices",
    "metric_percentile",
    "ttm_sum",
    "overlap_clusters",
    "stage_sequence",
    "scenario_outcomes",
    "dependency_diff",
    "dependency_freshness",
    "provider_health",
    "append_decision",
    "stream_ledger_append",
    "stream_turnover_pairing",
    "stream_evidence_gate",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["bar_deltas"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        spark.catalog.clearCache()
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
