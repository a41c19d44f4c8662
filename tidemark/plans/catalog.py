"""All registered queries."""

from tidemark.plans import (  # noqa: F401 - imported for registration
    q_documents,
    q_ingest,
    q_ledger,
    q_market,
    q_outputs,
    q_panel,
    q_quality,
    q_requests,
    q_research,
    q_screening,
    q_snapshots,
    q_walkforward,
)
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
