"""KPIs and rates recomputed on the log after the ordered deletes.

The registered KPIs run on the de-duplicated log (FIXTURES.md §3); in the
original script order the descriptive analyses ran after the cleaning
deletes.  These variants run the same analysis on ``Tables.after_cleaning()``;
their oracles run the same SQL with the event views re-bound to the output
of the delete chain.
"""

from __future__ import annotations

from .catalog_cleaning import chain_sql
from .registry import ANALYSES, RAW_ORACLES, analysis

BASES = [
    "kpi_view_completion_rate",
    "kpi_expired_pct",
    "kpi_expired_pct_simple",
    "kpi_avg_completion_hours",
    "kpi_multi_offer_completers",
    "biv_rate_by_offer_type",
]


def _rebound(query: str) -> str:
    """``query`` with ev and the four event views taken from the chain output."""
    chain = chain_sql().strip()
    assert chain.upper().startswith("WITH ")
    chain_ctes = chain[5:chain.rindex("SELECT * FROM ev4")].rstrip().rstrip(",")
    views = """ev AS (SELECT * FROM ev4),
offer_received AS (SELECT person, offer_id, event, time FROM ev WHERE event = 'offer received'),
offer_viewed AS (SELECT person, offer_id, event, time FROM ev WHERE event = 'offer viewed'),
transaction_done AS (SELECT person, event, amount, time FROM ev WHERE event = 'transaction'),
offer_completed AS (SELECT person, offer_id, event, reward, time FROM ev WHERE event = 'offer completed')"""
    q = query.strip()
    inner = ("WITH " + views + ",\n" + q[4:].lstrip()) if q[:4].upper() == "WITH" else ("WITH " + views + "\n" + q)
    return "WITH " + chain_ctes + "\nSELECT * FROM (" + inner + ")"


for _base in BASES:
    analysis(f"{_base}_after_cleaning", _rebound(RAW_ORACLES[_base]))(
        lambda t, _b=_base: ANALYSES[_b](t.after_cleaning()))
